"""Relational graph operators; each is a lazy DataFrame transformation."""
