"""Iterative plans: scratch tables, run metrics and the fixpoint algorithms."""
