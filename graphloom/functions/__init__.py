"""Scalar column functions: partition functions and id packing."""
