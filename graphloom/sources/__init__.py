"""Readers and writers of edge lists and label tables."""
