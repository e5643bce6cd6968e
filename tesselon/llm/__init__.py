"""Operators for large text corpora (see the README for the list)."""
