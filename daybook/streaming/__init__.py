"""Structured Streaming forms of the row-wise and keyed operators."""
