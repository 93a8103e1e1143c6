"""Operators for text corpora that feed model training. Nothing outside this package imports it."""
