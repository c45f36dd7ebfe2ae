"""Operators and pipeline stages for large training-data corpora."""
