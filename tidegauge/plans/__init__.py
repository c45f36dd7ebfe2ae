"""Data products composed from the operators."""
