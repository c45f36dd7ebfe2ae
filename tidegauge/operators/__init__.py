"""Reusable DataFrame operators: series, as-of joins, order statistics, catalogue merges."""
