"""Audience analytics as plain Spark functions: DataFrame in, DataFrame out."""
