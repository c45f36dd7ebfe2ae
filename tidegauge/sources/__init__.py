"""Readers, writers and the stand-in adapters over the benchmark tables."""
