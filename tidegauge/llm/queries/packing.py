"""Packed rows of all documents; tested by putting the documents together again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm.packing import packed
from tidegauge.llm.registry import table

NAME = "op8_best_fit_packing"
RANKS = "byte_bpe_multi_50k.tiktoken"


def vocabulary(name: str = RANKS) -> tuple[str, str]:
    """Path of the vocabulary and the pattern that cuts texts before its merges."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), *vocabulary())
