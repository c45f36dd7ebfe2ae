"""Near-duplicate groups of all documents; tested against brute force (SQL would compare all pairs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm.ngram_join import near_duplicates
from tidegauge.llm.registry import table

NAME = "op5_near_duplicates"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
