"""Language of every document; tested by accuracy on the held-out fifth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm.language import identify
from tidegauge.llm.registry import table

NAME = "op6_language_filters"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, docs)
