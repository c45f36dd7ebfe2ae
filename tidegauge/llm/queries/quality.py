"""Quality of every document; tested by accuracy on the held-out fifth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm.quality import score_quality
from tidegauge.llm.registry import table

NAME = "op9_quality_discriminant"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
