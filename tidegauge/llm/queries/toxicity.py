"""Severity of every document; tested by accuracy on the held-out fifth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm.registry import table
from tidegauge.llm.toxicity import score_toxicity

NAME = "op2_toxicity_ordinal"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
