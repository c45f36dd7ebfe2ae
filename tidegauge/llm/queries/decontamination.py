"""Benchmark items met in each document; tested against exact edit distance to every run of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm.decontamination import find_leaks
from tidegauge.llm.registry import table

NAME = "op1_benchmark_leaks"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
