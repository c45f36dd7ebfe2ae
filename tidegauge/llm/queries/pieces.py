"""Every whole text through the encoder and back; tested against the model's own library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import pieces
from tidegauge.llm.registry import table

NAME = "op4_piece_round_trip"
MODEL = "piece_bpe_32k.model"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), model_path())
