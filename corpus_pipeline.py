"""Corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Quality and toxicity drop the documents they reject, near duplicates leave the document with the
smallest id of each group, decontamination drops documents that hold a benchmark item, and the last
stage encodes what is left and decodes it again. No stage has a SQL twin; the tests compare them
with brute force on small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import decontamination, ngram_join, pieces, quality, toxicity
from tidegauge.llm.batches import ready
from tidegauge.llm.queries.pieces import model_path
from tidegauge.llm.registry import table
from tidegauge.session import scratch_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good(docs, table(ready(spark), sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.mild(docs, table(ready(spark), sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an id cannot be grouped and stay; of rows with the same id one stays."""
    ready(spark)
    groups = ngram_join.near_duplicates(docs).where("component_id = doc_id").select("doc_id").distinct()
    kept = docs.join(groups, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.select(docs.columns).union(docs.where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_leaks(docs, table(ready(spark), sf_dir, "benchmark"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source with the ids, their number, and whether they decode to the text again."""
    ready(spark)
    encoded = pieces.encode(docs, model_path())
    return (pieces.decode(encoded, model_path())
            .select("doc_id", "lang", "source", "piece_ids", F.size("piece_ids").cast("long").alias("n_tokens"),
                    (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("restored")))


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near duplicates", near_duplicate_stage),
          ("decontamination", decontamination_stage), ("pieces", pieces_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
