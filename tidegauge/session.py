"""Session helpers: sane defaults, shared scratch space, lineage cuts."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session settings every query relies on (all are runtime SQL settings)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine find the package from any folder, as the driver does."""
    root = str(Path(__file__).resolve().parents[1])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it; else one in the warehouse, which they share too."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/tidegauge-steps"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tidegauge/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder once and go on from the table.

    Unlike a checkpoint, which runs the plan a second time to save it, this computes
    the rows once; readers prune columns, and losing an executor costs nothing.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
