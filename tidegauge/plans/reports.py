"""Roll-ups over side tables: reposts, creator tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repost_rollup(reposts: DataFrame, dimensions: list[str]) -> DataFrame:
    """Reposts per value of each dimension, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]))
    return reposts.select(pairs.alias("p")).select("p.*").where("value IS NOT NULL").groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("n"))


def creator_tags(videos: DataFrame) -> DataFrame:
    """Videos and views per creator tag; `videos` holds a `tags` array."""
    return videos.select("views", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(
        F.count(F.lit(1)).alias("videos"), F.sum("views").alias("views"))
