"""Connected components as alternating star contractions on tables; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.session import cut_lineage


def _lowest(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each node; written, so that the join with a hub's edges can be split."""
    return cut_lineage(edges.groupBy("u").agg(F.min("v").alias("m")))


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge list (a, b) of values of one ordered type, as numbers or strings.

    A component is named by its smallest node. Loops and rows with a null end are left out, and
    repeated edges count once; no edges give no rows. Each round hangs every node's larger
    neighbours, then its smaller ones, on the smallest node in sight, until nothing changes; the
    rounds grow with the logarithm of the longest path. The minimum is taken before the shuffle,
    so a node with very many edges stays cheap.
    """
    edges = cut_lineage(edges.where("a is not null and b is not null and a <> b")
                        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(_lowest(both), "u").where("v > u")
                 .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        large = cut_lineage(large)
        near = large.join(_lowest(large), "u")
        small = (near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(near.select("u", F.col("m").alias("v"))).distinct())
        edges = cut_lineage(small)
        after = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
