"""Ordered operators for keys of any size.

A key is cut into blocks of its numeric order column. Rows are only ordered inside
a block; what has to cross a block border travels through a summary with one row
per block.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.session import cut_lineage

BLOCK = 4096


def previous_row(df: DataFrame, key: str, order: str, cols: list[str], *, block: int = BLOCK) -> DataFrame:
    """Add `prev_<col>`: the value on the row before, per key."""
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    inside = Window.partitionBy(key, "_block").orderBy(order)
    row = F.struct(*cols)
    last = blocked.groupBy(key, "_block").agg(F.max_by(row, order).alias("_tail"))
    carry = last.select(key, "_block", F.lag("_tail").over(Window.partitionBy(key).orderBy("_block")).alias("_carry"))
    joined = (blocked.withColumn("_prev", F.lag(row).over(inside)).join(carry, [key, "_block"])
              .withColumn("_prev", F.coalesce("_prev", "_carry")))
    return joined.select(*df.columns, *[F.col(f"_prev.{c}").alias(f"prev_{c}") for c in cols])


def streaks(df: DataFrame, key: str, order: str, flag: Column, *, block: int = BLOCK) -> DataFrame:
    """Add `streak`: how many flagged rows in a row end here (0 on unflagged rows)."""
    blocked = df.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_flag", flag)
    inside = Window.partitionBy(key, "_block").orderBy(order)
    resets = blocked.withColumn("_resets", F.sum(F.when(F.col("_flag"), 0).otherwise(1)).over(inside))
    local = resets.withColumn("_local", F.when(F.col("_flag"), F.count_if("_flag").over(
        Window.partitionBy(key, "_block", "_resets").orderBy(order))).otherwise(0))
    summary = local.groupBy(key, "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_and("_flag").alias("_all"), F.max_by("_local", order).alias("_tail"))
    by_block = Window.partitionBy(key).orderBy("_block")
    broken = summary.withColumn("_group", F.sum(F.when(F.col("_all"), 0).otherwise(1)).over(by_block))
    # Within a group the first block carries its tail, the following ones are unbroken.
    reach = F.sum(F.when(F.col("_all"), F.col("_n")).otherwise(F.col("_tail"))).over(
        Window.partitionBy(key, "_group").orderBy("_block"))
    carry = broken.withColumn("_reach", reach).select(
        key, "_block", F.coalesce(F.lag("_reach").over(by_block), F.lit(0)).alias("_carry"))
    starts_open = F.col("_flag") & (F.col("_resets") == 0)
    return (local.join(carry, [key, "_block"])
            .withColumn("streak", F.col("_local") + F.when(starts_open, F.col("_carry")).otherwise(0))
            .select(*df.columns, "streak"))


def global_rank(df: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """Add the 1-based rank of each row within its key; null is a key value like any other.

    Rows are cut by range over key and order into parts of even size, so a key of any number of
    rows spans as many parts as it needs. A part ranks its own rows, and one count per (key, part)
    carries the rank on to the next part. The parts are written once, since both steps have to see
    the same cut. Rows equal in key and order share a part and are ranked in any order.
    """
    cut = (df.repartitionByRange(*[F.col(c) for c in (*keys, *order)])
           .withColumn("_part", F.spark_partition_id()))
    placed = cut_lineage(cut)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n")).select(
        *[F.col(k).alias(f"_at_{k}") for k in keys], F.col("_part").alias("_at_part"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys], F.col("_part") == F.col("_at_part"))
    return (placed.withColumn("_inside", inside).join(offsets, same)
            .select(*df.columns, (F.col("_before") + F.col("_inside")).alias(name)))
