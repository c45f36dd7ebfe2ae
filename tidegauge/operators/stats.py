"""Exact order statistics, modes and averages.

`median()` keeps every distinct value of a group in one task, which is fine for
groups or value domains bounded by the calendar or by rounding. Groups without
such a bound (a channel, the whole network) go through `order_values`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STEPS = 4096  # buckets per power of two


def _bucket(v: Column) -> Column:
    """Sign, power of two and leading fraction of a number as one whole number that never falls as the number grows."""
    size = F.abs(v)
    power = F.floor(F.log2(size))
    code = (power + 1100) * (4 * _STEPS) + F.floor(size / F.pow(F.lit(2.0), power) * _STEPS)
    top = F.lit(2 ** 40)
    return (F.when(F.isnan(v), top + 1).when(size == float("inf"), F.when(v > 0, top).otherwise(-top))
            .when(v == 0, 0).when(v > 0, code).otherwise(-code).cast("bigint"))


def order_values(df: DataFrame, keys: list[str], value: str, targets: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Exact ranked values per group, without gathering any group in one task.

    `targets` maps an output name to a function from the group's size to a 1-based rank; values are
    numbers. Equal values are counted before anything moves, spread by (group, value). The counts
    are summed per bucket, a bucket being 1/4096 of a power of two whatever the data, and only the
    buckets that hold a wanted rank are sorted. All steps read the same shuffled counts, the input is
    evaluated once, and nothing runs before the result is asked for. A null key is a group.
    """
    counted = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v"))
               .agg(F.count(F.lit(1)).alias("_c")).withColumn("_bucket", _bucket(F.col("_v").cast("double"))))
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = (counted.groupBy(*keys, "_bucket").agg(F.sum("_c").alias("_in"))
              .withColumn("_before", F.sum("_in").over(upto) - F.col("_in")).withColumn("n", F.sum("_in").over(group)))
    inside = {name: rank(F.col("n")).cast("bigint") - F.col("_before") for name, rank in targets.items()}
    hits = {name: F.when((r >= 1) & (r <= F.col("_in")), r) for name, r in inside.items()}
    wanted = totals.select(
        *[F.col(k).alias(f"_at_{k}") for k in keys], F.col("_bucket").alias("_at_bucket"), "n",
        *[r.alias(f"_rank_{name}") for name, r in hits.items()]).where(
            reduce(or_, [F.col(f"_rank_{name}").isNotNull() for name in targets]))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys],
                  F.col("_bucket").eqNullSafe(F.col("_at_bucket")))
    in_bucket = (Window.partitionBy(*keys, "_bucket").orderBy("_v")
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ordered = counted.join(wanted, same).withColumn("_upto", F.sum("_c").over(in_bucket))

    def holds(name: str) -> Column:
        rank = F.col(f"_rank_{name}")
        return (rank <= F.col("_upto")) & (rank > F.col("_upto") - F.col("_c"))

    return ordered.groupBy(*keys).agg(
        F.max("n").alias("n"), *[F.max(F.when(holds(name), F.col("_v"))).alias(name) for name in targets])


def interpolated_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """Mean of the two middle values for an even count; one row per group."""
    both = order_values(df, keys, value, {
        "_lo": lambda n: F.floor((n + 1) / 2),
        "_hi": lambda n: F.floor(n / 2) + 1})
    return both.select(*keys, "n", ((F.col("_lo") + F.col("_hi")) / 2).alias(name))


def upper_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """The sorted value at position floor(n/2), counted from zero."""
    return order_values(df, keys, value, {name: lambda n: F.floor(n / 2) + 1})


def floor_rank_quantiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """The sorted value at position floor(p * (n - 1)), counted from zero."""
    return order_values(df, keys, value, {
        name: lambda n, p=p: F.floor(F.lit(p) * (n - 1)) + 1 for name, p in points.items()})


def mode_low(df: DataFrame, keys: list[str], value: str, name: str = "mode") -> DataFrame:
    """Most frequent value; equal counts go to the lower value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(name))


def lower_half_median(df: DataFrame, keys: list[str], value: str, name: str = "baseline") -> DataFrame:
    """Median of the lowest max(1, n div 2) values; for groups bounded by the calendar."""
    order = Window.partitionBy(*keys).orderBy(value)
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ranked = df.withColumn("_rn", F.row_number().over(order)).withColumn("_n", size)
    return (ranked.where(F.col("_rn") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 2)))
            .groupBy(*keys).agg(F.median(value).alias(name)))


def with_scopes(df: DataFrame, channel: str = "channel_id", everything: str = "ALL") -> DataFrame:
    """Each row once for its channel and once for the network scope."""
    return df.withColumn("scope", F.explode(F.array(F.lit(everything), F.col(channel))))
