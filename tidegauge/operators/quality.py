"""Expectations that decide whether a product may be computed or published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def enough_snapshots(df: DataFrame, snaps: DataFrame, *, minimum: int) -> DataFrame:
    """The rows, or none at all while the archive holds too few snapshots."""
    return df.where(snaps.agg(F.count(F.lit(1))).scalar() >= minimum)


def harvest_floor(capture: DataFrame, *, minimum: int = 50) -> DataFrame:
    """A thin capture is no evidence: nothing is passed on."""
    return capture.where(capture.agg(F.count(F.lit(1))).scalar() >= minimum)


def harvest_status(capture: DataFrame, *, minimum: int = 50) -> DataFrame:
    return capture.agg(F.count(F.lit(1)).alias("captured")).withColumn(
        "status", F.when(F.col("captured") >= minimum, "ok").otherwise("too thin, nothing written"))


def fresh_readings(readings: DataFrame, *, today: str, day: str = "day", exact: str = "stock") -> DataFrame:
    """Number of exact readings dated today and whether that allows publishing."""
    return readings.agg(
        F.count_if((F.col(day) == F.lit(today).cast("date")) & F.col(exact).isNotNull()).alias("fresh"),
        F.max(day).alias("newest")).withColumn("publish", F.col("fresh") >= 1)


def staleness(snaps: DataFrame, *, as_of: str, limit_hours: float = 36.0) -> DataFrame:
    """Hours since the archive last grew."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.max("captured_at"))) / 3600000000.0
    return snaps.agg(F.round(age, 3).alias("hours")).withColumn("stale", F.col("hours") > limit_hours)


def marked_fabricated(df: DataFrame, text: Column) -> DataFrame:
    """Rows carrying the test-data marker, which must never be published."""
    return df.where(text.contains('"_TESTDATA":'))


def minimum_sample(df: DataFrame, keys: list[str], *, minimum: int) -> DataFrame:
    """Groups with enough rows to publish a rate."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum)
    return df.join(sizes.select(*keys), keys, "left_semi")
