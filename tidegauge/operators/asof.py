"""As-of lookups and interval joins, written as equi-joins on time buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.numbers import days_between


def forward_asof(left: DataFrame, right: DataFrame, *, left_time: str, right_time: str, tolerance_hours: float,
                 keep: list[str]) -> DataFrame:
    """First right row at or after each left row, within a tolerance.

    Both sides are cut into buckets one tolerance wide, so a left row only meets the
    right rows of its own and the next bucket through a plain equi-join.
    """
    width = int(tolerance_hours * 3600)
    probes = (left.select(F.col(left_time).alias("_lt")).distinct()
              .withColumn("_lt_bucket", F.floor(F.unix_seconds("_lt") / width))
              .withColumn("_bucket", F.explode(F.array(F.col("_lt_bucket"), F.col("_lt_bucket") + 1))))
    facts = right.select(F.col(right_time).alias("_rt"), *keep,
                         F.floor(F.unix_seconds(right_time) / width).alias("_bucket"))
    lag_hours = days_between(F.col("_lt"), F.col("_rt")) * 24
    near = (probes.join(facts, "_bucket").where((lag_hours >= 0) & (lag_hours <= tolerance_hours))
            .groupBy("_lt").agg(F.min_by(F.struct("_rt", *keep), "_rt").alias("m")))
    return left.join(near.select(F.col("_lt").alias(left_time), F.col("m._rt").alias(right_time),
                                 *[F.col(f"m.{c}").alias(c) for c in keep]), left_time)


def fill_forward_days(daily: DataFrame, *, lookback: int, day: str = "day", value: str = "views") -> DataFrame:
    """Value per (video, day) as read on that day or at most `lookback` days before."""
    spread = daily.select("video_id", value, F.col(day).alias("_seen"),
                          F.explode(F.sequence(F.col(day), F.date_add(day, lookback))).alias("_day"))
    return spread.groupBy("video_id", F.col("_day").alias(day)).agg(F.max_by(value, "_seen").alias(value))


def nearest_snapshot(targets: DataFrame, snaps: DataFrame, *, days: int = 1) -> DataFrame:
    """Snapshot closest to each target instant among the dates around it; ties keep the earlier file."""
    near = targets.withColumn("snap_date", F.explode(F.sequence(
        F.date_sub(F.to_date("target"), days), F.date_add(F.to_date("target"), days))))
    gap = F.abs(F.unix_micros("captured_at") - F.unix_micros("target"))
    return (near.join(snaps, "snap_date").withColumn("gap_us", gap)
            .groupBy("label", "target")
            .agg(F.min_by(F.struct("snap_ix", "snap_date", "slot", "captured_at", "gap_us"),
                          F.struct("gap_us", "snap_date", "slot")).alias("m"))
            .select("label", "target", "m.*"))


def busy_days(windows: DataFrame, *, tail_days: int = 2) -> DataFrame:
    """Every (video, day) inside a campaign window or its tail, once."""
    return windows.select("video_id", F.explode(F.sequence(
        F.col("win_from"), F.date_add("win_to", tail_days))).alias("day")).distinct()


def next_start(windows: DataFrame) -> DataFrame:
    """For every distinct window end, the first later start of the same video.

    Starts and ends are reduced to distinct days first, so the window is calendar-sized.
    """
    starts = windows.select("video_id", F.col("win_from").alias("day"), F.lit(True).alias("is_start"))
    ends = windows.select("video_id", F.col("win_to").alias("day"), F.lit(False).alias("is_start"))
    days = starts.unionByName(ends).groupBy("video_id", "day").agg(
        F.max("is_start").alias("is_start"), F.max(~F.col("is_start")).alias("is_end"))
    later = Window.partitionBy("video_id").orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    return (days.withColumn("next_start", F.min(F.when(F.col("is_start"), F.col("day"))).over(later))
            .where("is_end").select("video_id", F.col("day").alias("win_to"), "next_start"))


def values_at_ages(points: DataFrame, ages: list[float]) -> DataFrame:
    """Views and likes linearly interpolated at each wanted age (hours), in one pass.

    `points` holds (video_id, age_h, views, likes); an age not bracketed by two readings gives no row.
    Where several archives are united, `source` ranks them: of readings of one instant the lower
    bracket takes the highest source and the upper bracket the lowest.
    """
    reading = F.struct("age_h", *[c for c in ("source",) if c in points.columns], "views", "likes")
    ends = points.groupBy("video_id").agg(
        *[F.max(F.when(F.col("age_h") <= h, reading)).alias(f"lo_{i}") for i, h in enumerate(ages)],
        *[F.min(F.when(F.col("age_h") >= h, reading)).alias(f"hi_{i}") for i, h in enumerate(ages)])

    def at(i: int, h: float):
        lo, hi = F.col(f"lo_{i}"), F.col(f"hi_{i}")
        span = hi["age_h"] - lo["age_h"]
        w = F.when(span == 0, F.lit(0.0)).otherwise((F.lit(float(h)) - lo["age_h"]) / span)
        return F.when(lo.isNotNull() & hi.isNotNull(), F.struct(
            F.lit(float(h)).alias("age_h"),
            *[(lo[c] + (hi[c] - lo[c]) * w).alias(c) for c in ("views", "likes")]))

    return (ends.select("video_id", F.explode(F.array(*[at(i, h) for i, h in enumerate(ages)])).alias("p"))
            .where(F.col("p").isNotNull()).select("video_id", "p.*"))


def range_bucket(day: str, *, start: str, step: int, forced: str):
    """Start of the step-day bucket a date falls in, with one extra boundary forced in."""
    first, cut = F.lit(start).cast("date"), F.lit(forced).cast("date")
    regular = F.date_add(first, (F.floor(F.datediff(day, first) / step) * step).cast("int"))
    return F.when((F.col(day) >= cut) & (regular < cut), cut).otherwise(regular)
