"""Launch curves, the typical launch, and flat-then-spike movers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.numbers import days_between, half_even
from tidegauge.operators.series import adjacent_intervals, settled
from tidegauge.operators.stats import interpolated_median, with_scopes


def live_overlay(readings: DataFrame, videos: DataFrame) -> DataFrame:
    """Availability comes from the live catalogue, which is fresher than snapshots."""
    live = videos.select("video_id", F.col("unavailable").alias("_gone"))
    return readings.join(live, "video_id", "left").withColumn(
        "unavailable", F.coalesce("_gone", F.lit(False))).drop("_gone")


def launch_points(readings: DataFrame, videos: DataFrame, *, tracking_start: str, min_age: float = 0.25) -> DataFrame:
    """(mid age, views/day) between a launch's readings, starting from (0, 0)."""
    age = days_between(F.col("published_at"), F.col("captured_at"))
    order = Window.partitionBy("video_id").orderBy("age", "views")
    points = (
        live_overlay(settled(readings), videos)
        .where(~F.col("is_short") & ~F.col("unavailable")
               & (F.to_date("published_at") >= F.lit(tracking_start).cast("date")))
        .select("video_id", "channel_id", "published_at", "views", age.alias("age"))
        .where(F.col("age") >= min_age)
        .withColumn("prev_age", F.coalesce(F.lag("age").over(order), F.lit(0.0)))
        .withColumn("prev_views", F.coalesce(F.lag("views").over(order), F.lit(0))))
    step = F.col("age") - F.col("prev_age")
    return (points.where(step > 0)
            .withColumn("mid_age", F.round((F.col("prev_age") + F.col("age")) / 2, 3))
            .withColumn("rate", half_even((F.col("views") - F.col("prev_views")) / step)))


def launch_summary(points: DataFrame) -> DataFrame:
    """Current age and views of every launch."""
    return points.groupBy("video_id", "channel_id").agg(
        F.round(F.max("age"), 2).alias("age"), F.max_by("views", "age").alias("views"),
        F.count(F.lit(1)).alias("points"))


def typical_curve(points: DataFrame, as_of: DataFrame, *, bench_days: int = 35, max_age: float = 13.0,
                  min_points: int = 4) -> DataFrame:
    """Median views/day per half-day of age, per channel and for the network.

    `as_of` is a one-row frame holding the latest capture time in `at`.
    """
    now = as_of.select("at").scalar()
    recent = points.where(F.floor(days_between(F.col("published_at"), now)) <= bench_days)
    binned = (with_scopes(recent.where(F.col("mid_age") <= max_age))
              .withColumn("age_bin", F.bround(F.col("mid_age") * 2, 0) / 2))
    curve = interpolated_median(binned, ["scope", "age_bin"], "rate")
    return (curve.where((F.col("n") >= min_points) & (F.col("age_bin") <= max_age))
            .select("scope", "age_bin", "n", half_even(F.col("median")).alias("rate")))


def movers(readings: DataFrame, videos: DataFrame, ads: DataFrame, snaps: DataFrame, *, recent: int = 8,
           flat: float = 100, move: float = 300, spike: float = 3, week_checks: int = 14) -> DataFrame:
    """Videos whose gains were flat and then jumped (per-check gains, not rates)."""
    newest_first = Window.partitionBy("video_id").orderBy(F.desc("snap_ix"))
    gains = (adjacent_intervals(live_overlay(settled(readings), videos))
             .where(~F.col("is_short") & ~F.col("unavailable"))
             .withColumn("rn", F.row_number().over(newest_first)))
    shape = gains.groupBy("video_id", "channel_id", "published_at").agg(
        F.count(F.lit(1)).alias("n"),
        F.median(F.when(F.col("rn") > recent, F.col("delta"))).alias("base"),
        F.max(F.when(F.col("rn") <= recent, F.col("delta"))).alias("peak"))
    jumped = shape.where(
        (F.col("n") >= max(12, recent + 10)) & (F.col("base") <= flat)
        & (F.col("peak") >= move) & (F.col("peak") >= F.col("base") * spike))
    # Snapshot numbers are dense, so the last one gives the number of captures.
    archive = snaps.agg(F.struct(F.max("snap_ix").alias("last"), F.max("captured_at").alias("now"))).scalar()
    last = archive["last"]
    week = F.greatest(F.lit(0), last + 1 - week_checks)
    ends = (readings.where((F.col("snap_ix") == last) | (F.col("snap_ix") == week))
            .groupBy("video_id").agg(
                F.max(F.when(F.col("snap_ix") == last, F.col("views"))).alias("latest"),
                F.max(F.when(F.col("snap_ix") == week, F.col("views"))).alias("week_ago")))
    paid = ads.select("video_id", F.lit(True).alias("is_ad"))
    now = F.to_date(archive["now"])
    return (
        jumped.join(ends, "video_id", "left").join(paid, "video_id", "left")
        .select("video_id", "channel_id",
                F.datediff(now, F.to_date("published_at")).cast("bigint").alias("age_days"),
                F.coalesce(F.col("latest") - F.col("week_ago"), F.lit(0)).alias("gain7"),
                F.col("latest").alias("views"),
                half_even(F.col("base")).alias("base"), F.col("peak"),
                F.coalesce("is_ad", F.lit(False)).alias("is_ad")))
