"""Audit-aligned step test on the dormant back catalogue, and the clock's health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.numbers import days_between
from tidegauge.operators.asof import forward_asof


def dormant_pool(videos: DataFrame, ads: DataFrame, *, channel: str, published_before: str) -> DataFrame:
    return (videos.where((F.col("channel_id") == channel) & ~F.col("unavailable")
                         & (F.to_date("published_at") < F.lit(published_before).cast("date")))
            .join(ads.select("video_id"), "video_id", "left_anti").select("video_id", "is_short"))


def pool_totals(readings: DataFrame, pool: DataFrame) -> DataFrame:
    """Long and short totals of the pool at every snapshot (calendar-sized)."""
    return (readings.select("video_id", "snap_ix", "captured_at", "views").join(pool, "video_id")
            .groupBy("snap_ix", "captured_at").agg(
                F.sum(F.when(F.col("is_short"), 0).otherwise(F.col("views"))).alias("long_views"),
                F.sum(F.when(F.col("is_short"), F.col("views")).otherwise(0)).alias("short_views")))


def audit_legs(audits: DataFrame, totals: DataFrame, *, lag_max_h: float = 14.0) -> DataFrame:
    """Gain per 24 h between kept audits, each read from the first snapshot at or after it.

    Audits and snapshots are two a day, so these unpartitioned windows are calendar-sized.
    """
    seen = forward_asof(audits, totals, left_time="audit_at", right_time="captured_at",
                        tolerance_hours=lag_max_h, keep=["long_views", "short_views"])
    order = Window.orderBy("audit_at")
    same = (F.col("long_views") == F.lag("long_views").over(order)) & \
           (F.col("short_views") == F.lag("short_views").over(order))
    kept = seen.withColumn("same", F.coalesce(same, F.lit(False))).where(~F.col("same"))
    hours = days_between(F.lag("audit_at").over(order), F.col("audit_at")) * 24
    return (
        kept.withColumn("hours", hours)
        .withColumn("long_gain", (F.col("long_views") - F.lag("long_views").over(order)) / F.col("hours") * 24)
        .withColumn("short_gain", (F.col("short_views") - F.lag("short_views").over(order)) / F.col("hours") * 24)
        .where(F.col("hours").isNotNull())
        .withColumn("phase", F.when(F.hour("audit_at") < 9, "early").otherwise("late"))
        .select("audit_at", "hours", "phase", "long_gain", "short_gain"))


def well_formed(legs: DataFrame, *, leg: tuple[float, float] = (10.0, 13.5)) -> DataFrame:
    return legs.where(F.col("hours").between(*leg))


def did_factor(legs: DataFrame, *, change: str, min_pre: int = 3, min_post: int = 2) -> DataFrame:
    """Difference in differences per phase: long-form step over the Shorts step."""
    pre = F.to_date("audit_at") < F.lit(change).cast("date")

    def mid(col: str, cond):
        return F.median(F.when(cond, F.col(col)))

    s = well_formed(legs).groupBy("phase").agg(
        F.count_if(pre).alias("n_pre"), F.count_if(~pre).alias("n_post"),
        mid("long_gain", pre).alias("pl"), mid("short_gain", pre).alias("ps"),
        mid("long_gain", ~pre).alias("ql"), mid("short_gain", ~pre).alias("qs"),
        F.stddev_pop(F.when(pre, F.col("long_gain"))).alias("sd"))
    return s.where((F.col("n_pre") >= min_pre) & (F.col("n_post") >= min_post)).select(
        "phase", "n_pre", "n_post", F.round("pl", 3).alias("pre_long"), F.round("ps", 3).alias("pre_short"),
        F.round("ql", 3).alias("post_long"), F.round("qs", 3).alias("post_short"),
        F.round(F.try_divide("sd", "pl"), 4).alias("baseline_cv"),
        F.round(F.try_divide(F.try_divide("ql", "pl"), F.try_divide("qs", "ps")), 4).alias("did"))


def clock_health(legs: DataFrame, audits: DataFrame, *, leg: tuple[float, float] = (10.0, 13.5),
                 days: int = 7) -> DataFrame:
    """Share of irregular legs in the last week, and the verdict on the clock."""
    last = audits.agg(F.max("audit_at")).scalar()
    recent = legs.where(F.col("audit_at") > last - F.make_dt_interval(F.lit(days)))
    s = recent.agg(F.count(F.lit(1)).alias("legs"), F.count_if(~F.col("hours").between(*leg)).alias("irregular"))
    share = F.coalesce(F.try_divide("irregular", "legs"), F.lit(0.0))
    return s.select("legs", "irregular",
                    F.when(share > 0.20, "degraded").when(share > 0.05, "marginal").otherwise("steady").alias("verdict"))
