"""Daily gains by channel and bucket, the per-day video lists, and back-catalogue months."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.calendar import final_week_start, local_day, local_month, month_of
from tidegauge.operators.series import daily_gains


def classified_gains(readings: DataFrame, snaps: DataFrame, videos: DataFrame) -> DataFrame:
    """Daily gains with the new/old, late-previous-month and removed flags."""
    gains = daily_gains(readings, snaps)
    month = month_of(F.col("label_date"))
    pub_day = local_day(F.col("published_at"))
    is_new = local_month(F.col("published_at")) == month
    late = ~is_new & (pub_day >= final_week_start(month)) & (pub_day < F.trunc("label_date", "MM"))
    gone = videos.where("unavailable").select("video_id", F.lit(True).alias("removed"))
    return (gains.withColumn("is_new", is_new).withColumn("is_late", late)
            .join(gone, "video_id", "left")
            .withColumn("removed", F.coalesce("removed", F.lit(False))))


def _sum_if(cond, name: str):
    return F.sum(F.when(cond, F.col("gain")).otherwise(0)).alias(name)


def daily_views(classified: DataFrame, *, removed: bool = False) -> DataFrame:
    """Six buckets per (day, channel); the last two are a subset of the old ones."""
    short, new, late = F.col("is_short"), F.col("is_new"), F.col("is_late")
    return (
        classified.where(F.col("removed") == F.lit(removed))
        .groupBy(F.date_format("label_date", "yyyy-MM-dd").alias("label_date"), "channel_id")
        .agg(_sum_if(new & short, "new_short"), _sum_if(new & ~short, "new_long"),
             _sum_if(~new & short, "old_short"), _sum_if(~new & ~short, "old_long"),
             _sum_if(late & short, "late_short"), _sum_if(late & ~short, "late_long")))


def daily_top(classified: DataFrame, *, top: int = 30) -> DataFrame:
    """The biggest gainers of each (day, channel)."""
    best = Window.partitionBy("label_date", "channel_id").orderBy(F.desc("gain"), "video_id")
    return (classified.where("NOT removed").withColumn("position", F.row_number().over(best))
            .where(F.col("position") <= top))


def daily_rest(classified: DataFrame, *, top: int = 30) -> DataFrame:
    """Count and gain of everything below the top list, per bucket.

    Worked out as total minus top list, so only the bounded top list is ever ranked.
    """
    bucket = ["label_date", "channel_id", "is_new", "is_short"]
    parts = (classified.where("NOT removed").select(*bucket, F.lit(1).alias("n"), "gain")
             .unionByName(daily_top(classified, top=top).select(
                 *bucket, F.lit(-1).alias("n"), (-F.col("gain")).alias("gain"))))
    return parts.groupBy(*bucket).agg(F.sum("n").alias("rest_count"), F.sum("gain").alias("rest_gain")) \
        .where("rest_count > 0")


def historic_views(readings: DataFrame, snaps: DataFrame, videos: DataFrame, ads: DataFrame) -> DataFrame:
    """Views gained per month by videos published before it (negatives kept)."""
    tag = F.concat_ws("-", F.date_format("snap_date", "yyyy-MM-dd"), "slot")
    tagged = snaps.select(month_of(F.col("snap_date")).alias("month"), tag.alias("tag"), "snap_ix")
    months = (
        tagged.groupBy("month")
        .agg(F.min("tag").alias("window_from"), F.max("tag").alias("window_to"),
             F.min_by("snap_ix", "tag").alias("first_ix"), F.max_by("snap_ix", "tag").alias("last_ix"))
        .withColumn("in_progress", F.col("month") == F.max("month").over(Window.partitionBy()))
        .withColumn("partial", ~F.col("window_from").startswith(F.concat("month", F.lit("-01"))))
        .where("first_ix <> last_ix"))
    ends = months.select("month", "in_progress", "partial", "window_from", "window_to",
                         F.explode(F.array(
                             F.struct(F.col("first_ix").alias("snap_ix"), F.lit(False).alias("is_last")),
                             F.struct(F.col("last_ix").alias("snap_ix"), F.lit(True).alias("is_last")))).alias("e")) \
        .select("month", "in_progress", "partial", "window_from", "window_to", "e.*")
    pairs = (
        readings.select("video_id", "snap_ix", "views", "published_at",
                        F.col("channel_id").alias("snap_channel"), F.col("is_short").alias("snap_short"))
        .join(ends, "snap_ix")
        .where(F.col("published_at") < F.to_date(F.concat("month", F.lit("-01"))))
        .groupBy("month", "video_id", "published_at", "in_progress", "partial", "window_from", "window_to")
        .agg(F.max(F.when(~F.col("is_last"), F.col("views"))).alias("a"),
             F.max(F.when(F.col("is_last"), F.col("views"))).alias("b"),
             F.max("snap_channel").alias("snap_channel"), F.max("snap_short").alias("snap_short"))
        .withColumn("delta", F.col("b") - F.col("a"))
        .where("delta <> 0"))
    live = videos.select("video_id", F.col("channel_id").alias("live_channel"), F.col("is_short").alias("live_short"))
    paid = ads.select("video_id", F.lit(True).alias("paid"))
    joined = (
        pairs.join(live, "video_id", "left").join(paid, "video_id", "left")
        .withColumn("channel_id", F.coalesce("live_channel", "snap_channel"))
        .withColumn("short", F.coalesce("live_short", "snap_short"))
        .withColumn("paid", F.coalesce("paid", F.lit(False))))
    late = F.to_date("published_at") >= final_week_start(F.col("month"))
    long = ~F.col("short")

    def total(cond, name):
        return F.sum(F.when(cond, F.col("delta")).otherwise(0)).alias(name)

    return joined.groupBy("month", "channel_id", "window_from", "window_to", "partial", "in_progress").agg(
        total(long, "long_gain"), total(F.col("short"), "short_gain"),
        total(long & ~F.col("paid") & late, "last_week"), total(long & F.col("paid"), "paid_gain"))
