"""Filters and work queues over the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eligible(videos: DataFrame, *, exclude: DataFrame | None = None, long_form: bool = True, available: bool = True,
             published_from: str | None = None, channels: list[str] | None = None) -> DataFrame:
    """Any combination of: long-form, available, not excluded, published since, in channels."""
    out = videos
    if long_form:
        out = out.where(~F.col("is_short"))
    if available:
        out = out.where(~F.col("unavailable"))
    if published_from is not None:
        out = out.where(F.to_date("published_at") >= F.lit(published_from).cast("date"))
    if channels is not None:
        out = out.where(F.col("channel_id").isin(channels))
    if exclude is not None:
        out = out.join(exclude.select("video_id"), "video_id", "left_anti")
    return out


def recent_split(videos: DataFrame, *, as_of: str, days: int = 60) -> DataFrame:
    """Which refresh path owns a video: the incremental run or the audit."""
    edge = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return videos.withColumn("path", F.when(F.col("published_at") >= edge, "incremental").otherwise("audit"))


def backfill_since(as_of: str, *, years: int = 20) -> Column:
    """First of January, `years` before the current year."""
    return F.make_date(F.year(F.lit(as_of).cast("date")) - years, F.lit(1), F.lit(1))


def work_queue(videos: DataFrame, fetched: DataFrame, failures: DataFrame, *, mode: str, as_of: str,
               window_days: int = 30, cap: int = 100) -> DataFrame:
    """Videos whose transcript should be fetched next.

    backfill: never tried. incremental: never tried and recent, the newest `cap`.
    retry-failures: those that failed.
    """
    live = videos.where(~F.col("unavailable"))
    if mode == "retry-failures":
        return live.join(failures.select("video_id"), "video_id", "left_semi")
    todo = (live.join(fetched.select("video_id"), "video_id", "left_anti")
            .join(failures.select("video_id"), "video_id", "left_anti"))
    if mode == "backfill":
        return todo
    edge = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(window_days))
    return todo.where(F.col("published_at") >= edge).orderBy(F.desc("published_at"), "video_id").limit(cap)


def usable_name(name: Column) -> Column:
    """A stored subject name worth filing under."""
    s = F.trim(name)
    return F.coalesce((F.length(s) > 0) & ~F.lower(s).isin("null", "none") & (F.length(s) <= 80), F.lit(False))


def private_is_gone(answers: DataFrame) -> DataFrame:
    """A private answer counts as absent, yet the ask itself was not answered short."""
    answered = F.col("status").isNotNull()
    return (answers.withColumn("answered", answered)
            .withColumn("present", answered & (F.coalesce("status", F.lit("")) != "private"))
            .withColumn("needs_recheck", ~F.col("answered")))
