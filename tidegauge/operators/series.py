"""Operators over half-daily readings.

A video's readings are bounded by the snapshot calendar (two a day), so windows
partitioned by video are small no matter how popular the video is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.numbers import days_between


def snapshots(readings: DataFrame) -> DataFrame:
    """The global axis: one row per snapshot (calendar-sized)."""
    return readings.groupBy("snap_date", "slot").agg(
        F.max("captured_at").alias("captured_at"), F.max("snap_ix").alias("snap_ix"))


def one_per_date(snaps: DataFrame) -> DataFrame:
    """One snapshot per date, the AM one if there is one."""
    best = Window.partitionBy("snap_date").orderBy("slot")
    return snaps.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank")


def last_read_of_day(readings: DataFrame) -> DataFrame:
    """Per (video, day) the later reading wins."""
    return readings.groupBy("video_id", F.col("snap_date").alias("day")).agg(
        F.max_by("views", "slot").alias("views"))


def settled(readings: DataFrame) -> DataFrame:
    """Each reading with the format, channel and publish time of its video's newest reading."""
    kept = ["channel_id", "published_at", "is_short"]
    newest = F.max_by(F.struct(*kept), "snap_ix").over(Window.partitionBy("video_id"))
    return readings.withColumn("_newest", newest).withColumns({c: F.col(f"_newest.{c}") for c in kept}).drop("_newest")


def nominal_time(day: Column, slot: Column) -> Column:
    """Nominal clock in days: AM is the start of the day, PM its middle."""
    return F.datediff(day, F.lit("1970-01-01")) + F.when(slot == "PM", 0.5).otherwise(0.0)


def own_intervals(readings: DataFrame) -> DataFrame:
    """Deltas between a video's own consecutive readings on the nominal clock."""
    order = Window.partitionBy("video_id").orderBy("snap_ix")
    timed = readings.withColumn("t1", nominal_time(F.col("snap_date"), F.col("slot")))
    return (
        timed.withColumn("t0", F.lag("t1").over(order))
        .withColumn("dv", F.col("views") - F.lag("views").over(order))
        .withColumn("prev_date", F.lag("snap_date").over(order))
        .withColumn("prev_slot", F.lag("slot").over(order))
        .withColumn("dt", F.col("t1") - F.col("t0"))
        .withColumn("n_points", F.count(F.lit(1)).over(Window.partitionBy("video_id")))
        .where(F.col("dt") > 0)
        .withColumn("rate", F.col("dv") / F.col("dt")))


def adjacent_intervals(readings: DataFrame) -> DataFrame:
    """Deltas between neighbouring snapshots of the global axis; a gap breaks the pair."""
    order = Window.partitionBy("video_id").orderBy("snap_ix")
    return (
        readings
        .withColumn("prev_ix", F.lag("snap_ix").over(order))
        .withColumn("delta", F.col("views") - F.lag("views").over(order))
        .withColumn("t0", F.lag("captured_at").over(order))
        .withColumn("n_points", F.count(F.lit(1)).over(Window.partitionBy("video_id")))
        .where(F.col("snap_ix") - F.col("prev_ix") == 1)
        .withColumn("dt", days_between(F.col("t0"), F.col("captured_at")))
        .where(F.col("dt") > 0))


def daily_gains(readings: DataFrame, snaps: DataFrame) -> DataFrame:
    """Views gained between consecutive daily snapshots, labelled with the earlier date.

    A video missing from the previous snapshot counts in full only if it was
    published after that snapshot was taken.
    """
    axis = one_per_date(snaps)
    by_date = Window.orderBy("snap_date")
    axis = (axis.withColumn("day_ix", F.row_number().over(by_date))
            .withColumn("label_date", F.lag("snap_date").over(by_date))
            .withColumn("prev_captured", F.lag("captured_at").over(by_date))
            .select("snap_date", "slot", "day_ix", "label_date", "prev_captured"))
    order = Window.partitionBy("video_id").orderBy("day_ix")
    dated = (
        readings.select("video_id", "snap_date", "slot", "views", "published_at", "channel_id", "is_short")
        .join(axis, ["snap_date", "slot"])
        .withColumn("prev_ix", F.lag("day_ix").over(order))
        .withColumn("prev_views", F.lag("views").over(order)))
    known = F.col("prev_ix") == F.col("day_ix") - 1
    fresh = F.col("published_at") > F.col("prev_captured")
    gain = F.when(known, F.col("views") - F.col("prev_views")).when(fresh, F.col("views"))
    return (dated.withColumn("gain", gain)
            .where(F.col("label_date").isNotNull() & (F.col("gain") > 0))
            .select("label_date", "video_id", "channel_id", "is_short", "published_at", "gain"))


def gap_tolerant_runs(flagged: DataFrame, *, tolerance: int, rank: str = "rn") -> DataFrame:
    """Number the runs of flagged rows per video, bridging up to `tolerance` quiet rows."""
    order = Window.partitionBy("video_id").orderBy(rank)
    jump = F.col(rank) - F.lag(rank).over(order)
    starts = F.when(jump.isNull() | (jump > tolerance + 1), 1).otherwise(0)
    return flagged.withColumn("starts", starts).withColumn("run_no", F.sum("starts").over(order)).drop("starts")


def latest_run(rows: DataFrame, flag: Column, *, order_col: str) -> DataFrame:
    """Keep the last unbroken run of flagged rows per video."""
    order = Window.partitionBy("video_id").orderBy(order_col)
    island = F.sum(F.when(flag, 0).otherwise(1)).over(order)
    tagged = rows.withColumn("_flag", flag).withColumn("_island", island).where("_flag")
    last = F.max("_island").over(Window.partitionBy("video_id"))
    return tagged.withColumn("_last", last).where("_island = _last").drop("_flag", "_island", "_last")
