"""Promotion effects: the ad ledger, unexplained spikes and single-campaign impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.numbers import half_even, half_up
from tidegauge.operators.series import adjacent_intervals, gap_tolerant_runs, latest_run, own_intervals, settled


def ad_bursts(readings: DataFrame, ads: DataFrame, *, entangle_days: int = 3, min_views: int = 200,
              min_rate: float = 300.0, base_mult: float = 3.0, gap_tol: int = 2, min_readings: int = 3) -> DataFrame:
    """Burst runs of every advertised long-form video."""
    roster = settled(readings.join(ads.select("video_id"), "video_id", "left_semi")).where(~F.col("is_short"))
    per_video = Window.partitionBy("video_id")
    steps = (
        adjacent_intervals(roster).where(F.col("n_points") >= min_readings)
        .withColumn("gain", F.greatest(F.lit(0), F.col("delta")))
        .withColumn("rate", F.col("gain") / F.col("dt"))
        .withColumn("base", F.median("rate").over(per_video))
        .withColumn("excess", F.col("gain") - F.col("base") * F.col("dt"))
        .withColumn("rn", F.row_number().over(per_video.orderBy("snap_ix"))))
    burst = ((F.col("gain") >= min_views) & (F.col("excess") > 0)
             & (F.col("rate") >= F.greatest(F.lit(min_rate), F.lit(base_mult) * F.col("base"))))
    runs = gap_tolerant_runs(steps.where(burst), tolerance=gap_tol)
    return (
        runs.groupBy("video_id", "channel_id", "published_at", "base", "run_no").agg(
            F.to_date(F.min("t0")).alias("from_day"), F.to_date(F.max("captured_at")).alias("to_day"),
            F.sum(half_even(F.col("excess"))).alias("views"),
            F.min(F.col("snap_ix") - 1).alias("iv0"), F.max(F.col("snap_ix") - 1).alias("iv1"))
        .withColumn("entangled", F.datediff("from_day", F.to_date("published_at")) < entangle_days))


def ad_ledger(bursts: DataFrame) -> DataFrame:
    """Per video: confirmed and entangled views, burst count, first and last day."""
    return bursts.groupBy("video_id", "channel_id", F.round("base", 1).alias("baseline_per_day")).agg(
        F.sum(F.when(~F.col("entangled"), F.col("views")).otherwise(0)).alias("ad_views"),
        F.sum(F.when(F.col("entangled"), F.col("views")).otherwise(0)).alias("entangled_views"),
        F.count(F.lit(1)).alias("bursts"),
        F.min("from_day").alias("first_burst"), F.max("to_day").alias("last_burst"))


def ledger_totals(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.sum("ad_views").alias("ad_views"), F.sum("entangled_views").alias("entangled_views"),
                      F.count_if(F.col("ad_views") > 0).alias("videos_with_ad_views"))


def spike_events(readings: DataFrame, *, min_readings: int = 6, elev_ratio: float = 6,
                 elev_floor: float = 300) -> DataFrame:
    """The latest run of elevated intervals of each long-form video, above its own dormant rate."""
    per_video = Window.partitionBy("video_id")
    steps = own_intervals(settled(readings).where(~F.col("is_short"))).where(F.col("n_points") >= min_readings)
    ranked = (steps.withColumn("rank", F.row_number().over(per_video.orderBy("rate")))
              .withColumn("n", F.count(F.lit(1)).over(per_video)))
    low = F.when(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") / 2)), F.col("rate"))
    based = ranked.withColumn("baseline", F.median(low).over(per_video))
    elevated = F.col("rate") >= F.greatest(F.col("baseline") * elev_ratio, F.lit(elev_floor))
    run = latest_run(based, elevated, order_col="snap_ix")
    return (
        run.groupBy("video_id", "channel_id", "published_at", "baseline").agg(
            F.min("t0").alias("spike_start"),
            F.min_by(F.concat_ws("-", F.date_format("prev_date", "yyyy-MM-dd"), "prev_slot"), "t0").alias("spike_tag"),
            F.count(F.lit(1)).alias("intervals"), F.max("rate").alias("peak"),
            F.sum(F.col("dv") - F.col("baseline") * F.col("dt")).alias("excess"))
        .withColumn("age_at_spike", F.col("spike_start") - F.datediff(F.to_date("published_at"), F.lit("1970-01-01"))))


def unexplained_spikes(events: DataFrame, ads: DataFrame, topic_of: DataFrame, trackers: DataFrame, *,
                       min_age_days: float = 7, max_baseline: float = 150, min_excess: float = 500,
                       min_saturation: float = 0.15) -> DataFrame:
    """Spikes of aged videos outside the ad roster, with the active-story hint."""
    active = trackers.where(F.col("saturation") >= min_saturation).select(
        F.col("term_id").alias("topic_id"), F.lit(True).alias("active")).distinct()
    return (
        events.where((F.col("baseline") <= max_baseline) & (F.col("excess") >= min_excess)
                     & (F.col("age_at_spike") >= min_age_days))
        .join(ads.select("video_id"), "video_id", "left_anti")
        .join(topic_of, "video_id", "left").join(active, "topic_id", "left")
        .select("video_id", "channel_id", "spike_tag", "age_at_spike", "intervals",
                half_up(F.col("baseline")).alias("baseline_per_day"), half_up(F.col("peak")).alias("peak_per_day"),
                F.round(F.col("peak") / F.greatest(F.col("baseline"), F.lit(1.0)), 1).alias("ratio"),
                F.when(F.col("intervals") >= 2, "sustained").otherwise("emerging").alias("status"),
                half_up(F.col("excess")).alias("promoted_views"), "topic_id",
                F.coalesce("active", F.lit(False)).alias("news_likely")))


def known_ad_spikes(events: DataFrame, ads: DataFrame, *, min_age_days: float = 7, min_excess: float = 500) -> DataFrame:
    """The same event test on the roster itself, as a check of the method."""
    return (events.where((F.col("excess") >= min_excess) & (F.col("age_at_spike") >= min_age_days))
            .join(ads.select("video_id"), "video_id", "left_semi")
            .select("video_id", "spike_tag", half_up(F.col("excess")).alias("promoted_views")))


def ad_impact(readings: DataFrame, *, video_id: int | None = None, start: str | None = None, end: str | None = None,
              baseline: float | None = None, threshold: float = 8) -> DataFrame:
    """Views above the organic baseline over the latest run, for one video or for all."""
    if video_id is not None:
        readings = readings.where(F.col("video_id") == video_id)
    per_video = Window.partitionBy("video_id")
    steps = own_intervals(readings)
    middle = steps.withColumn("mid", F.median("rate").over(per_video))
    provisional = F.median(F.when(F.col("rate") <= F.col("mid"), F.col("rate"))).over(per_video)
    steps = middle.withColumn("provisional", provisional)
    trigger = F.greatest(F.col("provisional") * threshold, F.col("provisional") + 50)
    order = per_video.orderBy("snap_ix")
    hot = F.col("rate") > trigger
    island = F.sum(F.when(hot, 0).otherwise(1)).over(order)
    steps = (steps.withColumn("hot", hot).withColumn("island", island)
             .withColumn("last_hot", F.max(F.when(F.col("hot"), F.col("island"))).over(per_video)))
    in_run = F.col("hot") & (F.col("island") == F.col("last_hot"))
    auto = F.min(F.when(in_run, F.col("snap_date"))).over(per_video) if start is None else F.lit(start).cast("date")
    steps = steps.withColumn("auto_from", auto)
    before = F.col("auto_from").isNull() | (F.col("snap_date") < F.col("auto_from"))
    organic: Column = (F.lit(float(baseline)) if baseline is not None else
                       F.coalesce(F.median(F.when(before, F.col("rate"))).over(per_video), F.col("provisional")))
    last = F.max("snap_date").over(per_video) if end is None else F.lit(end).cast("date")
    steps = (steps.withColumn("baseline", organic)
             .withColumn("from_day", F.coalesce("auto_from", F.min("snap_date").over(per_video)))
             .withColumn("to_day", last)
             .where((F.col("snap_date") >= F.col("from_day")) & (F.col("snap_date") <= F.col("to_day"))))
    return (
        steps.groupBy("video_id", "from_day", "to_day", "baseline").agg(
            F.sum("dv").alias("observed"), F.sum("dt").alias("days"))
        .select("video_id", F.date_format("from_day", "yyyy-MM-dd").alias("from_day"),
                F.date_format("to_day", "yyyy-MM-dd").alias("to_day"), "observed", "days",
                F.round("baseline", 3).alias("baseline_per_day"),
                half_up(F.col("observed") - F.col("baseline") * F.col("days")).alias("ad_driven")))
