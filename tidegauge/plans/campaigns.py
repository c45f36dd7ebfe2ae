"""Campaign records, the ad roster, and what a campaign day yields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.numbers import half_up
from tidegauge.operators.asof import busy_days, fill_forward_days, next_start
from tidegauge.operators.blocks import global_rank
from tidegauge.operators.series import last_read_of_day
from tidegauge.session import cut_lineage


def merge_creatives(history: DataFrame, capture: DataFrame, *, seen: str) -> DataFrame:
    """Fold one capture of the ad listing into the creative history.

    Known creatives widen their dates, vanished ones stay, and a new creative takes over at most
    one legacy row of the same video and first day; an unknown first day matches an unknown one.
    Legacy rows and new creatives are paired by their rank within (video, first day), which may
    hold any number of rows. A creative listed more than once counts once, with its widest dates.
    """
    found = (capture.where("video_id IS NOT NULL").groupBy("creative_id")
             .agg(F.min("video_id").alias("video_id"), F.min("first_day").alias("first_day"),
                  F.max("last_day").alias("last_day")))
    group = ["video_id", "first_day"]
    fresh = found.join(history.select("creative_id"), "creative_id", "left_anti").select("creative_id", *group)
    legacy = history.where(F.col("creative_id").startswith("legacy:")).select(
        F.col("creative_id").alias("legacy_id"), *group)
    new = global_rank(fresh, group, ["creative_id"]).alias("new")
    old = global_rank(legacy, group, ["legacy_id"]).alias("old")
    claims = (
        new.join(old, (F.col("new.video_id") == F.col("old.video_id"))
                 & F.col("new.first_day").eqNullSafe(F.col("old.first_day"))
                 & (F.col("new.place") == F.col("old.place")))
        .select("creative_id", "legacy_id"))
    kept = (history.join(claims.select(F.col("legacy_id").alias("creative_id"), F.col("creative_id").alias("claimed_by")),
                         "creative_id", "left")
            .select(F.coalesce("claimed_by", "creative_id").alias("creative_id"), "video_id", "first_day", "last_day",
                    "seen_day"))
    listed = found.select("creative_id", F.col("video_id").alias("v"), F.col("first_day").alias("f"),
                          F.col("last_day").alias("l"))
    return (
        kept.join(listed, "creative_id", "full")
        .select("creative_id", F.coalesce("v", "video_id").alias("video_id"),
                F.least("first_day", "f").alias("first_day"), F.greatest("last_day", "l").alias("last_day"),
                F.when(F.col("v").isNotNull(), F.lit(seen).cast("date")).otherwise(F.col("seen_day")).alias("seen_day")))


def campaign_rollup(creatives: DataFrame) -> DataFrame:
    """Per video: runs, complete windows and their list (bounded by the calendar), first and last day shown."""
    whole = F.col("first_day").isNotNull() & F.col("last_day").isNotNull()
    span = F.concat(F.date_format("first_day", "yyyy-MM-dd"), F.lit(".."), F.date_format("last_day", "yyyy-MM-dd"))
    return (creatives.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(whole).alias("windows"),
        F.array_join(F.sort_array(F.collect_set(F.when(whole, span))), ",").alias("spans"),
        F.min(F.when(whole, F.col("first_day"))).alias("first_day"),
        F.max(F.when(whole, F.col("last_day"))).alias("last_day")))


def tracking_from(rollup: DataFrame) -> DataFrame:
    return rollup.agg(F.min("first_day").alias("tracking_from"), F.count(F.lit(1)).alias("videos"),
                      F.sum("runs").alias("creatives"))


def reconcile_roster(flagged: DataFrame, evidenced: DataFrame, harvested: DataFrame, videos: DataFrame) -> DataFrame:
    """Missing, stale, unevidenced and unknown ids, one row per (video, status)."""
    def marked(df: DataFrame, name: str) -> DataFrame:
        return df.select("video_id", F.lit(name).alias("source"))

    seen = (marked(flagged, "flagged").unionByName(marked(evidenced, "evidenced"))
            .unionByName(marked(harvested, "harvested")).unionByName(marked(videos, "known")))

    def has(name: str):
        return F.bool_or(F.col("source") == name).alias(name)

    flags = seen.groupBy("video_id").agg(*[has(n) for n in ("flagged", "evidenced", "harvested", "known")])
    missing = F.col("evidenced") & ~F.col("flagged")
    status = F.array_compact(F.array(
        F.when(missing, "missing"),
        F.when(missing & ~F.col("known"), "unknown"),
        F.when(F.col("flagged") & ~F.col("harvested") & ~F.col("evidenced"), "stale"),
        F.when(F.col("harvested") & ~F.col("flagged") & ~F.col("evidenced"), "unevidenced")))
    return flags.select("video_id", F.explode(status).alias("status"))


def placed_additions(reconciled: DataFrame, videos: DataFrame) -> DataFrame:
    """Missing ids that can be placed on a channel; the others are skipped."""
    return (reconciled.where("status = 'missing'")
            .join(videos.select("video_id", "channel_id"), "video_id")
            .select("channel_id", "video_id"))


def campaign_days(windows: DataFrame) -> DataFrame:
    """Advertised days per video; overlapping windows count twice."""
    whole = windows.where("win_from IS NOT NULL AND win_to IS NOT NULL")
    return whole.groupBy("video_id").agg(F.sum(F.datediff("win_to", "win_from") + 1).alias("days"))


def measurable_windows(windows: DataFrame, videos: DataFrame, *, era_from: str, era_to: str,
                       age_min: int = 14) -> DataFrame:
    """Windows inside the snapshot era on videos old enough to separate paid from launch traffic."""
    return (windows.where((F.col("win_from") >= F.lit(era_from).cast("date")) & (F.col("win_to") <= F.lit(era_to).cast("date")))
            .join(videos.select("video_id", "published_at"), "video_id")
            .where(F.datediff("win_from", F.to_date("published_at")) >= age_min).drop("published_at"))


def dormant_baseline(starts: DataFrame, filled: DataFrame, busy: DataFrame, *, min_gains: int = 3) -> DataFrame:
    """Upper median of the daily gains in the fortnight before each start, busy days left out.

    `starts` holds distinct (video_id, win_from); each has at most 13 day pairs.
    """
    pairs = starts.select("video_id", "win_from", F.explode(F.sequence(F.lit(2), F.lit(14))).alias("i")) \
        .withColumn("day_a", F.date_sub("win_from", F.col("i"))) \
        .withColumn("day_b", F.date_sub("win_from", F.col("i") - 1))
    for side in ("day_a", "day_b"):
        pairs = pairs.join(busy.select("video_id", F.col("day").alias(side)), ["video_id", side], "left_anti")
    for side, name in (("day_a", "va"), ("day_b", "vb")):
        pairs = pairs.join(filled.select("video_id", F.col("day").alias(side), F.col("views").alias(name)),
                           ["video_id", side])
    gains = pairs.where("vb >= va").groupBy("video_id", "win_from").agg(
        F.array_sort(F.collect_list(F.col("vb") - F.col("va"))).alias("gains"))
    return gains.where(F.size("gains") >= min_gains).select(
        "video_id", "win_from",
        F.element_at("gains", (F.floor(F.size("gains") / 2) + 1).cast("int")).alias("base"))


def campaign_yield(readings: DataFrame, videos: DataFrame, windows: DataFrame, *, era_from: str, era_to: str,
                   age_min: int = 14, tail_days: int = 2, lookback: int = 4) -> DataFrame:
    """Ad-driven views per campaign day for every completed, measurable window."""
    whole = windows.where("win_from IS NOT NULL AND win_to IS NOT NULL")
    # Both are small next to the readings and are looked up several times below.
    candidates = cut_lineage(measurable_windows(whole, videos, era_from=era_from, era_to=era_to, age_min=age_min))
    ids = candidates.select("video_id").distinct()
    mine = whole.join(ids, "video_id", "left_semi")
    daily = last_read_of_day(readings.join(ids, "video_id", "left_semi"))
    filled = cut_lineage(fill_forward_days(daily, lookback=lookback))
    base = dormant_baseline(candidates.select("video_id", "win_from").distinct(), filled,
                            busy_days(mine, tail_days=tail_days))
    end = F.date_add("win_to", tail_days)
    end = F.when(end >= F.col("next_start"), F.date_sub("next_start", 1)).otherwise(end)
    end = F.greatest(F.least(end, F.lit(era_to).cast("date")), F.col("win_to"))
    closed = (
        candidates.where(F.col("win_to") != F.lit(era_to).cast("date"))
        .join(next_start(mine), ["video_id", "win_to"], "left")
        .withColumn("observed_to", end)
        .withColumn("before", F.date_sub("win_from", 1))
        .withColumn("days", (F.datediff("win_to", "win_from") + 1).cast("bigint"))
        .withColumn("observed_days", (F.datediff("observed_to", "win_from") + 1).cast("bigint")))
    v0 = filled.select("video_id", F.col("day").alias("before"), F.col("views").alias("v0"))
    v1 = filled.select("video_id", F.col("day").alias("observed_to"), F.col("views").alias("v1"))
    return (
        closed.join(base, ["video_id", "win_from"]).join(v0, ["video_id", "before"]).join(v1, ["video_id", "observed_to"])
        .withColumn("gain", F.col("v1") - F.col("v0"))
        .withColumn("ad_views", F.greatest(F.lit(0), F.col("gain") - F.col("base") * F.col("observed_days")))
        .select("video_id", "win_from", "win_to", "days", "observed_to", "observed_days", "gain",
                F.col("base").alias("baseline_per_day"), "ad_views",
                half_up(F.col("ad_views") / F.col("days")).alias("per_day")))


def yield_rate(measured: DataFrame, *, min_sample: int = 3) -> DataFrame:
    """Low, pooled and high views per campaign day; nothing below the minimum sample."""
    return measured.agg(
        F.count(F.lit(1)).alias("campaigns"), F.sum("days").alias("campaign_days"), F.sum("ad_views").alias("ad_views"),
        F.min("per_day").alias("low"), half_up(F.sum("ad_views") / F.sum("days")).alias("central"),
        F.max("per_day").alias("high")).where(F.col("campaigns") >= min_sample)


def spend_estimate(rate: DataFrame, days: DataFrame, *, cpv: tuple[float, float] = (0.015, 0.04)) -> DataFrame:
    """Estimated ad views and spend range per video."""
    central = rate.select("central").scalar()
    views = F.col("ad_views")
    return days.withColumn("ad_views", F.col("days") * central).select(
        "video_id", "days", views, half_up(views * cpv[0]).alias("spend_low"), half_up(views * cpv[1]).alias("spend_high"))
