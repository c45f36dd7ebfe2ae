"""Format statistics per scope: monthly performance, month-to-date comparators, overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.calendar import local_month, same_point, shift_month
from tidegauge.functions.numbers import half_up
from tidegauge.functions.revenue import (FACTOR_HIGH, FACTOR_LOW, FACTOR_MID, ONSET, RPM_SHORT, engaged_views, rpm)
from tidegauge.operators.asof import nearest_snapshot
from tidegauge.operators.stats import interpolated_median, with_scopes

VIEW_FIGURES = ["tot", "med", "engaged", "engaged_med", "lv", "comments", "lrev_lo", "lrev_hi", "srev_lo",
                "srev_hi", "shorts_views", "shorts_med"]


def format_stats(videos: DataFrame, by: list[str], *, onset: str = ONSET) -> DataFrame:
    """The sixteen overview figures per group, long-form and Shorts apart.

    The low revenue estimate divides by the high factor and the other way round.
    All view-based medians share one exact order-statistics pass; lengths are whole
    seconds of a bounded range, so their median is an ordinary aggregate.
    """
    long, short = ~F.col("is_short"), F.col("is_short")
    views = F.coalesce("views", F.lit(0))
    length = F.when(F.col("duration_sec") > 0, F.col("duration_sec"))

    def restated(factor: float) -> Column:
        return engaged_views(F.col("views"), F.col("published_at"), factor, onset=onset)

    def of(cond: Column, value) -> Column:
        return F.when(cond, value)

    def total(cond: Column, value) -> Column:
        return F.coalesce(F.sum(of(cond, value)), F.lit(0))

    sums = videos.groupBy(*by).agg(
        F.count_if(long).alias("n"), total(long, views).alias("tot"),
        half_up(total(long, restated(FACTOR_MID))).alias("engaged"),
        total(long, F.coalesce("comments", F.lit(0))).alias("comments"),
        F.median(of(long, length)).alias("_len"), F.sum(of(long, length)).alias("_run"),
        half_up(total(long, restated(FACTOR_HIGH) / 1000 * rpm(F.col("duration_sec"), "low"))).alias("lrev_lo"),
        half_up(total(long, restated(FACTOR_LOW) / 1000 * rpm(F.col("duration_sec"), "high"))).alias("lrev_hi"),
        half_up(total(short, views / 1000 * RPM_SHORT[0])).alias("srev_lo"),
        half_up(total(short, views / 1000 * RPM_SHORT[1])).alias("srev_hi"),
        F.count_if(short).alias("shorts_n"), total(short, views).alias("shorts_views"))
    liked = long & (F.col("views") > 0) & F.col("likes").isNotNull()
    measures = {"med": of(long, views.cast("double")), "engaged_med": of(long, restated(FACTOR_MID)),
                "lv": of(liked, F.col("likes") / F.col("views")), "shorts_med": of(short, views.cast("double"))}
    stacked = videos.select(*by, F.explode(F.array(*[
        F.struct(F.lit(k).alias("measure"), v.alias("v")) for k, v in measures.items()])).alias("m")).select(*by, "m.*")
    mids = (interpolated_median(stacked, [*by, "measure"], "v").groupBy(*by)
            .agg(*[F.max(F.when(F.col("measure") == k, F.col("median"))).alias(f"_{k}") for k in measures]))
    some = F.col("n") > 0
    return sums.join(mids, by, "left").select(
        *by, "n", "tot", half_up(F.col("_med")).alias("med"), "engaged",
        half_up(F.col("_engaged_med")).alias("engaged_med"),
        F.when(some, F.coalesce(half_up(F.col("_lv") * 1000) / 10, F.lit(0.0))).alias("lv"), "comments",
        F.when(some, F.coalesce(half_up(F.col("_len") / 60 * 10) / 10, F.lit(0.0))).alias("avg_len"),
        F.coalesce(half_up(F.col("_run") / 3600 * 10) / 10, F.lit(0.0)).alias("runtime"),
        "lrev_lo", "lrev_hi", "srev_lo", "srev_hi", "shorts_n", "shorts_views",
        F.coalesce("_shorts_med", F.lit(0.0)).alias("shorts_med"))


def monthly_performance(videos: DataFrame) -> DataFrame:
    """Overview figures per local publish month, for every channel and the network."""
    rows = videos.where(~F.col("unavailable")).withColumn("month", local_month(F.col("published_at")))
    return format_stats(with_scopes(rows), ["scope", "month"])


def peaks(series: DataFrame, *, key: str = "scope", month: str = "month", value: str = "tot") -> DataFrame:
    """Running peak per month and the lowest month since the overall peak (calendar-sized windows)."""
    order = Window.partitionBy(key).orderBy(month)
    whole = Window.partitionBy(key)
    top = F.max(F.struct(F.col(value), F.col(month))).over(whole)
    after = F.when(F.col(month) > top[month], F.struct(F.col(value), F.col(month)))
    return (series.select(key, month, value)
            .withColumn("running_peak", F.max(value).over(order))
            .withColumn("is_new_peak", F.col(value) > F.coalesce(
                F.max(value).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)))
            .withColumn("lowest_since_peak", F.coalesce(F.min(after).over(whole)[month] == F.col(month), F.lit(False))))


def month_comparator(readings: DataFrame, videos: DataFrame, snaps: DataFrame, *, as_of: str,
                     months_back: int, onset: str = ONSET) -> DataFrame:
    """An earlier month as it stood at the same point, per scope.

    Figures come from the snapshot nearest to that point. Without one, only the
    publish-date and length figures are given and the view figures stay unknown.
    """
    at = F.lit(as_of).cast("timestamp")
    target = same_point(at, months_back)
    month = shift_month(local_month(at), -months_back)
    aim = snaps.sparkSession.range(1).select(F.lit("x").alias("label"), target.alias("target"))
    dump_ix = nearest_snapshot(aim, snaps).agg(F.max("snap_ix")).scalar()
    catalogue = videos.where(~F.col("unavailable"))
    lengths = catalogue.select("video_id", "duration_sec")
    cols = ["video_id", "channel_id", "published_at", "views", "likes", "comments", "is_short", "duration_sec"]
    dump = readings.where(F.col("snap_ix") == dump_ix).join(lengths, "video_id").select(*cols, F.lit(True).alias("measured"))
    plain = catalogue.where(dump_ix.isNull() & (F.col("published_at") <= target)) \
        .select(*cols, F.lit(False).alias("measured"))
    rows = dump.unionByName(plain).where(local_month(F.col("published_at")) == month)
    stats = format_stats(with_scopes(rows), ["scope"], onset=onset)
    scopes = with_scopes(videos.select("channel_id").distinct()).select("scope").distinct()
    counts = ["n", "tot", "engaged", "comments", "runtime", "lrev_lo", "lrev_hi", "srev_lo", "srev_hi", "shorts_n",
              "shorts_views", "shorts_med"]
    full = scopes.join(stats, "scope", "left").fillna(0, subset=counts).withColumn("seen", dump_ix.isNotNull())
    return full.select("scope", month.alias("month"), *[
        F.when(F.col("seen"), F.col(c)).alias(c) if c in VIEW_FIGURES else F.col(c)
        for c in stats.columns if c != "scope"])


def format_overview(videos: DataFrame) -> DataFrame:
    """Uploads, views, median length and runtime with live streams as a third format."""
    kind = F.when(F.col("is_live"), "live").when(F.col("is_short"), "short").otherwise("long")
    return (videos.where(~F.col("unavailable")).groupBy("channel_id", kind.alias("format"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("views").alias("views"),
                 F.median("duration_sec").alias("median_sec"), F.sum("duration_sec").alias("runtime_sec")))


def channel_month_deltas(days: DataFrame) -> DataFrame:
    """Change of each channel's totals from one month's last reading to the next."""
    last = days.groupBy("channel_id", F.date_format("day", "yyyy-MM").alias("month")).agg(
        F.max_by(F.struct("channel_views", "subscriber_count", "video_count"), "day").alias("s")) \
        .select("channel_id", "month", "s.*")
    order = Window.partitionBy("channel_id").orderBy("month")
    return last.select("channel_id", "month", *[
        c for n in ("channel_views", "subscriber_count", "video_count")
        for c in (F.col(n), (F.col(n) - F.lag(n).over(order)).alias(f"{n}_delta"))])


def debut_sample(videos: DataFrame, *, as_of: Column | str, hours: float = 24) -> DataFrame:
    """Videos younger than `hours`; a stamp over an hour in the future or unreadable is left out."""
    now = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    at = F.try_to_timestamp("published_text")
    age_us = F.unix_micros(now) - F.unix_micros(at)
    return (videos.withColumn("age_us", age_us)
            .where((F.col("age_us") >= -3600 * 1000000) & (F.col("age_us") <= int(hours * 3600 * 1000000)))
            .withColumn("age_h", F.round(F.col("age_us") / 3600000000.0, 2)).drop("age_us"))
