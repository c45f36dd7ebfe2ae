"""The counting-change benchmark: matched-age points, factor, checks, drift, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.numbers import days_between, half_up
from tidegauge.operators.asof import range_bucket, values_at_ages
from tidegauge.operators.stats import interpolated_median
from tidegauge.session import cut_lineage

CHECK_AGES = [24.0, 12.0, 48.0, 72.0]

#: Draws made from one row of work; a task makes 64 times as many.
DRAWS = 1 << 15


def eligible_videos(videos: DataFrame, ads: DataFrame, *, published_from: str) -> DataFrame:
    """Long-form, available, never advertised, published on or after a date."""
    return (videos.where(~F.col("is_short") & ~F.col("unavailable")
                         & (F.to_date("published_at") >= F.lit(published_from).cast("date")))
            .join(ads.select("video_id"), "video_id", "left_anti"))


def aged_points(readings: DataFrame, eligible: DataFrame, *, debut: DataFrame | None = None,
                ages: list[float] = CHECK_AGES, min_views: int = 500) -> DataFrame:
    """One row per (video, matched age): publish day, views, likes and the like rate per 1,000.

    `debut` holds the hourly samples of young videos (video_id, age_h, views, likes); they are read
    together with the half-daily snapshots, so an age that only they bracket still gives a point.
    Samples without an age or a view count are left out.
    """
    pool = eligible.select("video_id", F.col("channel_id"), F.col("published_at"))
    likes = F.coalesce("likes", F.lit(0)).alias("likes")
    obs = (readings.select("video_id", "captured_at", "views", likes)
           .where(F.col("views") > min_views).join(pool.select("video_id", "published_at"), "video_id")
           .select("video_id", (days_between(F.col("published_at"), F.col("captured_at")) * 24).alias("age_h"),
                   F.lit(1).alias("source"), "views", "likes"))
    if debut is not None:
        obs = obs.unionByName(debut.where((F.col("views") > min_views) & F.col("age_h").isNotNull())
                              .join(pool.select("video_id"), "video_id", "left_semi")
                              .select("video_id", F.col("age_h").cast("double").alias("age_h"),
                                      F.lit(0).alias("source"), "views", likes))
    return (values_at_ages(obs, ages).where(F.col("views") > min_views)
            .join(pool, "video_id")
            .select("video_id", "channel_id", F.to_date("published_at").alias("day"), "age_h",
                    F.col("views").alias("vw"), F.col("likes").alias("lk"),
                    (F.col("likes") * 1000 / F.col("views")).alias("rate")))


def sided(points: DataFrame, *, pre_end: str, onset: str) -> DataFrame:
    """Mark before and after; the announcement days in between belong to neither."""
    side = (F.when(F.col("day") < F.lit(pre_end).cast("date"), "pre")
            .when(F.col("day") >= F.lit(onset).cast("date"), "post"))
    return points.withColumn("side", side)


def enough_points(points: DataFrame, *, min_points: int) -> DataFrame:
    """Only channels with enough matched-age points."""
    big = points.groupBy("channel_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_points)
    return points.join(big.select("channel_id"), "channel_id", "left_semi")


def bucket_series(points: DataFrame, *, start: str, pre_end: str, onset: str, step: int = 5,
                  min_bucket: int = 3) -> DataFrame:
    """Median views and likes per bucket, indexed to the pre-change median = 100."""
    bucket = F.date_format(range_bucket("day", start=start, step=step, forced=onset), "yyyy-MM-dd")
    in_base = F.when(F.col("day") < F.lit(pre_end).cast("date"), F.lit("base"))
    # Both measures of the buckets and of the baseline share one median pass.
    stacked = (points.withColumn("part", F.explode(F.array_compact(F.array(bucket, in_base))))
               .select("channel_id", "part", F.explode(F.array(
                   F.struct(F.lit("vw").alias("measure"), F.col("vw").alias("v")),
                   F.struct(F.lit("lk").alias("measure"), F.col("lk").alias("v")))).alias("m"))
               .select("channel_id", "part", "m.*"))
    mids = (interpolated_median(stacked, ["channel_id", "part", "measure"], "v")
            .groupBy("channel_id", "part").agg(
                F.max("n").alias("n"), *[F.max(F.when(F.col("measure") == k, F.col("median"))).alias(k)
                                         for k in ("vw", "lk")]))
    base = mids.where("part = 'base'").select(
        "channel_id", F.col("vw").alias("base_v"), F.when(F.col("lk") != 0, F.col("lk")).alias("base_l"))
    return (mids.where((F.col("part") != "base") & (F.col("n") >= min_bucket)).join(base, "channel_id")
            .select("channel_id", F.col("part").alias("from_day"), "n",
                    half_up(F.col("vw") * 100 / F.col("base_v")).alias("views"),
                    half_up(F.col("lk") * 100 / F.col("base_l")).alias("likes")))


def rate_factor(points: DataFrame, *, pre_end: str, onset: str, low_rate_pct: float = 6.5) -> DataFrame:
    """Per channel: sizes, low-rate counts, like rate before and after, and their ratio."""
    rows = sided(points, pre_end=pre_end, onset=onset)
    pct = F.round(F.col("lk") * 100 / F.col("vw"), 2)
    low = pct < low_rate_pct
    counts = rows.groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("side") == "post").alias("n_post"),
        F.count_if((F.col("side") == "pre") & low).alias("low_pre"),
        F.count_if((F.col("side") == "post") & low).alias("low_post"),
        half_up(F.sum(F.when(F.col("side") == "post", F.col("vw")))).alias("post_views"))
    mids = (interpolated_median(rows.where("side IS NOT NULL"), ["channel_id", "side"], "rate")
            .groupBy("channel_id").agg(F.max(F.when(F.col("side") == "pre", F.col("median"))).alias("before"),
                                       F.max(F.when(F.col("side") == "post", F.col("median"))).alias("after")))
    return counts.join(mids, "channel_id").select(
        "channel_id", "n", "n_post", "low_pre", "low_post", "post_views",
        F.round("before", 1).alias("rate_before"), F.round("after", 1).alias("rate_after"),
        F.round(F.try_divide("before", "after"), 2).alias("factor"))


def drift_factor(points: DataFrame, *, onset: str) -> DataFrame:
    """Step in ln(rate) beside a linear drift, from one pass of sufficient sums."""
    x = F.datediff("day", F.lit(onset)).cast("double")
    p = F.when(F.col("side") == "post", 1.0).otherwise(0.0)
    y = F.ln("rate")
    s = points.where("side IS NOT NULL").groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(y).alias("ny"),
        F.sum(x).alias("x"), F.sum(x * x).alias("xx"), F.sum(p).alias("p"), F.sum(x * p).alias("xp"),
        F.sum(y).alias("y"), F.sum(x * y).alias("xy"), F.sum(p * y).alias("py"))

    def det(a: list[list[Column]]) -> Column:
        return (a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1])
                - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0])
                + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0]))

    c = F.col
    whole = det([[c("n"), c("x"), c("p")], [c("x"), c("xx"), c("xp")], [c("p"), c("xp"), c("p")]])
    swapped = det([[c("n"), c("x"), c("y")], [c("x"), c("xx"), c("xy")], [c("p"), c("xp"), c("py")]])
    beta = F.try_divide(swapped, whole)
    return s.select("channel_id", F.when(c("ny") == c("n"), F.exp(-beta)).alias("factor"))


def factor_checks(points: DataFrame, *, pre_end: str, onset: str, min_side: int = 15) -> DataFrame:
    """The same question asked nine ways, one row per (channel, check)."""
    rows = sided(points, pre_end=pre_end, onset=onset).where("side IS NOT NULL")
    at = F.datediff("day", F.lit(onset))
    pre, post = F.col("side") == "pre", F.col("side") == "post"
    main = F.col("age_h") == CHECK_AGES[0]

    def near(w: int) -> Column:
        return main & ((pre & (at >= -3 - w)) | (post & (at < w)))

    members = {
        "all": main, "two weeks either side": near(14), "four weeks either side": near(28),
        "last 30 days as baseline": main & (post | (at >= -33)),
        "at 12 hours": F.col("age_h") == 12.0, "at 48 hours": F.col("age_h") == 48.0,
        "at 72 hours": F.col("age_h") == 72.0}
    labelled = rows.withColumn("check", F.explode(F.array_compact(F.array(
        *[F.when(cond, F.lit(name)) for name, cond in members.items()]))))
    mids = interpolated_median(labelled, ["channel_id", "check", "side"], "rate")
    wide = mids.groupBy("channel_id", "check").agg(*[
        F.max(F.when(F.col("side") == s, F.col(v))).alias(f"{v}_{s}") for s in ("pre", "post") for v in ("n", "median")])
    enough = (F.col("n_pre") >= min_side) & (F.col("n_post") >= min_side)
    medians = wide.where(enough & (F.col("check") != "all")).select(
        "channel_id", "check", F.try_divide("median_pre", "median_post").alias("factor"))
    base = rows.where(main)
    ready = base.groupBy("channel_id").agg(F.count_if(pre).alias("n_pre"), F.count_if(post).alias("n_post")) \
        .where(enough).select("channel_id")
    ln = F.ln("rate")

    def total(col: str, cond: Column) -> Column:
        return F.sum(F.when(cond, F.col(col)))

    sums = base.groupBy("channel_id").agg(
        F.when(F.count(ln) == F.count(F.lit(1)),
               F.exp(F.avg(F.when(pre, ln)) - F.avg(F.when(post, ln)))).alias("geometric mean"),
        F.try_divide(F.try_divide(total("lk", pre), total("vw", pre)),
                     F.try_divide(total("lk", post), total("vw", post))).alias("ratio of sums"))
    drift = drift_factor(base, onset=onset).withColumnRenamed("factor", "allowing for drift")
    names = ["geometric mean", "ratio of sums", "allowing for drift"]
    others = (sums.join(drift, "channel_id").join(ready, "channel_id", "left_semi")
              .select("channel_id", F.explode(F.array(*[
                  F.struct(F.lit(n).alias("check"), F.col(n).alias("factor")) for n in names])).alias("c"))
              .select("channel_id", "c.*"))
    return (others.unionByName(medians)
            .where(F.col("factor").isNotNull() & ~F.isnan("factor") & (F.abs("factor") != float("inf")))
            .select("channel_id", "check", F.round("factor", 2).alias("factor")))


def rate_histogram(points: DataFrame, *, pre_end: str, onset: str) -> DataFrame:
    """Like rates in percent, rounded to two places, counted per side.

    The rounding bounds the number of distinct rates, so a channel's histogram stays
    small however many uploads it has.
    """
    rows = sided(points, pre_end=pre_end, onset=onset).where("side IS NOT NULL")
    return rows.groupBy("channel_id", "side", F.round(F.col("lk") * 100 / F.col("vw"), 2).alias("pct")).agg(
        F.count(F.lit(1)).alias("n"))


def _drawn(seed: int, n: Column, *key: Column) -> Column:
    """A number from 0 to n - 1, uniform up to n / 2^40: 40 bits of a digest of the seed and the key, so it can be drawn again anywhere."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in key))), 1, 10), 16, 10).cast("bigint")
    return F.floor(bits.cast("double") * n / float(1 << 40))


def _middle_places(sides: DataFrame, *, seed: int, tasks: int, spread: float | None) -> DataFrame:
    """The two middle draws of every (channel, side, replicate), as places; one that lies outside the counted places is -1 or null.

    `sides` holds (channel_id, side, size, replicate). With `spread`, places are counted up to that many square
    roots of the size from the middle, where the middle draws are nearly always; those before are one count.
    A replicate's draws are made block after block and only counts are kept, so no task holds them all.
    """
    size, middle = F.col("size"), F.col("size") / 2
    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((size - 1) / DRAWS)))
    drawn = (sides.repartition(tasks, "channel_id", "side", "replicate").withColumn("block", block)
             .withColumn("draw", F.explode(F.sequence(F.col("block") * DRAWS + 1, F.least(size, (F.col("block") + 1) * DRAWS))))
             .select("channel_id", "side", "replicate", "size",
                     _drawn(seed, size, F.col("channel_id"), F.col("side"), F.col("replicate"), F.col("draw")).alias("place")))
    if spread is not None:
        reach = F.sqrt(size) * spread
        drawn = drawn.where(F.col("place") <= middle + reach).withColumn(
            "place", F.when(F.col("place") < middle - reach, F.lit(-1).cast("bigint")).otherwise(F.col("place")))
    key = ["channel_id", "side", "replicate", "size"]
    counted = drawn.groupBy(*key, "place").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col("place")))

    return (counted.withColumn("upto", upto).groupBy(*key)
            .agg(at(F.floor((size - 1) / 2)).alias("low"), at(F.floor(size / 2)).alias("high")))


def bootstrap_factors(histogram: DataFrame, *, replicates: int = 4000, seed: int = 20260907) -> DataFrame:
    """One factor per (channel, replicate); null where the post side's median is zero.

    A replicate draws as many uploads as a side has, with replacement. Each draw depends on nothing but
    its own number, so replicates are spread over as many tasks as there are draws to make, and a task that
    is run again draws the same. Draws are places in the sorted rates; only those in the middle are looked
    up in the histogram, which holds a row for each rate of two decimals. Channels without uploads on one
    side have no rows.
    """
    # how many uploads lie up to each rate; a side has one row for each rate of two decimals
    upto = F.sum("n").over(Window.partitionBy("channel_id", "side").orderBy("pct"))
    sides = histogram.withColumn("upto", upto).groupBy("channel_id", "side").agg(
        F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct("pct", "upto"))).alias("bars"))
    both = sides.groupBy("channel_id").agg(F.count(F.lit(1)).alias("k")).where("k = 2").select("channel_id")
    sides = cut_lineage(sides.join(both, "channel_id", "left_semi"))
    uploads = sides.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # a fixed number of parts: the rows are few and small, and would else be put together in one task
    tasks = max(1, -(-uploads * replicates // (64 * DRAWS)))
    wanted = sides.select("channel_id", "side", "size", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    middle = cut_lineage(_middle_places(wanted, seed=seed, tasks=tasks, spread=3.0))
    missed = middle.where("low IS NULL OR high IS NULL OR low < 0 OR high < 0")
    if not missed.isEmpty():
        again = _middle_places(missed.drop("low", "high"), seed=seed, tasks=tasks, spread=None)
        middle = middle.where("low >= 0 AND high >= 0").unionByName(again)
    lookup = sides.select("channel_id", "side", F.col("bars.pct").alias("rates"), F.col("bars.upto").alias("ends"))

    def at(place: str) -> Column:
        return F.get("rates", F.size(F.filter("ends", lambda e: e <= F.col(place))))

    medians = middle.join(lookup, ["channel_id", "side"]).select("channel_id", "side", "replicate", ((at("low") + at("high")) / 2).alias("mid"))
    wide = medians.groupBy("channel_id", F.col("replicate").cast("bigint").alias("replicate")).agg(
        F.max(F.when(F.col("side") == "pre", F.col("mid"))).alias("pre"), F.max(F.when(F.col("side") == "post", F.col("mid"))).alias("post"))
    return wide.select("channel_id", "replicate", F.when(F.col("post") > 0, F.col("pre") / F.col("post")).alias("factor"))


def bootstrap_interval(draws: DataFrame, factors: DataFrame, checks: DataFrame, *, replicates: int = 4000) -> DataFrame:
    """2.5 % and 97.5 % of the replicates per channel, then widened by every check."""
    filled = (draws.join(factors.select("channel_id", F.col("factor").alias("own")), "channel_id")
              .withColumn("f", F.coalesce("factor", "own")))
    order = Window.partitionBy("channel_id").orderBy("f", "replicate")
    ranked = filled.withColumn("rn", F.row_number().over(order))
    lo, hi = int(replicates * 0.025) + 1, int(replicates * 0.975) + 1
    interval = ranked.groupBy("channel_id").agg(
        F.round(F.max(F.when(F.col("rn") == lo, F.col("f"))), 2).alias("sample_low"),
        F.round(F.max(F.when(F.col("rn") == hi, F.col("f"))), 2).alias("sample_high"))
    alt = checks.groupBy("channel_id").agg(F.min("factor").alias("alt_low"), F.max("factor").alias("alt_high"))
    return interval.join(alt, "channel_id", "left").select(
        "channel_id", "sample_low", "sample_high",
        F.least("sample_low", "alt_low").alias("low"), F.greatest("sample_high", "alt_high").alias("high"))


def pooled_interval(draws: DataFrame, factors: DataFrame, *, replicates: int = 4000) -> DataFrame:
    """View-weighted factor over the channels and the interval of its replicates."""
    own = factors.select("channel_id", "post_views", F.col("factor").alias("own"), "n_post")
    per_draw = (draws.join(own, "channel_id")
                .groupBy("replicate").agg(
                    (F.sum(F.col("post_views") * F.coalesce("factor", "own")) / F.sum("post_views")).alias("f")))
    ranked = per_draw.withColumn("rn", F.row_number().over(Window.orderBy("f", "replicate")))
    lo, hi = int(replicates * 0.025) + 1, int(replicates * 0.975) + 1
    point = pooled_factor(factors)
    return ranked.agg(F.round(F.max(F.when(F.col("rn") == lo, F.col("f"))), 2).alias("low"),
                      F.round(F.max(F.when(F.col("rn") == hi, F.col("f"))), 2).alias("high")).select(
        point.select("factor").scalar().alias("factor"), point.select("n_post").scalar().alias("n_post"), "low", "high")


def site_record(factors: DataFrame, intervals: DataFrame, checks: DataFrame, *, benchmark: str) -> DataFrame:
    """The figures a site prints: those of the benchmark channel, or of the first one if it is not measured."""
    chosen = factors.agg(F.min_by("channel_id", F.struct((F.col("channel_id") != benchmark).cast("int"), F.col("channel_id"))).alias("channel_id"))
    alt = checks.groupBy("channel_id").agg(F.count(F.lit(1)).alias("checks"), F.min("factor").alias("check_min"), F.max("factor").alias("check_max"))
    return (chosen.join(factors.select("channel_id", "factor", "n_post"), "channel_id").join(intervals, "channel_id").join(alt, "channel_id", "left")
            .select("channel_id", "factor", "low", "high", "n_post", "sample_low", "sample_high",
                    F.coalesce("checks", F.lit(0)).cast("bigint").alias("checks"), "check_min", "check_max"))


def pooled_factor(factors: DataFrame) -> DataFrame:
    return factors.agg(
        F.round(F.sum(F.col("post_views") * F.col("factor")) / F.sum("post_views"), 2).alias("factor"),
        F.sum("n_post").alias("n_post"))
