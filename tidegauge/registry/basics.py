"""The plain joins, aggregates, windows and sorts the products are built from."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegauge.functions import numbers as N
from tidegauge.functions import text as X
from tidegauge.functions.revenue import rpm
from tidegauge.operators import asof, blocks, series, stats
from tidegauge.registry.base import query, sql
from tidegauge.registry.series import _DAILY, _snaps
from tidegauge.registry.text import _TOK_WHOLE
from tidegauge.sources import tables as T

QUERIES: dict = {}
ORACLE: dict = {}


# ---- joins ----
@query(QUERIES, "jn1_lookup")
def jn1(spark, sf):
    items = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts = T.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    shops = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return items.join(parts, "l_partkey").join(shops, "l_suppkey", "left")


ORACLE["jn1_lookup"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name, s_name FROM lineitem JOIN part ON p_partkey = l_partkey
LEFT JOIN supplier ON s_suppkey = l_suppkey"""


@query(QUERIES, "jn2_exclude_ads")
def jn2(spark, sf):
    return T.videos(spark, sf).join(T.ad_videos(spark, sf).select("video_id"), "video_id", "left_anti").select("video_id", "views")


ORACLE["jn2_exclude_ads"] = sql("SELECT video_id, views FROM videos WHERE video_id NOT IN (SELECT video_id FROM ads)", "videos", "ads")


@query(QUERIES, "jn3_only_candidates")
def jn3(spark, sf):
    return T.readings(spark, sf).join(T.creatives(spark, sf).select("video_id"), "video_id", "left_semi").select("video_id", "snap_ix", "views")


ORACLE["jn3_only_candidates"] = sql(
    "SELECT video_id, snap_ix, views FROM readings WHERE video_id IN (SELECT video_id FROM creatives)", "readings", "creatives")


@query(QUERIES, "jn4_adjacent_snapshots")
def jn4(spark, sf):
    return series.adjacent_intervals(T.readings(spark, sf)).select("video_id", "snap_ix", "delta", F.round("dt", 6).alias("dt"))


ORACLE["jn4_adjacent_snapshots"] = sql("SELECT video_id, snap_ix, delta, round(dt, 6) AS dt FROM adj_iv", "adj_iv")


@query(QUERIES, "jn10_range_buckets")
def jn10(spark, sf):
    o = T.table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    bucket = asof.range_bucket("day", start="1995-01-01", step=5, forced="1998-08-27")
    return o.groupBy(F.date_format(bucket, "yyyy-MM-dd").alias("from_day")).agg(F.count(F.lit(1)).alias("n"))


ORACLE["jn10_range_buckets"] = """
SELECT strftime(CASE WHEN day >= DATE '1998-08-27' AND reg < DATE '1998-08-27' THEN DATE '1998-08-27' ELSE reg END, '%Y-%m-%d') AS from_day, count(*) AS n
FROM (SELECT day, DATE '1995-01-01' + CAST(floor(date_diff('day', DATE '1995-01-01', day) / 5) * 5 AS INTEGER) AS reg
      FROM (SELECT CAST(o_orderdate AS DATE) AS day FROM orders) d) b GROUP BY 1"""


# ---- aggregates ----
@query(QUERIES, "ag1_totals")
def ag1(spark, sf):
    v = T.order_videos(spark, sf)
    return v.groupBy("channel_id", "is_short").agg(F.count(F.lit(1)).alias("n"), F.sum("views").alias("views"),
                                                   F.min("views").alias("low"), F.max("views").alias("high"))


ORACLE["ag1_totals"] = sql("""
SELECT channel_id, is_short, count(*) AS n, CAST(sum(views) AS BIGINT) AS views, min(views) AS low, max(views) AS high FROM order_videos GROUP BY ALL""", "order_videos")


@query(QUERIES, "ag2_interpolated_median")
def ag2(spark, sf):
    return stats.interpolated_median(T.order_videos(spark, sf), ["channel_id", "is_short"], "views")


ORACLE["ag2_interpolated_median"] = sql(
    "SELECT channel_id, is_short, count(*) AS n, median(views) AS median FROM order_videos GROUP BY ALL", "order_videos")


@query(QUERIES, "ag3_upper_median")
def ag3(spark, sf):
    return stats.upper_median(T.order_videos(spark, sf), ["channel_id"], "views")


ORACLE["ag3_upper_median"] = sql("""
SELECT channel_id, len(v) AS n, v[len(v) // 2 + 1] AS median FROM (SELECT channel_id, list_sort(list(views)) AS v FROM order_videos GROUP BY channel_id) x""", "order_videos")


@query(QUERIES, "ag4_lower_half_median")
def ag4(spark, sf):
    return stats.lower_half_median(series.own_intervals(T.readings(spark, sf)), ["video_id"], "rate").select(
        "video_id", F.round("baseline", 6).alias("baseline"))


ORACLE["ag4_lower_half_median"] = sql("""
SELECT video_id, round(median(rate), 6) AS baseline FROM (
  SELECT video_id, rate, row_number() OVER (PARTITION BY video_id ORDER BY rate) AS rk, count(*) OVER (PARTITION BY video_id) AS n FROM own_iv) x
WHERE rk <= greatest(1, n // 2) GROUP BY video_id""", "own_iv")


@query(QUERIES, "ag5_median_below_median")
def ag5(spark, sf):
    w = Window.partitionBy("video_id")
    r = series.own_intervals(T.readings(spark, sf)).withColumn("mid", F.median("rate").over(w))
    return r.where(F.col("rate") <= F.col("mid")).groupBy("video_id").agg(F.round(F.median("rate"), 6).alias("provisional"))


ORACLE["ag5_median_below_median"] = sql("""
SELECT video_id, round(median(rate), 6) AS provisional FROM (SELECT video_id, rate, median(rate) OVER (PARTITION BY video_id) AS mid FROM own_iv) x
WHERE rate <= mid GROUP BY video_id""", "own_iv")


@query(QUERIES, "ag6_floor_rank_quantiles")
def ag6(spark, sf):
    return stats.floor_rank_quantiles(T.order_videos(spark, sf), ["channel_id"], "views", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


ORACLE["ag6_floor_rank_quantiles"] = sql("""
SELECT channel_id, len(v) AS n, v[CAST(floor(0.1::DOUBLE * (len(v) - 1)) AS INTEGER) + 1] AS p10, v[CAST(floor(0.5::DOUBLE * (len(v) - 1)) AS INTEGER) + 1] AS p50,
       v[CAST(floor(0.9::DOUBLE * (len(v) - 1)) AS INTEGER) + 1] AS p90
FROM (SELECT channel_id, list_sort(list(views)) AS v FROM order_videos GROUP BY channel_id) x""", "order_videos")


@query(QUERIES, "ag7_mode_low")
def ag7(spark, sf):
    return stats.mode_low(T.table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity")


ORACLE["ag7_mode_low"] = """
SELECT l_suppkey, min(struct_pack(a := -n, q := l_quantity)).q AS mode FROM (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL) c GROUP BY l_suppkey"""


@query(QUERIES, "ag8_variation")
def ag8(spark, sf):
    r = series.adjacent_intervals(T.readings(spark, sf))
    return r.groupBy("video_id").agg(F.round(F.try_divide(F.stddev_pop("delta"), F.median("delta")), 6).alias("cv"))


ORACLE["ag8_variation"] = sql(
    "SELECT video_id, round(stddev_pop(delta) / nullif(median(delta), 0), 6) AS cv FROM adj_iv GROUP BY video_id", "adj_iv")


@query(QUERIES, "ag9_three_averages")
def ag9(spark, sf):
    v = T.order_videos(spark, sf).where("likes > 0 AND views > 0").withColumn("rate", F.col("likes") / F.col("views"))
    mid = stats.interpolated_median(v, ["channel_id"], "rate", "mid").drop("n")
    return (v.groupBy("channel_id").agg((F.sum("likes") / F.sum("views")).alias("s"), F.exp(F.avg(F.ln("rate"))).alias("g"))
            .join(mid, "channel_id")
            .select("channel_id", F.round("s", 6).alias("ratio_of_sums"), F.round("mid", 6).alias("median_of_ratios"), F.round("g", 6).alias("geometric_mean")))


ORACLE["ag9_three_averages"] = sql("""
SELECT channel_id, round(sum(likes) / sum(views), 6) AS ratio_of_sums, round(median(likes / views), 6) AS median_of_ratios, round(exp(avg(ln(likes / views))), 6) AS geometric_mean
FROM order_videos WHERE likes > 0 AND views > 0 GROUP BY channel_id""", "order_videos")


@query(QUERIES, "ag11_scoped_totals")
def ag11(spark, sf):
    return stats.with_scopes(T.order_videos(spark, sf)).groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.sum("views").alias("views"))


ORACLE["ag11_scoped_totals"] = sql("""
SELECT coalesce(channel_id, 'ALL') AS scope, count(*) AS n, CAST(sum(views) AS BIGINT) AS views FROM order_videos GROUP BY ROLLUP (channel_id)""", "order_videos")


@query(QUERIES, "ag13_document_frequency")
def ag13(spark, sf):
    v = T.text_videos(spark, sf).select("channel_id", X.story_tokens(F.col("description"), opener_chars=None).alias("tokens"))
    return v.select("channel_id", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("channel_id", "term").agg(F.count(F.lit(1)).alias("videos"))


ORACLE["ag13_document_frequency"] = sql("""
SELECT channel_id, term, count(*) AS videos FROM (SELECT channel_id, unnest(list_distinct(t)) AS term FROM toks) x GROUP BY ALL""", "text_videos", toks=_TOK_WHOLE)


@query(QUERIES, "ag15_latest_record")
def ag15(spark, sf):
    e = T.table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"), F.max_by("event_type", "event_id").alias("last_type"))


ORACLE["ag15_latest_record"] = """
SELECT user_id, min_by(event_type, event_id) AS first_type, max_by(event_type, event_id) AS last_type FROM events GROUP BY user_id"""


# ---- windows ----
@query(QUERIES, "wn1_interval_rates")
def wn1(spark, sf):
    return series.own_intervals(T.readings(spark, sf)).select(
        "video_id", "snap_ix", "dv", "dt", F.round("rate", 6).alias("rate"), F.greatest(F.lit(0), F.col("dv")).alias("clamped"))


ORACLE["wn1_interval_rates"] = sql("""
SELECT video_id, snap_ix, dv, dt, round(rate, 6) AS rate, greatest(0, dv) AS clamped FROM own_iv""", "own_iv")


@query(QUERIES, "wn4_first_appearances")
def wn4(spark, sf):
    """Gains of uploads seen for the first time, next to all others."""
    g = series.daily_gains(T.readings(spark, sf), _snaps(spark, sf))
    debut = F.datediff("label_date", F.to_date("published_at")) <= 1
    return g.groupBy(F.date_format("label_date", "yyyy-MM-dd").alias("label_date"), debut.alias("debut")).agg(F.sum("gain").alias("gain"))


ORACLE["wn4_first_appearances"] = sql("""
SELECT strftime(label_date, '%Y-%m-%d') AS label_date, date_diff('day', CAST(published_at AS DATE), label_date) <= 1 AS debut, CAST(sum(gain) AS BIGINT) AS gain
FROM (SELECT *, CASE WHEN prev_ix = day_ix - 1 THEN views - prev_views WHEN published_at > prev_captured THEN views END AS gain FROM dated WHERE label_date IS NOT NULL) x
WHERE gain > 0 GROUP BY 1, 2""", "readings", "axis", **{k: _DAILY[k] for k in ("days", "dated")})


@query(QUERIES, "wn5_latest_run")
def wn5(spark, sf):
    r = series.latest_run(series.own_intervals(T.readings(spark, sf)), F.col("rate") >= 900, order_col="snap_ix")
    return r.groupBy("video_id").agg(F.min("snap_ix").alias("first_ix"), F.max("snap_ix").alias("last_ix"), F.count(F.lit(1)).alias("n"))


_LATEST = """
SELECT video_id, min(snap_ix) AS first_ix, max(snap_ix) AS last_ix, count(*) AS n
FROM (SELECT *, max(CASE WHEN {c} THEN isl END) OVER (PARTITION BY video_id) AS top FROM (
  SELECT *, sum(CASE WHEN {c} THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY snap_ix) AS isl FROM own_iv) a) b
WHERE {c} AND isl = top GROUP BY video_id"""
ORACLE["wn5_latest_run"] = sql(_LATEST.format(c="rate >= 900"), "own_iv")


@query(QUERIES, "wn6_latest_block_strict")
def wn6(spark, sf):
    r = series.latest_run(series.own_intervals(T.readings(spark, sf)), F.col("rate") > 400, order_col="snap_ix")
    return r.groupBy("video_id").agg(F.min("snap_ix").alias("first_ix"), F.max("snap_ix").alias("last_ix"), F.count(F.lit(1)).alias("n"))


ORACLE["wn6_latest_block_strict"] = sql(_LATEST.format(c="rate > 400"), "own_iv")


@query(QUERIES, "wn7_gap_tolerant_runs")
def wn7(spark, sf):
    order = Window.partitionBy("video_id").orderBy("snap_ix")
    steps = series.adjacent_intervals(T.readings(spark, sf)).withColumn("rn", F.row_number().over(order))
    runs = series.gap_tolerant_runs(steps.where("delta >= 300"), tolerance=2)
    return runs.groupBy("video_id", F.col("run_no").cast("bigint").alias("run_no")).agg(
        F.min("snap_ix").alias("first_ix"), F.max("snap_ix").alias("last_ix"), F.count(F.lit(1)).alias("bursts"))


ORACLE["wn7_gap_tolerant_runs"] = sql("""
SELECT video_id, CAST(run_no AS BIGINT) AS run_no, min(snap_ix) AS first_ix, max(snap_ix) AS last_ix, count(*) AS bursts FROM (
  SELECT *, sum(CASE WHEN jump IS NULL OR jump > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY rn) AS run_no FROM (
    SELECT *, rn - lag(rn) OVER (PARTITION BY video_id ORDER BY rn) AS jump FROM (
      SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY snap_ix) AS rn FROM adj_iv) a WHERE delta >= 300) b) c GROUP BY 1, 2""", "adj_iv")


@query(QUERIES, "wn9_trailing_split")
def wn9(spark, sf):
    newest = Window.partitionBy("video_id").orderBy(F.desc("snap_ix"))
    g = series.adjacent_intervals(T.readings(spark, sf)).withColumn("rn", F.row_number().over(newest))
    s = g.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("rn") <= 8, F.col("delta"))).alias("recent"),
                                  F.sum(F.when(F.col("rn") > 8, F.col("delta"))).alias("earlier"))
    return s.where("n >= 18")


ORACLE["wn9_trailing_split"] = sql("""
SELECT video_id, count(*) AS n, CAST(sum(CASE WHEN rn <= 8 THEN delta END) AS BIGINT) AS recent, CAST(sum(CASE WHEN rn > 8 THEN delta END) AS BIGINT) AS earlier
FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY snap_ix DESC) AS rn FROM adj_iv) x GROUP BY video_id HAVING count(*) >= 18""", "adj_iv")


@query(QUERIES, "wn11_collapse_equal")
def wn11(spark, sf):
    """Observations whose value differs from the one before, whatever the size of a user."""
    e = T.table(spark, sf, "events").select("user_id", "event_id", "event_type")
    seen = blocks.previous_row(e, "user_id", "event_id", ["event_type"])
    return seen.where(F.col("prev_event_type").isNull() | (F.col("prev_event_type") != F.col("event_type"))).select("user_id", "event_id", "event_type")


ORACLE["wn11_collapse_equal"] = """
SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) x WHERE p IS NULL OR p <> event_type"""


@query(QUERIES, "wn16_reading_index")
def wn16(spark, sf):
    last = _snaps(spark, sf).agg(F.max("snap_ix")).scalar()
    return T.readings(spark, sf).where(F.col("snap_ix") == F.greatest(F.lit(0), last + 1 - 14)).select("video_id", "snap_ix", "views")


ORACLE["wn16_reading_index"] = sql(
    "SELECT video_id, snap_ix, views FROM readings WHERE snap_ix = (SELECT greatest(0, max(snap_ix) - 13) FROM axis)", "readings", "axis")


# ---- sorts and limits ----
@query(QUERIES, "sl1_sorted_by_gain")
def sl1(spark, sf):
    g = series.adjacent_intervals(T.readings(spark, sf)).groupBy("video_id").agg(F.sum("delta").alias("gain"))
    return g.orderBy(F.desc("gain"), "video_id")


ORACLE["sl1_sorted_by_gain"] = sql(
    "SELECT video_id, CAST(sum(delta) AS BIGINT) AS gain FROM adj_iv GROUP BY video_id ORDER BY gain DESC, video_id", "adj_iv")


@query(QUERIES, "sl2_multi_key_rank")
def sl2(spark, sf):
    w = Window.partitionBy("channel_id").orderBy(F.desc("likes"), F.desc("views"), "video_id")
    v = T.order_videos(spark, sf).where("likes IS NOT NULL")
    return v.withColumn("position", F.row_number().over(w).cast("bigint")).where("position <= 10").select("channel_id", "video_id", "position")


ORACLE["sl2_multi_key_rank"] = sql("""
SELECT channel_id, video_id, position FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY likes DESC, views DESC, video_id) AS position
FROM order_videos WHERE likes IS NOT NULL) x WHERE position <= 10""", "order_videos")


@query(QUERIES, "sl3_top_100")
def sl3(spark, sf):
    return T.order_videos(spark, sf).orderBy(F.desc("views"), "video_id").limit(100).select("video_id", "views")


ORACLE["sl3_top_100"] = sql("SELECT video_id, views FROM order_videos ORDER BY views DESC, video_id LIMIT 100", "order_videos")


# ---- scalar functions not shown elsewhere ----
@query(QUERIES, "fn7_rpm_bands")
def fn7(spark, sf):
    d = F.when(F.col("video_id") % 10 == 0, 0).otherwise(F.col("duration_sec"))
    return T.order_videos(spark, sf).groupBy(rpm(d, "low").alias("low"), rpm(d, "high").alias("high")).agg(F.count(F.lit(1)).alias("n"))


ORACLE["fn7_rpm_bands"] = sql("""
SELECT CASE WHEN d >= 480 THEN 0.85::DOUBLE WHEN d >= 180 THEN 0.5 ELSE 0.3 END AS low, CASE WHEN d >= 480 THEN 1.28::DOUBLE WHEN d >= 180 THEN 1.0 ELSE 0.6 END AS high, count(*) AS n
FROM (SELECT CASE WHEN video_id % 10 = 0 THEN 600 ELSE duration_sec END AS d FROM order_videos) x GROUP BY 1, 2""", "order_videos")


@query(QUERIES, "fn19_tidy_labels")
def fn19(spark, sf):
    label = F.concat(F.lit("  "), F.regexp_replace("p_name", " ", "’s "), F.when(F.col("p_partkey") % 2 == 0, "�").otherwise(""), F.lit(" "))
    return T.table(spark, sf, "part").select("p_partkey", X.tidy_label(label).alias("label"))


ORACLE["fn19_tidy_labels"] = """
SELECT p_partkey, replace(p_name, ' ', '''s ') || CASE WHEN p_partkey % 2 = 0 THEN '''' ELSE '' END AS label FROM part"""


@query(QUERIES, "fn3_day_spans")
def fn3(spark, sf):
    c = T.creatives(spark, sf)
    return c.select("creative_id", (F.datediff("last_day", "first_day") + 1).cast("bigint").alias("days"),
                    F.date_format(F.date_add("last_day", 2), "yyyy-MM-dd").alias("tail_end"))


ORACLE["fn3_day_spans"] = sql("""
SELECT creative_id, date_diff('day', first_day, last_day) + 1 AS days, strftime(last_day + 2, '%Y-%m-%d') AS tail_end FROM creatives""", "creatives")
