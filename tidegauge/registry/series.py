"""Readings, daily gains, velocity and spike queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import series as S
from tidegauge.plans import daily, spikes, velocity
from tidegauge.registry.base import local, query, sql
from tidegauge.sources import tables as T

QUERIES: dict = {}
ORACLE: dict = {}

_DAILY = {
    "days": """
SELECT snap_date, slot, row_number() OVER (ORDER BY snap_date) AS day_ix,
       lag(snap_date) OVER (ORDER BY snap_date) AS label_date,
       lag(captured_at) OVER (ORDER BY snap_date) AS prev_captured
FROM (SELECT *, row_number() OVER (PARTITION BY snap_date ORDER BY slot) AS rk FROM axis) a WHERE rk = 1""",
    "dated": """
SELECT r.*, d.day_ix, d.label_date, d.prev_captured,
       lag(d.day_ix) OVER w AS prev_ix, lag(r.views) OVER w AS prev_views
FROM readings r JOIN days d USING (snap_date, slot)
WINDOW w AS (PARTITION BY r.video_id ORDER BY d.day_ix)""",
    "gains": f"""
SELECT label_date, video_id, channel_id, is_short, gain, is_new,
       NOT is_new AND pub_day >= first_of_month - 7 AND pub_day < first_of_month AS is_late,
       video_id % 17 = 0 AS removed
FROM (SELECT *, CAST(date_trunc('month', label_date) AS DATE) AS first_of_month,
             strftime({local('published_at')}, '%Y-%m') = strftime(label_date, '%Y-%m') AS is_new,
             CAST({local('published_at')} AS DATE) AS pub_day,
             CASE WHEN prev_ix = day_ix - 1 THEN views - prev_views
                  WHEN published_at > prev_captured THEN views END AS gain
      FROM dated WHERE label_date IS NOT NULL) x
WHERE gain > 0""",
}

_BUCKETS = """
SELECT strftime(label_date, '%Y-%m-%d') AS label_date, channel_id,
       CAST(sum(CASE WHEN is_new AND is_short THEN gain ELSE 0 END) AS BIGINT) AS new_short,
       CAST(sum(CASE WHEN is_new AND NOT is_short THEN gain ELSE 0 END) AS BIGINT) AS new_long,
       CAST(sum(CASE WHEN NOT is_new AND is_short THEN gain ELSE 0 END) AS BIGINT) AS old_short,
       CAST(sum(CASE WHEN NOT is_new AND NOT is_short THEN gain ELSE 0 END) AS BIGINT) AS old_long,
       CAST(sum(CASE WHEN is_late AND is_short THEN gain ELSE 0 END) AS BIGINT) AS late_short,
       CAST(sum(CASE WHEN is_late AND NOT is_short THEN gain ELSE 0 END) AS BIGINT) AS late_long
FROM gains WHERE {cond} GROUP BY ALL"""


def _snaps(spark, sf):
    return T.snapshot_clock(T.snapshot_axis(T.table(spark, sf, "events")))


def _classified(spark, sf):
    return daily.classified_gains(T.readings(spark, sf), _snaps(spark, sf), T.videos(spark, sf))


@query(QUERIES, "dp1_daily_views")
def dp1(spark, sf):
    return daily.daily_views(_classified(spark, sf))


ORACLE["dp1_daily_views"] = sql(_BUCKETS.format(cond="NOT removed"), "readings", "axis", **_DAILY)


@query(QUERIES, "dp1_removed_views")
def dp1_removed(spark, sf):
    return daily.daily_views(_classified(spark, sf), removed=True)


ORACLE["dp1_removed_views"] = sql(_BUCKETS.format(cond="removed"), "readings", "axis", **_DAILY)


@query(QUERIES, "dp2_daily_videos_top")
def dp2(spark, sf):
    return daily.daily_top(_classified(spark, sf)).select(
        F.date_format("label_date", "yyyy-MM-dd").alias("label_date"), "channel_id", "video_id", "gain",
        "is_short", "is_new", F.col("position").cast("bigint").alias("position"))


_RANKED = """
SELECT *, row_number() OVER (PARTITION BY label_date, channel_id ORDER BY gain DESC, video_id) AS position
FROM gains WHERE NOT removed"""
ORACLE["dp2_daily_videos_top"] = sql("""
SELECT strftime(label_date, '%Y-%m-%d') AS label_date, channel_id, video_id, gain, is_short, is_new, position
FROM ranked WHERE position <= 30""", "readings", "axis", **_DAILY, ranked=_RANKED)


@query(QUERIES, "dp2_daily_videos_rest")
def dp2_rest(spark, sf):
    return daily.daily_rest(_classified(spark, sf), top=10).withColumn(
        "label_date", F.date_format("label_date", "yyyy-MM-dd"))


ORACLE["dp2_daily_videos_rest"] = sql("""
SELECT strftime(label_date, '%Y-%m-%d') AS label_date, channel_id, is_new, is_short,
       count(*) AS rest_count, CAST(sum(gain) AS BIGINT) AS rest_gain
FROM ranked WHERE position > 10 GROUP BY ALL""", "readings", "axis", **_DAILY, ranked=_RANKED)


@query(QUERIES, "dp3_historic_views")
def dp3(spark, sf):
    return daily.historic_views(T.readings(spark, sf), _snaps(spark, sf), T.videos(spark, sf), T.ad_videos(spark, sf))


ORACLE["dp3_historic_views"] = sql("""
SELECT month, channel_id, window_from, window_to, window_from NOT LIKE month || '-01%' AS partial,
       month = (SELECT max(month) FROM months) AS in_progress,
       CAST(sum(CASE WHEN NOT is_short THEN d ELSE 0 END) AS BIGINT) AS long_gain,
       CAST(sum(CASE WHEN is_short THEN d ELSE 0 END) AS BIGINT) AS short_gain,
       CAST(sum(CASE WHEN NOT is_short AND video_id % 10 <> 1 AND CAST(published_at AS DATE) >= CAST(month || '-01' AS DATE) - 7 THEN d ELSE 0 END) AS BIGINT) AS last_week,
       CAST(sum(CASE WHEN NOT is_short AND video_id % 10 = 1 THEN d ELSE 0 END) AS BIGINT) AS paid_gain
FROM (SELECT m.month, m.window_from, m.window_to, b.video_id, b.channel_id, b.is_short, b.published_at, b.views - a.views AS d
      FROM months m JOIN readings a ON a.snap_ix = m.first_ix JOIN readings b ON b.snap_ix = m.last_ix AND b.video_id = a.video_id
      WHERE m.first_ix <> m.last_ix AND b.published_at < CAST(m.month || '-01' AS TIMESTAMP)) x
WHERE d <> 0 GROUP BY month, channel_id, window_from, window_to""", "readings", "axis",
    months="""SELECT strftime(snap_date, '%Y-%m') AS month, min(strftime(snap_date, '%Y-%m-%d') || '-' || slot) AS window_from,
 max(strftime(snap_date, '%Y-%m-%d') || '-' || slot) AS window_to, min(snap_ix) AS first_ix, max(snap_ix) AS last_ix FROM axis GROUP BY 1""")


@query(QUERIES, "dp10_launch_velocity")
def dp10(spark, sf):
    points = velocity.launch_points(T.readings(spark, sf), T.videos(spark, sf), tracking_start="2024-01-01")
    return points.select("video_id", "channel_id", "mid_age", "rate")


_POINTS = """
SELECT video_id, channel_id, published_at, age, views, round((prev_age + age) / 2, 3) AS mid_age,
       CAST(round_even((views - prev_views) / (age - prev_age), 0) AS BIGINT) AS rate
FROM (SELECT *, coalesce(lag(age) OVER w, 0::DOUBLE) AS prev_age, coalesce(lag(views) OVER w, 0) AS prev_views
      FROM (SELECT video_id, channel_id, published_at, views,
                   (epoch_us(captured_at) - epoch_us(published_at)) / 86400000000.0::DOUBLE AS age
            FROM readings WHERE NOT is_short AND video_id % 17 <> 0 AND CAST(published_at AS DATE) >= DATE '2024-01-01') r
      WHERE age >= 0.25 WINDOW w AS (PARTITION BY video_id ORDER BY age, views)) x
WHERE age - prev_age > 0"""
ORACLE["dp10_launch_velocity"] = sql(
    "SELECT video_id, channel_id, mid_age, rate FROM points", "readings", points=_POINTS)


@query(QUERIES, "dp10_launch_current")
def dp10_current(spark, sf):
    return velocity.launch_summary(velocity.launch_points(
        T.readings(spark, sf), T.videos(spark, sf), tracking_start="2024-01-01"))


LAUNCHES = """
SELECT video_id, channel_id, round(max(age), 2) AS age, max_by(views, age) AS views, count(*) AS points
FROM points GROUP BY video_id, channel_id"""
ORACLE["dp10_launch_current"] = sql(LAUNCHES, "readings", points=_POINTS)


@query(QUERIES, "dp11_typical_curve")
def dp11(spark, sf):
    points = velocity.launch_points(T.readings(spark, sf), T.videos(spark, sf), tracking_start="2024-01-01")
    at = _snaps(spark, sf).agg(F.max("captured_at").alias("at"))
    return velocity.typical_curve(points, at)


ORACLE["dp11_typical_curve"] = sql("""
SELECT scope, age_bin, count(*) AS n, CAST(round_even(median(rate), 0) AS BIGINT) AS rate
FROM (SELECT unnest(['ALL', channel_id]) AS scope, round_even(mid_age * 2, 0) / 2 AS age_bin, rate FROM points
      WHERE mid_age <= 13 AND floor((epoch_us((SELECT max(captured_at) FROM axis)) - epoch_us(published_at)) / 86400000000.0) <= 35) x
WHERE age_bin <= 13 GROUP BY scope, age_bin HAVING count(*) >= 4""", "readings", "axis", points=_POINTS)


@query(QUERIES, "dp12_movers")
def dp12(spark, sf):
    # The stand-in counters move faster than a dormant catalogue, so "flat" is set higher here.
    return velocity.movers(T.readings(spark, sf), T.videos(spark, sf), T.ad_videos(spark, sf), _snaps(spark, sf), flat=200)


MOVERS = """
SELECT s.video_id, s.channel_id,
       date_diff('day', CAST(s.published_at AS DATE), CAST((SELECT max(captured_at) FROM axis) AS DATE)) AS age_days,
       coalesce(l.views - w.views, 0) AS gain7, l.views AS views,
       CAST(round_even(base, 0) AS BIGINT) AS base, peak, s.video_id % 10 = 1 AS is_ad
FROM (SELECT video_id, channel_id, published_at, count(*) AS n,
             median(CASE WHEN rn > 8 THEN delta END) AS base, max(CASE WHEN rn <= 8 THEN delta END) AS peak
      FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY snap_ix DESC) AS rn
            FROM adj_iv WHERE NOT is_short AND video_id % 17 <> 0) g GROUP BY ALL) s
LEFT JOIN readings l ON l.video_id = s.video_id AND l.snap_ix = (SELECT max(snap_ix) FROM axis)
LEFT JOIN readings w ON w.video_id = s.video_id AND w.snap_ix = (SELECT greatest(0, max(snap_ix) - 13) FROM axis)
WHERE n >= 18 AND base <= 200 AND peak >= 300 AND peak >= base * 3"""
ORACLE["dp12_movers"] = sql(MOVERS, "adj_iv", "axis")

_BURSTS = {
    "steps": """
SELECT *, gain - base * dt AS excess, row_number() OVER (PARTITION BY video_id ORDER BY snap_ix) AS rn
FROM (SELECT *, median(rate) OVER (PARTITION BY video_id) AS base
      FROM (SELECT *, greatest(0, delta) AS gain, greatest(0, delta) / dt AS rate FROM adj_iv
            WHERE NOT is_short AND video_id % 10 = 1 AND n_points >= 3) a) b""",
    "runs": """
SELECT *, sum(CASE WHEN jump IS NULL OR jump > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY rn) AS run_no
FROM (SELECT *, rn - lag(rn) OVER (PARTITION BY video_id ORDER BY rn) AS jump FROM steps
      WHERE gain >= 200 AND excess > 0 AND rate >= greatest(300.0::DOUBLE, 3.0::DOUBLE * base)) x""",
    "bursts": """
SELECT *, date_diff('day', CAST(published_at AS DATE), from_day) < 3 AS entangled
FROM (SELECT video_id, channel_id, published_at, base, run_no, CAST(min(t0) AS DATE) AS from_day,
             CAST(max(captured_at) AS DATE) AS to_day, CAST(sum(round_even(excess, 0)) AS BIGINT) AS views,
             min(snap_ix - 1) AS iv0, max(snap_ix - 1) AS iv1
      FROM runs GROUP BY video_id, channel_id, published_at, base, run_no) b""",
    "ledger": """
SELECT video_id, channel_id, round(base, 1) AS baseline_per_day,
       CAST(sum(CASE WHEN NOT entangled THEN views ELSE 0 END) AS BIGINT) AS ad_views,
       CAST(sum(CASE WHEN entangled THEN views ELSE 0 END) AS BIGINT) AS entangled_views,
       count(*) AS bursts, min(from_day) AS first_burst, max(to_day) AS last_burst
FROM bursts GROUP BY video_id, channel_id, round(base, 1)""",
}


@query(QUERIES, "dp13_ad_bursts")
def dp13_bursts(spark, sf):
    return spikes.ad_bursts(T.readings(spark, sf), T.ad_videos(spark, sf)).select(
        "video_id", F.col("run_no").cast("bigint").alias("run_no"),
        F.date_format("from_day", "yyyy-MM-dd").alias("from_day"),
        F.date_format("to_day", "yyyy-MM-dd").alias("to_day"), "views", "iv0", "iv1", "entangled")


ORACLE["dp13_ad_bursts"] = sql("""
SELECT video_id, CAST(run_no AS BIGINT) AS run_no, strftime(from_day, '%Y-%m-%d') AS from_day,
       strftime(to_day, '%Y-%m-%d') AS to_day, views, iv0, iv1, entangled FROM bursts""", "adj_iv", **_BURSTS)


@query(QUERIES, "dp13_ad_ledger")
def dp13(spark, sf):
    return spikes.ad_ledger(spikes.ad_bursts(T.readings(spark, sf), T.ad_videos(spark, sf))).withColumns({
        "first_burst": F.date_format("first_burst", "yyyy-MM-dd"),
        "last_burst": F.date_format("last_burst", "yyyy-MM-dd")})


ORACLE["dp13_ad_ledger"] = sql("""
SELECT * REPLACE (strftime(first_burst, '%Y-%m-%d') AS first_burst, strftime(last_burst, '%Y-%m-%d') AS last_burst)
FROM ledger""", "adj_iv", **_BURSTS)


@query(QUERIES, "dp13_ledger_totals")
def dp13_totals(spark, sf):
    return spikes.ledger_totals(spikes.ad_ledger(spikes.ad_bursts(T.readings(spark, sf), T.ad_videos(spark, sf))))


ORACLE["dp13_ledger_totals"] = sql("""
SELECT CAST(sum(ad_views) AS BIGINT) AS ad_views, CAST(sum(entangled_views) AS BIGINT) AS entangled_views,
       count(*) FILTER (WHERE ad_views > 0) AS videos_with_ad_views FROM ledger""", "adj_iv", **_BURSTS)

_SPIKES = {
    "based": """
SELECT *, median(CASE WHEN rank <= greatest(1, n // 2) THEN rate END) OVER (PARTITION BY video_id) AS baseline
FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY rate) AS rank, count(*) OVER (PARTITION BY video_id) AS n
      FROM own_iv WHERE NOT is_short AND n_points >= 6) a""",
    "flagged": """
SELECT *, rate >= greatest(baseline * 6, 300::DOUBLE) AS hot,
       sum(CASE WHEN rate >= greatest(baseline * 6, 300::DOUBLE) THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY snap_ix) AS island
FROM based""",
    "spike_events": """
SELECT *, spike_start - date_diff('day', DATE '1970-01-01', CAST(published_at AS DATE)) AS age_at_spike
FROM (SELECT video_id, channel_id, published_at, baseline, min(t0) AS spike_start,
             min_by(strftime(prev_date, '%Y-%m-%d') || '-' || prev_slot, t0) AS spike_tag,
             count(*) AS intervals, max(rate) AS peak, sum(dv - baseline * dt) AS excess
      FROM (SELECT *, max(CASE WHEN hot THEN island END) OVER (PARTITION BY video_id) AS last_island FROM flagged) f
      WHERE hot AND island = last_island GROUP BY video_id, channel_id, published_at, baseline) e""",
}


def _topic_of(spark, sf):
    return T.videos(spark, sf).select("video_id", F.concat(F.lit("t"), (F.col("video_id") % 7).cast("string")).alias("topic_id"))


def _trackers(spark, sf):
    """Share of a topic's videos that are Shorts, standing in for a story's saturation."""
    return (T.videos(spark, sf)
            .groupBy(F.concat(F.lit("t"), (F.col("video_id") % 7).cast("string")).alias("term_id"))
            .agg(F.avg(F.when(F.col("unlisted"), 4.0).otherwise(0.0)).alias("saturation")))


@query(QUERIES, "dp14_unexplained_spikes")
def dp14(spark, sf):
    # Counters of the stand-in never go dormant, so the baseline ceiling is wider than the default.
    return spikes.unexplained_spikes(spikes.spike_events(T.readings(spark, sf)), T.ad_videos(spark, sf),
                                     _topic_of(spark, sf), _trackers(spark, sf), max_baseline=400)


ORACLE["dp14_unexplained_spikes"] = sql("""
SELECT video_id, channel_id, spike_tag, age_at_spike, intervals,
       CAST(floor(baseline + 0.5) AS BIGINT) AS baseline_per_day, CAST(floor(peak + 0.5) AS BIGINT) AS peak_per_day,
       round(peak / greatest(baseline, 1::DOUBLE), 1) AS ratio,
       CASE WHEN intervals >= 2 THEN 'sustained' ELSE 'emerging' END AS status,
       CAST(floor(excess + 0.5) AS BIGINT) AS promoted_views, 't' || CAST(video_id % 7 AS VARCHAR) AS topic_id,
       coalesce('t' || CAST(video_id % 7 AS VARCHAR) IN
         (SELECT 't' || CAST(video_id % 7 AS VARCHAR) FROM videos GROUP BY 1
          HAVING avg(CASE WHEN unlisted THEN 4.0::DOUBLE ELSE 0 END) >= 0.15), FALSE) AS news_likely
FROM spike_events WHERE baseline <= 400 AND excess >= 500 AND age_at_spike >= 7 AND video_id % 10 <> 1""",
    "own_iv", "videos", **_SPIKES)


@query(QUERIES, "dp15_known_ad_spikes")
def dp15(spark, sf):
    return spikes.known_ad_spikes(spikes.spike_events(T.readings(spark, sf)), T.ad_videos(spark, sf))


ORACLE["dp15_known_ad_spikes"] = sql("""
SELECT video_id, spike_tag, CAST(floor(excess + 0.5) AS BIGINT) AS promoted_views
FROM spike_events WHERE excess >= 500 AND age_at_spike >= 7 AND video_id % 10 = 1""", "own_iv", **_SPIKES)


@query(QUERIES, "dp16_ad_impact")
def dp16(spark, sf):
    return spikes.ad_impact(T.readings(spark, sf))


ORACLE["dp16_ad_impact"] = sql("""
SELECT video_id, strftime(from_day, '%Y-%m-%d') AS from_day, strftime(to_day, '%Y-%m-%d') AS to_day,
       CAST(sum(dv) AS BIGINT) AS observed, sum(dt) AS days, round(baseline, 3) AS baseline_per_day,
       CAST(floor(sum(dv) - baseline * sum(dt) + 0.5) AS BIGINT) AS ad_driven
FROM (SELECT *, coalesce(median(CASE WHEN auto_from IS NULL OR snap_date < auto_from THEN rate END) OVER v, provisional) AS baseline,
             coalesce(auto_from, min(snap_date) OVER v) AS from_day, max(snap_date) OVER v AS to_day
      FROM (SELECT *, min(CASE WHEN hot AND island = last_hot THEN snap_date END) OVER v AS auto_from
            FROM (SELECT *, max(CASE WHEN hot THEN island END) OVER v AS last_hot
                  FROM (SELECT *, sum(CASE WHEN hot THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY snap_ix) AS island
                        FROM (SELECT *, rate > greatest(provisional * 8, provisional + 50) AS hot
                              FROM (SELECT *, median(CASE WHEN rate <= mid THEN rate END) OVER v AS provisional
                                    FROM (SELECT *, median(rate) OVER v AS mid FROM own_iv WINDOW v AS (PARTITION BY video_id)) a
                                    WINDOW v AS (PARTITION BY video_id)) b) c) d
                  WINDOW v AS (PARTITION BY video_id)) e
            WINDOW v AS (PARTITION BY video_id)) f
      WINDOW v AS (PARTITION BY video_id)) g
WHERE snap_date >= from_day AND snap_date <= to_day
GROUP BY video_id, from_day, to_day, baseline""", "own_iv")
