"""Campaign, roster and yield queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import asof, series
from tidegauge.plans import campaigns as C
from tidegauge.registry.base import query, sql
from tidegauge.sources import tables as T

QUERIES: dict = {}
ORACLE: dict = {}
ERA = ("2024-01-01", "2024-01-30")


def _day(*cols):
    return {c: F.date_format(c, "yyyy-MM-dd") for c in cols}


def _creatives(spark, sf):
    """All creatives; the listing gives no first day for every fourth one."""
    return T.creatives(spark, sf).withColumn("first_day", F.when(F.col("creative_id") % 4 != 2, F.col("first_day")))


def _history(spark, sf):
    """Creatives seen before: two thirds of the ids, half of those only as legacy rows."""
    c = _creatives(spark, sf)
    key = F.col("creative_id")
    legacy = F.concat_ws(":", F.lit("legacy"), "video_id", F.date_format("first_day", "yyyy-MM-dd"), key.cast("string"))
    return c.where(key % 3 != 0).select(
        F.when(key % 3 == 1, legacy).otherwise(key.cast("string")).alias("creative_id"),
        "video_id", "first_day", F.date_sub("last_day", 1).alias("last_day"),
        F.lit("2024-01-20").cast("date").alias("seen_day"))


def _capture(spark, sf):
    """Today's listing: most ids, a few of them unresolved."""
    key = F.col("creative_id")
    return _creatives(spark, sf).where(key % 5 != 0).select(
        key.cast("string").alias("creative_id"), F.when(key % 7 != 0, F.col("video_id")).alias("video_id"),
        "first_day", "last_day")


def _merged(spark, sf):
    return C.merge_creatives(_history(spark, sf), _capture(spark, sf), seen="2024-01-31")


_MERGE = {
    "listed": """
SELECT creative_id, video_id, CASE WHEN creative_id % 4 <> 2 THEN first_day END AS first_day, last_day FROM creatives""",
    "hist": """
SELECT CASE WHEN creative_id % 3 = 1 THEN concat_ws(':', 'legacy', video_id, strftime(first_day, '%Y-%m-%d'), creative_id)
            ELSE CAST(creative_id AS VARCHAR) END AS creative_id,
       video_id, first_day, last_day - 1 AS last_day, DATE '2024-01-20' AS seen_day
FROM listed WHERE creative_id % 3 <> 0""",
    "cap": """
SELECT CAST(creative_id AS VARCHAR) AS creative_id, video_id, first_day, last_day
FROM listed WHERE creative_id % 5 <> 0 AND creative_id % 7 <> 0""",
    "fresh": """
SELECT *, row_number() OVER (PARTITION BY video_id, first_day ORDER BY creative_id) AS place
FROM cap WHERE creative_id NOT IN (SELECT creative_id FROM hist)""",
    "legacy": """
SELECT *, row_number() OVER (PARTITION BY video_id, first_day ORDER BY creative_id) AS place
FROM hist WHERE creative_id LIKE 'legacy:%'""",
    "kept": """
SELECT coalesce(f.creative_id, h.creative_id) AS creative_id, h.video_id, h.first_day, h.last_day, h.seen_day
FROM hist h LEFT JOIN legacy l ON l.creative_id = h.creative_id
LEFT JOIN fresh f ON f.video_id = l.video_id AND f.first_day IS NOT DISTINCT FROM l.first_day AND f.place = l.place""",
    "merged": """
SELECT creative_id, coalesce(c.video_id, k.video_id) AS video_id, least(k.first_day, c.first_day) AS first_day,
       greatest(k.last_day, c.last_day) AS last_day,
       CASE WHEN c.video_id IS NOT NULL THEN DATE '2024-01-31' ELSE k.seen_day END AS seen_day
FROM kept k FULL JOIN cap c USING (creative_id)""",
}


@query(QUERIES, "cat16_creative_history")
def cat16(spark, sf):
    return _merged(spark, sf).withColumns(_day("first_day", "last_day", "seen_day"))


ORACLE["cat16_creative_history"] = sql("""
SELECT creative_id, video_id, strftime(first_day, '%Y-%m-%d') AS first_day, strftime(last_day, '%Y-%m-%d') AS last_day,
       strftime(seen_day, '%Y-%m-%d') AS seen_day FROM merged""", "creatives", **_MERGE)


@query(QUERIES, "cat17_campaign_rollup")
def cat17(spark, sf):
    return C.campaign_rollup(_merged(spark, sf)).withColumns(_day("first_day", "last_day"))


ORACLE["cat17_campaign_rollup"] = sql("""
SELECT video_id, count(*) AS runs, count(first_day) AS windows,
       coalesce(array_to_string(list_sort(list(DISTINCT strftime(first_day, '%Y-%m-%d') || '..' || strftime(last_day, '%Y-%m-%d')) FILTER (WHERE first_day IS NOT NULL)), ','), '') AS spans, strftime(min(first_day), '%Y-%m-%d') AS first_day,
       strftime(max(last_day) FILTER (WHERE first_day IS NOT NULL), '%Y-%m-%d') AS last_day FROM merged GROUP BY video_id""", "creatives", **_MERGE)


@query(QUERIES, "cat17_tracking_from")
def cat17_from(spark, sf):
    return C.tracking_from(C.campaign_rollup(_merged(spark, sf))).withColumns(_day("tracking_from"))


ORACLE["cat17_tracking_from"] = sql("""
SELECT strftime(min(first_day), '%Y-%m-%d') AS tracking_from, count(DISTINCT video_id) AS videos, count(*) AS creatives
FROM merged""", "creatives", **_MERGE)


def _reconciled(spark, sf):
    ev = T.table(spark, sf, "events").select(F.col("user_id").alias("video_id")).distinct()
    v = F.col("video_id")
    flagged = ev.where((v % 20 == 1) | (v % 12 == 3))
    harvested = ev.where((v % 6 == 1) | (v % 14 == 3))
    evidenced = T.creatives(spark, sf).select("video_id").distinct()
    return C.reconcile_roster(flagged, evidenced, harvested, T.videos(spark, sf).where(v % 8 != 3))


_ROSTER = {
    "ids": "SELECT DISTINCT user_id AS v FROM events",
    "flags": """
SELECT v, v % 20 = 1 OR v % 12 = 3 AS flagged, v IN (SELECT video_id FROM creatives) AS evidenced,
       v % 6 = 1 OR v % 14 = 3 AS harvested, v IN (SELECT video_id FROM videos WHERE video_id % 8 <> 3) AS known FROM ids""",
    "recon": """
SELECT v AS video_id, 'missing' AS status FROM flags WHERE evidenced AND NOT flagged
UNION ALL SELECT v, 'unknown' FROM flags WHERE evidenced AND NOT flagged AND NOT known
UNION ALL SELECT v, 'stale' FROM flags WHERE flagged AND NOT harvested AND NOT evidenced
UNION ALL SELECT v, 'unevidenced' FROM flags WHERE harvested AND NOT flagged AND NOT evidenced""",
}


@query(QUERIES, "cat18_roster_reconcile")
def cat18(spark, sf):
    return _reconciled(spark, sf)


ORACLE["cat18_roster_reconcile"] = sql("SELECT * FROM recon", "creatives", "videos", **_ROSTER)


@query(QUERIES, "cat18_placed_additions")
def cat18_placed(spark, sf):
    return C.placed_additions(_reconciled(spark, sf), T.videos(spark, sf).where(F.col("video_id") % 8 != 3))


ORACLE["cat18_placed_additions"] = sql("""
SELECT v.channel_id, r.video_id FROM recon r JOIN videos v USING (video_id)
WHERE r.status = 'missing' AND r.video_id % 8 <> 3""", "creatives", "videos", **_ROSTER)


@query(QUERIES, "set_roster_algebra")
def set_ops(spark, sf):
    """Union, difference and intersection of the evidenced and flagged ids."""
    ev = T.table(spark, sf, "events").select(F.col("user_id").alias("video_id")).distinct()
    flagged = ev.where((F.col("video_id") % 20 == 1) | (F.col("video_id") % 12 == 3))
    evidenced = T.creatives(spark, sf).select("video_id").distinct()
    parts = {"union": flagged.union(evidenced).distinct(), "except": evidenced.subtract(flagged),
             "intersect": evidenced.intersect(flagged)}
    out = None
    for name, part in parts.items():
        one = part.select(F.lit(name).alias("op"), "video_id")
        out = one if out is None else out.unionByName(one)
    return out


ORACLE["set_roster_algebra"] = sql("""
SELECT 'union' AS op, v AS video_id FROM flags WHERE flagged OR evidenced
UNION ALL SELECT 'except', v FROM flags WHERE evidenced AND NOT flagged
UNION ALL SELECT 'intersect', v FROM flags WHERE evidenced AND flagged""", "creatives", "videos", **_ROSTER)

_FILL = {
    "daily": "SELECT video_id, snap_date AS day, max_by(views, slot) AS views FROM readings GROUP BY video_id, snap_date",
    "filled": """
SELECT video_id, day, max_by(views, seen) AS views
FROM (SELECT d.video_id, d.day + CAST(k AS INTEGER) AS day, d.views, d.day AS seen FROM daily d, (SELECT unnest(range(5)) AS k) ks) f
GROUP BY video_id, day""",
}


@query(QUERIES, "src5_last_read_of_day")
def src5(spark, sf):
    return series.last_read_of_day(T.readings(spark, sf)).withColumns(_day("day"))


ORACLE["src5_last_read_of_day"] = sql(
    "SELECT video_id, strftime(day, '%Y-%m-%d') AS day, views FROM daily", "readings", daily=_FILL["daily"])


@query(QUERIES, "jn6_backward_asof")
def jn6(spark, sf):
    return asof.fill_forward_days(series.last_read_of_day(T.readings(spark, sf)), lookback=4).withColumns(_day("day"))


ORACLE["jn6_backward_asof"] = sql(
    "SELECT video_id, strftime(day, '%Y-%m-%d') AS day, views FROM filled", "readings", **_FILL)


@query(QUERIES, "jn8_busy_days")
def jn8(spark, sf):
    return asof.busy_days(T.campaign_windows(spark, sf)).withColumns(_day("day"))


_BUSY = """
SELECT DISTINCT video_id, CAST(unnest(generate_series(win_from, win_to + 2, INTERVAL 1 DAY)) AS DATE) AS day FROM windows"""
ORACLE["jn8_busy_days"] = sql(
    "SELECT video_id, strftime(day, '%Y-%m-%d') AS day FROM busy", "windows", busy=_BUSY)


@query(QUERIES, "jn9_measurable_windows")
def jn9(spark, sf):
    return C.measurable_windows(T.campaign_windows(spark, sf), T.videos(spark, sf), era_from=ERA[0], era_to=ERA[1]) \
        .withColumns(_day("win_from", "win_to"))


_YIELD = {
    "cand": f"""
SELECT w.* FROM windows w JOIN videos v USING (video_id)
WHERE win_from >= DATE '{ERA[0]}' AND win_to <= DATE '{ERA[1]}' AND date_diff('day', CAST(v.published_at AS DATE), win_from) >= 14""",
    **_FILL, "busy": _BUSY,
    "pairs": """
SELECT s.video_id, s.win_from, s.win_from - CAST(i AS INTEGER) AS a, s.win_from - CAST(i AS INTEGER) + 1 AS b
FROM (SELECT DISTINCT video_id, win_from FROM cand) s, (SELECT unnest(range(2, 15)) AS i) k""",
    "base": """
SELECT video_id, win_from, list_sort(list(gain))[len(list(gain)) // 2 + 1] AS base
FROM (SELECT p.video_id, p.win_from, fb.views - fa.views AS gain FROM pairs p
      JOIN filled fa ON fa.video_id = p.video_id AND fa.day = p.a JOIN filled fb ON fb.video_id = p.video_id AND fb.day = p.b
      WHERE NOT EXISTS (SELECT 1 FROM busy x WHERE x.video_id = p.video_id AND x.day IN (p.a, p.b)) AND fb.views >= fa.views) g
GROUP BY video_id, win_from HAVING count(*) >= 3""",
    "closed": f"""
SELECT *, greatest(least(CASE WHEN win_to + 2 >= next_start THEN next_start - 1 ELSE win_to + 2 END, DATE '{ERA[1]}'), win_to) AS observed_to
FROM (SELECT c.*, (SELECT min(w.win_from) FROM windows w WHERE w.video_id = c.video_id AND w.win_from > c.win_to) AS next_start
      FROM cand c WHERE win_to <> DATE '{ERA[1]}') n""",
    "measured": """
SELECT c.video_id, c.win_from, c.win_to, date_diff('day', c.win_from, c.win_to) + 1 AS days, c.observed_to,
       date_diff('day', c.win_from, c.observed_to) + 1 AS observed_days, v1.views - v0.views AS gain, b.base AS baseline_per_day,
       greatest(0, v1.views - v0.views - b.base * (date_diff('day', c.win_from, c.observed_to) + 1)) AS ad_views
FROM closed c JOIN base b ON b.video_id = c.video_id AND b.win_from = c.win_from
JOIN filled v0 ON v0.video_id = c.video_id AND v0.day = c.win_from - 1
JOIN filled v1 ON v1.video_id = c.video_id AND v1.day = c.observed_to""",
    "yields": "SELECT *, CAST(floor(ad_views / days + 0.5) AS BIGINT) AS per_day FROM measured",
    "rate": """
SELECT count(*) AS campaigns, CAST(sum(days) AS BIGINT) AS campaign_days, CAST(sum(ad_views) AS BIGINT) AS ad_views,
       min(per_day) AS low, CAST(floor(sum(ad_views) / sum(days) + 0.5) AS BIGINT) AS central, max(per_day) AS high
FROM yields HAVING count(*) >= 3""",
}
ORACLE["jn9_measurable_windows"] = sql("""
SELECT video_id, strftime(win_from, '%Y-%m-%d') AS win_from, strftime(win_to, '%Y-%m-%d') AS win_to FROM cand""",
    "windows", "videos", cand=_YIELD["cand"])


@query(QUERIES, "wn13_next_start")
def wn13(spark, sf):
    return asof.next_start(T.campaign_windows(spark, sf)).withColumns(_day("win_to", "next_start"))


ORACLE["wn13_next_start"] = sql("""
SELECT e.video_id, strftime(e.win_to, '%Y-%m-%d') AS win_to, strftime(min(w.win_from), '%Y-%m-%d') AS next_start
FROM (SELECT DISTINCT video_id, win_to FROM windows) e LEFT JOIN windows w ON w.video_id = e.video_id AND w.win_from > e.win_to
GROUP BY e.video_id, e.win_to""", "windows")


def _measured(spark, sf):
    return C.campaign_yield(T.readings(spark, sf), T.videos(spark, sf), T.campaign_windows(spark, sf),
                            era_from=ERA[0], era_to=ERA[1])


@query(QUERIES, "dp17_campaign_yield")
def dp17(spark, sf):
    return _measured(spark, sf).withColumns(_day("win_from", "win_to", "observed_to"))


ORACLE["dp17_campaign_yield"] = sql("""
SELECT * REPLACE (strftime(win_from, '%Y-%m-%d') AS win_from, strftime(win_to, '%Y-%m-%d') AS win_to,
                  strftime(observed_to, '%Y-%m-%d') AS observed_to) FROM yields""",
    "windows", "videos", "readings", **{k: v for k, v in _YIELD.items() if k != "rate"})


@query(QUERIES, "dp17_yield_rate")
def dp17_rate(spark, sf):
    return C.yield_rate(_measured(spark, sf))


ORACLE["dp17_yield_rate"] = sql("SELECT * FROM rate", "windows", "videos", "readings", **_YIELD)


@query(QUERIES, "dp18_spend_estimate")
def dp18(spark, sf):
    return C.spend_estimate(C.yield_rate(_measured(spark, sf)), C.campaign_days(T.campaign_windows(spark, sf)))


ORACLE["dp18_spend_estimate"] = sql("""
SELECT video_id, days, days * (SELECT central FROM rate) AS ad_views,
       CAST(floor(days * (SELECT central FROM rate) * 0.015::DOUBLE + 0.5) AS BIGINT) AS spend_low,
       CAST(floor(days * (SELECT central FROM rate) * 0.04::DOUBLE + 0.5) AS BIGINT) AS spend_high
FROM (SELECT video_id, CAST(sum(date_diff('day', win_from, win_to) + 1) AS BIGINT) AS days FROM windows GROUP BY video_id) d""",
    "windows", "videos", "readings", **_YIELD)
