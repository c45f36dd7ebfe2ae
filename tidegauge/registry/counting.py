"""Counting-change, audit and as-of queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import asof
from tidegauge.plans import audits as A
from tidegauge.plans import counting as C
from tidegauge.registry.base import query, sql
from tidegauge.registry.series import _snaps
from tidegauge.session import cut_lineage
from tidegauge.sources import tables as T

QUERIES: dict = {}
ORACLE: dict = {}

# The stand-in counters start on 2024-01-01, so the step is looked for in mid-January.
START, PRE_END, ONSET = "2023-12-28", "2024-01-09", "2024-01-12"


def _points(spark, sf):
    pool = C.eligible_videos(T.videos(spark, sf), T.ad_videos(spark, sf), published_from=START)
    # Compact (a few rows per video) and read many times below.
    return cut_lineage(C.aged_points(T.readings(spark, sf), pool, debut=T.debut_samples(spark, sf), min_views=100))


def _main(spark, sf, points=None):
    points = _points(spark, sf) if points is None else points
    return C.enough_points(points.where("age_h = 24.0"), min_points=4)


_POINTS = {
    "hourly": """
SELECT user_id AS video_id, greatest(CAST(floor((floor(epoch(ts)) - epoch(published_at)) / 3600) AS BIGINT) + 1, 1) AS hour,
       min(published_at) AS published_at, sum(cents) AS cents, sum(CASE WHEN event_type IN ('click','view') THEN cents ELSE 0 END) AS engaged
FROM ev GROUP BY 1, 2 HAVING hour <= 72""",
    "debut": """
SELECT video_id, published_at, hour, CAST(total // 100 AS BIGINT) AS views,
       CASE WHEN video_id % 13 <> 0 THEN CAST((total + 2 * e) // 1600 AS BIGINT) END AS likes
FROM (SELECT *, CAST(sum(cents) OVER w AS BIGINT) AS total, CAST(sum(engaged) OVER w AS BIGINT) AS e
      FROM hourly WINDOW w AS (PARTITION BY video_id ORDER BY hour)) h""",
    "united": """
SELECT video_id, published_at, views, likes, 1 AS source,
       (epoch_us(captured_at) - epoch_us(published_at)) / 86400000000.0::DOUBLE * 24 AS age_h FROM readings
UNION ALL SELECT video_id, published_at, views, likes, 0, CAST(hour AS DOUBLE) FROM debut""",
    "obs": f"""
SELECT video_id, 'ch' || CAST(video_id % 5 AS VARCHAR) AS channel_id, published_at, views, coalesce(likes, 0) AS likes, source, age_h
FROM united WHERE video_id % 3 <> 0 AND video_id % 17 <> 0 AND video_id % 10 <> 1 AND views > 100
  AND CAST(published_at AS DATE) >= DATE '{START}'""",
    "ends": """
SELECT video_id, channel_id, published_at, h,
       max(CASE WHEN age_h <= h THEN struct_pack(a := age_h, s := source, v := views, l := likes) END) AS lo,
       min(CASE WHEN age_h >= h THEN struct_pack(a := age_h, s := source, v := views, l := likes) END) AS hi
FROM obs, (SELECT unnest([24.0::DOUBLE, 12.0, 48.0, 72.0]) AS h) ages GROUP BY video_id, channel_id, published_at, h""",
    "pts": """
SELECT video_id, channel_id, CAST(published_at AS DATE) AS day, h AS age_h, vw, lk, lk * 1000 / vw AS rate
FROM (SELECT *, lo.v + (hi.v - lo.v) * w AS vw, lo.l + (hi.l - lo.l) * w AS lk
      FROM (SELECT *, CASE WHEN hi.a = lo.a THEN 0::DOUBLE ELSE (h - lo.a) / (hi.a - lo.a) END AS w
            FROM ends WHERE lo IS NOT NULL AND hi IS NOT NULL) e) f WHERE vw > 100""",
    "main": """
SELECT * FROM pts WHERE age_h = 24 AND channel_id IN
  (SELECT channel_id FROM pts WHERE age_h = 24 GROUP BY channel_id HAVING count(*) >= 4)""",
    "sided": f"""
SELECT *, CASE WHEN day < DATE '{PRE_END}' THEN 'pre' WHEN day >= DATE '{ONSET}' THEN 'post' END AS side FROM main""",
    "factors": """
SELECT channel_id, count(*) AS n, count(*) FILTER (WHERE side = 'post') AS n_post,
       count(*) FILTER (WHERE side = 'pre' AND round(lk * 100 / vw, 2) < 6.5) AS low_pre,
       count(*) FILTER (WHERE side = 'post' AND round(lk * 100 / vw, 2) < 6.5) AS low_post,
       CAST(floor(sum(CASE WHEN side = 'post' THEN vw END) + 0.5) AS BIGINT) AS post_views,
       round(median(CASE WHEN side = 'pre' THEN rate END), 1) AS rate_before,
       round(median(CASE WHEN side = 'post' THEN rate END), 1) AS rate_after,
       round(median(CASE WHEN side = 'pre' THEN rate END) / nullif(median(CASE WHEN side = 'post' THEN rate END), 0), 2) AS factor
FROM sided GROUP BY channel_id""",
}


@query(QUERIES, "jn11_value_at_age")
def jn11(spark, sf):
    return _points(spark, sf).select("video_id", "age_h", F.round("vw", 6).alias("vw"), F.round("lk", 6).alias("lk"))


ORACLE["jn11_value_at_age"] = sql(
    "SELECT video_id, age_h, round(vw, 6) AS vw, round(lk, 6) AS lk FROM pts", "readings", **_POINTS)


@query(QUERIES, "dp5_bucket_series")
def dp5(spark, sf):
    return C.bucket_series(_main(spark, sf), start=START, pre_end=PRE_END, onset=ONSET, min_bucket=2)


ORACLE["dp5_bucket_series"] = sql(f"""
SELECT channel_id, strftime(from_day, '%Y-%m-%d') AS from_day, count(*) AS n,
       CAST(floor(median(vw) * 100 / any_value(base_v) + 0.5) AS BIGINT) AS views,
       CAST(floor(median(lk) * 100 / nullif(any_value(base_l), 0) + 0.5) AS BIGINT) AS likes
FROM (SELECT *, CASE WHEN day >= DATE '{ONSET}' AND reg < DATE '{ONSET}' THEN DATE '{ONSET}' ELSE reg END AS from_day
      FROM (SELECT *, DATE '{START}' + CAST(floor(date_diff('day', DATE '{START}', day) / 5) * 5 AS INTEGER) AS reg FROM main) m) b
JOIN (SELECT channel_id, median(vw) AS base_v, median(lk) AS base_l FROM main WHERE day < DATE '{PRE_END}' GROUP BY channel_id) p
  USING (channel_id)
GROUP BY channel_id, b.from_day HAVING count(*) >= 2""", "readings", **_POINTS)


@query(QUERIES, "dp6_rate_factor")
def dp6(spark, sf):
    return C.rate_factor(_main(spark, sf), pre_end=PRE_END, onset=ONSET)


ORACLE["dp6_rate_factor"] = sql("SELECT * FROM factors", "readings", **_POINTS)


@query(QUERIES, "dp7_factor_checks")
def dp7(spark, sf):
    return C.factor_checks(_points(spark, sf), pre_end=PRE_END, onset=ONSET, min_side=2)


_CHECKS = {
    "sp": f"""
SELECT *, date_diff('day', DATE '{ONSET}', day) AS gap_days,
       CASE WHEN day < DATE '{PRE_END}' THEN 'pre' WHEN day >= DATE '{ONSET}' THEN 'post' END AS side FROM pts""",
    "members": """
SELECT channel_id, side, rate, "check" FROM (
  SELECT *, unnest([CASE WHEN age_h = 24 AND ((side = 'pre' AND gap_days >= -17) OR (side = 'post' AND gap_days < 14)) THEN 'two weeks either side' END,
    CASE WHEN age_h = 24 AND ((side = 'pre' AND gap_days >= -31) OR (side = 'post' AND gap_days < 28)) THEN 'four weeks either side' END,
    CASE WHEN age_h = 24 AND (side = 'post' OR gap_days >= -33) THEN 'last 30 days as baseline' END,
    CASE WHEN age_h = 12 THEN 'at 12 hours' END, CASE WHEN age_h = 48 THEN 'at 48 hours' END,
    CASE WHEN age_h = 72 THEN 'at 72 hours' END]) AS "check" FROM sp WHERE side IS NOT NULL) u
WHERE "check" IS NOT NULL""",
    "fits": """
SELECT channel_id, count(*) FILTER (WHERE side = 'pre') AS n_pre, count(*) FILTER (WHERE side = 'post') AS n_post,
       count(*) AS n, count(y) AS ny, sum(gap_days)::DOUBLE AS x, sum(gap_days*gap_days)::DOUBLE AS xx, sum(p)::DOUBLE AS p,
       sum(gap_days*p)::DOUBLE AS xp, sum(y) AS y, sum(gap_days*y) AS xy, sum(p*y) AS py,
       avg(CASE WHEN side = 'pre' THEN y END) - avg(CASE WHEN side = 'post' THEN y END) AS gap,
       sum(CASE WHEN side = 'pre' THEN lk END) / sum(CASE WHEN side = 'pre' THEN vw END) AS r0,
       sum(CASE WHEN side = 'post' THEN lk END) / sum(CASE WHEN side = 'post' THEN vw END) AS r1
FROM (SELECT *, CASE WHEN rate > 0 THEN ln(rate) END AS y, CASE WHEN side = 'post' THEN 1 ELSE 0 END AS p
      FROM sp WHERE side IS NOT NULL AND age_h = 24) s GROUP BY channel_id""",
    "raw": """
SELECT channel_id, "check", median(CASE WHEN side = 'pre' THEN rate END) / nullif(median(CASE WHEN side = 'post' THEN rate END), 0) AS factor
FROM members GROUP BY channel_id, "check"
HAVING count(*) FILTER (WHERE side = 'pre') >= 2 AND count(*) FILTER (WHERE side = 'post') >= 2
UNION ALL SELECT channel_id, 'geometric mean', exp(gap) FROM fits WHERE n_pre >= 2 AND n_post >= 2 AND ny = n
UNION ALL SELECT channel_id, 'ratio of sums', r0 / nullif(r1, 0) FROM fits WHERE n_pre >= 2 AND n_post >= 2
UNION ALL SELECT channel_id, 'allowing for drift',
  exp(-((n*(xx*py - xy*xp) - x*(x*py - xy*p) + y*(x*xp - xx*p)) / nullif(n*(xx*p - xp*xp) - x*(x*p - xp*p) + p*(x*xp - xx*p), 0)))
FROM fits WHERE n_pre >= 2 AND n_post >= 2 AND ny = n""",
    "checks": """
SELECT channel_id, "check", round(factor, 2) AS factor FROM raw
WHERE factor IS NOT NULL AND NOT isnan(factor) AND abs(factor) <> 'inf'::DOUBLE""",
}
ORACLE["dp7_factor_checks"] = sql("SELECT * FROM checks", "readings", **_POINTS, **_CHECKS)


@query(QUERIES, "dp8_drift_factor")
def dp8(spark, sf):
    points = C.sided(_main(spark, sf), pre_end=PRE_END, onset=ONSET)
    return C.drift_factor(points, onset=ONSET).where("factor IS NOT NULL").select(
        "channel_id", F.round("factor", 4).alias("factor"))


ORACLE["dp8_drift_factor"] = sql("""
SELECT channel_id, round(exp(-((n*(xx*py - xy*xp) - x*(x*py - xy*p) + y*(x*xp - xx*p))
       / nullif(n*(xx*p - xp*xp) - x*(x*p - xp*p) + p*(x*xp - xx*p), 0))), 4) AS factor
FROM fits JOIN (SELECT DISTINCT channel_id FROM main) m USING (channel_id)
WHERE ny = n AND n*(xx*p - xp*xp) - x*(x*p - xp*p) + p*(x*xp - xx*p) <> 0""", "readings", **_POINTS,
    **{k: _CHECKS[k] for k in ("sp", "fits")})


def _draws(main):
    return C.bootstrap_factors(C.rate_histogram(main, pre_end=PRE_END, onset=ONSET))


def _interval(spark, sf):
    points = _points(spark, sf)
    main = _main(spark, sf, points)
    factors = C.rate_factor(main, pre_end=PRE_END, onset=ONSET)
    checks = C.factor_checks(points, pre_end=PRE_END, onset=ONSET, min_side=2)
    return factors, checks, C.bootstrap_interval(_draws(main), factors, checks)


# Every draw is a digest of its own number, so both engines draw the same uploads.
_BOOT = {
    "hist": "SELECT channel_id, side, round(lk * 100 / vw, 2) AS pct, count(*) AS n FROM sided WHERE side IS NOT NULL GROUP BY ALL",
    "bars": """
SELECT channel_id, side, pct, upto, upto - n AS before, size FROM (
  SELECT *, sum(n) OVER (PARTITION BY channel_id, side ORDER BY pct) AS upto, sum(n) OVER (PARTITION BY channel_id, side) AS size FROM hist) h""",
    "sides": """
SELECT channel_id, side, CAST(any_value(size) AS BIGINT) AS size FROM bars
WHERE channel_id IN (SELECT channel_id FROM bars GROUP BY channel_id HAVING count(DISTINCT side) = 2) GROUP BY channel_id, side""",
    "drawn": """
SELECT channel_id, side, size, replicate, CAST(floor(CAST(CAST('0x' || substr(md5(concat_ws('|', '20260907', channel_id, side, replicate, draw)), 1, 10) AS BIGINT) AS DOUBLE)
       * size / 1099511627776.0::DOUBLE) AS BIGINT) AS place
FROM (SELECT s.*, replicate, unnest(range(1, size + 1)) AS draw FROM sides s, (SELECT unnest(range(4000)) AS replicate) r) d""",
    "mids": """
SELECT m.channel_id, m.side, m.replicate, (a.pct + b.pct) / 2 AS mid FROM (
  SELECT channel_id, side, replicate, l[CAST((size - 1) // 2 AS INT) + 1] AS low, l[CAST(size // 2 AS INT) + 1] AS high
  FROM (SELECT channel_id, side, replicate, size, list_sort(list(place)) AS l FROM drawn GROUP BY ALL) x) m
JOIN bars a ON a.channel_id = m.channel_id AND a.side = m.side AND a.before <= low AND low < a.upto
JOIN bars b ON b.channel_id = m.channel_id AND b.side = m.side AND b.before <= high AND high < b.upto""",
    "draws": """
SELECT channel_id, replicate, CASE WHEN post > 0 THEN pre / post END AS factor FROM (
  SELECT channel_id, replicate, max(mid) FILTER (WHERE side = 'pre') AS pre, max(mid) FILTER (WHERE side = 'post') AS post FROM mids GROUP BY ALL) w""",
    "intervals": """
SELECT i.channel_id, sample_low, sample_high, least(sample_low, alt_low) AS low, greatest(sample_high, alt_high) AS high FROM (
  SELECT channel_id, round(max(f) FILTER (WHERE rn = 101), 2) AS sample_low, round(max(f) FILTER (WHERE rn = 3901), 2) AS sample_high
  FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY f, replicate) AS rn
        FROM (SELECT d.channel_id, d.replicate, coalesce(d.factor, f.factor) AS f FROM draws d JOIN factors f USING (channel_id)) g) r GROUP BY channel_id) i
LEFT JOIN (SELECT channel_id, min(factor) AS alt_low, max(factor) AS alt_high, count(*) AS checks FROM checks GROUP BY channel_id) c USING (channel_id)""",
}


@query(QUERIES, "dp9_bootstrap_interval")
def dp9(spark, sf):
    return _interval(spark, sf)[2]


ORACLE["dp9_bootstrap_interval"] = sql("SELECT * FROM intervals", "readings", **_POINTS, **_CHECKS, **_BOOT)


@query(QUERIES, "dp9_site")
def dp9_site(spark, sf):
    factors, checks, intervals = _interval(spark, sf)
    return C.site_record(factors, intervals, checks, benchmark="ch2")


ORACLE["dp9_site"] = sql("""
SELECT channel_id, f.factor, i.low, i.high, f.n_post, i.sample_low, i.sample_high, count(c.factor) AS checks, min(c.factor) AS check_min, max(c.factor) AS check_max
FROM factors f JOIN intervals i USING (channel_id) LEFT JOIN checks c USING (channel_id)
WHERE channel_id = (SELECT channel_id FROM factors ORDER BY channel_id <> 'ch2', channel_id LIMIT 1)
GROUP BY ALL""", "readings", **_POINTS, **_CHECKS, **_BOOT)


@query(QUERIES, "dp9_pooled_interval")
def dp9_pooled(spark, sf):
    main = _main(spark, sf)
    return C.pooled_interval(_draws(main), C.rate_factor(main, pre_end=PRE_END, onset=ONSET))


ORACLE["dp9_pooled_interval"] = sql("""
SELECT (SELECT round(sum(post_views * factor) / sum(post_views), 2) FROM factors) AS factor, (SELECT CAST(sum(n_post) AS BIGINT) FROM factors) AS n_post,
       round(max(f) FILTER (WHERE rn = 101), 2) AS low, round(max(f) FILTER (WHERE rn = 3901), 2) AS high
FROM (SELECT *, row_number() OVER (ORDER BY f, replicate) AS rn FROM (
  SELECT replicate, sum(f.post_views * coalesce(d.factor, f.factor)) / sum(f.post_views) AS f FROM draws d JOIN factors f USING (channel_id) GROUP BY replicate) g) r""",
    "readings", **_POINTS, **_BOOT)


@query(QUERIES, "ag10_pooled_factor")
def ag10(spark, sf):
    return C.pooled_factor(C.rate_factor(_main(spark, sf), pre_end=PRE_END, onset=ONSET))


ORACLE["ag10_pooled_factor"] = sql("""
SELECT round(sum(post_views * factor) / sum(post_views), 2) AS factor, CAST(sum(n_post) AS BIGINT) AS n_post
FROM factors""", "readings", **_POINTS)


@query(QUERIES, "ag16_rate_distribution")
def ag16(spark, sf):
    return C.rate_histogram(_main(spark, sf), pre_end=PRE_END, onset=ONSET)


ORACLE["ag16_rate_distribution"] = sql("""
SELECT channel_id, side, round(lk * 100 / vw, 2) AS pct, count(*) AS n FROM sided WHERE side IS NOT NULL GROUP BY ALL""",
    "readings", **_POINTS)


def _audits(spark, sf):
    """One audit per half-day, a little after the slot opens."""
    at = F.col("slot_ix") * 43200 + 7200 + (F.col("slot_ix") % 3) * 2700
    return _snaps(spark, sf).select(F.timestamp_seconds(at).alias("audit_at"))


def _legs(spark, sf):
    pool = A.dormant_pool(T.videos(spark, sf), T.ad_videos(spark, sf), channel="ch2", published_before="2024-01-02")
    return A.audit_legs(_audits(spark, sf), A.pool_totals(T.readings(spark, sf), pool))


_LEGS = {
    "audits": "SELECT TIMESTAMP '1970-01-01' + to_seconds(slot_ix*43200 + 7200 + (slot_ix % 3)*2700) AS audit_at FROM axis",
    "totals": """
SELECT snap_ix, captured_at, CAST(sum(CASE WHEN is_short THEN 0 ELSE views END) AS BIGINT) AS l,
       CAST(sum(CASE WHEN is_short THEN views ELSE 0 END) AS BIGINT) AS s
FROM readings WHERE channel_id = 'ch2' AND video_id % 17 <> 0 AND video_id % 10 <> 1
  AND CAST(published_at AS DATE) < DATE '2024-01-02' GROUP BY snap_ix, captured_at""",
    "seen": """
SELECT a.audit_at, min_by(t.l, t.captured_at) AS l, min_by(t.s, t.captured_at) AS s, min(t.captured_at) AS captured_at
FROM audits a JOIN totals t ON t.captured_at >= a.audit_at
 AND epoch_us(t.captured_at) - epoch_us(a.audit_at) <= 14 * 3600000000 GROUP BY a.audit_at""",
    "kept": """
SELECT * FROM (SELECT *, coalesce(l = lag(l) OVER w AND s = lag(s) OVER w, FALSE) AS same FROM seen WINDOW w AS (ORDER BY audit_at)) k
WHERE NOT same""",
    "legs": """
SELECT audit_at, hours, CASE WHEN hour(audit_at) < 9 THEN 'early' ELSE 'late' END AS phase, dl / hours * 24 AS lg, ds / hours * 24 AS sg
FROM (SELECT *, (epoch_us(audit_at) - epoch_us(lag(audit_at) OVER w)) / 86400000000.0::DOUBLE * 24 AS hours,
             l - lag(l) OVER w AS dl, s - lag(s) OVER w AS ds FROM kept WINDOW w AS (ORDER BY audit_at)) g WHERE hours IS NOT NULL""",
}


@query(QUERIES, "jn5_forward_asof")
def jn5(spark, sf):
    pool = A.dormant_pool(T.videos(spark, sf), T.ad_videos(spark, sf), channel="ch2", published_before="2024-01-02")
    seen = asof.forward_asof(_audits(spark, sf), A.pool_totals(T.readings(spark, sf), pool), left_time="audit_at",
                             right_time="captured_at", tolerance_hours=14.0, keep=["long_views", "short_views"])
    return seen.select(F.unix_seconds("audit_at").alias("audit_sec"), F.unix_seconds("captured_at").alias("captured_sec"),
                       "long_views", "short_views")


ORACLE["jn5_forward_asof"] = sql("""
SELECT CAST(floor(epoch(audit_at)) AS BIGINT) AS audit_sec, CAST(floor(epoch(captured_at)) AS BIGINT) AS captured_sec,
       l AS long_views, s AS short_views FROM seen""", "readings", "axis", **_LEGS)


@query(QUERIES, "wn12_audit_legs")
def wn12(spark, sf):
    return _legs(spark, sf).select(F.unix_seconds("audit_at").alias("audit_sec"), "phase",
                                   F.round("hours", 4).alias("hours"), F.round("long_gain", 3).alias("long_gain"),
                                   F.round("short_gain", 3).alias("short_gain"))


ORACLE["wn12_audit_legs"] = sql("""
SELECT CAST(floor(epoch(audit_at)) AS BIGINT) AS audit_sec, phase, round(hours, 4) AS hours,
       round(lg, 3) AS long_gain, round(sg, 3) AS short_gain FROM legs""", "readings", "axis", **_LEGS)


@query(QUERIES, "dp19_step_test")
def dp19(spark, sf):
    return A.did_factor(_legs(spark, sf), change="2024-01-16")


ORACLE["dp19_step_test"] = sql("""
SELECT phase, n_pre, n_post, round(pl, 3) AS pre_long, round(ps, 3) AS pre_short, round(ql, 3) AS post_long,
       round(qs, 3) AS post_short, round(sd / nullif(pl, 0), 4) AS baseline_cv,
       round((ql / nullif(pl, 0)) / nullif(qs / nullif(ps, 0), 0), 4) AS did
FROM (SELECT phase, count(*) FILTER (WHERE pre) AS n_pre, count(*) FILTER (WHERE NOT pre) AS n_post,
             median(CASE WHEN pre THEN lg END) AS pl, median(CASE WHEN pre THEN sg END) AS ps,
             median(CASE WHEN NOT pre THEN lg END) AS ql, median(CASE WHEN NOT pre THEN sg END) AS qs,
             stddev_pop(CASE WHEN pre THEN lg END) AS sd
      FROM (SELECT *, CAST(audit_at AS DATE) < DATE '2024-01-16' AS pre FROM legs WHERE hours BETWEEN 10 AND 13.5) l GROUP BY phase) g
WHERE n_pre >= 3 AND n_post >= 2""", "readings", "axis", **_LEGS)


@query(QUERIES, "qg6_clock_health")
def qg6(spark, sf):
    return A.clock_health(_legs(spark, sf), _audits(spark, sf))


ORACLE["qg6_clock_health"] = sql("""
SELECT legs, irregular, CASE WHEN irregular > 0.20 * legs THEN 'degraded' WHEN irregular > 0.05 * legs THEN 'marginal' ELSE 'steady' END AS verdict
FROM (SELECT count(*) AS legs, count(*) FILTER (WHERE hours NOT BETWEEN 10 AND 13.5) AS irregular
      FROM legs WHERE audit_at > (SELECT max(audit_at) FROM audits) - INTERVAL 7 DAY) g""", "readings", "axis", **_LEGS)
