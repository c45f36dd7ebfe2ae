"""Monthly performance, comparators and channel overview queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions.calendar import same_point
from tidegauge.functions.revenue import engaged_views, exposure
from tidegauge.operators import asof
from tidegauge.plans import formats as P
from tidegauge.registry.base import local, query, sql
from tidegauge.registry.series import _snaps
from tidegauge.sources import tables as T

QUERIES: dict = {}
ORACLE: dict = {}
AS_OF = "2024-02-20 09:14:37"
STEP = "2024-01-14 00:00:00"  # the stand-in's counting change


def _exposure(onset: str) -> str:
    days = f"((epoch_us(TIMESTAMP '{onset}') - epoch_us(published_at)) / 86400000000.0::DOUBLE)"
    knots = [(0.0, 0.0), (0.5, 0.416), (1.0, 0.718), (2.0, 0.917), (3.0, 0.96), (7.0, 0.995), (14.0, 0.999), (21.0, 1.0)]
    arms = " ".join(f"WHEN {days} <= {d1} THEN 1 - ({a0}::DOUBLE + {a1 - a0!r}::DOUBLE * (({days} - {d0}) / {d1 - d0}::DOUBLE))"
                    for (d0, a0), (d1, a1) in zip(knots, knots[1:]))
    return f"(CASE WHEN {days} <= 0 THEN 1::DOUBLE WHEN {days} >= 21 THEN 0::DOUBLE {arms} ELSE 0::DOUBLE END)"


def _engaged(onset: str, factor: str) -> str:
    return f"(coalesce(views, 0)::DOUBLE / (1 + ({factor}::DOUBLE - 1) * {_exposure(onset)}))"


def _stats_sql(src: str, by: str, onset: str) -> str:
    """The SQL twin of format_stats over a relation `src`."""
    dur = "(CASE WHEN duration_sec > 0 THEN duration_sec ELSE 600 END)"
    low = f"(CASE WHEN {dur} >= 480 THEN 0.85::DOUBLE WHEN {dur} >= 180 THEN 0.5 ELSE 0.3 END)"
    high = f"(CASE WHEN {dur} >= 480 THEN 1.28::DOUBLE WHEN {dur} >= 180 THEN 1.0 ELSE 0.6 END)"

    def r(x: str) -> str:
        return f"CAST(floor({x} + 0.5) AS BIGINT)"

    def t(cond: str, x: str) -> str:
        return f"coalesce(sum(CASE WHEN {cond} THEN {x} END), 0)"

    L, S = "NOT is_short", "is_short"
    return f"""
SELECT {by}, n, tot, med, engaged, engaged_med, CASE WHEN n > 0 THEN coalesce(lv, 0) END AS lv, comments,
       CASE WHEN n > 0 THEN coalesce(avg_len, 0) END AS avg_len, runtime, lrev_lo, lrev_hi, srev_lo, srev_hi,
       shorts_n, shorts_views, coalesce(shorts_med, 0) AS shorts_med
FROM (SELECT {by}, count(*) FILTER (WHERE {L}) AS n, CAST({t(L, 'views')} AS BIGINT) AS tot,
  {r(f"median(CASE WHEN {L} THEN views END)")} AS med, {r(t(L, _engaged(onset, '2.07')))} AS engaged,
  {r(f"median(CASE WHEN {L} THEN {_engaged(onset, '2.07')} END)")} AS engaged_med,
  {r(f"median(CASE WHEN {L} AND views > 0 THEN likes / views END) * 1000")} / 10 AS lv,
  CAST({t(L, 'comments')} AS BIGINT) AS comments,
  {r(f"median(CASE WHEN {L} AND duration_sec > 0 THEN duration_sec END) / 60 * 10")} / 10 AS avg_len,
  coalesce({r(f"sum(CASE WHEN {L} AND duration_sec > 0 THEN duration_sec END) / 3600 * 10")} / 10, 0) AS runtime,
  {r(t(L, f"{_engaged(onset, '2.24')} / 1000 * {low}"))} AS lrev_lo, {r(t(L, f"{_engaged(onset, '1.94')} / 1000 * {high}"))} AS lrev_hi,
  {r(t(S, 'views / 1000 * 0.02::DOUBLE'))} AS srev_lo, {r(t(S, 'views / 1000 * 0.07::DOUBLE'))} AS srev_hi,
  count(*) FILTER (WHERE {S}) AS shorts_n, CAST({t(S, 'views')} AS BIGINT) AS shorts_views,
  median(CASE WHEN {S} THEN views END) AS shorts_med
FROM {src} GROUP BY {by}) g"""


_MONTHLY = {
    "rows_in": f"""
SELECT *, unnest(['ALL', channel_id]) AS scope, strftime({local('published_at')}, '%Y-%m') AS month
FROM order_videos WHERE NOT unavailable""",
    "monthly": _stats_sql("rows_in", "scope, month", "2026-08-27 00:00:00"),
}


@query(QUERIES, "dp40_monthly_performance")
def dp40(spark, sf):
    return P.monthly_performance(T.order_videos(spark, sf))


ORACLE["dp40_monthly_performance"] = sql("SELECT * FROM monthly", "order_videos", **_MONTHLY)


@query(QUERIES, "wn15_peaks")
def wn15(spark, sf):
    rows = T.order_videos(spark, sf).where("NOT unavailable")
    series = rows.withColumn("month", F.date_format("published_at", "yyyy-MM")).groupBy(
        F.col("channel_id").alias("scope"), "month").agg(F.sum("views").alias("tot"))
    return P.peaks(series)


ORACLE["wn15_peaks"] = sql("""
SELECT s.scope, s.month, s.tot, max(tot) OVER w AS running_peak,
       s.tot > coalesce(max(tot) OVER (PARTITION BY scope ORDER BY s.month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS is_new_peak,
       coalesce(s.month = l.month, FALSE) AS lowest_since_peak
FROM series s LEFT JOIN (
  SELECT s.scope, min_by(s.month, struct_pack(t := s.tot, m := s.month)) AS month FROM series s
  JOIN (SELECT scope, max_by(month, struct_pack(t := tot, m := month)) AS top FROM series GROUP BY scope) p ON p.scope = s.scope AND s.month > p.top
  GROUP BY s.scope) l USING (scope)
WINDOW w AS (PARTITION BY scope ORDER BY s.month)""", "order_videos", series="""
SELECT channel_id AS scope, strftime(published_at, '%Y-%m') AS month, CAST(sum(views) AS BIGINT) AS tot
FROM order_videos WHERE NOT unavailable GROUP BY 1, 2""")


@query(QUERIES, "dp4_previous_month")
def dp4(spark, sf):
    return P.month_comparator(T.readings(spark, sf), T.videos(spark, sf), _snaps(spark, sf), as_of=AS_OF, months_back=1, onset=STEP)


_SCOPES = "SELECT 'ALL' AS scope UNION SELECT channel_id FROM videos"
_FIGS = "n tot med engaged engaged_med lv comments avg_len runtime lrev_lo lrev_hi srev_lo srev_hi shorts_n shorts_views shorts_med".split()
_ZERO = set(_FIGS) - {"med", "engaged_med", "lv", "avg_len"}


def _filled(hide: bool) -> str:
    out = []
    for c in _FIGS:
        col = f"coalesce(s.{c}, 0)" if c in _ZERO else f"s.{c}"
        if c in ("n", "tot", "engaged", "comments", "lrev_lo", "lrev_hi", "srev_lo", "srev_hi", "shorts_n", "shorts_views"):
            col = f"CAST({col} AS BIGINT)"
        if hide and c in P.VIEW_FIGURES:
            col = f"CASE WHEN FALSE THEN {col} END"
        out.append(f"{col} AS {c}")
    return ", ".join(out)


ORACLE["dp4_previous_month"] = sql(f"""
SELECT scope, '2024-01' AS month, {_filled(False)} FROM scopes LEFT JOIN stats s USING (scope)""",
    "readings", "videos", "axis",
    chosen="""
SELECT snap_ix FROM axis WHERE snap_date BETWEEN DATE '2024-01-19' AND DATE '2024-01-21'
ORDER BY abs(epoch_us(captured_at) - epoch_us(TIMESTAMP '2024-01-20 09:14:00')), snap_date, slot LIMIT 1""",
    rows_in=f"""
SELECT r.*, v.duration_sec, unnest(['ALL', r.channel_id]) AS scope FROM readings r JOIN videos v USING (video_id)
WHERE r.snap_ix = (SELECT snap_ix FROM chosen) AND NOT v.unavailable AND strftime({local('r.published_at')}, '%Y-%m') = '2024-01'""",
    stats=_stats_sql("rows_in", "scope", STEP), scopes=_SCOPES)


@query(QUERIES, "dp4_month_without_dump")
def dp4_yoy(spark, sf):
    return P.month_comparator(T.readings(spark, sf), T.videos(spark, sf), _snaps(spark, sf), as_of=AS_OF, months_back=2, onset=STEP)


ORACLE["dp4_month_without_dump"] = sql(f"""
SELECT scope, '2023-12' AS month, {_filled(True)} FROM scopes LEFT JOIN stats s USING (scope)""", "videos",
    rows_in=f"""
SELECT *, unnest(['ALL', channel_id]) AS scope FROM videos
WHERE NOT unavailable AND published_at <= TIMESTAMP '2023-12-20 09:14:00' AND strftime({local('published_at')}, '%Y-%m') = '2023-12'""",
    stats=_stats_sql("rows_in", "scope", STEP), scopes=_SCOPES)


@query(QUERIES, "jn7_nearest_snapshot")
def jn7(spark, sf):
    """Nearest snapshot to the publication instant of every video."""
    aims = T.videos(spark, sf).select(F.col("video_id").cast("string").alias("label"), F.col("published_at").alias("target"))
    return asof.nearest_snapshot(aims, _snaps(spark, sf)).select(
        "label", F.date_format("snap_date", "yyyy-MM-dd").alias("snap_date"), "slot", "gap_us")


ORACLE["jn7_nearest_snapshot"] = sql("""
SELECT label, snap_date, slot, gap_us FROM (
  SELECT CAST(v.video_id AS VARCHAR) AS label, strftime(a.snap_date, '%Y-%m-%d') AS snap_date, a.slot,
         abs(epoch_us(a.captured_at) - epoch_us(v.published_at)) AS gap_us,
         row_number() OVER (PARTITION BY v.video_id ORDER BY abs(epoch_us(a.captured_at) - epoch_us(v.published_at)), a.snap_date, a.slot) AS rk
  FROM videos v JOIN axis a ON a.snap_date BETWEEN CAST(v.published_at AS DATE) - 1 AND CAST(v.published_at AS DATE) + 1) x
WHERE rk = 1""", "videos", "axis")


@query(QUERIES, "fn2_same_point")
def fn2(spark, sf):
    return T.order_videos(spark, sf).select("video_id", *[
        F.unix_seconds(same_point(F.col("published_at"), m)).alias(f"back_{m}") for m in (1, 12)])


def _same_point(m: int) -> str:
    loc = local("published_at")
    first = f"CAST(date_trunc('month', {loc}) - INTERVAL {m} MONTH AS DATE)"
    return (f"CAST(epoch(CAST({first} + CAST(least(day({loc}), day(last_day({first}))) - 1 AS INTEGER) AS TIMESTAMP)) AS BIGINT)"
            f" + hour(published_at) * 3600 + minute(published_at) * 60 AS back_{m}")


ORACLE["fn2_same_point"] = sql(
    f"SELECT video_id, {_same_point(1)}, {_same_point(12)} FROM order_videos", "order_videos")


@query(QUERIES, "fn6_engaged_views")
def fn6(spark, sf):
    return T.videos(spark, sf).select(
        "video_id", F.round(exposure(F.col("published_at"), onset=STEP), 9).alias("exposure"),
        F.round(engaged_views(F.col("views"), F.col("published_at"), 2.07, onset=STEP), 6).alias("engaged"))


ORACLE["fn6_engaged_views"] = sql(
    f"SELECT video_id, round({_exposure(STEP)}, 9) AS exposure, round({_engaged(STEP, '2.07')}, 6) AS engaged FROM videos", "videos")


def _live(df):
    return df.withColumn("is_live", F.col("video_id") % 7 == 0).withColumn(
        "is_short", ~F.col("is_live") & F.col("is_short"))


@query(QUERIES, "dp43_format_overview")
def dp43(spark, sf):
    return P.format_overview(_live(T.order_videos(spark, sf)))


ORACLE["dp43_format_overview"] = sql("""
SELECT channel_id, CASE WHEN video_id % 7 = 0 THEN 'live' WHEN is_short THEN 'short' ELSE 'long' END AS format, count(*) AS n,
       CAST(sum(views) AS BIGINT) AS views, median(duration_sec) AS median_sec, CAST(sum(duration_sec) AS BIGINT) AS runtime_sec
FROM order_videos WHERE NOT unavailable GROUP BY 1, 2""", "order_videos")


def channel_days(spark, sf):
    """Daily channel totals: cumulative views and answered checks of all its videos."""
    r = T.readings(spark, sf)
    return r.groupBy("channel_id", F.col("snap_date").alias("day")).agg(
        F.sum("views").alias("channel_views"), F.sum("comments").alias("subscriber_count"),
        F.count_distinct("video_id").alias("video_count"))


CHANNEL_DAYS = """
SELECT channel_id, snap_date AS day, CAST(sum(views) AS BIGINT) AS channel_views, CAST(sum(comments) AS BIGINT) AS subscriber_count,
       count(DISTINCT video_id) AS video_count FROM readings GROUP BY channel_id, snap_date"""


@query(QUERIES, "dp45_channel_month_deltas")
def dp45(spark, sf):
    # The tables span one month, so ten-day periods stand in for months here.
    days = channel_days(spark, sf)
    shifted = days.withColumn("day", F.add_months(F.trunc("day", "MM"), F.least(F.floor((F.dayofmonth("day") - 1) / 10), F.lit(2)).cast("int"))
                              + F.expr("make_dt_interval(dayofmonth(day) - 1 - 10 * least((dayofmonth(day) - 1) div 10, 2))"))
    return P.channel_month_deltas(shifted.withColumn("day", F.to_date("day")))


ORACLE["dp45_channel_month_deltas"] = sql("""
SELECT channel_id, month, channel_views, channel_views - lag(channel_views) OVER w AS channel_views_delta,
       subscriber_count, subscriber_count - lag(subscriber_count) OVER w AS subscriber_count_delta,
       video_count, video_count - lag(video_count) OVER w AS video_count_delta
FROM (SELECT channel_id, strftime(date_trunc('month', day) + to_months(CAST(least((day(day) - 1) // 10, 2) AS INTEGER)), '%Y-%m') AS month,
             max_by(channel_views, k) AS channel_views, max_by(subscriber_count, k) AS subscriber_count, max_by(video_count, k) AS video_count
      FROM (SELECT *, day(day) - 1 - 10 * least((day(day) - 1) // 10, 2) AS k FROM cd) c GROUP BY 1, 2) m
WINDOW w AS (PARTITION BY channel_id ORDER BY month)""", "readings", cd=CHANNEL_DAYS)


def _debut_source(spark, sf):
    """Videos with their publication as text, some of it unreadable."""
    text = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return T.videos(spark, sf).select(
        "video_id", "channel_id", "views", "published_at",
        F.when(F.col("video_id") % 9 == 0, "soon").otherwise(text).alias("published_text"))


@query(QUERIES, "dp39_debut_sample")
def dp39(spark, sf):
    return P.debut_sample(_debut_source(spark, sf), as_of="2024-01-12 10:30:00", hours=240).select(
        "video_id", "channel_id", "views", "age_h")


ORACLE["dp39_debut_sample"] = sql("""
SELECT video_id, channel_id, views, round(us / 3600000000.0::DOUBLE, 2) AS age_h
FROM (SELECT *, epoch_us(TIMESTAMP '2024-01-12 10:30:00') - epoch_us(published_at) AS us FROM videos WHERE video_id % 9 <> 0) x
WHERE us >= -3600000000 AND us <= 864000000000""", "videos")


@query(QUERIES, "dp39_debut_newest")
def dp39_newest(spark, sf):
    sample = P.debut_sample(_debut_source(spark, sf), as_of="2024-01-12 10:30:00", hours=240)
    return sample.agg(F.count(F.lit(1)).alias("n"), F.max_by("video_id", F.struct("published_at", "video_id")).alias("newest"))


ORACLE["dp39_debut_newest"] = sql("""
SELECT count(*) AS n, max_by(video_id, struct_pack(p := published_at, v := video_id)) AS newest FROM videos
WHERE video_id % 9 <> 0 AND published_at <= TIMESTAMP '2024-01-12 11:30:00' AND published_at >= TIMESTAMP '2024-01-02 10:30:00'""", "videos")
