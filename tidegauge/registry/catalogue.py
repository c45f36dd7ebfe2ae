"""Catalogue, projection and quality-guard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import numbers as N
from tidegauge.operators import catalogue as C
from tidegauge.operators import quality as Q
from tidegauge.operators import selections as SEL
from tidegauge.plans import audits
from tidegauge.registry.base import query, sql
from tidegauge.registry.formats import CHANNEL_DAYS, channel_days
from tidegauge.registry.series import _snaps
from tidegauge.sources import tables as T

QUERIES: dict = {}
ORACLE: dict = {}
AS_OF = "2024-02-01 00:00:00"


def _key():
    return F.col("video_id")


def _stored(spark, sf):
    """Yesterday's catalogue: three quarters of the ids, with lower counts."""
    return T.order_videos(spark, sf).where(_key() % 4 != 0).withColumns({
        "views": F.expr("views div 2"), "comments": F.expr("comments div 2")})


def _fresh(spark, sf):
    return T.order_videos(spark, sf).where(_key() % 3 != 1)


_OLD = "SELECT * REPLACE (views // 2 AS views, comments // 2 AS comments) FROM order_videos WHERE video_id % 4 <> 0"
_NEW = "SELECT * FROM order_videos WHERE video_id % 3 <> 1"


@query(QUERIES, "cat1_merge_latest")
def cat1(spark, sf):
    return C.merge_latest(_stored(spark, sf), _fresh(spark, sf)).select("video_id", "channel_id", "views", "likes", "comments")


ORACLE["cat1_merge_latest"] = sql("""
SELECT video_id, channel_id, views, likes, comments FROM fresh UNION ALL
SELECT video_id, channel_id, views, likes, comments FROM stored WHERE video_id NOT IN (SELECT video_id FROM fresh)""",
    "order_videos", stored=_OLD, fresh=_NEW)


def _flagged(spark, sf):
    since = F.lit("2024-01-05 00:00:00").cast("timestamp")
    return _stored(spark, sf).withColumn("unavailable_since", F.when(F.col("unavailable"), since))


@query(QUERIES, "cat2_apply_observations")
def cat2(spark, sf):
    out = C.apply_observations(_flagged(spark, sf), _fresh(spark, sf), as_of=AS_OF)
    return out.select("video_id", "views", "likes", "comments", "is_short", "unavailable",
                      F.date_format("unavailable_since", "yyyy-MM-dd").alias("unavailable_since"))


ORACLE["cat2_apply_observations"] = sql("""
SELECT s.video_id, CASE WHEN f.video_id IS NOT NULL THEN f.views ELSE s.views END AS views,
       CASE WHEN f.video_id IS NOT NULL THEN f.likes ELSE s.likes END AS likes,
       CASE WHEN f.video_id IS NOT NULL THEN f.comments ELSE s.comments END AS comments,
       CASE WHEN f.video_id IS NOT NULL THEN coalesce(f.duration_sec > 0 AND f.duration_sec <= 180 AND s.published_at >= TIMESTAMP '2021-03-18', FALSE) ELSE s.is_short END AS is_short,
       f.video_id IS NULL AS unavailable,
       CASE WHEN f.video_id IS NULL THEN CASE WHEN s.unavailable THEN '2024-01-05' ELSE '2024-02-01' END END AS unavailable_since
FROM stored s LEFT JOIN fresh f USING (video_id)""", "order_videos", stored=_OLD, fresh=_NEW)

_STREAKS = {
    "st": """
SELECT *, CASE WHEN present THEN 0 ELSE row_number() OVER (PARTITION BY video_id, isl, present ORDER BY pass_id) END AS streak
FROM (SELECT *, sum(CASE WHEN present THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY pass_id) AS isl FROM presence) p""",
    "evs": """
SELECT video_id, pass_id, observed_at, CASE WHEN streak = 4 THEN 'newly_unavailable' ELSE 'restored' END AS event
FROM (SELECT *, lag(streak) OVER (PARTITION BY video_id ORDER BY pass_id) AS prev FROM st) s
WHERE streak = 4 OR (present AND prev >= 4)""",
}


@query(QUERIES, "cat3_availability_events")
def cat3(spark, sf):
    return C.availability_events(T.presence_observations(spark, sf)).select("video_id", "pass_id", "event")


ORACLE["cat3_availability_events"] = sql("SELECT video_id, pass_id, event FROM evs", "presence", **_STREAKS)


@query(QUERIES, "cat4_confirmed_absences")
def cat4(spark, sf):
    return C.confirmed_absences(T.presence_observations(spark, sf), rechecks=1).select(
        "video_id", F.col("streak").cast("bigint").alias("streak"))


ORACLE["cat4_confirmed_absences"] = sql("""
SELECT video_id, max_by(streak, pass_id) AS streak FROM st GROUP BY video_id HAVING max_by(streak, pass_id) > 1""",
    "presence", st=_STREAKS["st"])


@query(QUERIES, "cat5_bulk_removal_guard")
def cat5(spark, sf):
    return C.bulk_removal_guard(T.presence_observations(spark, sf), bulk_over=1)


ORACLE["cat5_bulk_removal_guard"] = sql("""
SELECT pass_id, flagged, returned, flagged - returned AS confirmed, flagged - returned > 1 AS warn
FROM (SELECT pass_id, count(*) AS flagged, CASE WHEN count(*) > 1 THEN count(*) FILTER (WHERE coalesce(nxt, FALSE)) ELSE 0 END AS returned
      FROM evs JOIN (SELECT video_id, pass_id, lead(present) OVER (PARTITION BY video_id ORDER BY pass_id) AS nxt FROM presence) n
        USING (video_id, pass_id) WHERE event = 'newly_unavailable' GROUP BY pass_id) g""", "presence", **_STREAKS)


@query(QUERIES, "cat6_unlisted_state")
def cat6(spark, sf):
    stored = T.videos(spark, sf).withColumn("unlisted_since", F.when(F.col("unlisted"), F.lit("2024-01-05").cast("timestamp")))
    status = T.videos(spark, sf).where(_key() % 5 != 0).select(
        "video_id", F.when(_key() % 4 == 0, "unlisted").when(_key() % 4 == 1, "public").otherwise("private").alias("privacy_status"))
    return C.apply_privacy(stored, status, as_of=AS_OF).select(
        "video_id", "unlisted", "newly_unlisted", F.date_format("unlisted_since", "yyyy-MM-dd").alias("unlisted_since"))


ORACLE["cat6_unlisted_state"] = sql("""
SELECT video_id, ps = 'unlisted' OR (unlisted AND ps <> 'public') AS unlisted, ps = 'unlisted' AND NOT unlisted AS newly_unlisted,
       CASE WHEN ps = 'unlisted' AND NOT unlisted THEN '2024-02-01' WHEN ps <> 'public' AND unlisted THEN '2024-01-05' END AS unlisted_since
FROM (SELECT *, CASE WHEN video_id % 5 = 0 THEN '-' WHEN video_id % 4 = 0 THEN 'unlisted' WHEN video_id % 4 = 1 THEN 'public' ELSE 'private' END AS ps
      FROM videos) v""", "videos")


@query(QUERIES, "cat7_deletion_sweep")
def cat7(spark, sf):
    return C.deletion_sweep(_stored(spark, sf), _fresh(spark, sf), since="2000-01-01").select("video_id", "channel_id")


ORACLE["cat7_deletion_sweep"] = sql("""
SELECT video_id, channel_id FROM stored WHERE published_at >= TIMESTAMP '2000-01-01' AND video_id NOT IN (SELECT video_id FROM fresh)""",
    "order_videos", stored=_OLD, fresh=_NEW)

_TITLES = {
    "tc": """
SELECT video_id, pass_id, prev AS from_title, title AS to_title, via
FROM (SELECT *, lag(title) OVER (PARTITION BY video_id ORDER BY pass_id) AS prev FROM title_obs WHERE length(title) > 0) t
WHERE prev IS NOT NULL AND title <> prev""",
}


@query(QUERIES, "cat8_title_changes")
def cat8(spark, sf):
    return C.title_changes(T.title_observations(spark, sf))


ORACLE["cat8_title_changes"] = sql("SELECT * FROM tc", "title_obs", **_TITLES)


@query(QUERIES, "cat8_title_ledger")
def cat8_ledger(spark, sf):
    return C.title_ledger(T.title_observations(spark, sf))


ORACLE["cat8_title_ledger"] = sql("""
SELECT video_id, min_by(title, pass_id) AS first_title, max_by(title, pass_id) AS current_title
FROM title_obs WHERE length(title) > 0 GROUP BY video_id""", "title_obs")


@query(QUERIES, "cat9_title_summary")
def cat9(spark, sf):
    return C.title_summary(T.title_observations(spark, sf), T.text_videos(spark, sf))


ORACLE["cat9_title_summary"] = sql("""
SELECT (SELECT count(DISTINCT video_id) FROM title_obs WHERE length(title) > 0 AND video_id IN (SELECT doc_id FROM documents)) AS tracked,
       count(DISTINCT video_id) AS retitled, count(*) AS changes FROM tc WHERE video_id IN (SELECT doc_id FROM documents)""", "title_obs", **_TITLES)


@query(QUERIES, "cat10_descriptions")
def cat10(spark, sf):
    docs = T.text_videos(spark, sf).select("video_id", F.col("description").alias("text"))
    stored = docs.where(_key() % 3 != 0).withColumn("text", F.lower("text"))
    return C.upsert_descriptions(stored, docs.where(_key() % 2 == 0), docs.where(_key() % 7 != 0))


ORACLE["cat10_descriptions"] = sql("""
SELECT video_id, CASE WHEN video_id % 2 = 0 THEN description ELSE lower(description) END AS text
FROM text_videos WHERE (video_id % 2 = 0 OR video_id % 3 <> 0) AND video_id % 7 <> 0""", "text_videos")


@query(QUERIES, "cat11_channel_days")
def cat11(spark, sf):
    days = channel_days(spark, sf)
    stored = days.where(F.dayofmonth("day") % 3 != 0).withColumn("channel_views", F.col("channel_views") - 1)
    return C.channel_day_upsert(stored, days.where(F.dayofmonth("day") % 2 == 0)).withColumn(
        "day", F.date_format("day", "yyyy-MM-dd"))


ORACLE["cat11_channel_days"] = sql("""
SELECT channel_id, strftime(day, '%Y-%m-%d') AS day, CASE WHEN day(day) % 2 = 0 THEN channel_views ELSE channel_views - 1 END AS channel_views, subscriber_count, video_count
FROM cd WHERE day(day) % 2 = 0 OR day(day) % 3 <> 0""", "readings", cd=CHANNEL_DAYS)


@query(QUERIES, "cat12_catalogue_counts")
def cat12(spark, sf):
    videos = T.order_videos(spark, sf).withColumn("unlisted", _key() % 23 == 0)
    return C.catalogue_counts(videos).withColumns({
        "channel_id": F.coalesce("channel_id", F.lit("ALL")),
        "oldest": F.date_format("oldest", "yyyy-MM-dd HH:mm"), "newest": F.date_format("newest", "yyyy-MM-dd HH:mm")})


ORACLE["cat12_catalogue_counts"] = sql("""
SELECT coalesce(channel_id, 'ALL') AS channel_id, count(*) AS videos, count(*) FILTER (WHERE NOT is_short AND NOT unavailable) AS long_form,
       count(*) FILTER (WHERE is_short AND NOT unavailable) AS shorts, count(*) FILTER (WHERE unavailable) AS unavailable,
       count(*) FILTER (WHERE video_id % 23 = 0 AND NOT unavailable) AS unlisted,
       strftime(min(published_at), '%Y-%m-%d %H:%M') AS oldest, strftime(max(published_at), '%Y-%m-%d %H:%M') AS newest
FROM order_videos GROUP BY ROLLUP (channel_id)""", "order_videos")


@query(QUERIES, "qg5_reconcile")
def qg5(spark, sf):
    videos = T.order_videos(spark, sf).withColumn("unlisted", _key() % 23 == 0)
    platform = _fresh(spark, sf).where(_key() % 2 == 0).groupBy("channel_id").agg(F.count(F.lit(1)).alias("c")).select(
        "channel_id", F.when(F.col("channel_id") == "5-LOW", 0).otherwise(F.col("c")).cast("bigint").alias("platform_count"))
    return C.reconcile_counts(videos, platform)


ORACLE["qg5_reconcile"] = sql("""
SELECT channel_id, platform_count, our_public, our_public - platform_count AS shortfall
FROM (SELECT channel_id, CASE WHEN channel_id = '5-LOW' THEN 0 ELSE count(*) END AS platform_count FROM fresh GROUP BY channel_id) p
JOIN (SELECT channel_id, count(*) FILTER (WHERE NOT unavailable AND video_id % 23 <> 0) AS our_public FROM order_videos GROUP BY channel_id) o
  USING (channel_id) WHERE platform_count > 0 AND platform_count < our_public""", "order_videos", fresh=_NEW + " AND video_id % 2 = 0")

# Status lines of removed items, chosen per row by id.
_LINES = [
    ("OK", "", ""), ("LOGIN_REQUIRED", "Private video", "Sign in if you have been granted access"),
    ("LOGIN_REQUIRED", "Sign in to confirm your age", ""), ("ERROR", "Video unavailable", "It was removed following a copyright removal request by Acme Media Ltd. "),
    ("ERROR", "Removed", "violating the Terms of Service"), ("UNPLAYABLE", "Removed for violating Community Guidelines", ""),
    ("ERROR", "The account associated with this video has been terminated", ""), ("ERROR", "Removed by the uploader", ""),
    ("ERROR", "This video isn't available anymore", ""), ("UNPLAYABLE", "Something else", ""), ("", "", "")]


def _statuses(spark, sf):
    pick = F.element_at(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(line, ("status", "reason_text", "detail_text"))])
                                  for line in _LINES]), (_key() % len(_LINES) + 1).cast("int"))
    return (T.order_videos(spark, sf).where("unavailable").select("video_id", pick.alias("p")).select("video_id", "p.*"))


_REASON_SQL = """
SELECT video_id, CASE video_id % 11 WHEN 0 THEN 'public' WHEN 1 THEN 'private' WHEN 3 THEN 'copyright' WHEN 4 THEN 'terms'
 WHEN 5 THEN 'guidelines' WHEN 6 THEN 'terminated' WHEN 7 THEN 'deleted' WHEN 8 THEN 'deleted' WHEN 9 THEN 'unavailable' END AS reason,
 CASE WHEN video_id % 11 = 3 THEN 'Acme Media Ltd' END AS detail FROM order_videos WHERE unavailable"""


@query(QUERIES, "cat14_reason_classifier")
def cat14(spark, sf):
    s = _statuses(spark, sf)
    reason = C.removal_reason(F.col("status"), F.col("reason_text"), F.col("detail_text"))
    return s.select("video_id", reason.alias("reason"), C.copyright_claimant(F.col("detail_text")).alias("detail"))


ORACLE["cat14_reason_classifier"] = sql(_REASON_SQL, "order_videos")


def _reason_store(spark, sf):
    """Reasons known from before, checked at different times."""
    kept = T.order_videos(spark, sf).where(_key() % 2 == 0)
    return kept.select(
        "video_id", F.when(_key() % 8 == 0, "unavailable").when(_key() % 8 == 2, "unlisted").otherwise("private").alias("reason"),
        F.lit(None).cast("string").alias("detail"),
        F.timestamp_seconds(F.lit(1706745600) - (_key() % 15) * 86400).alias("checked"))


def _next_reasons(spark, sf):
    videos = T.order_videos(spark, sf).withColumn("unlisted", _key() % 23 == 0)
    s = _statuses(spark, sf)
    resolved = s.select("video_id", C.removal_reason(F.col("status"), F.col("reason_text"), F.col("detail_text")).alias("reason"),
                        C.copyright_claimant(F.col("detail_text")).alias("detail"))
    return C.merge_reasons(_reason_store(spark, sf), videos, resolved, as_of=AS_OF, refresh_days=7)


_REASONS = {
    "store": """
SELECT video_id, CASE video_id % 8 WHEN 0 THEN 'unavailable' WHEN 2 THEN 'unlisted' ELSE 'private' END AS reason, video_id % 15 AS age
FROM order_videos WHERE video_id % 2 = 0""",
    "resolved": _REASON_SQL,
    "nexts": """
SELECT video_id, CASE action WHEN 'take' THEN new WHEN 'unlisted' THEN 'unlisted' ELSE old END AS reason,
       CASE WHEN action = 'take' THEN detail END AS detail, CASE WHEN action IN ('take', 'unlisted') THEN 0 ELSE age END AS age
FROM (SELECT *, CASE WHEN NOT unavailable AND old = 'unlisted' THEN 'keep' WHEN NOT unavailable THEN 'unlisted'
                     WHEN (old <> 'unavailable' AND age < 7) OR new IS NULL THEN 'keep' WHEN new = 'public' THEN 'drop' ELSE 'take' END AS action
      FROM (SELECT o.video_id, o.unavailable, s.reason AS old, s.age, r.reason AS new, r.detail
            FROM order_videos o LEFT JOIN store s USING (video_id) LEFT JOIN resolved r USING (video_id)
            WHERE o.unavailable OR o.video_id % 23 = 0) j) a
WHERE action <> 'drop' AND CASE action WHEN 'take' THEN new WHEN 'unlisted' THEN 'unlisted' ELSE old END IS NOT NULL""",
}


@query(QUERIES, "cat13_reason_upsert")
def cat13(spark, sf):
    return _next_reasons(spark, sf).withColumn("checked", F.date_format("checked", "yyyy-MM-dd"))


ORACLE["cat13_reason_upsert"] = sql("""
SELECT video_id, reason, detail, strftime(DATE '2024-02-01' - CAST(age AS INTEGER), '%Y-%m-%d') AS checked FROM nexts""",
    "order_videos", **_REASONS)


@query(QUERIES, "cat15_reason_tally")
def cat15(spark, sf):
    return _next_reasons(spark, sf).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


ORACLE["cat15_reason_tally"] = sql("SELECT reason, count(*) AS n FROM nexts GROUP BY reason", "order_videos", **_REASONS)


@query(QUERIES, "dp44_removed_list")
def dp44(spark, sf):
    videos = T.order_videos(spark, sf).withColumn("unlisted", _key() % 23 == 0)
    return C.removed_list(videos, _next_reasons(spark, sf))


ORACLE["dp44_removed_list"] = sql("""
SELECT o.video_id, o.channel_id, o.views, coalesce(n.reason, 'unknown') AS reason, coalesce(n.reason = 'guidelines', FALSE) AS strike_alert
FROM order_videos o LEFT JOIN nexts n USING (video_id) WHERE o.unavailable OR o.video_id % 23 = 0""", "order_videos", **_REASONS)


@query(QUERIES, "cat19_associate_refresh")
def cat19(spark, sf):
    name = F.concat(F.lit("Order "), _key().cast("string"))
    stored = _stored(spark, sf).withColumn("title", F.lower(name)).withColumn(
        "duration_sec", F.when(_key() % 9 == 0, 0).otherwise(F.col("duration_sec")).cast("bigint"))
    return C.refresh_associates(stored, _fresh(spark, sf).withColumn("title", name), since="2001-01-01") \
        .withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd"))


ORACLE["cat19_associate_refresh"] = sql("""
SELECT video_id, channel_id, CASE WHEN video_id % 3 <> 1 THEN 'Order ' ELSE 'order ' END || CAST(video_id AS VARCHAR) AS title,
       strftime(published_at, '%Y-%m-%d') AS published_at, d AS duration_sec, v AS views,
       published_at >= TIMESTAMP '2001-01-01' OR d = 0 AS refresh
FROM (SELECT *, CASE WHEN video_id % 4 = 0 OR video_id % 9 = 0 THEN 0 ELSE duration_sec END AS d,
             CASE WHEN video_id % 4 = 0 THEN 0 ELSE views // 2 END AS v
      FROM order_videos WHERE video_id % 4 <> 0 OR video_id % 3 <> 1) x""", "order_videos")


def _attempts(spark, sf):
    """Conversation turns as transcript attempts: a quarter of the conversations fails, some for good."""
    conv, turn = F.col("conv_id"), F.col("turn")
    ok = (conv + turn) % 4 != 0
    error = F.when(~ok, F.when(conv % 3 == 0, "Subtitles are Disabled on this video").otherwise("empty transcript"))
    segs = F.transform(F.split("text", "\n"), lambda s: F.struct(s.alias("text")))
    return T.table(spark, sf, "conversations").select(
        (conv * 3 + turn % 3).alias("video_id"), (conv * 1000 + turn).alias("at"), ok.alias("ok"), error.alias("error"),
        F.when(ok, segs).alias("segments"))


@query(QUERIES, "cat20_transcript_index")
def cat20(spark, sf):
    return C.transcript_index(_attempts(spark, sf))


ORACLE["cat20_transcript_index"] = sql("""
SELECT video_id, CASE WHEN bool_or(ok) THEN 'fetched' ELSE 'failed' END AS status,
       CAST(max_by(CASE WHEN ok THEN len(string_split(text, chr(10))) END, CASE WHEN ok THEN a END) AS BIGINT) AS segment_count,
       CAST(max_by(CASE WHEN ok THEN length(text) END, CASE WHEN ok THEN a END) AS BIGINT) AS char_count,
       CASE WHEN NOT bool_or(ok) THEN max_by(error, a) END AS error
FROM (SELECT conv_id*3 + turn % 3 AS video_id, conv_id*1000 + turn AS a, (conv_id + turn) % 4 <> 0 AS ok, text,
             CASE WHEN conv_id % 3 = 0 THEN 'Subtitles are Disabled on this video' ELSE 'empty transcript' END AS error FROM conversations) x
GROUP BY video_id""")


@query(QUERIES, "cat21_failure_streaks")
def cat21(spark, sf):
    """One run per day of events; purchases and errors fail, sign-ups are uploader-disabled."""
    kind = F.col("event_type")
    attempts = T.table(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("event_id").alias("attempt"),
        kind.isin("click").alias("ok"),
        F.when(kind == "signup", "disabled on this video").when(kind != "click", "blocked").alias("error"))
    return C.failure_streaks(attempts, limit=12)


ORACLE["cat21_failure_streaks"] = sql("""
SELECT run_id, min(attempt) AS bail_attempt, max(streak) AS longest FROM (
  SELECT run_id, attempt, row_number() OVER (PARTITION BY run_id, isl ORDER BY attempt) - CASE WHEN isl > 0 THEN 1 ELSE 0 END AS streak, ok
  FROM (SELECT strftime(ts, '%Y-%m-%d') AS run_id, event_id AS attempt, event_type = 'click' AS ok,
               sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS isl
        FROM events WHERE event_type <> 'signup') a) b
WHERE NOT ok AND streak >= 12 GROUP BY run_id""")


@query(QUERIES, "cat22_live_overlay")
def cat22(spark, sf):
    from tidegauge.plans.velocity import live_overlay
    return live_overlay(T.readings(spark, sf), T.videos(spark, sf)).groupBy("snap_ix").agg(
        F.count_if("unavailable").alias("unavailable"), F.count_if(~F.col("unavailable")).alias("live"))


ORACLE["cat22_live_overlay"] = sql("""
SELECT snap_ix, count(*) FILTER (WHERE video_id % 17 = 0) AS unavailable, count(*) FILTER (WHERE video_id % 17 <> 0) AS live
FROM readings GROUP BY snap_ix""", "readings")


# ---- projections and selections ----
@query(QUERIES, "prj1_short_classifier")
def prj1(spark, sf):
    live = _key() % 7 == 0
    return T.order_videos(spark, sf).select(
        "video_id", N.is_short(F.col("duration_sec"), F.col("published_at"), since="1998-03-18").alias("is_short"),
        N.is_short(F.col("duration_sec"), F.col("published_at"), since="1998-03-18", live=live).alias("is_short_not_live"))


ORACLE["prj1_short_classifier"] = sql("""
SELECT video_id, s AS is_short, s AND video_id % 7 <> 0 AS is_short_not_live
FROM (SELECT video_id, duration_sec > 0 AND duration_sec <= 180 AND published_at >= TIMESTAMP '1998-03-18' AS s FROM order_videos) x""",
    "order_videos")

_ISO = ("concat('PT', CASE WHEN o_orderkey % 3 = 0 THEN concat(o_orderkey % 5, 'H') ELSE '' END, "
        "CASE WHEN o_orderkey % 4 <> 0 THEN concat(o_orderkey % 60, 'M') ELSE '' END, "
        "CASE WHEN o_orderkey % 7 <> 0 THEN concat(o_orderkey % 59, 'S') ELSE '' END, CASE WHEN o_orderkey % 11 = 0 THEN ' live' ELSE '' END)")


@query(QUERIES, "prj3_iso_duration")
def prj3(spark, sf):
    text = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("video_id"), F.expr(_ISO).alias("iso"))
    return text.select("video_id", N.iso_duration_seconds(F.col("iso")).alias("seconds"),
                       N.iso_duration_seconds(F.col("iso"), anchored=True).alias("seconds_anchored"))


_SECS = """(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 * 3600 ELSE 0 END + CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 60 * 60 ELSE 0 END
 + CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 59 ELSE 0 END)"""
ORACLE["prj3_iso_duration"] = sql(f"""
SELECT o_orderkey AS video_id, CAST({_SECS} AS BIGINT) AS seconds,
       CAST(CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE {_SECS} END AS BIGINT) AS seconds_anchored FROM orders""")


@query(QUERIES, "prj4_nullable_counts")
def prj4(spark, sf):
    raw = F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'hidden' WHEN o_orderkey % 3 = 0 THEN concat(o_orderkey, ' likes') ELSE cast(o_orderkey % 4 as string) END")
    return T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("video_id"), N.nullable_count(raw).alias("likes"))


ORACLE["prj4_nullable_counts"] = """
SELECT o_orderkey AS video_id, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE o_orderkey % 4 END AS likes
FROM orders"""


@query(QUERIES, "prj5_money")
def prj5(spark, sf):
    item = F.col("l_orderkey") % 9
    text = F.when(item == 0, "n/a").otherwise(F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)))
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey"), (N.money(text) * 100).cast("bigint").alias("cents"))


ORACLE["prj5_money"] = """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE CAST(round(l_extendedprice * 100) AS BIGINT) END AS cents FROM lineitem"""


@query(QUERIES, "prj6_exact_counts")
def prj6(spark, sf):
    return T.price_observations(spark, sf).select("seq", "sku", N.exact_count(F.col("available")).alias("stock"))


ORACLE["prj6_exact_counts"] = sql("""
SELECT seq, sku, CASE WHEN regexp_full_match(available, '\\d+') THEN TRY_CAST(available AS BIGINT) END AS stock FROM price_obs""", "price_obs")


@query(QUERIES, "prj7_eligible")
def prj7(spark, sf):
    return SEL.eligible(T.videos(spark, sf), exclude=T.ad_videos(spark, sf), published_from="2024-01-01",
                        channels=["ch0", "ch2", "ch4"]).select("video_id", "channel_id")


ORACLE["prj7_eligible"] = sql("""
SELECT video_id, channel_id FROM videos WHERE NOT is_short AND NOT unavailable AND video_id % 10 <> 1
AND CAST(published_at AS DATE) >= DATE '2024-01-01' AND channel_id IN ('ch0', 'ch2', 'ch4')""", "videos")


@query(QUERIES, "prj8_dormant_pool")
def prj8(spark, sf):
    return audits.dormant_pool(T.videos(spark, sf), T.ad_videos(spark, sf), channel="ch2", published_before="2024-01-02")


ORACLE["prj8_dormant_pool"] = sql("""
SELECT video_id, is_short FROM videos WHERE channel_id = 'ch2' AND NOT unavailable AND video_id % 10 <> 1
AND CAST(published_at AS DATE) < DATE '2024-01-02'""", "videos")


@query(QUERIES, "prj9_recent_split")
def prj9(spark, sf):
    split = SEL.recent_split(T.order_videos(spark, sf), as_of="2001-06-01 00:00:00")
    since = F.date_format(SEL.backfill_since("2001-06-01"), "yyyy-MM-dd")
    return split.groupBy("path").agg(F.count(F.lit(1)).alias("n")).withColumn("backfill_since", since)


ORACLE["prj9_recent_split"] = sql("""
SELECT CASE WHEN published_at >= TIMESTAMP '2001-06-01' - INTERVAL 60 DAY THEN 'incremental' ELSE 'audit' END AS path, count(*) AS n,
       '1981-01-01' AS backfill_since FROM order_videos GROUP BY 1""", "order_videos")


@query(QUERIES, "prj11_work_queue")
def prj11(spark, sf):
    videos = T.order_videos(spark, sf)
    fetched, failed = videos.where(_key() % 3 == 0), videos.where(_key() % 3 == 1)
    out = None
    for mode in ("backfill", "incremental", "retry-failures"):
        one = SEL.work_queue(videos, fetched, failed, mode=mode, as_of="2001-07-01 00:00:00").select(F.lit(mode).alias("mode"), "video_id")
        out = one if out is None else out.unionByName(one)
    return out


ORACLE["prj11_work_queue"] = sql("""
SELECT 'backfill' AS mode, video_id FROM order_videos WHERE NOT unavailable AND video_id % 3 = 2
UNION ALL SELECT 'retry-failures', video_id FROM order_videos WHERE NOT unavailable AND video_id % 3 = 1
UNION ALL SELECT 'incremental', video_id FROM (SELECT video_id FROM order_videos WHERE NOT unavailable AND video_id % 3 = 2
  AND published_at >= TIMESTAMP '2001-07-01' - INTERVAL 30 DAY ORDER BY published_at DESC, video_id LIMIT 100) q""", "order_videos")


@query(QUERIES, "prj12_usable_names")
def prj12(spark, sf):
    name = F.expr("CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN ' None ' WHEN 2 THEN '  ' WHEN 3 THEN repeat(concat(p_name, ' '), 9) WHEN 4 THEN 'NULL' ELSE p_name END")
    return T.table(spark, sf, "part").select("p_partkey", name.alias("name")).select("p_partkey", SEL.usable_name(F.col("name")).alias("usable"))


ORACLE["prj12_usable_names"] = """
SELECT p_partkey, CASE WHEN p_partkey % 6 = 3 THEN length(trim(repeat(p_name || ' ', 9))) <= 80 ELSE p_partkey % 6 = 5 END AS usable FROM part"""


@query(QUERIES, "prj13_private_is_gone")
def prj13(spark, sf):
    status = F.when(_key() % 4 == 0, "public").when(_key() % 4 == 1, "private").when(_key() % 4 == 2, "unlisted")
    return SEL.private_is_gone(T.order_videos(spark, sf).select("video_id", status.alias("status"))).groupBy(
        "answered", "present", "needs_recheck").agg(F.count(F.lit(1)).alias("n"))


ORACLE["prj13_private_is_gone"] = """
SELECT o_orderkey % 4 <> 3 AS answered, o_orderkey % 4 IN (0, 2) AS present, o_orderkey % 4 = 3 AS needs_recheck, count(*) AS n
FROM orders GROUP BY ALL"""


# ---- quality guards ----
@query(QUERIES, "qg1_enough_snapshots")
def qg1(spark, sf):
    snaps = _snaps(spark, sf)
    out = None
    for need in (2, 6, 20, 100):
        one = Q.enough_snapshots(snaps, snaps, minimum=need).agg(F.count(F.lit(1)).alias("kept")).withColumn("minimum", F.lit(need).cast("bigint"))
        out = one if out is None else out.unionByName(one)
    return out


ORACLE["qg1_enough_snapshots"] = sql("""
SELECT m AS minimum, (SELECT CASE WHEN count(*) >= m THEN count(*) ELSE 0 END FROM axis) AS kept
FROM (SELECT unnest([2, 6, 20, 100]::BIGINT[]) AS m) x""", "axis")


@query(QUERIES, "qg2_harvest_floor")
def qg2(spark, sf):
    c = T.creatives(spark, sf)
    passed = Q.harvest_floor(c).agg(F.count(F.lit(1)).alias("passed_on"))
    return Q.harvest_status(c).withColumn("passed_on", passed.scalar())


ORACLE["qg2_harvest_floor"] = sql("""
SELECT count(*) AS captured, CASE WHEN count(*) >= 50 THEN 'ok' ELSE 'too thin, nothing written' END AS status,
       CASE WHEN count(*) >= 50 THEN count(*) ELSE 0 END AS passed_on FROM creatives""", "creatives")


@query(QUERIES, "qg3_freshness")
def qg3(spark, sf):
    p = T.price_observations(spark, sf).withColumn("stock", N.exact_count(F.col("available")))
    return Q.fresh_readings(p, today="2000-05-01").withColumn("newest", F.date_format("newest", "yyyy-MM-dd"))


ORACLE["qg3_freshness"] = sql("""
SELECT count(*) FILTER (WHERE day = DATE '2000-05-01' AND regexp_full_match(available, '\\d+')) AS fresh,
       strftime(max(day), '%Y-%m-%d') AS newest, count(*) FILTER (WHERE day = DATE '2000-05-01' AND regexp_full_match(available, '\\d+')) >= 1 AS publish
FROM price_obs""", "price_obs")


@query(QUERIES, "qg4_staleness")
def qg4(spark, sf):
    return Q.staleness(_snaps(spark, sf), as_of=AS_OF)


ORACLE["qg4_staleness"] = sql("""
SELECT round(h, 3) AS hours, round(h, 3) > 36 AS stale
FROM (SELECT (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(captured_at))) / 3600000000.0::DOUBLE AS h FROM axis) x""", "axis")


@query(QUERIES, "qg7_fabricated_marker")
def qg7(spark, sf):
    ev = T.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 50 == 0, F.concat(F.lit('{"_TESTDATA": true, "was": '), "props", F.lit("}"))).otherwise(F.col("props")).alias("props"))
    return Q.marked_fabricated(ev, F.col("props")).select("event_id")


ORACLE["qg7_fabricated_marker"] = "SELECT event_id FROM events WHERE event_id % 50 = 0"


@query(QUERIES, "qg8_minimum_sample")
def qg8(spark, sf):
    kept = Q.minimum_sample(T.creatives(spark, sf), ["video_id"], minimum=14)
    return kept.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))


ORACLE["qg8_minimum_sample"] = sql(
    "SELECT video_id, count(*) AS n FROM creatives GROUP BY video_id HAVING count(*) >= 14", "creatives")
