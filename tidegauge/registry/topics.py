"""Topic upkeep and side-table roll-up queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import text as X
from tidegauge.plans import reports
from tidegauge.plans import topics as TP
from tidegauge.registry import series
from tidegauge.registry.base import query, sql
from tidegauge.registry.text import _colour_ctes, key_ctes, slug_sql, topic_name
from tidegauge.session import cut_lineage
from tidegauge.sources import tables as T

QUERIES: dict = {}
ORACLE: dict = {}


def _slug(k: str):
    return X.slug(F.expr(topic_name(k)))


def topics(spark, sf):
    k = F.col("p_partkey")
    return T.spread(T.table(spark, sf, "part").select("p_partkey")).select(
        _slug("p_partkey").alias("topic_id"), k.alias("ord"), F.expr(topic_name("p_partkey")).alias("name"),
        F.when(k % 13 == 0, "theme").otherwise("subject").alias("kind"),
        F.when(k % 4 != 0, X.name_colour(F.expr(topic_name("p_partkey")))).alias("colour"),
        F.when(k % 10 == 0, F.array(_slug("p_partkey + 1"), _slug("p_partkey + 8"))).alias("related"),
        F.when(k % 20 == 0, F.array(_slug("p_partkey + 3"))).alias("claims"))


def tags(spark, sf):
    """Every order is a video; those still in process carry no tag yet."""
    return T.spread(T.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")).select(
        F.col("o_orderkey").alias("video_id"), F.when(F.col("o_orderstatus") != "P", _slug("o_custkey")).alias("topic_id"))


def promoted(spark, sf):
    return T.table(spark, sf, "part").where("p_partkey % 50 IN (3, 7)").select(_slug("p_partkey").alias("topic_id"))


def aliases(spark, sf):
    k = "p_partkey"
    target = (F.expr(f"CASE WHEN {k} % 40 = 20 THEN NULL WHEN {k} % 100 = 50 THEN {k} + 11 WHEN {k} % 100 = 61 THEN {k} - 11 ELSE {k} + 7 END"))
    listed = T.table(spark, sf, "part").select(k).where(f"{k} % 40 IN (0, 7, 20) OR {k} % 100 IN (50, 61)")
    return (T.spread(listed).withColumn("tk", target)
            .select(_slug(k).alias("variant_id"), F.coalesce(X.slug(F.expr(topic_name("tk"))), F.lit("no-such-topic")).alias("topic_id")))


def raw_names(spark, sf):
    name = F.expr(f"CASE WHEN o_orderkey % 4 = 0 THEN {topic_name('o_custkey + 2')} ELSE concat('Story number ', o_custkey % 50, CASE WHEN o_orderkey % 8 = 2 THEN ' saga' ELSE '' END) END")
    listed = T.spread(T.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"))
    return listed.select(F.col("o_orderkey").alias("video_id"), F.when(~F.col("o_orderpriority").startswith("1"), name).alias("name"))


def _inputs(spark, sf):
    """Topics and tags as stored tables, as an upkeep run finds them, and the promoted list."""
    return cut_lineage(topics(spark, sf)), cut_lineage(tags(spark, sf)), promoted(spark, sf)


def _canon(spark, sf, inputs=None):
    t, tg, pr = inputs or _inputs(spark, sf)
    return TP.canon_map(t, tg, pr, aliases(spark, sf))


def _name(k: str) -> str:
    return topic_name(k)


_TOPICS = {
    "topics": f"""
SELECT {slug_sql(_name('p_partkey'))} AS topic_id, p_partkey AS ord, {_name('p_partkey')} AS name,
       CASE WHEN p_partkey % 13 = 0 THEN 'theme' ELSE 'subject' END AS kind,
       CASE WHEN p_partkey % 10 = 0 THEN [{slug_sql(_name('p_partkey + 1'))}, {slug_sql(_name('p_partkey + 8'))}] END AS related,
       CASE WHEN p_partkey % 20 = 0 THEN [{slug_sql(_name('p_partkey + 3'))}] END AS claims FROM part""",
    "tags": f"SELECT o_orderkey AS video_id, CASE WHEN o_orderstatus <> 'P' THEN {slug_sql(_name('o_custkey'))} END AS topic_id FROM orders",
    "promoted": f"SELECT {slug_sql(_name('p_partkey'))} AS topic_id FROM part WHERE p_partkey % 50 IN (3, 7)",
    "aliases": f"""
SELECT {slug_sql(_name('p_partkey'))} AS variant_id, CASE WHEN tk IS NULL THEN 'no-such-topic' ELSE {slug_sql(_name('tk'))} END AS topic_id
FROM (SELECT p_partkey, CASE WHEN p_partkey % 40 = 20 THEN NULL WHEN p_partkey % 100 = 50 THEN p_partkey + 11 WHEN p_partkey % 100 = 61 THEN p_partkey - 11 ELSE p_partkey + 7 END AS tk
      FROM part WHERE p_partkey % 40 IN (0, 7, 20) OR p_partkey % 100 IN (50, 61)) a""",
    "referenced": """
SELECT DISTINCT unnest(list_concat(coalesce(related, []), coalesce(claims, []))) AS topic_id FROM topics""",
    **key_ctes("topics", "topic_id, name, kind", "name", "t"),
    "counts": "SELECT topic_id, count(*) AS videos FROM tags WHERE topic_id IS NOT NULL GROUP BY topic_id",
    "ranked": """
SELECT k.topic_id, k.key, row_number() OVER (PARTITION BY k.key ORDER BY
  (CASE WHEN k.topic_id IN (SELECT topic_id FROM promoted) THEN 1000000 ELSE 0 END
   + CASE WHEN k.topic_id IN (SELECT topic_id FROM referenced) THEN 100000 ELSE 0 END
   + coalesce(c.videos, 0) * 10 - least(9::DOUBLE, length(k.name) / 10.0::DOUBLE)) DESC, k.topic_id) AS rk
FROM t_keys k LEFT JOIN counts c USING (topic_id) WHERE k.kind = 'subject' AND length(k.key) > 0""",
    "best": "SELECT key, topic_id AS best FROM ranked WHERE rk = 1",
    "manual": "SELECT variant_id AS variant, topic_id AS target FROM aliases WHERE variant_id <> topic_id AND topic_id IN (SELECT topic_id FROM topics)",
    "e0": """
SELECT variant, target FROM manual UNION ALL
SELECT r.topic_id, b.best FROM ranked r JOIN best b USING (key) WHERE r.topic_id <> b.best AND r.topic_id NOT IN (SELECT variant FROM manual)""",
    "chain": "SELECT variant, target FROM e0 UNION SELECT c.variant, e.target FROM chain c JOIN e0 e ON e.variant = c.target",
    "canon": "SELECT variant, target AS canonical FROM chain WHERE target NOT IN (SELECT variant FROM e0)",
    "refiled": """
SELECT t.video_id, coalesce(c.canonical, t.topic_id) AS topic_id, c.canonical IS NOT NULL AS moved FROM tags t LEFT JOIN canon c ON c.variant = t.topic_id""",
}


@query(QUERIES, "dp25_canon_map")
def dp25(spark, sf):
    return _canon(spark, sf)


ORACLE["dp25_canon_map"] = sql("SELECT * FROM canon", **_TOPICS)


@query(QUERIES, "dp25_invalid_aliases")
def dp25_invalid(spark, sf):
    return TP.invalid_aliases(aliases(spark, sf), topics(spark, sf))


ORACLE["dp25_invalid_aliases"] = sql(
    "SELECT * FROM aliases WHERE variant_id <> topic_id AND topic_id NOT IN (SELECT topic_id FROM topics)", **{k: _TOPICS[k] for k in ("topics", "aliases")})


@query(QUERIES, "dp26_refiled_tags")
def dp26(spark, sf):
    inputs = _inputs(spark, sf)
    return TP.refile(inputs[1], _canon(spark, sf, inputs))


ORACLE["dp26_refiled_tags"] = sql("SELECT * FROM refiled", **_TOPICS)


@query(QUERIES, "dp26_merge_counts")
def dp26_counts(spark, sf):
    t, tg, pr = inputs = _inputs(spark, sf)
    canon = cut_lineage(_canon(spark, sf, inputs))
    return TP.merge_counts(TP.refile(tg, canon), pr, t, canon)


ORACLE["dp26_merge_counts"] = sql("""
SELECT 'moved' AS what, count(*) AS n FROM refiled WHERE moved HAVING count(*) > 0
UNION ALL SELECT 'demoted', count(*) FROM promoted WHERE topic_id IN (SELECT variant FROM canon) HAVING count(*) > 0
UNION ALL SELECT 'removed', count(*) FROM topics WHERE topic_id IN (SELECT variant FROM canon)
  AND topic_id NOT IN (SELECT topic_id FROM referenced) AND topic_id NOT IN (SELECT topic_id FROM refiled WHERE topic_id IS NOT NULL) HAVING count(*) > 0""", **_TOPICS)


@query(QUERIES, "dp27_alias_candidates")
def dp27(spark, sf):
    t, tg, _ = inputs = _inputs(spark, sf)
    return TP.alias_candidates(t, tg, _canon(spark, sf, inputs)).select("ends", "topic_id")


ORACLE["dp27_alias_candidates"] = sql("""
SELECT ends, topic_id FROM (SELECT *, count(*) OVER (PARTITION BY ends) AS n FROM (
  SELECT DISTINCT split_part(k.key, ' ', 1) || ' ' || split_part(k.key, ' ', -1) AS ends, coalesce(c.canonical, k.topic_id) AS topic_id
  FROM t_keys k LEFT JOIN canon c ON c.variant = k.topic_id
  WHERE k.kind = 'subject' AND k.topic_id IN (SELECT topic_id FROM tags) AND k.key LIKE '% %') d) e WHERE n > 1""", **_TOPICS)


def _backfilled(spark, sf):
    t, tg, pr = inputs = _inputs(spark, sf)
    grouped = cut_lineage(TP.survivors(t, tg, pr))
    canon = TP.canon_map(t, tg, pr, aliases(spark, sf), grouped=grouped)
    return cut_lineage(TP.backfill(raw_names(spark, sf), tg, t, canon, grouped))


_RAWNAME = f"CASE WHEN o_orderkey % 4 = 0 THEN {_name('o_custkey + 2')} ELSE concat('Story number ', o_custkey % 50, CASE WHEN o_orderkey % 8 = 2 THEN ' saga' ELSE '' END) END"
_BACKFILL = {
    **_TOPICS,
    "raw": f"""SELECT o_orderkey AS video_id, {_RAWNAME} AS name FROM orders
WHERE NOT starts_with(o_orderpriority, '1') AND o_orderkey NOT IN (SELECT video_id FROM tags WHERE topic_id IS NOT NULL)""",
    **key_ctes("raw", "video_id, name", "name", "r"),
    "slugs": f"SELECT *, {slug_sql('name')} AS slug FROM r_keys",
    "found": """
SELECT s.*, t.kind AS slug_kind, coalesce(c.canonical, CASE WHEN t.kind = 'subject' THEN s.slug END, c3.canonical, b.best) AS found
FROM slugs s LEFT JOIN canon c ON c.variant = s.slug LEFT JOIN topics t ON t.topic_id = s.slug
LEFT JOIN best b ON b.key = s.key LEFT JOIN canon c3 ON c3.variant = b.best""",
    "filed": """
SELECT video_id, found AS topic_id, CAST(NULL AS VARCHAR) AS topic_name, CASE WHEN found = slug THEN 'joined' ELSE 'folded' END AS how FROM found WHERE found IS NOT NULL
UNION ALL SELECT f.video_id, r.slug, r.name, 'created' FROM found f JOIN (
  SELECT key, min_by(slug, video_id) AS slug, min_by(name, video_id) AS name FROM found WHERE found IS NULL AND slug_kind IS NULL GROUP BY key) r USING (key)
WHERE f.found IS NULL AND f.slug_kind IS NULL""",
}


@query(QUERIES, "dp28_backfilled_tags")
def dp28(spark, sf):
    return _backfilled(spark, sf)


ORACLE["dp28_backfilled_tags"] = sql("SELECT * FROM filed", **_BACKFILL)


@query(QUERIES, "dp28_new_definitions")
def dp28_new(spark, sf):
    return TP.new_definitions(_backfilled(spark, sf))


ORACLE["dp28_new_definitions"] = sql("SELECT topic_id, name, colour, 'subject' AS kind FROM colours", **_BACKFILL,
                                     fresh="SELECT DISTINCT topic_id, topic_name AS name FROM filed WHERE how = 'created'",
                                     **_colour_ctes("fresh", "topic_id", "name"))


def _titled(spark, sf):
    return T.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("video_id"), F.expr(f"concat('Live: ', {topic_name('o_custkey')}, '!')").alias("title"),
        (F.col("o_orderkey") % 5 == 0).alias("is_short"))


@query(QUERIES, "jn12_contained_phrases")
def jn12(spark, sf):
    people = topics(spark, sf).where("related IS NOT NULL").select(F.col("topic_id").alias("person"), "name")
    return TP.contained_phrases(_titled(spark, sf), people).select("video_id", "person")


ORACLE["jn12_contained_phrases"] = sql("""
SELECT v.video_id, p.person FROM titled v JOIN people p ON contains(v.tw, p.pw)""", topics=_TOPICS["topics"],
    people="SELECT topic_id AS person, ' ' || trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) || ' ' AS pw FROM topics WHERE related IS NOT NULL",
    titled=f"""SELECT o_orderkey AS video_id, ' ' || trim(regexp_replace(lower(concat('Live: ', {_name('o_custkey')}, '!')), '[^a-z0-9]+', ' ', 'g')) || ' ' AS tw FROM orders""")


@query(QUERIES, "dp29_cede_to_person")
def dp29(spark, sf):
    modes = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("video_id"), F.when(F.col("o_orderpriority") >= "3", F.col("o_orderpriority")).alias("mode"))
    return TP.cede_to_person(_titled(spark, sf), tags(spark, sf), modes, topics(spark, sf))


ORACLE["dp29_cede_to_person"] = sql("""
SELECT video_id, cur AS from_topic, person AS topic_id FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ord) AS rk FROM (
    SELECT v.video_id, g.topic_id AS cur, p.person, p.ord, coalesce(g.topic_id = p.person, FALSE) AS stay,
           (g.topic_id IS NULL AND v.mode >= '3') OR coalesce(list_contains(p.cede, g.topic_id), FALSE) AS take
    FROM titled v JOIN people p ON contains(v.tw, p.pw) LEFT JOIN tags g USING (video_id) WHERE v.video_id % 5 <> 0) c
  WHERE stay OR take) d WHERE rk = 1 AND NOT stay""", **{k: _TOPICS[k] for k in ("topics", "tags")},
    people="""SELECT topic_id AS person, ord, list_concat(coalesce(related, []), coalesce(claims, [])) AS cede,
 ' ' || trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) || ' ' AS pw FROM topics WHERE related IS NOT NULL OR claims IS NOT NULL""",
    titled=f"""SELECT o_orderkey AS video_id, o_orderpriority AS mode, ' ' || trim(regexp_replace(lower(concat('Live: ', {_name('o_custkey')}, '!')), '[^a-z0-9]+', ' ', 'g')) || ' ' AS tw FROM orders""")


@query(QUERIES, "dp47_topic_totals")
def dp47(spark, sf):
    return TP.topic_totals(T.order_videos(spark, sf), tags(spark, sf), topics(spark, sf))


ORACLE["dp47_topic_totals"] = sql("""
SELECT topic_id AS shown, topic_id, videos, views, FALSE AS is_related FROM own
UNION ALL SELECT r.shown, r.topic_id, o.videos, o.views, TRUE FROM (SELECT topic_id AS shown, unnest(related) AS topic_id FROM topics WHERE related IS NOT NULL) r JOIN own o USING (topic_id)""",
    "order_videos", **{k: _TOPICS[k] for k in ("topics", "tags")},
    own="SELECT topic_id, count(*) AS videos, CAST(sum(views) AS BIGINT) AS views FROM tags JOIN order_videos USING (video_id) WHERE topic_id IS NOT NULL GROUP BY topic_id")


@query(QUERIES, "dp48_newly_promoted")
def dp48(spark, sf):
    return TP.newly_promoted(tags(spark, sf), promoted(spark, sf), floor=12)


ORACLE["dp48_newly_promoted"] = sql("""
SELECT topic_id, videos FROM counts WHERE videos >= 12 AND topic_id NOT IN (SELECT topic_id FROM promoted)""",
    **{k: _TOPICS[k] for k in ("tags", "promoted", "counts")})


@query(QUERIES, "dp42_enriched_rows")
def dp42(spark, sf):
    t = topics(spark, sf)
    themes = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("video_id"), F.when(F.col("o_orderpriority") < "3", _slug("o_custkey + 1")).alias("topic_id"))
    rows = T.order_videos(spark, sf).select("video_id", "views")
    return TP.enriched(rows, {"subject": tags(spark, sf), "theme": themes}, t)


ORACLE["dp42_enriched_rows"] = sql(f"""
SELECT o.video_id, o.views, concat_ws(';', s.chip, h.chip) AS chips FROM order_videos o
LEFT JOIN (SELECT g.video_id, 'subject|' || t.name || '|' || t.colour AS chip FROM tags g JOIN topic_colours t USING (topic_id)) s USING (video_id)
LEFT JOIN (SELECT g.video_id, 'theme|' || t.name || '|' || t.colour AS chip FROM themes g JOIN topic_colours t USING (topic_id)) h USING (video_id)""",
    "order_videos", **{k: _TOPICS[k] for k in ("topics", "tags")}, **_colour_ctes("topics", "topic_id, ord", "name"),
    topic_colours="SELECT topic_id, name, CASE WHEN ord % 4 <> 0 THEN colour ELSE '#888' END AS colour FROM colours",
    themes=f"SELECT o_orderkey AS video_id, CASE WHEN o_orderpriority < '3' THEN {slug_sql(_name('o_custkey + 1'))} END AS topic_id FROM orders")


def _axes(spark, sf):
    """Subject, theme and format of every video of the events; unlisted, unrated or first-channel ones lack one of them."""
    v = T.videos(spark, sf).withColumn("user_id", F.col("video_id"))

    def axis(known, k):
        return v.select("video_id", F.when(known, _slug(k)).alias("topic_id"))

    return {"subject": axis(~F.col("unlisted"), "user_id"), "theme": axis(F.col("likes").isNotNull(), "user_id + 1"),
            "format": axis(F.col("channel_id") != "ch0", "user_id + 2")}


_AXES = {
    **{k: _TOPICS[k] for k in ("topics",)}, **_colour_ctes("topics", "topic_id, ord", "name"),
    "topic_colours": "SELECT topic_id, name, CASE WHEN ord % 4 <> 0 THEN colour ELSE '#888' END AS colour FROM colours",
    "chips": f"""
SELECT video_id, string_agg(axis || '|' || name || '|' || colour, ';' ORDER BY nr) AS chips FROM (
  SELECT video_id, 1 AS nr, 'subject' AS axis, {slug_sql(_name('video_id'))} AS topic_id FROM videos WHERE NOT unlisted
  UNION ALL SELECT video_id, 2, 'theme', {slug_sql(_name('video_id + 1'))} FROM videos WHERE likes IS NOT NULL
  UNION ALL SELECT video_id, 3, 'format', {slug_sql(_name('video_id + 2'))} FROM videos WHERE channel_id <> 'ch0') a
JOIN topic_colours USING (topic_id) GROUP BY video_id""",
    "snippets": """
SELECT doc_id AS video_id, CASE WHEN length(line) > 260 THEN substring(line, 1, 260) || '…' ELSE line END AS snippet
FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS line FROM documents) d""",
}


def _adorned(source: str, needs: tuple, **extra: str) -> str:
    return sql("SELECT r.*, coalesce(chips, '') AS chips, coalesce(snippet, '') AS snippet FROM found r "
               "LEFT JOIN chips USING (video_id) LEFT JOIN snippets USING (video_id)", *needs, **extra, found=source, **_AXES)


@query(QUERIES, "dp42_launch_rows")
def dp42_launches(spark, sf):
    return TP.enriched(series.QUERIES["dp10_launch_current"](spark, sf), _axes(spark, sf), topics(spark, sf), T.text_videos(spark, sf))


ORACLE["dp42_launch_rows"] = _adorned(series.LAUNCHES, ("readings", "videos"), points=series._POINTS)


@query(QUERIES, "dp42_mover_rows")
def dp42_movers(spark, sf):
    return TP.enriched(series.QUERIES["dp12_movers"](spark, sf), _axes(spark, sf), topics(spark, sf), T.text_videos(spark, sf))


ORACLE["dp42_mover_rows"] = _adorned(series.MOVERS, ("adj_iv", "axis", "videos"))


@query(QUERIES, "dp49_creator_tags")
def dp49(spark, sf):
    rows = T.table(spark, sf, "lineitem").select(
        F.floor("l_extendedprice").cast("bigint").alias("views"),
        F.array("l_returnflag", "l_linestatus", F.concat(F.lit("q"), F.col("l_quantity").cast("bigint").cast("string"))).alias("tags"))
    return reports.creator_tags(rows)


ORACLE["dp49_creator_tags"] = """
SELECT tag, count(*) AS videos, CAST(sum(views) AS BIGINT) AS views FROM (
  SELECT CAST(floor(l_extendedprice) AS BIGINT) AS views, unnest(list_distinct([l_returnflag, l_linestatus, 'q' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)])) AS tag FROM lineitem) x
GROUP BY tag"""


@query(QUERIES, "dp41_repost_rollup")
def dp41(spark, sf):
    rows = T.table(spark, sf, "events").select(
        F.col("event_type").alias("platform"), (F.col("user_id") % 40).alias("creator"), T.channel_of(F.col("user_id")).alias("channel_id"),
        F.date_format("ts", "yyyy-MM").alias("month"), F.when(F.col("event_id") % 5 == 0, "watermark").alias("via"))
    return reports.repost_rollup(rows, ["platform", "creator", "channel_id", "month", "via"])


ORACLE["dp41_repost_rollup"] = """
SELECT dimension, value, count(*) AS n FROM (
  SELECT unnest([struct_pack(d := 'platform', v := event_type), struct_pack(d := 'creator', v := CAST(user_id % 40 AS VARCHAR)),
    struct_pack(d := 'channel_id', v := 'ch' || CAST(user_id % 5 AS VARCHAR)), struct_pack(d := 'month', v := strftime(ts, '%Y-%m')),
    struct_pack(d := 'via', v := CASE WHEN event_id % 5 = 0 THEN 'watermark' END)]) AS s FROM events) x,
  LATERAL (SELECT s.d AS dimension, s.v AS value) y WHERE value IS NOT NULL GROUP BY dimension, value"""
