"""Shared pieces of the registry: the SQL twin of each adapter, and a query decorator."""

from __future__ import annotations

import functools

from tidegauge.session import prepare

PUBLISHED = ("(TIMESTAMP '2023-12-10 00:00:00' + to_days(CAST((user_id*7)%45 AS INTEGER))"
             " + to_hours(CAST((user_id*13)%24 AS BIGINT)))")

CTES = {
    "ev": ([], f"""
SELECT event_id, user_id, event_type, ts, props,
       CAST(floor(epoch(ts)/43200) AS BIGINT) AS slot_ix,
       CAST(round(value*100) AS BIGINT) AS cents,
       {PUBLISHED} AS stated_at,
       {PUBLISHED} AS published_at
FROM events"""),
    "axis": (["ev"], """
SELECT slot_ix, max(ts) AS captured_at,
       CAST(row_number() OVER (ORDER BY slot_ix) - 1 AS BIGINT) AS snap_ix,
       CAST(TIMESTAMP '1970-01-01' + to_seconds(slot_ix*43200) AS DATE) AS snap_date,
       CASE WHEN slot_ix % 2 = 0 THEN 'AM' ELSE 'PM' END AS slot
FROM ev GROUP BY slot_ix"""),
    "per_slot": (["ev"], """
SELECT user_id, greatest(slot_ix, CAST(floor(epoch(published_at)/43200) AS BIGINT)) AS slot_ix, min(published_at) AS published_at, sum(cents) AS cents,
       sum(CASE WHEN event_type IN ('click','view') THEN cents ELSE 0 END) AS engaged,
       sum(CASE WHEN event_type = 'click' THEN cents ELSE 0 END) AS clicks
FROM ev GROUP BY 1, 2"""),
    "grid": (["per_slot", "axis"], """
SELECT v.user_id AS video_id, v.published_at, a.slot_ix, a.captured_at, a.snap_ix, a.snap_date, a.slot
FROM (SELECT user_id, min(published_at) AS published_at FROM per_slot GROUP BY user_id) v
JOIN axis a ON a.slot_ix >= floor(epoch(v.published_at)/43200)"""),
    "readings": (["grid", "per_slot"], """
SELECT video_id, published_at, slot_ix, captured_at, snap_ix, snap_date, slot,
       CAST(total // 100 AS BIGINT) AS views,
       CASE WHEN video_id % 13 <> 0 THEN CAST((total + 2*engaged) // 1600 AS BIGINT) END AS likes,
       CAST(clicks // 2000 AS BIGINT) AS comments,
       'ch' || CAST(video_id % 5 AS VARCHAR) AS channel_id,
       video_id % 3 = 0 AS is_short
FROM (SELECT g.*, CAST(sum(coalesce(p.cents,0)) OVER w AS BIGINT) AS total,
             CAST(sum(coalesce(p.engaged,0)) OVER w AS BIGINT) AS engaged,
             CAST(sum(coalesce(p.clicks,0)) OVER w AS BIGINT) AS clicks
      FROM grid g LEFT JOIN per_slot p ON p.user_id = g.video_id AND p.slot_ix = g.slot_ix
      WINDOW w AS (PARTITION BY g.video_id ORDER BY g.slot_ix)) x
WHERE (video_id + slot_ix) % 11 <> 0"""),
    "videos": (["per_slot"], """
SELECT user_id AS video_id, 'ch' || CAST(user_id % 5 AS VARCHAR) AS channel_id,
       'Video ' || CAST(user_id AS VARCHAR) AS title, min(published_at) AS published_at,
       CAST(CASE WHEN user_id % 3 = 0 THEN 30 + user_id % 150 ELSE 200 + (user_id*37) % 3600 END AS BIGINT) AS duration_sec,
       CAST(sum(cents) // 100 AS BIGINT) AS views,
       CASE WHEN user_id % 13 <> 0 THEN CAST((sum(cents) + 2*sum(engaged)) // 1600 AS BIGINT) END AS likes,
       CAST(sum(clicks) // 2000 AS BIGINT) AS comments,
       user_id % 3 = 0 AS is_short, user_id % 17 = 0 AS unavailable, user_id % 23 = 0 AS unlisted
FROM per_slot GROUP BY user_id"""),
    "ads": ([], """
SELECT DISTINCT user_id AS video_id, 'ch' || CAST(user_id % 5 AS VARCHAR) AS channel_id
FROM events WHERE user_id % 10 = 1"""),
    "creatives": ([], """
SELECT event_id AS creative_id, user_id AS video_id, CAST(ts AS DATE) AS first_day,
       CAST(ts AS DATE) + CAST(event_id % 4 AS INTEGER) AS last_day
FROM events WHERE event_type = 'signup' AND user_id % 10 = 1"""),
    "windows": (["creatives"], "SELECT video_id, first_day AS win_from, last_day AS win_to FROM creatives"),
    "own_iv": (["readings"], """
SELECT *, t1 - t0 AS dt, dv / (t1 - t0) AS rate FROM (
  SELECT *, lag(t1) OVER w AS t0, views - lag(views) OVER w AS dv,
         lag(snap_date) OVER w AS prev_date, lag(slot) OVER w AS prev_slot,
         count(*) OVER (PARTITION BY video_id) AS n_points
  FROM (SELECT *, date_diff('day', DATE '1970-01-01', snap_date) + CASE WHEN slot = 'PM' THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS t1 FROM readings) r
  WINDOW w AS (PARTITION BY video_id ORDER BY snap_ix)) x
WHERE t1 - t0 > 0"""),
    "adj_iv": (["readings"], """
SELECT *, (epoch_us(captured_at) - epoch_us(t0)) / 86400000000.0::DOUBLE AS dt FROM (
  SELECT *, lag(snap_ix) OVER w AS prev_ix, views - lag(views) OVER w AS delta,
         lag(captured_at) OVER w AS t0, count(*) OVER (PARTITION BY video_id) AS n_points
  FROM readings WINDOW w AS (PARTITION BY video_id ORDER BY snap_ix)) x
WHERE snap_ix - prev_ix = 1 AND captured_at > t0"""),
    "text_videos": ([], """
SELECT doc_id AS video_id, source AS channel_id, split_part(text, chr(10), 1) AS title, text AS description,
       CAST(DATE '2024-03-01' - CAST(doc_id % 60 AS INTEGER) AS TIMESTAMP) + to_hours(CAST((doc_id*7) % 24 AS BIGINT)) AS published_at,
       n_chars AS views
FROM documents"""),
    "title_obs": ([], """
SELECT conv_id AS video_id, turn AS pass_id,
       TIMESTAMP '2024-01-01 00:00:00' + to_seconds(turn*43200) AS observed_at,
       split_part(text, chr(10), 1) AS title,
       CASE WHEN turn % 2 = 0 THEN 'audit' ELSE 'incremental' END AS via
FROM conversations"""),
    "presence": ([], """
SELECT user_id AS video_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS pass_id,
       min(ts) AS observed_at, max(CASE WHEN event_type IN ('click','view','purchase') THEN 1 ELSE 0 END) = 1 AS present
FROM events GROUP BY user_id, CAST(ts AS DATE)"""),
    "price_obs": ([], """
SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS sku, CAST(date_trunc('week', l_shipdate) AS DATE) AS day,
       l_orderkey*100 + l_linenumber AS seq,
       CAST((CASE WHEN l_quantity >= 49 THEN 150 WHEN l_quantity <= 2 THEN 50 ELSE 100 END) * (10 + l_suppkey % 20) AS BIGINT) AS cents,
       CASE WHEN l_returnflag = 'R' THEN '0' WHEN l_orderkey % 7 = 0 THEN ''
            WHEN l_orderkey % 5 = 0 THEN 'at least ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)
            ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS available,
       CASE WHEN l_returnflag = 'R' THEN 'out of stock' WHEN l_linestatus = 'O' THEN 'ok' ELSE 'ok (other seller)' END AS status,
       CASE l_suppkey % 4 WHEN 0 THEN 'Ground' WHEN 1 THEN 'Whole Bean' WHEN 2 THEN 'K-Cups' ELSE 'Tea' END
         || ' - ' || CASE WHEN l_suppkey % 11 = 0 THEN 'Kona ' ELSE '' END || 'Blend ' || CAST(l_suppkey AS VARCHAR) AS label
FROM lineitem"""),
    "price_scans": (["price_obs"], """
SELECT *, '$' || CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS price FROM price_obs"""),
    "order_videos": ([], """
SELECT o_orderkey AS video_id, o_orderpriority AS channel_id,
       o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)) AS published_at,
       CAST(60 + (o_orderkey*37) % 3600 AS BIGINT) AS duration_sec,
       CAST(floor(o_totalprice) AS BIGINT) AS views,
       CASE WHEN o_orderkey % 11 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) // (10 + o_orderkey % 40) END AS likes,
       CAST(floor(o_totalprice) AS BIGINT) // 500 AS comments,
       o_orderkey % 3 = 0 AS is_short, o_orderstatus = 'P' AS unavailable
FROM orders"""),
}


def local(ts: str) -> str:
    """UTC timestamp to the creator's wall clock, in SQL."""
    return f"timezone('America/Chicago', timezone('UTC', {ts}))"


def sql(body: str, *needs: str, **extra: str) -> str:
    """Compose a statement from the adapter CTEs it needs plus its own, in order."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        deps, text = CTES[name]
        for dep in deps:
            add(dep)
        done[name] = text

    for name in needs:
        add(name)
    done.update(extra)
    if not done:
        return body.strip()
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({t.strip()})" for n, t in done.items()) + "\n" + body.strip()


def query(registry: dict, name: str):
    """Register a function (spark, sf_dir) -> DataFrame under a stable name."""
    def wrap(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            return fn(prepare(spark), sf_dir)
        registry[name] = run
        return run
    return wrap
