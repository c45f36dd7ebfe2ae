"""Source, sink and streaming queries; files live in the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge import schemas
from tidegauge.functions import calendar as CAL
from tidegauge.functions import numbers as N
from tidegauge.operators.series import one_per_date
from tidegauge.registry.base import local, query, sql
from tidegauge.registry.catalogue import _STREAKS, _TITLES
from tidegauge.registry.series import _snaps
from tidegauge.session import cut_lineage, scratch_path
from tidegauge.sources import readers as R
from tidegauge.sources import sinks as K
from tidegauge.sources import tables as T
from tidegauge.sources.versions import VersionedTable
from tidegauge.streaming import jobs as J

QUERIES: dict = {}
ORACLE: dict = {}


def _video_docs(spark, sf):
    """Readings packed into catalogue documents of at most a thousand ids each, as JSON lines."""
    r = T.readings(spark, sf)
    rec = F.struct(F.col("video_id").cast("string").alias("id"), F.col("channel_id").alias("channelId"), F.col("views"), F.col("likes"),
                   F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"), F.col("is_short").alias("isShort"))
    tag = F.concat_ws("-", F.date_format("snap_date", "yyyy-MM-dd"), "slot")
    docs = r.groupBy(tag.alias("tag"), "captured_at", F.floor(F.col("video_id") / 1000).alias("chunk")).agg(F.collect_list(rec).alias("videos"))
    return docs.select("tag", F.struct(F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("lastUpdated")).alias("meta"),
                       F.create_map(F.lit("ch0"), F.struct(F.lit("ch0").alias("id"))).alias("channels"), "videos")


def _archived(docs, spark, name, by):
    """Documents as gzipped files of one document each, below one folder per tag, with a damaged and a foreign file beside them."""
    path = scratch_path(spark, name)
    options = {"compression": "gzip", "maxRecordsPerFile": 1}
    docs.write.partitionBy(by).options(**options).json(path)
    # The first half of a document is damaged; a document in a folder of another name is none of the archive's.
    text = F.to_json(F.struct(*[c for c in docs.columns if c != by]))
    damaged = docs.orderBy(by).limit(1).select(by, text.alias("value")).select(by, F.expr("left(value, length(value) div 2)").alias("value"))
    damaged.write.mode("append").partitionBy(by).options(**options).format("text").save(path)
    docs.where(F.col(by).endswith("AM") | F.col(by).endswith("10")).limit(1).withColumn(by, F.lit("notes")) \
        .write.mode("append").partitionBy(by).options(**options).json(path)
    return path


@query(QUERIES, "src1_snapshot_archive")
def src1(spark, sf):
    path = _archived(_video_docs(spark, sf), spark, "archive", "tag")
    return R.read_snapshots(spark, path, name=R.SLOT_FOLDER).select(
        F.concat_ws("-", F.date_format("snap_date", "yyyy-MM-dd"), "slot").alias("tag"), F.unix_seconds("captured_at").alias("captured_sec"),
        "video_id", "channel_id", "views", "likes", "is_short")


ORACLE["src1_snapshot_archive"] = sql("""
SELECT strftime(snap_date, '%Y-%m-%d') || '-' || slot AS tag, CAST(floor(epoch(captured_at)) AS BIGINT) AS captured_sec,
       CAST(video_id AS VARCHAR) AS video_id, channel_id, views, likes, is_short FROM readings""", "readings")


@query(QUERIES, "src2_unreadable_documents")
def src2(spark, sf):
    """Every thirteenth document is cut off in the middle."""
    text = F.when(F.col("event_id") % 13 == 0, F.expr("left(props, length(props) - 2)")).otherwise(F.col("props"))
    doc = F.from_json(text, "k bigint, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return R.unreadable(T.table(spark, sf, "events").select(doc.alias("d")).select("d.*"))


ORACLE["src2_unreadable_documents"] = """
SELECT count(*) FILTER (WHERE json_valid(t)) AS read, count(*) FILTER (WHERE NOT json_valid(t)) AS skipped
FROM (SELECT CASE WHEN event_id % 13 = 0 THEN left(props, length(props) - 2) ELSE props END AS t FROM events) x"""


@query(QUERIES, "src3_capture_time")
def src3(spark, sf):
    snaps = _snaps(spark, sf)
    stamp = F.when(F.col("slot_ix") % 5 != 0, F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("not recorded")
    rules = {"series": (10, 18), "comparator": (2, 14), "benchmark": (2, 2)}
    return snaps.select("snap_ix", *[F.unix_seconds(R.capture_time(stamp, F.col("snap_date"), F.col("slot"), am_hour=a, pm_hour=p)).alias(n)
                                     for n, (a, p) in rules.items()])


ORACLE["src3_capture_time"] = sql("SELECT snap_ix, " + ", ".join(
    f"CAST(CASE WHEN slot_ix % 5 <> 0 THEN floor(epoch(captured_at)) ELSE epoch(CAST(snap_date AS TIMESTAMP)) + CASE WHEN slot = 'AM' THEN {a} ELSE {p} END * 3600 END AS BIGINT) AS {n}"
    for n, (a, p) in {"series": (10, 18), "comparator": (2, 14), "benchmark": (2, 2)}.items()) + " FROM axis", "axis")


@query(QUERIES, "src4_one_per_date")
def src4(spark, sf):
    return one_per_date(_snaps(spark, sf)).select(F.date_format("snap_date", "yyyy-MM-dd").alias("snap_date"), "slot", "snap_ix")


ORACLE["src4_one_per_date"] = sql("""
SELECT strftime(snap_date, '%Y-%m-%d') AS snap_date, min(slot) AS slot, min_by(snap_ix, slot) AS snap_ix FROM axis GROUP BY 1""", "axis")


@query(QUERIES, "src6_catalogue_scan")
def src6(spark, sf):
    """Customers as catalogue documents, some in the old form and some only placeholders."""
    key = F.col("c_custkey")
    body = F.when(key % 5 == 0, F.lit('"videos": []')).otherwise(F.concat(
        F.lit('"videos": [{"id": "v'), key.cast("string"), F.lit('", "views": '), (key * 3).cast("string"), F.lit(', "likes": null}, {"id": "w'), key.cast("string"), F.lit('"}]')))
    head = F.when(key % 7 == 0, F.lit('"channel": {"id": "c"}')).otherwise(F.lit('"channels": {"c": {"id": "c"}}'))
    text = F.concat(F.lit("{"), head, F.lit(", "), body, F.lit("}"))
    docs = T.table(spark, sf, "customer").select(F.from_json(text, schemas.CATALOGUE).alias("d")).select("d.*")
    return R.catalogue_videos(docs).select(*R.video_columns()).select("video_id", "views", "likes", "unavailable")


ORACLE["src6_catalogue_scan"] = """
SELECT p || CAST(c_custkey AS VARCHAR) AS video_id, CASE WHEN p = 'v' THEN c_custkey * 3 ELSE 0 END AS views, CAST(NULL AS BIGINT) AS likes, FALSE AS unavailable
FROM customer, (SELECT unnest(['v', 'w']) AS p) x WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0"""


@query(QUERIES, "src7_map_scan")
def src7(spark, sf):
    return R.map_rows(T.table(spark, sf, "events").select("event_id", "props"), "props", value="bigint")


ORACLE["src7_map_scan"] = "SELECT event_id, 'k' AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS value FROM events"


@query(QUERIES, "src8_roster_scan")
def src8(spark, sf):
    key = F.col("c_custkey").cast("string")
    text = F.concat(F.lit('{"channels": {"@'), F.col("c_mktsegment"), F.lit('": {"channelId": "UC'), F.col("c_nationkey").cast("string"),
                    F.lit('", "videoIds": ["a'), key, F.lit('", "b'), key, F.lit('"]}, "@empty": {"channelId": "x", "videoIds": []}}}'))
    return R.roster_rows(T.table(spark, sf, "customer").select(F.from_json(text, schemas.ROSTER).alias("d")).select("d.*"))


ORACLE["src8_roster_scan"] = """
SELECT '@' || c_mktsegment AS handle, 'UC' || CAST(c_nationkey AS VARCHAR) AS channel_id, p || CAST(c_custkey AS VARCHAR) AS video_id
FROM customer, (SELECT unnest(['a', 'b']) AS p) x"""


@query(QUERIES, "src9_window_scan")
def src9(spark, sf):
    day = F.date_format("first_day", "yyyy-MM-dd")
    end = F.when(F.col("creative_id") % 4 == 0, F.lit("null")).otherwise(F.concat(F.lit('"'), F.date_format("last_day", "yyyy-MM-dd"), F.lit('"')))
    text = F.concat(F.lit('{"videos": {"'), F.col("video_id").cast("string"), F.lit('": {"windows": [["'), day, F.lit('", '), end, F.lit('], ["'), day, F.lit('"]]}}}'))
    docs = T.creatives(spark, sf).select("creative_id", F.from_json(text, schemas.CAMPAIGNS).alias("d")).select("d.*")
    return R.window_rows(docs)


ORACLE["src9_window_scan"] = sql("""
SELECT CAST(video_id AS VARCHAR) AS video_id, strftime(first_day, '%Y-%m-%d') AS win_from, strftime(last_day, '%Y-%m-%d') AS win_to
FROM creatives WHERE creative_id % 4 <> 0""", "creatives")


@query(QUERIES, "src11_price_csv")
def src11(spark, sf):
    """Price scans written as CSV and read back; every ninth row has no usable date."""
    path = scratch_path(spark, "prices")
    p = T.price_observations(spark, sf)
    date = F.when(F.col("seq") % 9 == 0, "yesterday").otherwise(F.date_format("day", "yyyy-MM-dd"))
    p.select(date.alias("date"), F.col("seq").cast("string").alias("time"), F.col("sku").alias("asin"), "label", "available", "price", "status") \
        .write.option("header", True).csv(path)
    return R.read_price_history(spark, path).groupBy("sku").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(N.exact_count(F.col("available")).isNotNull()).alias("exact"),
        F.sum((N.money(F.col("price")) * 100).cast("bigint")).alias("cents"), F.date_format(F.max("day"), "yyyy-MM-dd").alias("newest"))


ORACLE["src11_price_csv"] = sql("""
SELECT sku, count(*) AS n, count(*) FILTER (WHERE regexp_full_match(available, '\\d+')) AS exact, CAST(sum(cents) AS BIGINT) AS cents, strftime(max(day), '%Y-%m-%d') AS newest
FROM price_obs WHERE seq % 9 <> 0 GROUP BY sku""", "price_obs")


@query(QUERIES, "src13_dimension_scan")
def src13(spark, sf):
    """Parts as a taxonomy with drafts and keyword-less topics, and labels in both forms."""
    k = F.col("p_partkey")
    topics = T.table(spark, sf, "part").select(
        F.concat(F.when(k % 6 == 0, "_").otherwise(""), F.lit("t"), k.cast("string")).alias("topic_id"),
        F.when(k % 4 != 0, F.split("p_name", " ")).alias("keywords"), F.col("p_name"), k)
    usable = R.taxonomy_rows(topics).select("topic_id", F.size("keywords").cast("bigint").alias("keywords"))
    labels = R.label_rows(topics.select(F.col("topic_id").alias("term_id"), F.when(
        k % 2 == 0, F.concat(F.lit('{"name": "'), F.initcap("p_name"), F.lit('", "keywords": ["x"]}'))).otherwise(F.col("p_name")).alias("entry")))
    return usable.join(labels.select(F.col("term_id").alias("topic_id"), "display_name"), "topic_id")


ORACLE["src13_dimension_scan"] = """
SELECT 't' || CAST(p_partkey AS VARCHAR) AS topic_id, len(string_split(p_name, ' ')) AS keywords,
       CASE WHEN p_partkey % 2 = 0 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE p_name END AS display_name
FROM part WHERE p_partkey % 6 <> 0 AND p_partkey % 4 <> 0"""


# ---- sinks ----
def _gains(spark, sf):
    r = T.readings(spark, sf)
    return r.select("video_id", "snap_date", "slot", "views", F.date_format("snap_date", "yyyy-MM").alias("month"))


@query(QUERIES, "src12_debut_scan")
def src12(spark, sf):
    """Readings of videos under two days old written as hourly samples and read back."""
    r = T.readings(spark, sf).withColumn("age_h", N.days_between(F.col("published_at"), F.col("captured_at")) * 24).where("age_h BETWEEN 0 AND 48")
    rec = F.struct(F.col("video_id").cast("string").alias("id"), F.round("age_h", 2).alias("ageH"), "views", F.col("is_short").alias("isShort"))
    docs = r.groupBy(F.date_format("captured_at", "yyyy-MM-dd-HH").alias("hour"), "captured_at", F.floor(F.col("video_id") / 1000).alias("chunk")) \
        .agg(F.collect_list(rec).alias("videos")) \
        .select("hour", F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"), "videos")
    return R.read_debut(spark, _archived(docs, spark, "debut", "hour"), name=R.HOUR_FOLDER).select(
        F.unix_seconds("sampled_at").alias("sampled_sec"), "age_h", "video_id", "views", "is_short")


ORACLE["src12_debut_scan"] = sql("""
SELECT CAST(floor(epoch(captured_at)) AS BIGINT) AS sampled_sec, round(a, 2) AS age_h, CAST(video_id AS VARCHAR) AS video_id, views, is_short
FROM (SELECT *, (epoch_us(captured_at) - epoch_us(published_at)) / 86400000000.0::DOUBLE * 24 AS a FROM readings) r WHERE a BETWEEN 0 AND 48""", "readings")


@query(QUERIES, "snk2_month_partitions")
def snk2(spark, sf):
    """Write all months, then rewrite one; the others must stay."""
    path = scratch_path(spark, "months")
    rows = T.order_videos(spark, sf).select("video_id", "views", F.date_format("published_at", "yyyy-MM").alias("month"))
    K.write_months(rows, path)
    K.write_months(rows.where("month = '1998-05'").withColumn("views", F.col("views") + 1), path)
    return spark.read.parquet(path).groupBy(F.col("month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("views").alias("views"))


ORACLE["snk2_month_partitions"] = sql("""
SELECT strftime(published_at, '%Y-%m') AS month, count(*) AS n, CAST(sum(views + CASE WHEN strftime(published_at, '%Y-%m') = '1998-05' THEN 1 ELSE 0 END) AS BIGINT) AS views
FROM order_videos GROUP BY 1""", "order_videos")


@query(QUERIES, "snk3_write_once_slots")
def snk3(spark, sf):
    """A second run with other numbers only adds the slots the first run did not have."""
    path = scratch_path(spark, "slots")
    rows = _gains(spark, sf).select("video_id", "snap_date", "slot", "views")
    K.append_new_slots(rows.where("slot = 'AM'"), path, slot=["snap_date", "slot"])
    K.append_new_slots(rows.withColumn("views", F.lit(-1).cast("bigint")), path, slot=["snap_date", "slot"])
    return K.read_slots(spark, path).groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum("views").alias("views"))


ORACLE["snk3_write_once_slots"] = sql("""
SELECT slot, count(*) AS n, CAST(sum(CASE WHEN slot = 'AM' THEN views ELSE -1 END) AS BIGINT) AS views FROM readings GROUP BY slot""", "readings")


@query(QUERIES, "snk4_publish_if_changed")
def snk4(spark, sf):
    """Publish, publish again with only a new stamp, publish a real change."""
    path = scratch_path(spark, "product")
    rows = cut_lineage(T.order_videos(spark, sf).select("video_id", "views"))
    runs = [rows.withColumn("generated", F.lit("1")), rows.withColumn("generated", F.lit("2")),
            rows.withColumn("views", F.col("views") + F.when(F.col("video_id") == 0, 1).otherwise(0)).withColumn("generated", F.lit("3"))]
    wrote = [K.publish_if_changed(df, path) for df in runs]
    return spark.read.parquet(path).groupBy("generated").agg(F.count(F.lit(1)).alias("n"), F.sum("views").alias("views")).select(
        "*", F.lit(",".join(str(w).lower() for w in wrote)).alias("wrote"))


ORACLE["snk4_publish_if_changed"] = sql("""
SELECT '3' AS generated, count(*) AS n, CAST(sum(views) + 1 AS BIGINT) AS views, 'true,false,true' AS wrote FROM order_videos""", "order_videos")


@query(QUERIES, "snk1_product_table")
def snk1(spark, sf):
    """One product written as JSON and read back."""
    path = scratch_path(spark, "product")
    out = T.order_videos(spark, sf).groupBy("channel_id").agg(F.count(F.lit(1)).alias("n"), F.sum("views").alias("views"))
    K.write_product(out, path, fmt="json")
    return spark.read.schema("channel_id string, n bigint, views bigint").json(path)


ORACLE["snk1_product_table"] = sql(
    "SELECT channel_id, count(*) AS n, CAST(sum(views) AS BIGINT) AS views FROM order_videos GROUP BY channel_id", "order_videos")


# ---- calendar and rounding ----
@query(QUERIES, "fn1_local_calendar")
def fn1(spark, sf):
    p = F.col("published_at")
    return T.order_videos(spark, sf).select("video_id", CAL.local_month(p).alias("month"), F.date_format(CAL.local_day(p), "yyyy-MM-dd").alias("day"))


ORACLE["fn1_local_calendar"] = sql(f"""
SELECT video_id, strftime({local('published_at')}, '%Y-%m') AS month, strftime({local('published_at')}, '%Y-%m-%d') AS day FROM order_videos""", "order_videos")


@query(QUERIES, "fn4_day_arithmetic")
def fn4(spark, sf):
    m = CAL.month_of(F.col("published_at"))
    return T.order_videos(spark, sf).select(
        "video_id", F.date_format(CAL.final_week_start(m), "yyyy-MM-dd").alias("late_from"), CAL.shift_month(m, -1).alias("month_before"),
        CAL.days_in_month(m).cast("bigint").alias("days"), F.datediff(F.to_date("published_at"), F.lit("1970-01-01")).cast("bigint").alias("ordinal"),
        F.date_format(F.date_add(F.to_date("published_at"), 14), "yyyy-MM-dd").alias("two_weeks_on"))


ORACLE["fn4_day_arithmetic"] = sql("""
SELECT video_id, strftime(CAST(date_trunc('month', published_at) AS DATE) - 7, '%Y-%m-%d') AS late_from, strftime(date_trunc('month', published_at) - INTERVAL 1 MONTH, '%Y-%m') AS month_before,
       CAST(day(last_day(published_at)) AS BIGINT) AS days, date_diff('day', DATE '1970-01-01', CAST(published_at AS DATE)) AS ordinal,
       strftime(CAST(published_at AS DATE) + 14, '%Y-%m-%d') AS two_weeks_on FROM order_videos""", "order_videos")


@query(QUERIES, "fn8_rounding")
def fn8(spark, sf):
    x = (F.col("l_quantity") - 25) / 2
    return T.table(spark, sf, "lineitem").groupBy(x.alias("x")).agg(F.count(F.lit(1)).alias("n")).select(
        "x", "n", N.half_up(F.col("x")).alias("half_up"), N.half_even(F.col("x")).alias("half_even"))


ORACLE["fn8_rounding"] = """
SELECT x, count(*) AS n, CAST(floor(x + 0.5) AS BIGINT) AS half_up, CAST(round_even(x, 0) AS BIGINT) AS half_even
FROM (SELECT (l_quantity - 25) / 2 AS x FROM lineitem) q GROUP BY x"""


# ---- streaming ----
def _event_stream(spark, sf):
    schema = T.table(spark, sf, "events").schema
    return J.read_stream(spark, sf, schema, files="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _logged(df, name):
    """Observations kept as a table and read as a stream."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return J.read_stream(df.sparkSession, path, df.schema)


def _drained(df, spark, name):
    path = scratch_path(spark, name)
    q = J.append_to(df, path, scratch_path(spark, f"{name}-progress"))
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


@query(QUERIES, "str1_hourly_debut")
def str1(spark, sf):
    s = _event_stream(spark, sf).select(F.col("user_id").alias("video_id"), "ts", T.published_of(F.col("user_id")).alias("published_at"),
                                        F.round(F.col("value") * 100).cast("bigint").alias("views"))
    return _drained(J.hourly_debut(s), spark, "debut-stream").select(
        F.unix_seconds("window.start").alias("hour_sec"), "video_id", "readings", "views")


ORACLE["str1_hourly_debut"] = sql("""
SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour_sec, user_id AS video_id, count(*) AS readings, max(cents) AS views
FROM ev WHERE ts >= stated_at AND epoch_us(ts) - epoch_us(stated_at) <= 24 * 3600000000
  AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM ev) - INTERVAL 2 HOUR GROUP BY 1, 2""", "ev")


@query(QUERIES, "str2_half_day_slots")
def str2(spark, sf):
    s = _event_stream(spark, sf).select(F.col("user_id").alias("video_id"), "ts")
    return _drained(J.half_day_slots(s), spark, "slot-stream").select("video_id", F.unix_seconds("slot_at").alias("slot_sec"))


ORACLE["str2_half_day_slots"] = sql("SELECT DISTINCT user_id AS video_id, slot_ix * 43200 AS slot_sec FROM ev", "ev")


@query(QUERIES, "str3_availability_feed")
def str3(spark, sf):
    stream = _logged(T.presence_observations(spark, sf).select("video_id", "pass_id", "present"), "presence")
    root = scratch_path(spark, "availability-stream")
    J.availability_feed(stream, root, scratch_path(spark, "availability-progress")).awaitTermination()
    return J.read_feed(spark, root, J.EVENTS)


ORACLE["str3_availability_feed"] = sql("SELECT video_id, pass_id, event FROM evs", "presence", **_STREAKS)


@query(QUERIES, "str4_title_feed")
def str4(spark, sf):
    stream = _logged(T.title_observations(spark, sf).select("video_id", "pass_id", "title", "via"), "titles")
    root = scratch_path(spark, "title-stream")
    J.title_feed(stream, root, scratch_path(spark, "title-progress")).awaitTermination()
    return J.read_feed(spark, root, J.CHANGES)


ORACLE["str4_title_feed"] = sql("SELECT * FROM tc", "title_obs", **_TITLES)


@query(QUERIES, "str5_catalogue_upsert")
def str5(spark, sf):
    s = _event_stream(spark, sf).select(F.col("user_id").alias("video_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    root = scratch_path(spark, "catalogue-stream")
    q = J.upsert_catalogue(s, root, scratch_path(spark, "catalogue-progress"))
    q.awaitTermination()
    return VersionedTable(spark, root, "video_id", J.table_schema(s)).read()


ORACLE["str5_catalogue_upsert"] = """
SELECT user_id AS video_id, max(event_id) AS seq, max_by(event_type, event_id) AS status FROM events GROUP BY user_id"""


@query(QUERIES, "str6_future_guard")
def str6(spark, sf):
    s = _event_stream(spark, sf).select("event_id", "ts")
    return _drained(J.not_from_the_future(s, as_of="2024-01-20 12:00:00"), spark, "guarded-stream").select("event_id")


ORACLE["str6_future_guard"] = "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-20 13:00:00'"
