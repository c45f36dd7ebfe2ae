"""Stand-in inputs: the benchmark tables re-shaped into the canonical schemas.

Every adapter is deterministic in the ids, so the same rows can be derived by any
SQL engine. Events are pre-aggregated per (video, half-day) before anything is
ordered, so one very busy video never sends its raw rows to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLOT_SECONDS = 43200  # half a day


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One benchmark table; its footer is read for the schema once per process, not once per use."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def spread(df: DataFrame, *, rows: int = 50_000) -> DataFrame:
    """The same rows, dealt out in parts of about that many, for work that costs much more than reading a few narrow columns."""
    parts = -(-df.count() // rows)
    return df.repartition(parts) if parts > 1 else df


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970 of a UTC timestamp."""
    return F.unix_seconds(ts.cast("timestamp"))


def slot_of(ts: Column) -> Column:
    return F.floor(epoch(ts) / SLOT_SECONDS).cast("bigint")


def published_of(video: Column) -> Column:
    days = (video * 7) % 45
    hours = (video * 13) % 24
    base = F.lit("2023-12-10 00:00:00").cast("timestamp")
    return F.timestamp_seconds(F.unix_seconds(base) + days * 86400 + hours * 3600)


def channel_of(video: Column) -> Column:
    return F.concat(F.lit("ch"), (video % 5).cast("string"))


def short_of(video: Column) -> Column:
    return video % 3 == 0


def is_ad(video: Column) -> Column:
    return video % 10 == 1


def snapshot_axis(events: DataFrame) -> DataFrame:
    """One row per half-day that holds any event: (slot_ix, captured_at, snap_ix).

    Its size is bounded by the calendar (730 rows a year), whatever the event count.
    """
    slots = events.groupBy(slot_of(F.col("ts")).alias("slot_ix")).agg(
        F.max(F.col("ts").cast("timestamp")).alias("captured_at"))
    return slots.withColumn(
        "snap_ix", (F.row_number().over(Window.orderBy("slot_ix")) - 1).cast("bigint"))


def snapshot_clock(slots: DataFrame) -> DataFrame:
    start = F.timestamp_seconds(F.col("slot_ix") * SLOT_SECONDS)
    return (slots.withColumn("snap_date", F.to_date(start))
            .withColumn("slot", F.when(F.col("slot_ix") % 2 == 0, "AM").otherwise("PM")))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-daily counter readings of every video, with the scheduled gaps left out."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    axis = snapshot_axis(events)
    cents = F.round(F.col("value") * 100).cast("bigint")
    engaged = F.col("event_type").isin("click", "view")
    per_slot = (
        # events before publication count from it on
        events.groupBy(F.col("user_id").alias("video_id"),
                       F.greatest(slot_of(F.col("ts")), slot_of(published_of(F.col("user_id")))).alias("event_slot"))
        .agg(F.sum(cents).alias("cents"),
             F.sum(F.when(engaged, cents).otherwise(0)).alias("engaged_cents"),
             F.sum(F.when(F.col("event_type") == "click", cents).otherwise(0)).alias("click_cents")))
    running = Window.partitionBy("video_id").orderBy("event_slot")
    last_slot = axis.agg(F.max("slot_ix")).scalar()
    sparse = (
        per_slot
        .withColumn("total", F.sum("cents").over(running))
        .withColumn("engaged_total", F.sum("engaged_cents").over(running))
        .withColumn("click_total", F.sum("click_cents").over(running))
        .withColumn("next_slot", F.lead("event_slot").over(running))
        .withColumn("is_first", F.row_number().over(running) == 1)
        .withColumn("published_at", published_of(F.col("video_id"))))
    # Each reading holds until the next one; the first also covers the empty slots
    # since publication, so the dense series needs no join against a grid.
    start = F.when(F.col("is_first"), slot_of(F.col("published_at"))).otherwise(F.col("event_slot"))
    stop = F.coalesce(F.col("next_slot") - 1, last_slot)
    dense = sparse.where(start <= stop).withColumn("slot_ix", F.explode(F.sequence(start, stop)))
    reached = F.col("slot_ix") >= F.col("event_slot")

    def units(total: str, per: int) -> Column:
        return F.when(reached, F.expr(f"{total} div {per}")).otherwise(F.lit(0)).cast("bigint")

    video = F.col("video_id")
    out = (
        dense.where((video + F.col("slot_ix")) % 11 != 0)
        .select(
            "video_id", "slot_ix", "published_at",
            units("total", 100).alias("views"),
            F.when(video % 13 != 0, units("(total + 2 * engaged_total)", 1600)).alias("likes"),
            units("click_total", 2000).alias("comments"),
            channel_of(video).alias("channel_id"),
            short_of(video).alias("is_short"))
        .join(axis, "slot_ix"))
    return snapshot_clock(out)


def debut_samples(spark: SparkSession, sf_dir: str, *, hours: int = 72) -> DataFrame:
    """Hourly samples of young videos: running totals at the end of every hour with events since publication."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    video, cents = F.col("video_id"), F.round(F.col("value") * 100).cast("bigint")
    age = F.floor((epoch(F.col("ts")) - epoch(published_of(F.col("user_id")))) / 3600) + 1
    per_hour = (events.select(F.col("user_id").alias("video_id"), F.greatest(age, F.lit(1)).cast("bigint").alias("hour"),
                              cents.alias("cents"),
                              F.when(F.col("event_type").isin("click", "view"), cents).otherwise(0).alias("engaged"))
                .where(F.col("hour") <= hours).groupBy("video_id", "hour")
                .agg(F.sum("cents").alias("cents"), F.sum("engaged").alias("engaged")))
    running = Window.partitionBy("video_id").orderBy("hour")
    sums = per_hour.withColumn("total", F.sum("cents").over(running)).withColumn("e", F.sum("engaged").over(running))
    return sums.select("video_id", F.col("hour").cast("double").alias("age_h"), F.expr("total div 100").alias("views"),
                       F.when(video % 13 != 0, F.expr("(total + 2 * e) div 1600")).alias("likes"))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue: one row per video with its last-known totals."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    cents = F.round(F.col("value") * 100).cast("bigint")
    video = F.col("video_id")
    seen = (
        events.groupBy(F.col("user_id").alias("video_id"))
        .agg(F.sum(cents).alias("total"),
             F.sum(F.when(F.col("event_type").isin("click", "view"), cents).otherwise(0)).alias("engaged_total"),
             F.sum(F.when(F.col("event_type") == "click", cents).otherwise(0)).alias("click_total")))
    return seen.select(
        video,
        channel_of(video).alias("channel_id"),
        F.concat(F.lit("Video "), video.cast("string")).alias("title"),
        published_of(video).alias("published_at"),
        F.when(short_of(video), 30 + video % 150).otherwise(200 + (video * 37) % 3600).cast("bigint").alias("duration_sec"),
        F.expr("total div 100").alias("views"),
        F.when(video % 13 != 0, F.expr("(total + 2 * engaged_total) div 1600")).alias("likes"),
        F.expr("click_total div 2000").alias("comments"),
        short_of(video).alias("is_short"),
        (video % 17 == 0).alias("unavailable"),
        (video % 23 == 0).alias("unlisted"))


def ad_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    video = F.col("video_id")
    return (events.select(F.col("user_id").alias("video_id")).where(is_ad(video)).distinct()
            .select(channel_of(video).alias("channel_id"), "video_id"))


def creatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One advertising creative per sign-up event of an advertised video."""
    events = table(spark, sf_dir, "events")
    first = F.to_date("ts")
    return (
        events.where((F.col("event_type") == "signup") & is_ad(F.col("user_id")))
        .select(F.col("event_id").alias("creative_id"), F.col("user_id").alias("video_id"),
                first.alias("first_day"),
                F.date_add(first, (F.col("event_id") % 4).cast("int")).alias("last_day")))


def campaign_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return creatives(spark, sf_dir).select(
        "video_id", F.col("first_day").alias("win_from"), F.col("last_day").alias("win_to"))


TEXT_AS_OF = "2024-03-01"


def text_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as catalogue entries: the first line is the title, the text the description."""
    doc = F.col("doc_id")
    day = F.date_sub(F.lit(TEXT_AS_OF).cast("date"), (doc % 60).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text", "n_chars").select(
        doc.alias("video_id"), F.col("source").alias("channel_id"),
        F.split(F.col("text"), "\n")[0].alias("title"),
        F.col("text").alias("description"),
        F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + (doc * 7) % 24 * 3600).alias("published_at"),
        F.col("n_chars").alias("views"),
        F.lit(False).alias("is_short"), F.lit(False).alias("unavailable"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as transcripts: one row per video, one timed segment per line."""
    doc = F.col("doc_id")
    lines = F.split(F.col("text"), "\n")
    first = F.lit("2020-05-01").cast("date")
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text").select(
        doc.alias("video_id"), F.col("source").alias("channel_id"),
        F.concat(F.lit("Talk "), doc.cast("string")).alias("title"),
        F.date_add(first, ((doc * 3) % 900).cast("int")).cast("timestamp").alias("published_at"),
        F.transform(lines, lambda line, i: F.struct(
            line.alias("text"), (i.cast("bigint") * 60000).alias("offset"),
            F.lit(55000).cast("bigint").alias("duration"))).alias("segments"))


def title_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as title sightings, one per (video, pass)."""
    turn = F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("video_id"), turn.alias("pass_id"),
        F.timestamp_seconds(F.lit(1704067200) + turn * 43200).alias("observed_at"),
        F.split(F.col("text"), "\n")[0].alias("title"),
        F.when(turn % 2 == 0, "audit").otherwise("incremental").alias("via"))


def presence_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as presence checks: a video answered a pass or was missing from it."""
    events = table(spark, sf_dir, "events")
    return (
        events.groupBy(F.col("user_id").alias("video_id"), F.to_date("ts").alias("day"))
        .agg(F.max(F.when(F.col("event_type").isin("click", "view", "purchase"), 1).otherwise(0)).alias("answered"),
             F.min("ts").cast("timestamp").alias("observed_at"))
        .select("video_id", F.datediff("day", F.lit("2024-01-01")).cast("bigint").alias("pass_id"),
                "observed_at", (F.col("answered") == 1).alias("present")))


def price_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as price scans: sku = supplier, day = shipping week."""
    sku = F.col("l_suppkey")
    base = 10 + sku % 20
    qty = F.col("l_quantity")
    cents = F.when(qty >= 49, base * 150).when(qty <= 2, base * 50).otherwise(base * 100).cast("bigint")
    status = F.when(F.col("l_returnflag") == "R", "out of stock").when(F.col("l_linestatus") == "O", "ok").otherwise("ok (other seller)")
    # Every fifth reading is a lower bound, every seventh is blank.
    count = qty.cast("bigint").cast("string")
    avail = (F.when(F.col("l_returnflag") == "R", "0")
             .when(F.col("l_orderkey") % 7 == 0, "")
             .when(F.col("l_orderkey") % 5 == 0, F.concat(F.lit("at least "), count))
             .otherwise(count))
    scans = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    return scans.select(
        F.concat(F.lit("S"), sku.cast("string")).alias("sku"),
        F.to_date(F.date_trunc("week", "l_shipdate")).alias("day"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("bigint").alias("seq"),
        F.concat(F.lit("$"), F.format_string("%d.%02d", F.floor(cents / 100), cents % 100)).alias("price"),
        avail.alias("available"), status.alias("status"),
        F.concat(F.element_at(F.array(F.lit("Ground"), F.lit("Whole Bean"), F.lit("K-Cups"), F.lit("Tea")),
                              (sku % 4 + 1).cast("int")),
                 F.lit(" - "), F.when(sku % 11 == 0, "Kona ").otherwise(""), F.lit("Blend "), sku.cast("string")).alias("label"))


def order_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a long publishing history: views = price, channel = priority."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("video_id"), F.col("o_orderpriority").alias("channel_id"),
        F.timestamp_seconds(epoch(F.col("o_orderdate")) + (key % 24) * 3600).alias("published_at"),
        (60 + (key * 37) % 3600).cast("bigint").alias("duration_sec"),
        F.floor("o_totalprice").cast("bigint").alias("views"),
        F.when(key % 11 != 0, F.expr("cast(floor(o_totalprice) as bigint) div (10 + o_orderkey % 40)")).alias("likes"),
        F.expr("cast(floor(o_totalprice) as bigint) div 500").alias("comments"),
        (key % 3 == 0).alias("is_short"), (F.col("o_orderstatus") == "P").alias("unavailable"))
