"""The scheduled jobs as Structured Streaming queries.

Each job reads a stream, keeps its state with Spark, and appends to a table. All of
them run to completion with an available-now trigger, or continuously without one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegauge.operators.blocks import previous_row, streaks
from tidegauge.operators.catalogue import merge_latest
from tidegauge.session import cut_lineage
from tidegauge.sources.versions import BUCKETS, VersionedTable


def read_stream(spark: SparkSession, folder: str, schema, *, files: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)


def not_from_the_future(stream: DataFrame, *, as_of: str, ts: str = "ts", slack_hours: float = 1) -> DataFrame:
    """Drop rows stamped more than an hour after the given instant."""
    limit = F.lit(as_of).cast("timestamp") + F.make_dt_interval(hours=F.lit(int(slack_hours)))
    return stream.where(F.col(ts) <= limit)


def hourly_debut(stream: DataFrame, *, max_age_h: float = 24, lateness: str = "2 hours") -> DataFrame:
    """Per hour and young video one closed sample: readings seen and the highest count.

    Input columns: video_id, ts, published_at, views.
    """
    age_h = (F.unix_micros("ts") - F.unix_micros("published_at")) / 3600000000.0
    return (stream.withWatermark("ts", lateness).where((age_h >= 0) & (age_h <= max_age_h))
            .groupBy(F.window("ts", "1 hour"), "video_id")
            .agg(F.count(F.lit(1)).alias("readings"), F.max("views").alias("views")))


def half_day_slots(stream: DataFrame, *, lateness: str = "12 hours") -> DataFrame:
    """First reading of every (video, half-day) wins; repeats within the lateness are dropped."""
    return (stream.withColumn("slot_at", F.window("ts", "12 hours")["start"]).withWatermark("ts", lateness)
            .dropDuplicatesWithinWatermark(["video_id", "slot_at"]))


def keyed_feed(stream: DataFrame, root: str, checkpoint: str, advance: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], *,
               key: str, state: str, available_now: bool = True) -> StreamingQuery:
    """A feed with one row of state per key, kept as a versioned table and advanced by each micro-batch.

    ``advance(batch, state)`` gives what the batch puts out and the new state of its keys. State and feed of batch n
    are written under n, from the state before n, so a batch that is played again repeats both. Only the buckets of
    the state that hold a key of the batch are read and rewritten. A key may have any number of rows in a batch.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        table = VersionedTable(batch.sparkSession, f"{root}/state", key, state)
        rows = cut_lineage(batch)  # read several times below
        held = table.before(batch_id, rows)
        feed, changed = advance(rows, held.join(rows.select(key).distinct(), key, "left_semi"))
        feed.write.mode("overwrite").parquet(f"{root}/feed/v={batch_id}")
        table.write(batch_id, cut_lineage(changed), lambda old, new: merge_latest(old, new, key=key))

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_feed(spark: SparkSession, root: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{root}/feed").drop("v")


EVENTS, STREAK = "video_id long, pass_id long, event string", "video_id long, streak long"


def availability_feed(stream: DataFrame, root: str, checkpoint: str, *, rechecks: int = 3, available_now: bool = True) -> StreamingQuery:
    """Confirmed removals and restorations, from explicit presence rows (video_id, pass_id, present).

    The state of a video is how many passes in a row it has been missing.
    """
    def advance(batch: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
        carried = held.select("video_id", F.col("streak").alias("carry"))
        seen = batch.where("present").groupBy("video_id").agg(F.min("pass_id").alias("first_seen"))
        missing = streaks(batch.select("video_id", "pass_id", "present"), "video_id", "pass_id", ~F.col("present"))
        # until it is first seen in the batch, a video goes on missing from before
        open_ = ~F.col("present") & (F.col("first_seen").isNull() | (F.col("pass_id") < F.col("first_seen")))
        rows = (missing.join(carried, "video_id", "left").join(seen, "video_id", "left").withColumn("carry", F.coalesce("carry", F.lit(0)))
                .withColumn("streak", F.col("streak") + F.when(open_, F.col("carry")).otherwise(0)))
        before = previous_row(rows, "video_id", "pass_id", ["streak"]).withColumn("prev", F.coalesce("prev_streak", "carry"))
        event = (F.when(F.col("streak") == rechecks + 1, "newly_unavailable")
                 .when(F.col("present") & (F.col("prev") > rechecks), "restored"))
        feed = before.withColumn("event", event).where("event IS NOT NULL").select("video_id", "pass_id", "event")
        return feed, rows.groupBy("video_id").agg(F.max_by("streak", "pass_id").cast("long").alias("streak"))

    return keyed_feed(stream, root, checkpoint, advance, key="video_id", state=STREAK, available_now=available_now)


CHANGES, TITLE = "video_id long, pass_id long, from_title string, to_title string, via string", "video_id long, title string"


def title_feed(stream: DataFrame, root: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """A row whenever a video's title differs from the last one seen (video_id, pass_id, title, via); that one is its state."""
    def advance(batch: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
        usable = batch.where(F.length("title") > 0).select("video_id", "pass_id", "title", "via")
        rows = (previous_row(usable, "video_id", "pass_id", ["title"])
                .join(held.select("video_id", F.col("title").alias("carry")), "video_id", "left")
                .withColumn("from_title", F.coalesce("prev_title", "carry")))
        feed = rows.where(F.col("from_title") != F.col("title")).select("video_id", "pass_id", "from_title", F.col("title").alias("to_title"), "via")
        return feed, usable.groupBy("video_id").agg(F.max_by("title", "pass_id").alias("title"))

    return keyed_feed(stream, root, checkpoint, advance, key="video_id", state=TITLE, available_now=available_now)


def append_to(df: DataFrame, path: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)


def upsert_catalogue(stream: DataFrame, root: str, checkpoint: str, *, key: str = "video_id", version: str = "seq",
                     buckets: int = BUCKETS, available_now: bool = True) -> StreamingQuery:
    """Latest-wins merge of every micro-batch into a versioned table; a batch rewrites only the buckets it touches.

    Of rows of a batch with one key the highest ``version`` stays; a stored row gives way to any later batch.
    """
    schema = table_schema(stream)

    def merge(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c != key]
        fresh = cut_lineage(batch.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("_r"))
                            .select(key, *[F.col(f"_r.{c}").alias(c) for c in rest]))
        VersionedTable(batch.sparkSession, root, key, schema, buckets=buckets).write(batch_id, fresh, lambda old, new: merge_latest(old, new, key=key))

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def table_schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
