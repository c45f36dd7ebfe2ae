"""Readers for the archive's documents: snapshots, samples, rosters, windows, transcripts, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge import schemas

SLOT_NAME = r"^(\d{4}-\d{2}-\d{2})-(AM|PM)\.json\.gz$"
HOUR_NAME = r"^(\d{4}-\d{2}-\d{2})-(\d{2})\.json\.gz$"
# The same names as folders of a partitioned archive, with files of any name below.
SLOT_FOLDER = r"(?:^|/)tag=(\d{4}-\d{2}-\d{2})-(AM|PM)/[^/]+\.gz$"
HOUR_FOLDER = r"(?:^|/)hour=(\d{4}-\d{2}-\d{2})-(\d{2})/[^/]+\.gz$"


def capture_time(stamp: Column, day: Column, slot: Column, *, am_hour: float = 10, pm_hour: float = 18) -> Column:
    """The document's own stamp, else the nominal hour of its slot."""
    hours = F.when(slot == "AM", am_hour).otherwise(pm_hour)
    nominal = F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + hours * 3600)
    return F.coalesce(F.try_to_timestamp(stamp), nominal)


def catalogue_videos(docs: DataFrame) -> DataFrame:
    """Explode catalogue documents; placeholders and the old single-channel form give no rows."""
    usable = docs.where(F.col("channels").isNotNull() & (F.size("videos") > 0))
    return usable.withColumn("v", F.explode("videos"))


def unreadable(docs: DataFrame) -> DataFrame:
    """How many documents could and could not be parsed."""
    return docs.agg(F.count_if(F.col("_corrupt_record").isNull()).alias("read"),
                    F.count_if(F.col("_corrupt_record").isNotNull()).alias("skipped"))


def _json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
            .withColumns({"file": F.col("_metadata.file_name"), "path": F.col("_metadata.file_path")}))


def _named(docs: DataFrame, name: str) -> DataFrame:
    """Readable documents whose file name, or whose path, has the given form; it stays in `found`."""
    found = F.when(F.col("file").rlike(name), F.col("file")).when(F.col("path").rlike(name), F.col("path"))
    return docs.where(F.col("_corrupt_record").isNull()).withColumn("found", found).where("found IS NOT NULL")


def read_snapshots(spark: SparkSession, path: str, *, am_hour: float = 10, pm_hour: float = 18,
                   name: str = SLOT_NAME) -> DataFrame:
    """Half-daily dumps as readings; date and slot come from the file name, other names are ignored.

    Documents that cannot be parsed are left out. `name` is the form of the file name, or of the path
    (`SLOT_FOLDER`), with date and slot as its groups. A document may span lines; a file holds one.
    A gzipped document is one task, so land the archive once with `land_readings`
    and let the products read the partitioned table.
    """
    docs = _named(_json(spark, path, schemas.CATALOGUE), name)
    tagged = (docs.withColumn("snap_date", F.to_date(F.regexp_extract("found", name, 1)))
              .withColumn("slot", F.regexp_extract("found", name, 2)))
    return catalogue_videos(tagged).select(
        "snap_date", "slot",
        capture_time(F.col("meta.lastUpdated"), F.col("snap_date"), F.col("slot"), am_hour=am_hour, pm_hour=pm_hour).alias("captured_at"),
        *video_columns())


def video_columns() -> list[Column]:
    """The catalogue's record in canonical names; absent flags are false, hidden counters stay null."""
    return [F.col("v.id").alias("video_id"), F.col("v.channelId").alias("channel_id"), F.col("v.title").alias("title"),
            F.try_to_timestamp("v.publishedAt").alias("published_at"), F.col("v.durationSec").alias("duration_sec"),
            F.coalesce("v.views", F.lit(0)).alias("views"), F.col("v.likes").alias("likes"), F.col("v.comments").alias("comments"),
            F.coalesce("v.isShort", F.lit(False)).alias("is_short"),
            F.coalesce("v.unavailable", F.lit(False)).alias("unavailable"),
            F.coalesce("v.unlisted", F.lit(False)).alias("unlisted")]


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return catalogue_videos(_json(spark, path, schemas.CATALOGUE)).select(*video_columns())


def read_debut(spark: SparkSession, path: str, *, name: str = HOUR_NAME) -> DataFrame:
    """Hourly samples of young videos; other file names (or paths, with `HOUR_FOLDER`) and unreadable ones are left out."""
    docs = _named(_json(spark, path, schemas.CATALOGUE), name)
    return (docs.where(F.size("videos") > 0).withColumn("v", F.explode("videos")).where("v.ageH IS NOT NULL")
            .select(F.try_to_timestamp("t").alias("sampled_at"), F.col("v.ageH").alias("age_h"), *video_columns()))


def map_rows(docs: DataFrame, text: str, *, value: str = "string") -> DataFrame:
    """A JSON object of id -> value as two columns beside the document's own."""
    parsed = F.from_json(text, f"map<string,{value}>")
    return docs.select(*[c for c in docs.columns if c != text], F.explode(parsed).alias("key", "value"))


def roster_rows(docs: DataFrame) -> DataFrame:
    """handle -> {channelId, videoIds[]} as one row per flagged video."""
    return (docs.select(F.explode("channels").alias("handle", "c"))
            .select("handle", F.col("c.channelId").alias("channel_id"), F.explode("c.videoIds").alias("video_id")))


def window_rows(docs: DataFrame) -> DataFrame:
    """videos -> windows[[from, to]] as rows; incomplete pairs are dropped."""
    return (docs.select(F.explode("videos").alias("video_id", "w")).select("video_id", F.explode("w.windows").alias("p"))
            .select("video_id", F.get("p", F.lit(0)).alias("win_from"), F.get("p", F.lit(1)).alias("win_to"))
            .where("win_from IS NOT NULL AND win_to IS NOT NULL"))


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    return roster_rows(spark.read.schema(schemas.ROSTER).option("multiLine", True).json(path))


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    return window_rows(spark.read.schema(schemas.CAMPAIGNS).option("multiLine", True).json(path)).select(
        "video_id", F.to_date("win_from").alias("win_from"), F.to_date("win_to").alias("win_to"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One document per video; unreadable ones are left out."""
    docs = _json(spark, path, schemas.TRANSCRIPT).where(F.col("_corrupt_record").isNull())
    return docs.select(F.col("videoId").alias("video_id"), F.col("channelId").alias("channel_id"), "title",
                       F.try_to_timestamp("publishedAt").alias("published_at"), "segments")


def read_price_history(spark: SparkSession, path: str) -> DataFrame:
    """Price scans from CSV; rows whose date is not an ISO day are dropped."""
    rows = spark.read.schema(schemas.PRICE_HISTORY).option("header", True).csv(path)
    return rows.where(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$")).select(
        F.col("asin").alias("sku"), F.try_to_date("date").alias("day"), F.col("time").alias("seq"), "label", "available", "price", "status")


def taxonomy_rows(topics: DataFrame) -> DataFrame:
    """Topics that can score: id not starting with '_', at least one keyword."""
    return topics.where(~F.col("topic_id").startswith("_") & (F.coalesce(F.size("keywords"), F.lit(0)) > 0))


def label_rows(labels: DataFrame) -> DataFrame:
    """Label entries given as plain text or as {name, keywords}."""
    obj = F.from_json("entry", "name string, keywords array<string>")
    is_object = F.col("entry").startswith("{")
    return labels.select("term_id", F.when(is_object, obj["name"]).otherwise(F.col("entry")).alias("display_name"),
                         F.when(is_object, obj["keywords"]).alias("keywords"))
