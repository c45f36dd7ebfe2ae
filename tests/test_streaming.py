"""Keyed feeds and versioned tables over several micro-batches, replays included."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import catalogue
from tidegauge.sources import sinks
from tidegauge.sources.versions import VersionedTable
from tidegauge.streaming import jobs


def drain(start):
    start().awaitTermination()


def kept(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture()
def passes():
    rng = random.Random(3)
    rows = [(v, p, rng.random() < (0.3 if v % 3 else 0.9)) for v in range(40) for p in range(30) if rng.random() < 0.95]
    return rows + [(99, p, p % 7000 == 5000) for p in range(20_000)]  # one video with very many rows


def test_availability_over_batches(spark, tmp_path, passes):
    src, root, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    frame = spark.createDataFrame(passes, "video_id long, pass_id long, present boolean")
    os.makedirs(src)
    for low, high in ((0, 7), (7, 8), (8, 6000), (6000, 30_000)):
        frame.where((F.col("pass_id") >= low) & (F.col("pass_id") < high)).coalesce(1).write.mode("append").parquet(src)
        stream = jobs.read_stream(spark, src, frame.schema)
        drain(lambda: jobs.availability_feed(stream, root, progress))
    got = kept(jobs.read_feed(spark, root, jobs.EVENTS))
    want = kept(catalogue.availability_events(frame.withColumn("observed_at", F.lit(None).cast("timestamp"))).select("video_id", "pass_id", "event"))
    assert got == want and len(got) > 40 and {e for *_, e in got} == {"newly_unavailable", "restored"}
    # a batch that is played again repeats its output and its state
    held = kept(VersionedTable(spark, f"{root}/state", "video_id", jobs.STREAK).read())
    last = max(int(os.path.basename(p)) for p in glob.glob(f"{progress}/commits/[0-9]*"))
    for name in (f"{last}", f".{last}.crc"):
        os.remove(f"{progress}/commits/{name}")
    drain(lambda: jobs.availability_feed(jobs.read_stream(spark, src, frame.schema), root, progress))
    assert kept(jobs.read_feed(spark, root, jobs.EVENTS)) == want
    assert kept(VersionedTable(spark, f"{root}/state", "video_id", jobs.STREAK).read()) == held


def test_titles_over_batches(spark, tmp_path):
    rng = random.Random(5)
    rows = [(v, p, rng.choice(["a", "b", "", None, "c"]), "audit") for v in range(30) for p in range(20)]
    frame = spark.createDataFrame(rows, "video_id long, pass_id long, title string, via string")
    src, root, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    for low, high in ((0, 5), (5, 6), (6, 20)):
        frame.where((F.col("pass_id") >= low) & (F.col("pass_id") < high)).coalesce(1).write.mode("append").parquet(src)
        drain(lambda: jobs.title_feed(jobs.read_stream(spark, src, frame.schema), root, progress))
    assert kept(jobs.read_feed(spark, root, jobs.CHANGES)) == kept(catalogue.title_changes(frame))


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    src, root, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    schema = "video_id long, seq long, status string"

    def batch(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        drain(lambda: jobs.upsert_catalogue(jobs.read_stream(spark, src, spark.createDataFrame([], schema).schema), root, progress, buckets=8))

    table = VersionedTable(spark, root, "video_id", schema, buckets=8)
    batch([(v, 1, "new") for v in range(200)] + [(7, 2, "twice")])
    first = table.manifest()
    assert len(first) == 8 and set(first.values()) == {0}
    batch([(7, 5, "changed"), (7, 4, "older")])
    second = table.manifest()
    assert sum(v == 1 for v in second.values()) == 1 and len(glob.glob(f"{root}/data/v=1/bucket=*")) == 1
    assert kept(table.read()) == kept(spark.createDataFrame([(v, 1, "new") for v in range(200) if v != 7] + [(7, 5, "changed")], schema))
    batch([(v, 9, "all") for v in range(200)])
    batch([(500, 1, "late")])
    # only the two newest versions stay on record, and no file that neither names
    assert sorted(os.path.basename(p) for p in glob.glob(f"{root}/manifests/v=*")) == ["v=2", "v=3"]
    assert not glob.glob(f"{root}/data/v=0/bucket=*") and not glob.glob(f"{root}/data/v=1/bucket=*")
    assert table.read().count() == 201
    # written again under the same number: the same table
    before = kept(table.read())
    table.write(3, spark.createDataFrame([(500, 1, "late")], schema), lambda old, new: catalogue.merge_latest(old, new))
    assert kept(table.read()) == before


def test_slots_are_looked_up_in_their_record(spark, tmp_path):
    path = str(tmp_path / "slots")
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", 2)], "v long, slot string, part int")
    sinks.append_new_slots(df.where("slot = 'a'"), path, slot=["slot", "part"])
    files = set(glob.glob(f"{path}/data/**/*.parquet", recursive=True))
    sinks.append_new_slots(df.withColumn("v", F.lit(-1).cast("long")), path, slot=["slot", "part"])
    sinks.append_new_slots(df, path, slot=["slot", "part"])
    assert files < set(glob.glob(f"{path}/data/**/*.parquet", recursive=True))
    assert kept(sinks.read_slots(spark, path).select("v", "slot")) == [(-1, "b"), (1, "a"), (2, "a")]
    # written but never recorded, as after a failure: written again in full
    df.where("slot = 'b'").withColumn("slot", F.lit("c")).write.mode("append").partitionBy("slot", "part").parquet(f"{path}/data")
    assert sinks.read_slots(spark, path).where("slot = 'c'").count() == 0
    sinks.append_new_slots(df.where("slot = 'b'").withColumn("slot", F.lit("c")), path, slot=["slot", "part"])
    assert kept(sinks.read_slots(spark, path).where("slot = 'c'").select("v")) == [(3,)]
