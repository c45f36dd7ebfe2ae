"""Text helpers, document readers and sinks on real files."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import calendar, numbers, text
from tidegauge.functions.revenue import exposure
from tidegauge.operators.keywords import KeywordIndex
from tidegauge.sources import readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("name,key", [
    ("Harbour 7 case", "harbour 7"), ("Harbour Seven", "harbour 7"), ("The Harbour seven saga case", "harbour 7"), ("Mary K. Stone II", "mary stone ii"),
    ("The", "the"), ("saga", "saga"), ("Rock & Roll", "rock and roll"), ("Zoé Martin", "zoe martin"), ("!!", ""),
    ("Acme™ Case", "acmetm"), ("𝐓rump Trial", "trump trial"), ("ℝed Pill", "red pill"), ("ÉCOLE Ⅳ", "ecole iv"), (None, "")])
def test_name_keys(spark, name, key):
    assert one(spark, text.name_key(F.lit(name))) == key


def test_slug_colour_ids_and_snippets(spark):
    assert one(spark, text.slug(F.lit("  Éloïse Dûmont, 2nd! "))) == "eloise-dumont-2nd"
    assert one(spark, text.name_colour(F.lit("a"))) == "#7fd24b"
    assert one(spark, text.video_ids(F.lit("https://youtu.be/abcdefghijk x youtube.com/watch?v=ABCDEFGHIJ_ i.ytimg.com/vi/abcdefghijk/0.jpg"))) == ["abcdefghijk", "ABCDEFGHIJ_"]
    assert one(spark, text.snippet(F.lit("a  b\n" + "c" * 300))) == "a b " + "c" * 256 + "…"


def test_keywords_need_ascii_word_borders(spark):
    index = KeywordIndex(["t", "of the", "the"], [0, 0, 0])
    data = "été tea, t t-shirt of the t_".encode()
    assert [x.tolist() for x in index.counts(np.frombuffer(data, np.uint8), np.array([0, len(data)]))] == [[0], [0], [5]]


def test_rounding_conventions(spark):
    got = [(one(spark, numbers.half_up(F.lit(x))), one(spark, numbers.half_even(F.lit(x)))) for x in (-2.5, 0.5, 1.5, 2.5)]
    assert got == [(-2, -2), (1, 0), (2, 2), (3, 2)]


def test_parsers(spark):
    assert [one(spark, numbers.iso_duration_seconds(F.lit(x))) for x in ("PT1H2M3S", "PT5S", "P1D", "xPT2Mx")] == [3723, 5, 0, 120]
    assert one(spark, numbers.iso_duration_seconds(F.lit("xPT2Mx"), anchored=True)) == 0
    assert [one(spark, numbers.nullable_count(F.lit(x))) for x in ("0", "12abc", "hidden", None)] == [0, 12, None, None]
    assert [one(spark, numbers.exact_count(F.lit(x))) for x in ("7", "at least 7", " ")] == [7, None, None]
    assert float(one(spark, numbers.money(F.lit("$1,234.50")))) == 1234.5 and one(spark, numbers.money(F.lit("n/a"))) is None


def test_exposure_curve_and_same_point(spark):
    ages = {"2026-08-28": 1.0, "2026-08-25": 1 - 0.917, "2026-08-01": 0.0}
    for day, want in ages.items():
        assert one(spark, exposure(F.lit(f"{day} 00:00:00").cast("timestamp"))) == pytest.approx(want)
    at = F.lit("2024-03-31 09:14:37").cast("timestamp")
    assert str(one(spark, calendar.same_point(at, 1))) == "2024-02-29 09:14:00"


def _dump(path, doc):
    with gzip.open(path, "wt") as f:
        f.write(doc if isinstance(doc, str) else json.dumps(doc))


def test_snapshot_archive_from_files(spark, tmp_path):
    video = {"id": "v1", "channelId": "c", "title": "T", "publishedAt": "2024-01-01T05:00:00Z", "views": 7, "likes": None}
    _dump(tmp_path / "2024-01-02-AM.json.gz", {"channels": {"c": {"id": "c"}}, "meta": {"lastUpdated": "2024-01-02T01:30:00Z"}, "videos": [video]})
    _dump(tmp_path / "2024-01-02-PM.json.gz", {"channels": {"c": {"id": "c"}}, "videos": [dict(video, views=9, isShort=True)]})
    _dump(tmp_path / "2024-01-03-AM.json.gz", '{"channels": {"c"')
    _dump(tmp_path / "notes.json.gz", {"channels": {"c": {"id": "c"}}, "videos": [video]})
    rows = readers.read_snapshots(spark, str(tmp_path)).orderBy("captured_at").collect()
    assert [(r.slot, str(r.captured_at), r.views, r.likes, r.is_short) for r in rows] == [
        ("AM", "2024-01-02 01:30:00", 7, None, False), ("PM", "2024-01-02 18:00:00", 9, None, True)]


def test_old_and_placeholder_catalogues_are_empty(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"channel": {"id": "c"}, "videos": [{"id": "v"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"channels": {"c": {}}, "videos": []}))
    assert readers.read_catalogue(spark, str(tmp_path)).count() == 0


def test_rosters_windows_and_transcripts(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"channels": {"@a": {"channelId": "c", "videoIds": ["x", "y"]}, "@b": {"channelId": "d", "videoIds": []}}}))
    (tmp_path / "w.json").write_text(json.dumps({"videos": {"x": {"windows": [["2024-01-01", "2024-01-03"], ["2024-02-01", None]]}}}))
    (tmp_path / "t.json").write_text(json.dumps({"videoId": "x", "segments": [{"text": "a", "offset": 0, "duration": 5}]}))
    assert {(r.handle, r.video_id) for r in readers.read_roster(spark, str(tmp_path / "r.json")).collect()} == {("@a", "x"), ("@a", "y")}
    assert [(str(r.win_from), str(r.win_to)) for r in readers.read_windows(spark, str(tmp_path / "w.json")).collect()] == [("2024-01-01", "2024-01-03")]
    assert readers.read_transcripts(spark, str(tmp_path / "t.json")).first().segments[0].text == "a"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("2024-01", 1, "x"), ("2024-02", 2, "x")], "month string, v long, generated string")
    path = str(tmp_path / "p")
    assert [sinks.publish_if_changed(d, path) for d in (df, df.withColumn("generated", F.lit("y")), df.withColumn("v", F.col("v") * 2))] == [True, False, True]
    months = str(tmp_path / "m")
    sinks.write_months(df, months)
    sinks.write_months(df.where("month = '2024-02'").withColumn("v", F.lit(9).cast("long")), months)
    assert {(str(r.month)[:7], r.v) for r in spark.read.parquet(months).collect()} == {("2024-01", 1), ("2024-02", 9)}
    slots = str(tmp_path / "s")
    sinks.append_new_slots(df.where("month = '2024-01'"), slots, slot=["month"])
    sinks.append_new_slots(df.withColumn("v", F.lit(-1).cast("long")), slots, slot=["month"])
    assert {(r.month, r.v) for r in sinks.read_slots(spark, slots).collect()} == {("2024-01", 1), ("2024-02", -1)}


def test_folding_reaches_all_compatible_letters(spark):
    names = ["Nguyễn Văn", "Ｆull ﬁt", "Ĳssel ①", "naïve Ørsted", "plain"]
    got = [r.s for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(text.slug(F.col("n")).alias("s")).collect()]
    assert got == ["nguyen-van", "full-fit", "ijssel-1", "naive-rsted", "plain"]
