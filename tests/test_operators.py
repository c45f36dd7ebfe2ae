"""Operators against brute force on small hand-made rows."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import asof, blocks, catalogue, stats


def _rows(seed=3):
    rnd = random.Random(seed)
    groups = {"hot": 400, "mid": 37, "one": 1, "two": 2}
    return [(g, float(rnd.choice([rnd.randint(0, 9), rnd.lognormvariate(3, 2)]))) for g, n in groups.items() for _ in range(n)]


def test_order_values_agree_with_sorting(spark):
    """Ranks by counted buckets give the sorted list's own values."""
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, v double")
    got = stats.order_values(df, ["k"], "v", {
        "lo": lambda n: F.floor((n + 1) / 2), "hi": lambda n: F.floor(n / 2) + 1,
        "p90": lambda n: F.floor(F.lit(0.9) * (n - 1)) + 1, "top": lambda n: n})
    for r in got.collect():
        v = sorted(x for k, x in rows if k == r.k)
        n = len(v)
        assert (r.n, r.lo, r.hi, r.top) == (n, v[(n + 1) // 2 - 1], v[n // 2], v[-1])
        assert r.p90 == v[math.floor(0.9 * (n - 1))]
        assert (r.lo + r.hi) / 2 == statistics.median(v)


def test_four_medians_differ_where_they_should(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 4, 10)], "k string, v double")
    assert stats.interpolated_median(df, ["k"], "v").first().median == 3.0
    assert stats.upper_median(df, ["k"], "v").first().median == 4.0
    assert stats.lower_half_median(df, ["k"], "v").first().baseline == 1.5


def test_mode_takes_the_lower_value_on_ties(spark):
    df = spark.createDataFrame([("a", 3), ("a", 3), ("a", 2), ("a", 2), ("a", 9), ("a", None)], "k string, v int")
    assert stats.mode_low(df, ["k"], "v").first().mode == 2


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_streaks_and_previous_rows_cross_block_borders(spark, block):
    rnd = random.Random(block)
    rows = [(k, i, rnd.random() < 0.7) for k in ("a", "b") for i in range(60) if rnd.random() < 0.9]
    df = spark.createDataFrame(rows, "k string, i long, miss boolean")
    got = {(r.k, r.i): r.streak for r in blocks.streaks(df, "k", "i", F.col("miss"), block=block).collect()}
    prev = {(r.k, r.i): r.prev_miss for r in blocks.previous_row(df, "k", "i", ["miss"], block=block).collect()}
    run, last = {}, {}
    for k, i, miss in rows:
        run[k] = run.get(k, 0) + 1 if miss else 0
        assert got[(k, i)] == run[k]
        assert prev[(k, i)] == last.get(k)
        last[k] = miss


def test_absence_is_believed_after_three_rechecks(spark):
    seen = [True, False, False, False, True, False, False, False, False, False, True]
    df = spark.createDataFrame([(1, i, None, p) for i, p in enumerate(seen)], "video_id long, pass_id long, observed_at timestamp, present boolean")
    events = [(r.pass_id, r.event) for r in catalogue.availability_events(df).orderBy("pass_id").collect()]
    assert events == [(8, "newly_unavailable"), (10, "restored")]


def test_absent_video_keeps_its_figures_and_first_stamp(spark):
    cat = spark.sql("""SELECT 1L video_id, 10L views, 2L likes, 0L comments, 60L duration_sec, false unavailable, CAST(null AS timestamp) unavailable_since
        UNION ALL SELECT 2L, 20L, null, 1L, 60L, true, timestamp'2024-01-01 00:00:00'""")
    out = {r.video_id: r for r in catalogue.apply_observations(cat, cat.where("video_id = 9"), as_of="2024-02-02 00:00:00").collect()}
    assert (out[1].views, out[1].likes, out[1].unavailable, str(out[1].unavailable_since)[:10]) == (10, 2, True, "2024-02-02")
    assert (out[2].likes, str(out[2].unavailable_since)[:10]) == (None, "2024-01-01")
    back = catalogue.apply_observations(cat, cat.withColumn("views", F.lit(99).cast("long")), as_of="2024-02-02 00:00:00").where("video_id = 2").first()
    assert (back.views, back.unavailable, back.unavailable_since) == (99, False, None)


def test_interpolation_needs_both_sides(spark):
    pts = spark.createDataFrame([(1, 20.0, 100, 10), (1, 30.0, 200, 20), (2, 30.0, 5, 1), (3, 24.0, 7, 3)], "video_id long, age_h double, views long, likes long")
    got = {r.video_id: (r.views, r.likes) for r in asof.values_at_ages(pts, [24.0]).collect()}
    assert got == {1: (140.0, 14.0), 3: (7.0, 3.0)}


def test_forward_asof_takes_the_first_within_tolerance(spark):
    left = spark.sql("SELECT timestamp'2024-01-01 00:00:00' a UNION ALL SELECT timestamp'2024-01-03 00:00:00'")
    right = spark.sql("SELECT timestamp'2024-01-01 13:59:00' t, 1 v UNION ALL SELECT timestamp'2024-01-01 10:00:00', 2 UNION ALL SELECT timestamp'2024-01-03 14:01:00', 3")
    got = asof.forward_asof(left, right, left_time="a", right_time="t", tolerance_hours=14, keep=["v"]).collect()
    assert [(str(r.a)[:10], r.v) for r in got] == [("2024-01-01", 2)]


@pytest.mark.parametrize("status,reason,detail,want", [
    ("OK", "", "", "public"), ("LOGIN_REQUIRED", "Sign in to confirm", "", None), ("LOGIN_REQUIRED", "Private video", "", "private"),
    ("ERROR", "x", "copyright removal request by A B. ", "copyright"), ("ERROR", "", "", "unavailable"), ("", "", "", None)])
def test_removal_reasons(spark, status, reason, detail, want):
    df = spark.createDataFrame([(status, reason, detail)], "s string, r string, d string")
    row = df.select(catalogue.removal_reason(F.col("s"), F.col("r"), F.col("d")).alias("x"), catalogue.copyright_claimant(F.col("d")).alias("c")).first()
    assert row.x == want
    if want == "copyright":
        assert row.c == "A B"


def test_order_values_take_any_number_and_null_keys(spark):
    rnd = random.Random(11)
    values = [0.0, -0.0, 1.0, -1.0, math.inf, -math.inf, 5e-324, -5e-324, 1.7e308, 2.0 ** 40 - 1, 2.0 ** 40,
              *[rnd.choice((-1, 1)) * 2.0 ** rnd.uniform(-60, 60) for _ in range(300)],
              *[2.0 ** k for k in range(-30, 30)], *[math.nextafter(2.0 ** k, 0) for k in range(-30, 30)]]
    df = spark.createDataFrame([(k, v) for k in ("a", None) for v in values], "k string, v double")
    n = len(values)
    got = stats.order_values(df, ["k"], "v", {f"r{i}": (lambda i: lambda n: F.lit(i))(i) for i in range(1, n + 1, 7)})
    rows = got.collect()
    assert {r.k for r in rows} == {"a", None}
    for r in rows:
        assert [r[f"r{i}"] for i in range(1, n + 1, 7)] == sorted(values)[::7]
    whole = spark.range(1, 100001).selectExpr("'k' AS k", "1700000000000000 + id AS v")
    assert stats.upper_median(whole, ["k"], "v").first().median == 1700000000050001


def test_order_values_move_counts_not_rows(spark):
    """One evaluation of the input, nothing cached, and no shuffle on the group alone before values are counted."""
    df = spark.range(200000).selectExpr("'hot' AS k", "CAST(id % 500 AS DOUBLE) AS v")
    got = stats.interpolated_median(df, ["k"], "v")
    assert got.first().median == 249.5
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert "InMemoryTableScan" not in plan and "ReusedExchange" in final
    assert final.count("Range (") == 1


def test_global_rank_of_one_key_with_many_rows(spark):
    """A key of 100,000 rows spans parts; ranks are those of sorting, and a null key is ranked too."""
    df = spark.range(100000).selectExpr("CAST(NULL AS STRING) AS k", "(id * 7919) % 100000 AS o").union(
        spark.range(3).selectExpr("'x' AS k", "10 - id AS o"))
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = blocks.global_rank(df, ["k"], ["o"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    assert got.where("k IS NULL AND place <> o + 1").count() == 0
    assert got.where("k IS NULL").selectExpr("count(DISTINCT place)", "max(place)").first() == (100000, 100000)
    assert [(r.o, r.place) for r in got.where("k = 'x'").orderBy("o").collect()] == [(8, 1), (9, 2), (10, 3)]
