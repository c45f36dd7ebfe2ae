"""Products on hand-made rows, with the edge cases that matter."""

import datetime as dt
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions.text import speech_tokens
from tidegauge.operators import series
from tidegauge.plans import campaigns, counting, daily, prices, speech, spikes, stories, topics
from tidegauge.session import cut_lineage
from tidegauge.sources import tables


def _readings(spark, rows):
    """rows: (video, day of January 2024, slot, views, published 'MM-DD')."""
    out = []
    for video, day, slot, views, pub in rows:
        ix = (day - 1) * 2 + (slot == "PM")
        out.append((video, dt.date(2024, 1, day), slot, ix, dt.datetime(2024, 1, day, 2 if slot == "AM" else 14), views,
                    dt.datetime.fromisoformat(f"{pub} 12:00:00"), "c", False))
    return spark.createDataFrame(out, "video_id long, snap_date date, slot string, snap_ix long, captured_at timestamp, views long, published_at timestamp, channel_id string, is_short boolean")


def test_daily_gains_edge_cases(spark):
    r = _readings(spark, [
        (1, 10, "AM", 100, "2023-12-01"), (1, 10, "PM", 150, "2023-12-01"), (1, 11, "AM", 130, "2023-12-01"), (1, 12, "PM", 120, "2023-12-01"),
        (2, 11, "AM", 40, "2024-01-10"),  # new upload: counts in full
        (3, 11, "AM", 900, "2023-11-01"),  # reappearing old video: does not count
        (4, 10, "AM", 5, "2023-12-01"), (4, 12, "PM", 9, "2023-12-01")])  # missing in between
    snaps = series.snapshots(r)
    got = {(r.video_id, r.label_date.day): r.gain for r in series.daily_gains(r, snaps).collect()}
    assert got == {(1, 10): 30, (2, 10): 40}


def test_day_list_adds_up_to_the_day(spark):
    rows = [(v, d, "AM", v * d, "2023-12-01") for v in range(1, 40) for d in (10, 11, 12)]
    r = _readings(spark, rows)
    videos = r.select("video_id", "channel_id").distinct().withColumn("unavailable", F.lit(False))
    c = daily.classified_gains(r, series.snapshots(r), videos)
    total = c.agg(F.sum("gain")).first()[0]
    top = daily.daily_top(c, top=5).agg(F.sum("gain")).first()[0]
    rest = daily.daily_rest(c, top=5).agg(F.sum("rest_gain"), F.sum("rest_count")).first()
    assert top + rest[0] == total and rest[1] == (39 - 5) * 2


@pytest.mark.parametrize("quiet,runs", [(2, 1), (3, 2)])
def test_burst_bridges_two_quiet_intervals_only(spark, quiet, runs):
    gains = [0] * 10 + [900] + [0] * quiet + [900] + [0] * 6
    views, rows = 0, []
    for i, g in enumerate([0] + gains):
        views += g
        rows.append((1, 1 + i // 2, "AM" if i % 2 == 0 else "PM", views, "2023-11-01"))
    b = spikes.ad_bursts(_readings(spark, rows), spark.createDataFrame([(1,)], "video_id long")).collect()
    assert len(b) == runs and sum(x.views for x in b) == 1800 and not any(x.entangled for x in b)


def test_ad_impact_measures_the_latest_block(spark):
    views, rows = 0, []
    for i in range(20):
        views += 2000 if i in (14, 15) else 10
        rows.append((1, 1 + i // 2, "AM" if i % 2 == 0 else "PM", views, "2023-11-01"))
    got = spikes.ad_impact(_readings(spark, rows)).first()
    assert got.from_day == "2024-01-08" and got.baseline_per_day == 20.0
    assert got.ad_driven == 2 * 1990


def test_campaign_yield_and_published_rate(spark):
    rows = [(1, d, s, 100 * d + (5000 if d >= 25 else 0), "2023-11-01") for d in range(1, 31) for s in ("AM", "PM")]
    w = spark.sql("SELECT 1L video_id, date'2024-01-24' win_from, date'2024-01-25' win_to")
    v = spark.sql("SELECT 1L video_id, timestamp'2023-11-01 12:00:00' published_at")
    m = campaigns.campaign_yield(_readings(spark, rows), v, w, era_from="2024-01-01", era_to="2024-01-30").first()
    assert (m.days, str(m.observed_to), m.observed_days, m.baseline_per_day, m.gain, m.ad_views, m.per_day) == (2, "2024-01-27", 4, 100, 5400, 5000, 2500)
    # Published figures: 277,120 ad views over 50 campaign days give 5,542 a day.
    rate = campaigns.yield_rate(spark.createDataFrame([(10, 55420, 5542), (20, 110850, 5543), (20, 110850, 5542)], "days long, ad_views long, per_day long"))
    assert rate.first().central == 5542


def test_bootstrap_matches_plain_resampling(spark):
    rng = np.random.default_rng(5)
    pre, post = np.round(rng.normal(9, 1.5, 61), 2), np.round(rng.normal(4.3, 0.8, 48), 2)
    rows = [("c", s, float(x)) for s, a in (("pre", pre), ("post", post)) for x in a]
    hist = spark.createDataFrame(rows, "channel_id string, side string, pct double").groupBy("channel_id", "side", "pct").agg(F.count(F.lit(1)).alias("n"))
    one, two = ([r.factor for r in counting.bootstrap_factors(hist).orderBy("replicate").collect()] for _ in range(2))
    assert one == two and len(one) == 4000
    plain = np.median(rng.choice(pre, (20000, 61)), axis=1) / np.median(rng.choice(post, (20000, 48)), axis=1)
    for q in (2.5, 25, 50, 75, 97.5):
        assert np.percentile(one, q) == pytest.approx(np.percentile(plain, q), abs=0.04)


def test_bootstrap_draws_are_counted_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(counting, "DRAWS", 16)  # sides of more than one block
    sizes = {("c", "pre"): 61, ("c", "post"): 48, (None, "pre"): 1}
    rows = [(c, s, n, r) for (c, s), n in sizes.items() for r in range(12)]
    sides = spark.createDataFrame(rows, "channel_id string, side string, size long, replicate int")

    def places(c, s, n, r):
        keys = ("|".join(x for x in ("7", c, s, str(r), str(d)) if x is not None) for d in range(1, n + 1))
        drawn = sorted(int(int(hashlib.md5(k.encode()).hexdigest()[:10], 16) * n / 2**40) for k in keys)
        return drawn[(n - 1) // 2], drawn[n // 2]

    for spread in (3.0, None):
        found = counting._middle_places(sides, seed=7, tasks=5, spread=spread)
        assert found.rdd.getNumPartitions() == 5
        assert {(r.channel_id, r.side, r.size, r.replicate): (r.low, r.high) for r in found.collect()} == {x: places(*x) for x in rows}
    narrow = counting._middle_places(sides, seed=7, tasks=5, spread=0.0).where("low >= 0 AND high >= 0").collect()
    assert all((r.low, r.high) == places(r.channel_id, r.side, r.size, r.replicate) for r in narrow)


def test_backfill_works_names_out_once_over_several_tasks(spark):
    raw = spark.createDataFrame([(1, "The Red Tea"), (2, "red tea saga"), (3, "Blue"), (4, "!!"), (5, "blue"), (6, "Green")], "video_id long, name string")
    tags = spark.createDataFrame([(6, "green")], "video_id long, topic_id string")
    t = spark.createDataFrame([("red-tea", "Red tea", "subject", None, None)], "topic_id string, name string, kind string, related array<string>, claims array<string>")
    none = spark.createDataFrame([], "variant string, canonical string")
    grouped = topics.survivors(t, tags, tags.limit(0))
    filed = topics.backfill(raw, tags, t, none, grouped)
    plan = topics.backfill(raw, tags, t, none, cut_lineage(grouped))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
    assert {(r.video_id, r.topic_id, r.how) for r in filed.collect()} == {
        (1, "red-tea", "folded"), (2, "red-tea", "folded"), (3, "blue", "created"), (5, "blue", "created")}
    assert tables.spread(spark.range(105), rows=10).rdd.getNumPartitions() == 11
    assert tables.spread(spark.range(105), rows=10).count() == 105


def test_pooled_factor_is_view_weighted(spark):
    f = spark.createDataFrame([(3, 2.0, 10), (1, 3.0, 5)], "post_views long, factor double, n_post long")
    assert counting.pooled_factor(f).first().factor == 2.25


def test_published_spike_ratio(spark):
    row = spark.range(1).select(stories.spike_ratio(F.lit(3), F.lit(6), F.lit(0), F.lit(10)).alias("r")).first()
    assert row.r == pytest.approx(11.0)


def test_filler_overlaps_count_once(spark):
    text = "uh uh like like very very you know if if " + " ".join(f"w{i}" for i in range(60))
    t = spark.createDataFrame([(1, "c", "t", dt.datetime(2024, 1, 1), [(text + " [music um]", 0, 60000)])],
                              "video_id long, channel_id string, title string, published_at timestamp, segments array<struct<text:string,offset:long,duration:long>>")
    r = speech.filler_tally(t).first()
    assert (r.words, r.hard, r.rep_all, r.rep, r.hedge, r.filler_words) == (70, 2, 4, 3, 3, 2 + 2 + 2 + 1)


def test_a_text_is_cut_into_tokens_once(spark):
    schema = "video_id long, channel_id string, title string, published_at timestamp, segments array<struct<text: string, offset: long, duration: long>>"
    when = dt.datetime(2021, 1, 5)
    rows = [(1, "c", "t", when, [("Um [music] UM, it's ", 0, 1000), (None, 1000, 1000), ("word " * 60, 400_000, 5000)]),
            (2, "c", "t", when, [("um " * 60, 0, 5000)]),  # too short
            (3, "c", "t", when, [("um " * 10, 0, 500_000)]),  # too few words
            (4, "c", "t", when, []), (5, "c", "t", when, None), (6, "c", "t", when, [(None, 400_000, None)])]
    out = speech.token_totals(speech.qualifying(speech.filler_tally(spark.createDataFrame(rows, schema))))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("array_join(") == 1
    assert [tuple(r) for r in out.collect()] == [("um", 2)]


def test_speech_tokens_are_what_splitting_leaves(spark):
    texts = ["", " ", "A-b  c'd [x] e[", "[[a]b] é1\u212a\tz\U0001f600q\r\n'", "[a\nb] 'it's' \u0130x", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(speech_tokens(F.col("t"))).collect()

    def plain(t):
        return [w for w in re.sub(r"[^a-z0-9' ]+", " ", re.sub(r"\[[^\]]*\]", " ", t.lower())).split(" ") if w]

    assert [r[0] for r in got] == [None if t is None else plain(t) for t in texts]


def test_prices_are_cleaned_on_one_side_only(spark):
    rows = [(f"s{s}", dt.date(2024, 1, d), d, 5, p, "ok") for s in range(6) for d in range(1, 31)
            for p in [30.0 if d == 5 else 8.0 if d in (9, 5) and s == 0 else 85.0 if s == 1 and 20 <= d <= 22 else 20.0]]
    rows += [("low", dt.date(2024, 1, d), d, 5, 8.0 if d in (5, 9) else 20.0, "ok") for d in range(1, 31)]
    r = spark.createDataFrame(rows, "sku string, day date, day_ix long, stock long, price double, status string")
    modal = prices.modal_price(r)
    bad = prices.bad_days(r, modal)
    assert [str(x.day) for x in bad.collect()] == ["2024-01-05"]
    nulled = {(x.sku, x.day_ix) for x in prices.clean_prices(r, modal, bad).where("nulled").collect()}
    assert nulled == {(f"s{s}", 5) for s in range(6)} | {("low", 5)}


def test_alias_chains_cycles_and_unknown_targets(spark):
    t = spark.sql("""SELECT id topic_id, name, 'subject' kind, ord, CAST(null AS array<string>) related, CAST(null AS array<string>) claims FROM VALUES
        ('a','Alpha',1),('b','Beta',2),('c','Gamma',3),('d','Delta',4),('e','Epsilon',5),('f','The Alpha saga',6) v(id,name,ord)""")
    tags = spark.createDataFrame([(1, "a"), (2, "a"), (3, "f"), (4, "d")], "video_id long, topic_id string")
    none = spark.createDataFrame([], "topic_id string")
    al = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("e", "d"), ("x", "nowhere")], "variant_id string, topic_id string")
    canon = {r.variant: r.canonical for r in topics.canon_map(t, tags, none, al).collect()}
    assert canon == {"a": "c", "b": "c", "f": "c"}
    again = topics.refile(topics.refile(tags, topics.canon_map(t, tags, none, al)).select("video_id", "topic_id"), topics.canon_map(t, tags, none, al))
    assert again.where("moved").count() == 0
    assert [r.topic_id for r in topics.invalid_aliases(al, t).collect()] == ["nowhere"]


def test_a_corrected_record_does_not_split_a_burst(spark):
    views, rows = 0, []
    for i, gain in enumerate([10] * 6 + [900, 900] + [10] * 6):
        views += gain
        rows.append((1, 5 + i // 2, "AM" if i % 2 == 0 else "PM", views, "2023-12-01"))
    r = _readings(spark, rows)
    late = F.col("snap_ix") >= 15
    r = r.withColumns({"published_at": F.when(late, F.col("published_at") + F.expr("interval 1 second")).otherwise(F.col("published_at")),
                       "channel_id": F.when(late, "d").otherwise("c"), "is_short": ~late})
    got = spikes.ad_bursts(r, spark.createDataFrame([(1,)], "video_id long")).collect()
    assert [(b.channel_id, b.views) for b in got] == [("d", 1780)]


@pytest.mark.parametrize("length", [1, 3, 17, 200])
def test_alias_chains_of_any_length(spark, length):
    names = spark.createDataFrame([(f"t{i:03d}", f"name {i:03d} x", "subject") for i in range(length + 6)], "topic_id string, name string, kind string").selectExpr(
        "*", "CAST(NULL AS ARRAY<STRING>) AS related", "CAST(NULL AS ARRAY<STRING>) AS claims")
    cycle = [f"t{length + k:03d}" for k in range(1, 6)]
    links = [(f"t{i:03d}", f"t{i + 1:03d}") for i in range(length)]
    links += [(cycle[0], cycle[1]), (cycle[1], cycle[0]), (cycle[2], cycle[3]), (cycle[3], cycle[4]), (cycle[4], cycle[2]), ("in", cycle[0])]
    none = spark.createDataFrame([], "video_id long, topic_id string")
    got = topics.canon_map(names, none, none.select("topic_id"), spark.createDataFrame(links, "variant_id string, topic_id string")).collect()
    assert {(r.variant, r.canonical) for r in got} == {(f"t{i:03d}", f"t{length:03d}") for i in range(length)}


def test_creatives_claim_legacy_rows_by_rank(spark):
    """Unknown first days match each other, a repeated creative claims once, and a crowded day is paired in full."""
    cols = "creative_id string, video_id long, first_day date, last_day date"
    day = dt.date(2024, 1, 5)
    history = spark.createDataFrame(
        [("legacy:1:a", 1, None, None), ("legacy:1:b", 1, day, day), ("legacy:1:c", 1, day, day), ("old", 2, day, day)],
        cols).withColumn("seen_day", F.lit("2024-01-06").cast("date"))
    capture = spark.createDataFrame(
        [("n1", 1, None, day), ("n2", 1, day, day), ("n2", 1, day, dt.date(2024, 1, 9)), ("n3", 3, None, None), ("x", None, day, day)], cols)
    got = campaigns.merge_creatives(history, capture, seen="2024-01-31")
    rows = {r.creative_id: (r.video_id, r.first_day, r.last_day) for r in got.collect()}
    assert rows == {"n1": (1, None, day), "n2": (1, day, dt.date(2024, 1, 9)), "legacy:1:c": (1, day, day),
                    "old": (2, day, day), "n3": (3, None, None)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number()" in line and "Window" in line]
    assert windows and all("_part" in line for line in windows)

    many = spark.range(20000)
    history = many.selectExpr("concat('legacy:9:', lpad(id, 6, '0')) AS creative_id", "9L AS video_id", "DATE'2024-01-05' AS first_day",
                              "DATE'2024-01-05' AS last_day", "DATE'2024-01-06' AS seen_day")
    capture = many.where("id < 15000").selectExpr("concat('n', lpad(id, 6, '0')) AS creative_id", "9L AS video_id",
                                                  "DATE'2024-01-05' AS first_day", "DATE'2024-01-05' AS last_day")
    got = campaigns.merge_creatives(history, capture, seen="2024-01-31")
    assert got.selectExpr("count(*)", "count_if(creative_id LIKE 'n%')", "min(CASE WHEN creative_id LIKE 'legacy%' THEN creative_id END)").first() \
        == (20000, 15000, "legacy:9:015000")


def test_matched_age_known_only_from_hourly_samples(spark):
    """The snapshots alone do not bracket 24 hours; with samples they do, and at one instant each bracket keeps its source."""
    pub = dt.datetime(2024, 1, 1)
    pool = spark.createDataFrame([(1, "c", pub), (2, "c", pub), (3, "c", pub)], "video_id long, channel_id string, published_at timestamp")
    shots = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 2, 6), 3000, 30), (2, dt.datetime(2024, 1, 2), 5000, 50), (2, dt.datetime(2024, 1, 3), 9000, 90),
         (3, dt.datetime(2024, 1, 2, 6), 3000, None)], "video_id long, captured_at timestamp, views long, likes long")
    hourly = spark.createDataFrame([(1, 18.0, 1000, 10), (1, None, 1, 1), (1, 2.0, 600, 0), (2, 24.0, 4000, 40), (3, 18.0, 400, 4), (9, 24.0, 999, 9)],
                                   "video_id long, age_h double, views long, likes long")
    assert {r.video_id for r in counting.aged_points(shots, pool, ages=[24.0]).collect()} == {2}
    got = {r.video_id: (r.vw, r.lk) for r in counting.aged_points(shots, pool, debut=hourly, ages=[24.0]).collect()}
    assert got == {1: (2000.0, 20.0), 2: (5000.0, 50.0)}  # 3 has too few views at 18 hours


def test_price_runs_cover_the_axis_and_expand_to_the_grid(spark):
    rng = np.random.default_rng(5)
    rows = [(s, int(d), *[(None, 1, 2)[rng.integers(3)], (None, 9.5)[rng.integers(2)]]) for s in "abc" for d in range(40) if rng.random() < 0.7]
    rows += [("late", 39, 4, 1.0), ("early", 0, None, None)]
    readings = spark.createDataFrame(rows, "sku string, day_ix long, stock long, price double")
    runs = prices.price_runs(readings)
    found = runs.collect()
    want = {(s, d): (k, p) for s, d, k, p in rows}
    cells = {}
    for r in found:
        for d in range(r.first_ix, r.last_ix + 1):
            assert (r.sku, d) not in cells
            cells[r.sku, d] = (r.stock, r.price)
            assert r.was_read == ((r.sku, d) in want)
    assert cells == {(s, d): want.get((s, d), (None, None)) for s in ("a", "b", "c", "late", "early") for d in range(40)}
    assert len(found) <= 2 * len(rows) + 5
    days = spark.range(40).selectExpr("id AS day_ix", "date_add(DATE'2024-01-01', CAST(id AS INT)) AS day")
    assert prices.dense_grid(runs, days, sku="a").count() == 40
    assert prices.dense_grid(runs, days).count() == 200


def test_hand_kept_catalogue_wins_over_the_label_read(spark):
    readings = spark.createDataFrame([(s, dt.date(2024, 1, 1), 3, "Ground - Kona X") for s in "abcd"], "sku string, day date, stock long, label string")
    modal = spark.createDataFrame([(s, 50.0) for s in "abcd"], "sku string, modal double")
    listed = spark.createDataFrame([("a", " Whole Bean - Plain ", None), ("b", " ", "16oz "), ("c", "Ground - ", ""), ("z", "Tea - Z", "1lb")],
                                   "sku string, label string, size string")
    got = {r.sku: (r.name, r.family, r["size"]) for r in prices.sku_catalogue(readings, modal, listed).collect()}
    assert got["a"] == ("Plain", "Whole Bean", "5lb")
    assert got["b"] == ("Kona X", "Ground", "16oz") and got["d"] == ("Kona X", "Ground", "7oz") and len(got) == 4
