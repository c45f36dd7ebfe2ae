"""Parallel greedy clusters against taking one seed after the other."""

import collections
import datetime as dt
import random

import pytest

from tidegauge.plans import stories
from tidegauge.registry import text


def one_by_one(spikes, videos, overlap):
    out = {}
    for channel in {c for c, *_ in spikes}:
        left = sorted(((-ratio, term) for c, term, _, _, ratio in spikes if c == channel))
        number = 0
        while left:
            seed = left[0][1]
            number += 1
            a = videos[channel, seed]
            near = {t for _, t in left if len(a & videos[channel, t]) / len(a | videos[channel, t]) >= overlap}
            out.update({(channel, t): (number, seed) for t in near})
            left = [x for x in left if x[1] not in near]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_equal_one_seed_after_the_other(spark, seed):
    rng = random.Random(seed)
    spikes, videos = [], {}
    for channel in ("a", "b"):
        stories_ = [rng.sample(range(60), rng.randrange(3, 12)) for _ in range(14)]
        for k in range(90):
            own = {v for v in rng.choice(stories_) if rng.random() < 0.8} | set(rng.sample(range(60), rng.randrange(0, 3)))
            if own:
                term = f"t{k:02d}"
                videos[channel, term] = own
                spikes.append((channel, term, len(own), 1, float(rng.randrange(3, 9))))  # many equal ratios
    spikes.append(("c", "alone", 1, 0, 5.0))
    videos["c", "alone"] = {1}
    frame = spark.createDataFrame(spikes, "channel_id string, term string, recent long, base long, ratio double")
    rows = [(c, t, v, True) for (c, t), vs in videos.items() for v in vs] + [(c, t, 1000 + k, False) for k, (c, t) in enumerate(videos)]
    postings = spark.createDataFrame(rows, "channel_id string, term string, video_id long, is_recent boolean")
    got = stories.cluster_terms(frame, postings)
    want = one_by_one(spikes, videos, 0.35)
    assert {(r.channel_id, r.term): (r.cluster, r.seed) for r in got.collect()} == want
    rest = {r.channel_id: (r.clusters, r.terms) for r in stories.unpublished(got).collect()}
    for channel in ("a", "b"):
        beyond = [n for (c, _), (n, _) in want.items() if c == channel and n > 6]
        assert rest.get(channel, (0, 0)) == (len(set(beyond)), len(beyond))
    assert stories.published(got).where("cluster > 6").count() == 0 and "c" not in rest


def test_no_spikes_no_clusters(spark):
    frame = spark.createDataFrame([], "channel_id string, term string, recent long, base long, ratio double")
    postings = spark.createDataFrame([], "channel_id string, term string, video_id long, is_recent boolean")
    assert stories.cluster_terms(frame, postings).count() == 0


def test_display_names_come_from_the_given_postings(spark):
    postings = spark.createDataFrame([("c", 1, True, "storm"), ("d", 2, False, "storm"), ("c", 1, True, "storms"), ("c", 1, True, "sea")],
                                     "channel_id string, video_id long, is_recent boolean, term string")
    rows = text._labels(postings).collect()
    assert sorted((r.term_id, r.display_name) for r in rows) == [("sea", "Story: sea"), ("storm", "Story: storm")]


@pytest.mark.parametrize("few", [700_000, 0])
def test_frequent_postings_come_from_one_reading_of_recent_texts(spark, few):
    rng = random.Random(few)
    words = ["storm", "flood", "harbour", "quay", "tide", "lamp", "buoy"]
    rows = []
    for k in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))
        rows.append((k // 2 if k < 8 else k, rng.choice(["a", "b"]), text, dt.datetime(2024, 3, 1) - dt.timedelta(days=rng.randrange(0, 70)), False, False))
    rows += [(90, "a", None, dt.datetime(2024, 2, 28), False, False), (91, None, "storm tide", dt.datetime(2024, 2, 28), False, False)]
    rows += [(92, "a", "storm tide lamp", dt.datetime(2024, 2, 28), True, False), (93, "a", "storm", None, False, False)]
    videos = spark.createDataFrame(rows, "video_id long, channel_id string, description string, published_at timestamp, is_short boolean, unavailable boolean")
    at = {"as_of": "2024-03-01 00:00:00"}
    recent = stories.recent_postings(videos, **at)
    found = stories.frequent_postings(videos, recent, **at, few=few)
    want, often = [], collections.Counter()
    for video, channel, text, when, short, _ in rows:
        age = None if when is None else (dt.datetime(2024, 3, 1) - when).days
        if text and not short and age is not None and age <= 60 and channel is not None:
            w = text.split()
            for term in {*w, *(f"{x} {y}" for x, y in zip(w, w[1:]))}:
                want.append((channel, term, video, age <= 7))
                often[channel, term] += age <= 7
    want = sorted(p for p in want if often[p[:2]] >= 3)
    assert want and sorted(tuple(r) for r in found.select("channel_id", "term", "video_id", "is_recent").collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("ShuffledHashJoin" in plan) == (few == 0) and "SortMergeJoin" not in plan


def test_suppressed_clusters_work_out_their_videos_once(spark):
    matched = spark.createDataFrame([("a", 1, v, True) for v in (1, 2, 3)] + [("a", 2, 9, True), ("a", 1, 4, False)],
                                    "channel_id string, cluster long, video_id long, is_recent boolean")
    postings = spark.createDataFrame([("a", v, True, t) for v in (2, 3, 4) for t in ("tide", "lamp")] + [("a", 9, False, "tide")],
                                     "channel_id string, video_id long, is_recent boolean, term string")
    keywords = spark.createDataFrame([("a", "hand", "tide"), ("a", "hand", "lamp")], "channel_id string, tracker string, keyword string")
    out = stories.suppressed_clusters(matched, keywords, postings)
    assert [tuple(r) for r in out.collect()] == [("a", 1, "hand", 0.5)]
    assert "LocalRelation" not in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "ExistingRDD" not in plan and "LogicalRDD" not in plan
