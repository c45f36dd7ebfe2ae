"""Keyword counting against regular expressions, and tagging from a taxonomy table."""

import random
import re

import numpy as np
import pytest

from tidegauge.operators import keywords
from tidegauge.plans import topics

WORDS = ["c++", "#tag", "fast food", "food", "a", "a a", "a b a", "é", "++", "the", "thethethethe", "thethethethex", "fast-food", "b_1", " a", "a ",
         "", "x", "ab  c", "été", "A"]


def expected(text, word):
    return len(re.findall(r"\b" + re.escape(word.lower()) + r"\b", (text or "").lower(), re.ASCII)) if word else 0


@pytest.fixture(scope="module")
def texts():
    random.seed(4)
    letters = ["a", "b", "a", "food", "fast", "c++", "#tag", " ", "  ", "-", "é", "++", "The", "thethethethe", "thethethethex", "b_1", "x", "ab", "c", "\n", "_", "été"]
    return ["".join(random.choice(letters) + random.choice(["", " ", " "]) for _ in range(random.randrange(60))) for _ in range(400)] + [
        "", None, "a", "a a a a a", "a b a b a b a", "#tag #tag", "c++", "c++x c++", "fast food " * 4000]


@pytest.mark.parametrize("limit,size", [(200_000, 1 << 21), (4, 200)])
def test_counts_equal_regular_expressions(spark, texts, monkeypatch, limit, size):
    monkeypatch.setattr(keywords, "KEYWORDS", limit)
    monkeypatch.setattr(keywords, "SLICE", size)
    taxonomy = [(f"t{i % 6}", w) for i, w in enumerate(WORDS)] + [("t1", "food"), ("t1", None), (None, "a"), ("empty", None)]
    frame = spark.createDataFrame([(i, t, texts[-i]) for i, t in enumerate(texts)], "video_id long, one string, two string")
    rows = keywords.keyword_counts(frame, ["one", "two"], spark.createDataFrame(taxonomy, "topic_id string, keyword string")).collect()
    got = {}
    for r in rows:
        a, b = got.get((r.video_id, r.topic_id), (0, 0))
        got[r.video_id, r.topic_id] = a + r.one, b + r.two
    want = {}
    for i, t in enumerate(texts):
        for topic in {x for x, _ in taxonomy if x}:
            n = [sum(expected(x, w) for k, w in taxonomy if k == topic and w) for x in (t, texts[-i])]
            if any(n):
                want[i, topic] = tuple(n)
    assert got == want
    assert keywords.keyword_counts(frame, ["one"], spark.createDataFrame([], "topic_id string, keyword string")).count() == 0
    assert keywords.keyword_counts(frame.limit(0), ["one"], spark.createDataFrame(taxonomy, "topic_id string, keyword string")).count() == 0


def test_a_frequent_keyword_costs_its_hits():
    data = ("the " * 200_000).encode()
    index = keywords.KeywordIndex(["the", *(f"the w{i}" for i in range(50))], [0] * 51)
    text, topic, n = index.counts(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert (text.tolist(), topic.tolist(), n.tolist()) == ([0], [0], [200_000])


def test_hits_of_keywords_with_many_topics_are_summed_in_parts(monkeypatch):
    monkeypatch.setattr(keywords, "HITS", 5_000)
    topics_of = {"the": range(0, 2_000), "of": range(1_000, 3_000), "of the": [7, 7, 2_999]}
    index = keywords.KeywordIndex([k for k, ts in topics_of.items() for _ in ts], [t for ts in topics_of.values() for t in ts])
    made = []
    monkeypatch.setattr(index, "_by_topic", lambda *a, f=index._by_topic: made.append(f(*a)) or made[-1])
    parts = ["the of the", "", "of", "x"] * 20
    bounds = np.cumsum([0, *map(len, parts)])
    data = np.frombuffer("".join(parts).encode(), np.uint8)
    text, topic, n = index.counts(data, bounds)
    want = {}
    for i, t in enumerate(parts):
        for k, ts in topics_of.items():
            for x in ts:
                if c := expected(t, k):
                    want[i, x] = want.get((i, x), 0) + c
    assert dict(zip(zip(text.tolist(), topic.tolist(), strict=True), n.tolist(), strict=True)) == want
    assert max(len(k) for k, _ in made) <= 2 * 5_000


def test_a_topic_goes_with_one_pass(spark, monkeypatch):
    monkeypatch.setattr(keywords, "KEYWORDS", 40)
    taxonomy = spark.createDataFrame([(f"t{i}", k) for i in range(30) for k in ("a", "b", "c", "d")], "topic_id string, keyword string")
    rows = keywords.keyword_counts(spark.createDataFrame([(1, "a b b c d")], "video_id long, one string"), ["one"], taxonomy).collect()
    assert sorted((r.topic_id, r.one) for r in rows) == sorted((f"t{i}", 5) for i in range(30))


def test_tags_from_a_taxonomy_table(spark):
    videos = spark.createDataFrame([(1, "Red tea", "tea tea"), (2, "live", "tea"), (3, None, None), (4, "x", "y"), (5, "red", "")],
                                   "video_id long, title string, description string")
    spoken = spark.createDataFrame([(2, "live live live"), (3, "coffee coffee coffee"), (9, "red red red")], "video_id long, transcript string")
    taxonomy = spark.createDataFrame([("tea", "tea"), ("red", "red"), ("livestream", "live"), ("coffee", "coffee"), ("_draft", "tea"), ("bare", None)],
                                     "topic_id string, keyword string")
    scores = topics.topic_scores(videos, spoken, taxonomy)
    got = {(r.video_id, r.topic_id): (r.title_score, r.total_score) for r in scores.collect()}
    assert got == {(1, "tea"): (3.0, 6.0), (1, "red"): (3.0, 3.0), (2, "livestream"): (3.0, 6.0), (2, "tea"): (0.0, 1.5), (3, "coffee"): (0.0, 3.0),
                   (5, "red"): (3.0, 3.0), (9, "red"): (0.0, 3.0)}
    overrides = spark.createDataFrame([(1, None), (4, "coffee"), (5, "bare"), (3, "no-such")], "video_id long, topic_id string")
    tags = topics.tag_videos(videos, topics.pick_topic(scores), overrides, taxonomy).collect()
    assert {(r.video_id, r.topic_id, r.overridden) for r in tags} == {(1, None, True), (2, "livestream", False), (3, "coffee", False), (4, "coffee", True), (5, "red", False)}
