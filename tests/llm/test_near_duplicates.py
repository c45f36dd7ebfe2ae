"""Near duplicates and components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidegauge.llm import ngram_join
from tidegauge.llm.batches import ready
from tidegauge.llm.components import connected

SCHEMA = "doc_id long, text string, n string, g int, component long"


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def grouped(pairs, nodes):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def expected(rows):
    sets = {d: shingles(t) for d, t in rows}
    ids = list(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {d: (len(sets[d]), c) for d, c in grouped(pairs, ids).items()}


@pytest.fixture(scope="module")
def rows():
    random.seed(7)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [random.choice(vocabulary) for _ in range(n)]
    common = text(40)
    out = []
    for size in (1, 3, 4, 5, 6, 12, 30, 80, 200):
        base = text(size)
        for edits in (0, 0, 1, 1, 2, size // 30, size // 20, size // 12):
            words = list(base)
            for _ in range(edits):
                words[random.randrange(size)] = random.choice(vocabulary)
            out.append(" ".join(words))
    out += [" ".join(text(10) + common + text(10)) for _ in range(90)]  # a passage many share
    base = text(150)
    for i in range(120):  # a large group of near copies, no two alike
        words = list(base)
        words[random.randrange(150)] = f"x{i}"
        words[random.randrange(150)] = f"y{i}"
        out.append(" ".join(words))
    out += [None, "", "  \n\t ", "ONE two", "one TWO", " one  two ", "É a b c d e f", "é a b c d e f", "long " * 30000]
    return list(enumerate(out))


@pytest.mark.parametrize("family", [5, 256])
def test_groups_equal_brute_force(spark, rows, monkeypatch, family):
    monkeypatch.setattr(ngram_join, "HOT", 12)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "FAMILY", family)
    monkeypatch.setattr(ngram_join, "WEIGHT", 64 * family)
    docs = ready(spark).createDataFrame([(d, t, "x", 1, 2) for d, t in rows] + [(5, rows[5][1], "again", 1, 2), (None, "one two", "", 1, 2)], SCHEMA)
    got = [tuple(r) for r in ngram_join.near_duplicates(docs).collect()]
    assert len(got) == len(rows) + 2
    assert (None, 1, None) in got
    want = expected(rows)
    assert {d: (n, c) for d, n, c in got if d is not None} == want
    assert max(map(list(c for _, c in want.values()).count, set(c for _, c in want.values()))) >= 100


def test_no_documents(spark):
    assert ngram_join.near_duplicates(ready(spark).createDataFrame([], SCHEMA)).collect() == []


def test_tree_walk_equals_counting():
    random.seed(3)
    for percent in (50, 80, 100):
        for _ in range(30):
            base = random.sample(range(1000), random.randrange(1, 40))
            sets = [sorted(set(base[:random.randrange(1, len(base) + 1)]) | set(random.sample(range(1000), random.randrange(6)))) for _ in range(25)]
            block = pa.table({"id": pa.array(range(25)), "n": pa.array([len(s) for s in sets]), "grams": pa.array(sets, pa.list_(pa.int64())),
                              "probe": pa.array([i < 3 for i in range(25)])})
            want = {(p, m) for p in range(3) for m in range(3, 25) if 100 * len({*sets[p]} & {*sets[m]}) >= percent * len({*sets[p]} | {*sets[m]})}
            assert set(ngram_join.tree_links(block, percent)) == want


def test_family_pairs_equal_counting():
    random.seed(5)
    for percent in (50, 80, 100):
        for _ in range(20):
            base = random.sample(range(1000), random.randrange(1, 40))
            sets = [sorted({*base[:random.randrange(1, len(base) + 1)], *random.sample(range(1000), random.randrange(4))}) for _ in range(30)]
            at = [random.randrange(6) for _ in sets]
            odd = np.array(ngram_join.parities([np.array(s) for s in sets]).to_pylist())
            rows = [(i, len(s), at[i], 0, odd[i].tolist(), s, list(range(len(s))), probe)
                    for probe in (True, False) for i, s in enumerate(sets) if not probe or at[i]]
            random.shuffle(rows)
            block = pa.table({c: pa.array(v, t) for c, v, t in zip(
                ("doc", "n", "at", "main", "odd", "grams", "places", "probe"), zip(*rows, strict=True),
                (pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.bool_()), strict=True)})
            got = ngram_join.family_pairs(block, percent).to_pylist()
            assert len({(r["a"], r["b"]) for r in got}) == len(got)
            for r in got:
                a, b = sets[r["a"]], sets[r["b"]]
                shared = {*a} & {*b}
                assert at[r["a"]] != at[r["b"]] and r["met"] == len(shared) and r["both"] == len(a) + len(b)
                assert r["rest"] == min(min(len(x) - x.index(g) for x in (a, b)) for g in shared) - 1
            linked = {(a, b) for b in range(30) for a in range(b) if at[a] != at[b]
                      and 100 * len({*sets[a]} & {*sets[b]}) >= percent * len({*sets[a]} | {*sets[b]})}
            assert linked <= {(r["a"], r["b"]) for r in got}


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(None, 2), (3, None)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(100, i) for i in range(101, 150)] + [(149, 30)],
    [(5, 4), (4, 5), (5, 4), (9, 7)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in connected(ready(spark).createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == grouped(real, sorted({x for e in real for x in e}))


def test_sets_of_texts():
    got = [len(s) for s in ngram_join.sets_of(pa.array(["a b c d e f", None, "", "a A", "x " * 100]), 5)]
    assert got == [2, 0, 0, 1, 1]
    one, two = ngram_join.sets_of(pa.array(["A B c D e f", "a\tb\nC d  E F"]), 5)
    assert np.array_equal(one, two)
