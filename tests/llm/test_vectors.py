"""Hard negatives, near vectors and part codes against brute force."""

import math

import numpy as np
import pytest

from tidegauge.llm import hard_negatives, near_vectors, part_codes, topk
from tidegauge.llm.batches import ready

ROWS = "label int, vec_id long, embedding array<double>, id long, v string, block int"


def clouds(n=260, dims=24, seed=3):
    """Rows in a few tight groups and loose ones, of several labels, with repeated rows and odd ones."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dims))
    out = []
    for i in range(n):
        spread = (0.02, 0.1, 0.3, 1.5)[i % 4]
        v = centres[0 if i % 3 == 0 else i % 9] + spread * rng.normal(size=dims)
        out.append((int(rng.integers(0, 4)), i, [float(x) for x in v / np.linalg.norm(v)], i, "x", 0))
    nan, inf = float("nan"), float("inf")
    out += [out[5], out[20], out[20], (out[40][0] + 1, *out[40][1:]), (1, 40, out[41][2], 0, None, 0)]  # repeated rows and ids
    out += [(1, 1000, [0.0] * dims, 1, None, None), (1, 1001, None, 1, "y", 2), (None, 1002, out[0][2], 1, "y", 2), (2, None, out[0][2], 1, "y", 2),
            (2, 1003, [None] * dims, 1, "y", 2), (2, 1004, [nan] * dims, 1, "y", 2), (2, 1005, [inf] * dims, 1, "y", 2), (2, 1006, [], 1, "y", 2),
            (3, 1007, [1.0, 0.5], 1, "y", 2), (0, 1020, [-x for x in out[0][2]], 1, "y", 2), (0, 1040, [1e200] * dims, 1, "y", 2), (0, 1041, [-3e250] * dims, 1, "y", 2)]
    return out


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def mined(rows, step, positives, negatives):
    limit = (1 << 63) - 1
    kept = [(i, label, [math.floor(x * 256) for x in v]) for label, i, v, *_ in rows if i is not None and label is not None and sound(v)]
    dot = lambda a, b: max(-limit, min(limit, sum(x * y for x, y in zip(a, b, strict=False))))
    out = []
    for i, label, v in {(i, label, tuple(v)) for i, label, v in kept if i % step == 0}:
        others = sorted(((-dot(v, w), j, other) for j, other, w in kept if j != i), key=lambda x: x[:2])
        for p, j, _ in [x for x in others if x[2] == label][:positives]:
            near = [x for x in others if x[2] != label and -30 * p <= -100 * x[0] <= -90 * p][:negatives]
            out += [(i, j, r, k, -p, -s) for r, (s, k, _) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [24, 8192])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(hard_negatives, "ROWS", size)
    monkeypatch.setattr(hard_negatives, "ANCHORS", max(size // 4, 4))
    rows = clouds()
    frame = ready(spark).createDataFrame(rows, ROWS)
    got = hard_negatives.mine(frame, lambda x: x % 20 == 0, 5, 10)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(tuple(r) for r in got.collect())
    assert got == mined(rows, 20, 5, 10) and len({r[0] for r in got}) > 12
    assert hard_negatives.mine(frame.limit(0), lambda x: x % 20 == 0).count() == 0
    assert hard_negatives.mine(frame, lambda x: x < 0).count() == 0
    assert hard_negatives.mine(frame.where("vec_id = 1000 or vec_id = 1006"), lambda x: x > 0).count() == 0


def test_score_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 16))
    m = np.floor(256 * np.concatenate([centres[rng.integers(0, 6, 400)] + 0.05 * rng.normal(size=(400, 16)), np.zeros((1, 16))]))
    length = hard_negatives.V.lengths(m)
    refs = hard_negatives.references(m[:64], 8)
    angle = hard_negatives.angles(m, length, refs)
    pruned = 0
    for i in (0, 17, 400):
        low, high, most = hard_negatives.bounds(angle[:, i], length[i], angle, length)
        score = m @ m[i]
        assert (low <= score).all() and (score <= high).all() and (np.abs(score) <= most + 1).all()
        pruned += (high < 0.5 * score.max()).sum()
    assert pruned > 300


def broadcast(frame):
    """Lines of the plan that stand below a broadcast."""
    out, depth = [], None
    for line in frame._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-*()0123456789"))
        depth = depth if depth is not None and at > depth else at if "BroadcastExchange" in line else None
        out += [line] * (depth is not None)
    return out


def test_blocks_of_queries_are_never_broadcast(spark):
    """Their copies, one for each block of candidates, count once in Spark's estimate."""
    got = topk.nearest(ready(spark).createDataFrame(clouds()[:200], ROWS), lambda x: x % 20 == 0)
    assert not any("cells" in line for line in broadcast(got)) and len({r[0] for r in got.collect()}) == 10


def test_blocks_of_anchors_are_never_broadcast(spark, monkeypatch):
    """Nor do the tasks send their shares of the sample to the driver: every step is written, and its plan looked at."""
    seen = []
    monkeypatch.setattr(hard_negatives, "cut_lineage", lambda df, cut=hard_negatives.cut_lineage: (seen.append(df), cut(df))[1])
    seen.append(hard_negatives.mine(ready(spark).createDataFrame(clouds()[:200], ROWS), lambda x: x % 20 == 0))
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in seen]
    assert not any("cells" in line for x in seen for line in broadcast(x)) and any("TakeOrdered" in x for x in plans)
    assert len({r[0] for r in seen[-1].collect()}) == 10


def test_topk_of_many_blocks_on_both_sides(spark, monkeypatch):
    monkeypatch.setattr(topk.V, "CELLS", 24 * 7)
    rows = clouds()[:150]
    kept = {i: [math.floor(x * 256) for x in v] for _, i, v, *_ in rows}
    want = [(i, r, j, s) for i in kept if i % 5 == 0 for r, (s, j) in enumerate(
        sorted(((sum(x * y for x, y in zip(kept[i], w, strict=True)), j) for j, w in kept.items() if j != i), key=lambda x: (-x[0], x[1]))[:5], 1)]
    got = topk.nearest(ready(spark).createDataFrame(rows, ROWS), lambda x: x % 5 == 0)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_blocks_grow_and_are_narrow():
    V = topk.V
    assert [V.block_size(n, 64, 4096) for n in (100, 300_000, 10 ** 9)] == [4096, 4688, 32768]
    assert V.block_size(10 ** 6, 10 ** 9, 4096) == 1 and V.block_size(0, 0, 8192) == 8192
    for most, kind in ((32767.0, "<i2"), (-32768.0, "<i4"), (2.0 ** 31 - 1, "<i4"), (2.0 ** 31, "<f8"), (1e300, "<f8")):
        m = np.array([[most, 0.0, 1.0], [-1.0, 5.0, 2.0]])
        cells, found = V.narrowed(m.T)
        assert found == kind and (V.widened(topk.pa.scalar(cells), topk.pa.scalar(found)).reshape(3, 2) == m.T).all()


def grouped(rows, cosine=0.9):
    """vec_id, links, component and kept of each row, by comparing all pairs."""
    width = max(len(r[2] or []) for r in rows)
    usable = [k for k, r in enumerate(rows) if r[1] is not None and sound(r[2]) and any(r[2])]
    m = np.array([[*rows[k][2], *[0.0] * (width - len(rows[k][2]))] for k in usable])
    m = m / np.abs(m).max(1)[:, None]
    m = m / np.sqrt((m * m).sum(1))[:, None]
    up, count = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in zip(*np.nonzero(m @ m.T >= cosine), strict=True):
        if i != j:
            count[usable[i]] += 1
            up[root(usable[i])] = root(usable[j])
    names = {}
    for k, r in enumerate(rows):
        if r[1] is not None:
            names[root(k)] = min(names.get(root(k), r[1]), r[1])
    return sorted(((r[1], count[k], names.get(root(k)), names.get(root(k)) == r[1]) for k, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("cell,residents,visitors", [(2048, 4096, 16384), (8, 4096, 16384), (16, 7, 11)])
def test_near_vectors_equal_brute_force(spark, monkeypatch, cell, residents, visitors):
    monkeypatch.setattr(near_vectors, "CELL", cell)
    monkeypatch.setattr(near_vectors, "RESIDENTS", residents)
    monkeypatch.setattr(near_vectors, "VISITORS", visitors)
    rows = clouds(320)
    frame = ready(spark).createDataFrame(rows, ROWS)
    got = near_vectors.near_vectors(frame)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = grouped(rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert sum(r[1] > 20 for r in want) > 20 and sum(not r[3] for r in want) > 50
    if cell == 8:
        assert near_vectors.near_vectors(frame.limit(0)).count() == 0
        odd = near_vectors.near_vectors(frame.where("vec_id is null or vec_id = 1000")).collect()
        assert sorted((tuple(r) for r in odd), key=str) == [(1000, 0, 1000, True), (None, 0, None, True)]


def test_pigeonhole_finds_every_pair():
    """Pairs just within the range: some block holds its share, and one of the two visits the other's cell there."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(4000, 64)) + 0.5
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    b = (0.9 + 1e-12) * a + np.sqrt(1 - (0.9 + 1e-12) ** 2) * side
    layout = near_vectors.Layout(64, 0.9, 16, near_vectors.Layout(64, 0.9).rotated(a).mean(0))
    ra, rb = layout.rotated(a), layout.rotated(b)
    assert np.allclose((ra * rb).sum(1), 0.9) and np.array_equal(layout.rotated(a[7:8])[0], ra[7])
    found = np.zeros(len(a), bool)
    for block in range(layout.blocks):
        near = layout.apart(ra, rb, block) <= layout.shares[block]
        one, two = layout.codes(ra, block), layout.codes(rb, block)
        meet = layout.reaches(ra, one, two, block) | layout.reaches(rb, two, one, block)
        assert meet[near].all()
        found |= near
    assert found.all()
    row, code = layout.visits(ra[:50], 2)
    own = layout.codes(ra[:50], 2)
    assert len(set(zip(row.tolist(), code.tolist(), strict=True))) == len(row)
    everywhere = np.repeat(np.arange(50), 1 << 16), np.tile(np.arange(1 << 16), 50)
    assert layout.reaches(ra[everywhere[0]], own[everywhere[0]], everywhere[1], 2).sum() == len(row)


def coded(rows, entries, rounds, parts=4):
    kept = [(r[1], r[0], [math.floor(x * 1024) for x in r[2]]) for r in rows if sound(r[2])]
    width = -(-max(len(v) for *_, v in kept) // parts)
    kept = [(i, label, v + [0] * (width * parts - len(v))) for i, label, v in kept]
    cut = lambda v: [tuple(v[p * width:(p + 1) * width]) for p in range(parts)]
    heads = sorted(kept, key=lambda r: (r[0] is None, r[0], r[2]))[:entries]
    books = [[cut(v)[p] for *_, v in heads] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for *_, v in kept:
                held.setdefault(nearest(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            books[p] = [tuple(sum(c) // len(held[k]) for c in zip(*held[k], strict=True)) if k in held else e for k, e in enumerate(books[p])]
    out = []
    for i, label, v in kept:
        got = [nearest(x, books[p]) for p, x in enumerate(cut(v))]
        out.append((i, label, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got)))
    return sorted(out, key=str), books


def test_part_codes_equal_brute_force(spark):
    rows = [r for r in clouds(200, dims=22) if not (r[2] and max(abs(x or 0) for x in r[2]) > 2)]
    rows += [(1, 300 + k, rows[k][2], 0, "", 0) for k in range(40)] + [(None, 400, rows[3][2], 0, "", 0)]  # ties and a null label
    frame = ready(spark).createDataFrame(rows, ROWS)
    codes, books = part_codes.part_codes(frame, entries=24, rounds=3)
    want, want_books = coded(rows, 24, 3)
    assert codes.columns == ["vec_id", "label", "code", "error"]
    assert sorted((tuple(r) for r in codes.collect()), key=str) == want
    assert [[tuple(e) for e in b.tolist()] for b in books] == want_books
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    got = part_codes.with_label_error(codes).collect()
    assert len(got) == len(want) and all(r.label_error == sums[r.label] for r in got) and None in sums
    empty, none = part_codes.part_codes(frame.limit(0))
    assert part_codes.with_label_error(empty).count() == 0 and part_codes.digest(none) == part_codes.digest([])
    with pytest.raises(ValueError):
        part_codes.part_codes(ready(spark).createDataFrame([(1, 1, [1e30])], "label int, vec_id long, embedding array<double>"))


def test_pivots_prune_exactly():
    rng = np.random.default_rng(4)
    centres = rng.integers(-500, 500, (40, 8))
    parts = centres[rng.integers(0, 40, 3000)] + rng.integers(-20, 20, (3000, 8))
    entries = np.concatenate([centres, centres[:5], parts[:60]])  # equal entries tie to the lower index
    fixed = part_codes.pivots(entries)
    evaluated = []
    index, least = part_codes.assign(parts, part_codes.far(parts, fixed), entries, part_codes.far(entries, fixed), evaluated)
    every = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (index == every.argmin(1)).all() and (least == every.min(1)).all()
    assert sum(evaluated) < 0.5 * every.size
