"""Hard negatives by angular triangle filtering.

Each row keeps its angles to a few reference directions. For an anchor and a row the difference of
two such angles is a lower and their sum an upper bound of the angle between them, so that the
references give an interval of cosines; times the two lengths, and widened by more than rounding can
take, it is an interval that surely holds the integer score. Rows whose interval misses what is asked
for (the best of the same label, or the score windows of the positives) are never scored; the others
are scored by descending upper bound until no further row can enter.

Rows lie in blocks sorted by label. The search for positives meets only blocks that hold the anchor's
label; the search for negatives lets each block of anchors meet each block of rows, which is the
stated query set against all rows. A label with a third of all rows fills blocks of the usual size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm import vectors as V
from tidegauge.session import cut_lineage

#: Rows in a block, about, while the table is small, and anchors in a block at most.
ROWS, ANCHORS = 8192, 32768
#: Reference directions, and the rows (by hash of the id) they are picked from; both decide speed, never a result.
REFERENCES, PICKED_FROM = 16, 1024
#: Radians that rounding of an angle, and share of a score that rounding of a bound, stay below.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9
TOP = 2.0 ** 63

BLOCK = "block long, ids array<long>, labels array<long>, cells binary, kind string"
MEETING = ("block", "ids", "labels", "cells", "kind")


def references(sample: np.ndarray, n: int = REFERENCES) -> np.ndarray:
    """Unit directions far from each other: the first row, then always the row furthest from those taken."""
    length = V.lengths(sample)
    sample, length = sample[(length > 0) & np.isfinite(length)], length[(length > 0) & np.isfinite(length)]
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    unit = sample / length[:, None]
    taken, nearest = [0], unit @ unit[0]
    while len(taken) < min(n, len(unit)):
        taken.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[taken[-1]])
    return unit[taken]


def angles(m: np.ndarray, length: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Angle of each row (columns of the result) to each reference; a row without a direction is at a right angle."""
    usable = (length > 0) & np.isfinite(length)
    unit = np.where(usable[:, None], m / np.where(usable, length, 1.0)[:, None], 0.0)
    return np.arccos(np.clip(refs @ unit.T, -1.0, 1.0))


def bounds(angle: np.ndarray, length: float, others: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lowest and highest possible score of a vector with each row, and the product of lengths."""
    with np.errstate(over="ignore", invalid="ignore"):
        most = np.where((lengths > 0) & (length > 0), length * lengths, 0.0)
    if len(others):
        near = np.abs(others - angle[:, None]).max(0)
        total = others + angle[:, None]
        far = np.minimum(total, 2 * np.pi - total).min(0)
    else:
        near, far = np.zeros(len(lengths)), np.full(len(lengths), np.pi)
    finite = np.isfinite(most)
    scale, slack = np.where(finite, most, 0.0), np.where(finite, most * SCORE_SLACK + 1e-6, 0.0)
    high = scale * np.cos(np.maximum(near - ANGLE_SLACK, 0)) + slack
    low = scale * np.cos(np.minimum(far + ANGLE_SLACK, np.pi)) - slack
    # scores end at 64 bits, so the bounds do
    return np.where(finite, np.clip(low, -TOP, TOP * (1 - 1e-15)), -np.inf), np.where(finite, np.clip(high, -TOP * (1 - 1e-15), TOP), np.inf), most


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -score))[:k]


def first_of(one: np.ndarray, rows: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, most: np.ndarray, k: int):
    """The k highest scores among the rows, as (ids, scores)."""
    if len(ids) > k:
        sure = np.partition(low, len(low) - k)[len(low) - k]  # k rows reach this at least
        keep = high >= sure
        rows, ids, most = rows[keep], ids[keep], most[keep]
    score = V.scores(one, rows, most)
    at = best(score, ids, k)
    return ids[at], score[at]


def in_windows(one: np.ndarray, rows: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, most: np.ndarray,
               windows: list[tuple[int, int]], k: int):
    """For each window of scores (both ends included) the k highest in it, as (window, ids, scores)."""
    meets = np.zeros(len(ids), bool)
    for least, greatest in windows:
        if least <= greatest:
            meets |= (high >= least) & (low <= greatest)
    at = np.flatnonzero(meets)
    at = at[np.argsort(-high[at], kind="stable")]
    score = np.zeros(0, np.int64)
    step = 512
    while len(score) < len(at):
        some = at[len(score):len(score) + step]
        score = np.concatenate([score, V.scores(one, rows[some], most[some])])
        step *= 2
        if len(score) < len(at):
            reach = high[at[len(score)]]  # no row still to come scores more
            if all(((score > reach) & (score >= a) & (score <= b)).sum() >= k for a, b in windows if a <= b and reach >= a):
                break
    ids = ids[at[:len(score)]]
    for w, (least, greatest) in enumerate(windows):
        held = np.flatnonzero((score >= least) & (score <= greatest))
        top = held[best(score[held], ids[held], k)]
        yield w, ids[top], score[top]


def packed(rows: DataFrame, size: int, dims: int, count: int) -> DataFrame:
    """Blocks of about ``size`` rows, by label; ``rows`` has id, label and v, ``count`` of them.

    Rows are dealt by ranges of (label, hash), so a frequent label fills many blocks and rare ones share one.
    """
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.asarray(p.column("id")), np.asarray(p.column("label")), V.matrix(p.column("v"), dims)) for p in parts if p.num_rows]
        if not got:
            return
        ids, labels, m = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((ids, labels))
        cells, kind = V.narrowed(V.whole(m[order], 256))
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([ids[order]], pa.list_(pa.int64())), pa.array([labels[order]], pa.list_(pa.int64())),
             pa.array([cells], pa.binary()), pa.array([kind])], MEETING)

    dealt = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-count // size)), "label", F.xxhash64("id", "v"), "at")
    return cut_lineage(dealt.select("id", "label", "v").mapInArrow(run, BLOCK))


def _opened(block: pa.Table, refs: np.ndarray, prefix: str = ""):
    """ids, labels, components, lengths and angles of the rows of a block."""
    at = {c: block[prefix + c][0] for c in MEETING[1:]}
    m = V.widened(at["cells"], at["kind"]).reshape(-1, refs.shape[1])
    length = V.lengths(m)
    return np.asarray(at["ids"].values), np.asarray(at["labels"].values), m, length, angles(m, length, refs)


def mine(rows: DataFrame, is_anchor: Callable[[Column], Column], positives: int = 5, negatives: int = 10,
         least: int = 30, greatest: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has vec_id, embedding and label (whole numbers); components count as floor(256 x), a score is the
    integer inner product. Anchors are the rows where ``is_anchor`` holds for the id; an anchor's positives are the
    ``positives`` best rows of its label, and for each of them the ``negatives`` best rows of other labels with a
    score of ``least`` to ``greatest`` percent of the positive's are given, ranked from 1. Ties go to the smaller
    id; fewer rows give fewer results, a positive with a negative score has none.

    Rows with a null id, label or vector, or with a null, NaN or infinite component take no part. Shorter vectors
    are filled up with zeros; a vector of zeros scores 0 with any. An anchor never meets rows with its own id.
    A row that occurs several times is a candidate as often; an anchor that occurs several times with the same
    label and vector counts once, with other ones each of them is mined. Scores beyond 64 bits count as
    plus or minus 2^63 - 1. Other columns are ignored; empty tables give no rows.
    """
    spark = rows.sparkSession
    clean = rows.where(V.sound("embedding") & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), V.doubles("embedding").alias("v"))
    count, asked, dims = clean.agg(F.count(F.lit(1)), F.count(F.when(is_anchor(F.col("id")), 1)), F.max(F.size("v"))).first()
    dims = max(dims or 0, 1)
    # a bounded sample, written first: else each task would send as many rows to the driver
    picked = cut_lineage(clean.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(PICKED_FROM)).collect()
    refs = references(V.whole(V.matrix(pa.array([r.v for r in picked], pa.list_(pa.float64())), dims), 256)) if picked else np.zeros((0, dims))

    here = packed(clean, V.block_size(count, dims, ROWS), dims, count)
    asks = packed(clean.where(is_anchor(F.col("id"))).dropDuplicates(), min(ANCHORS, V.fitting(dims)), dims, asked)
    asks = asks.select(*(F.col(c).alias(f"a_{c}") for c in MEETING))

    def find_positives(ask: pa.Table, row: pa.Table) -> list:
        block = ask["a_block"][0].as_py()
        a_ids, a_labels, a_cells, a_lengths, a_angles = _opened(ask, refs, "a_")
        ids, labels, cells, lengths, angle = _opened(row, refs)
        out = [[], [], []]
        for j in range(len(a_ids)):
            x, y = np.searchsorted(labels, a_labels[j], "left"), np.searchsorted(labels, a_labels[j], "right")
            if x == y:
                continue
            low, high, most = bounds(a_angles[:, j], a_lengths[j], angle[:, x:y], lengths[x:y])
            own = ids[x:y] == a_ids[j]
            some, among = cells[x:y], ids[x:y]
            if own.any():
                some, among, low, high, most = some[~own], among[~own], low[~own], high[~own], most[~own]
            found, score = first_of(a_cells[j], some, among, low, high, most, positives)
            out[0].append(np.full(len(found), (block << 32) + j))
            out[1].append(found)
            out[2].append(score)
        return [np.concatenate([np.zeros(0, np.int64), *x]) for x in out]

    def labelled(blocks: DataFrame, block: str, labels: str) -> DataFrame:
        return blocks.select(F.col(block), F.explode(F.array_distinct(labels)).alias("label"))

    # pairs of block numbers; the blocks themselves are never broadcast
    met = F.broadcast(labelled(asks, "a_block", "a_labels").join(labelled(here, "block", "labels"), "label").select("a_block", "block").distinct())
    found = V.meetings(asks.join(met, "a_block"), here.join(met, "block"), ["a_block", "block"], find_positives, ["asked", "positive_id", "positive_score"])
    ranked = Window.partitionBy("asked").orderBy(F.desc("positive_score"), "positive_id")
    chosen = cut_lineage(found.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= positives))

    # windows of an anchor: at most ``positives``; of a block of anchors: that times its anchors
    wanted = chosen.groupBy(F.shiftrightunsigned("asked", 32).alias("a_block")).agg(
        F.sort_array(F.collect_list(F.struct("asked", "place", "positive_score"))).alias("w"))
    wanted = wanted.select("a_block", *(F.col(f"w.{c}").alias(f"w_{c}") for c in ("asked", "place", "positive_score")))
    a_last, last = (blocks.agg(F.max(block)).first()[0] or 0 for blocks, block in ((asks, "a_block"), (here, "block")))

    def find_negatives(ask: pa.Table, row: pa.Table) -> list:
        a_ids, a_labels, a_cells, a_lengths, a_angles = _opened(ask, refs, "a_")
        ids, labels, cells, lengths, angle = _opened(row, refs)
        asked, place, score = (np.asarray(ask[f"w_{c}"][0].values) for c in ("asked", "place", "positive_score"))
        out = [[], [], [], []]
        edges = np.flatnonzero(np.diff(asked, prepend=-1, append=-1)) if len(asked) else np.zeros(1, np.int64)
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            j = int(asked[s] & 0xFFFFFFFF)
            windows = [(-(-least * p // 100), greatest * p // 100) for p in score[s:e].tolist()]
            low, high, most = bounds(a_angles[:, j], a_lengths[j], angle, lengths)
            other = (labels != a_labels[j]) & (ids != a_ids[j])
            high = np.where(other, high, -np.inf)
            low = np.where(other, low, np.inf)
            for w, got, points in in_windows(a_cells[j], cells, ids, low, high, most, windows, negatives):
                for k, x in enumerate((np.full(len(got), asked[s]), np.full(len(got), place[s + w]), got, points)):
                    out[k].append(x)
        return [np.concatenate([np.zeros(0, np.int64), *x]) for x in out]

    # each block of anchors meets each block of rows: the stated queries against all rows
    every = lambda until: F.explode(F.sequence(F.lit(0), F.lit(until)).cast("array<long>"))
    windowed = asks.hint("merge").join(wanted, "a_block").withColumn("block", every(last))
    found = V.meetings(windowed, here.withColumn("a_block", every(a_last)), ["a_block", "block"], find_negatives,
                       ["asked", "place", "negative_id", "negative_score"])
    ranked = Window.partitionBy("asked", "place").orderBy(F.desc("negative_score"), "negative_id")
    top = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives)
    names = asks.select(F.col("a_block"), F.posexplode("a_ids").alias("pos", "anchor_id")).select(
        (F.shiftleft("a_block", 32) + F.col("pos")).alias("asked"), "anchor_id")
    return (top.join(chosen.withColumn("place", F.col("place").cast("long")), ["asked", "place"]).join(names, "asked")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
