"""Product codes of vectors, trained by exact integer k-means with LAESA pivots.

Vectors are cut into equal parts of whole-number components; each part gets the index of its nearest
codebook entry. The distances of a part to a few fixed pivots are computed once and written beside
it. In each round only the distances of pivots and entries are new: by the triangle inequality the
difference of the two distances to a pivot is a lower bound of the distance between part and entry.
Entries are tried in the order of these bounds, and all whose bound is beyond the best exact distance
so far are left out. What decides is always an exact integer distance; bounds are widened by more than
rounding can take.

A round is one pass over the written table; each task sums the parts of each entry, and only these
sums, as many as the codebooks have components, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import vectors as V
from tidegauge.session import cut_lineage

#: Pivots of a part; they decide speed, never a result.
PIVOTS = 8
#: Components at this many units or more are refused: squared distances and sums must fit 64 bits.
LARGEST = 1 << 24
#: Entries tried before the bounds are compared with the best distance.
FIRST = 4
#: Parts worked on at a time.
CHUNK = 4096


def pivots(entries: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Rows far from each other: the first entry, then always the one furthest from those taken."""
    taken, nearest = [0], ((entries - entries[0]) ** 2).sum(1)
    while len(taken) < min(n, len(entries)):
        taken.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((entries - entries[taken[-1]]) ** 2).sum(1))
    return entries[taken]


def far(parts: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distance of each part to each of a few others."""
    return np.stack([np.sqrt(((parts - p) ** 2).sum(1).astype(np.float64)) for p in others], 1)


def squared(parts: np.ndarray, entries: np.ndarray, i: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Exact squared distances of the pairs (part i, entry e)."""
    apart = parts[i] - entries[e]
    return np.einsum("ij,ij->i", apart, apart)


def assign(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivot_entry: np.ndarray, evaluated: list[int] | None = None):
    """Nearest entry of each part, ties to the lower index, and its squared distance; both are exact."""
    n, k = len(parts), len(entries)
    bound = np.abs(to_pivots[:, :1] - pivot_entry[None, :, 0])
    for p in range(1, pivot_entry.shape[1]):
        np.maximum(bound, np.abs(to_pivots[:, p:p + 1] - pivot_entry[None, :, p]), out=bound)
    # a distance is off by some 1e-16 of itself, the longest of all distances bounds it
    reach = float(max(to_pivots.max(initial=0.0), pivot_entry.max(initial=0.0)))
    bound -= reach * 1e-12
    first = np.argpartition(bound, min(FIRST, k) - 1, axis=1)[:, :FIRST]
    rows = np.repeat(np.arange(n), first.shape[1])
    tried = squared(parts, entries, rows, first.ravel()).reshape(first.shape)
    least = tried.min(1)
    nearest = np.where(tried == least[:, None], first, k).min(1)
    total = tried.size
    np.put_along_axis(bound, first, np.inf, 1)
    # the others by ascending bound, a few at a time, as long as any bound is within the best distance
    at, e = np.nonzero(bound <= np.sqrt(least.astype(np.float64))[:, None] * (1 + 1e-12))
    if len(at):
        order = np.lexsort((bound[at, e], at))
        at, e = at[order], e[order]
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        place = np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))
        low, step = 0, 2 * FIRST
        while len(at):
            now = place < low + step
            x, y = at[now], e[now]
            d = squared(parts, entries, x, y)
            total += len(d)
            at, e, place = at[~now], e[~now], place[~now]
            better = np.full(n, np.iinfo(np.int64).max)
            np.minimum.at(better, x, d)
            least_now = np.minimum(least, better)
            nearest = np.where(better < least, k, nearest)
            held = d == least_now[x]
            np.minimum.at(nearest, x[held], y[held])
            least = least_now
            keep = bound[at, e] <= np.sqrt(least[at].astype(np.float64)) * (1 + 1e-12)
            at, e, place = at[keep], e[keep], place[keep]
            low, step = low + step, 2 * step
    if evaluated is not None:
        evaluated.append(total)
    return nearest, least


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components, by part, entry and place, in decimal and comma-joined."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def part_codes(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error), codebooks): codes of the rows and the entries of each part.

    ``rows`` has vec_id, embedding and label; a component counts as floor(scale * x). Codebooks start as the parts of
    the ``entries`` smallest ids (ties by the vector); each of ``rounds`` rounds assigns all parts and replaces an entry
    by the floor of the mean of its parts, an entry without parts stays. ``code`` has two hexadecimal digits for each
    part, ``error`` is the sum of the squared distances.

    Rows whose vector is null or has a null, NaN or infinite component are left out; a null id comes after all others
    when codebooks start; a null label stays null. Shorter vectors, and those whose length ``parts`` does not divide, are
    filled up with zeros. Rows that occur several times count as often. Components of 2^24 units or more are refused
    with an error. An empty table gives no rows and codebooks without entries. Other columns are ignored.
    """
    if entries > 256:
        raise ValueError("an index has two hexadecimal digits")
    spark = rows.sparkSession
    clean = rows.where(V.sound("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform(
        V.doubles("embedding"), lambda x: F.floor(F.greatest(F.least(x, F.lit(1e15)), F.lit(-1e15)) * scale)).alias("v"))
    most, dims = clean.agg(F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))), F.max(F.size("v"))).first()
    if (most or 0) >= LARGEST:
        raise ValueError(f"a component of {most} units is beyond the {LARGEST} that exact codes allow")
    width = max(1, -(-(dims or 0) // parts))
    size = width * parts

    def filled(v: pa.Array) -> np.ndarray:
        return V.matrix(v, size).astype(np.int64)

    head = clean.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    start = filled(pa.array([r.v for r in head], pa.list_(pa.int64()))) if head else np.zeros((0, size), np.int64)
    books = [start[:, p * width:(p + 1) * width].copy() for p in range(parts)]
    fixed = [pivots(b) if len(b) else b for b in books]
    if not head:
        return clean.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books
    n_pivots = len(fixed[0])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = filled(b.column("v"))
                record = np.concatenate([m.astype(np.int32), *(far(m[:, p * width:(p + 1) * width], fixed[p]).view(np.int32) for p in range(parts))], 1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), V.records(record.view(np.uint8))], ["vec_id", "label", "record"])

    kind = clean.schema["label"].dataType.simpleString()
    table = cut_lineage(clean.mapInArrow(measured, f"vec_id long, label {kind}, record binary"))
    bytes_each = 4 * size + 8 * parts * n_pivots

    def nearest(column: pa.Array, books: list[np.ndarray], to_entries: list[np.ndarray]):
        """(slice, part, its vectors, indexes, squared distances) of a column of records."""
        got = V.record_bytes(pa.chunked_array([column]), bytes_each)
        for x in range(0, len(got), CHUNK):
            some = np.ascontiguousarray(got[x:x + CHUNK])
            m, d = some[:, :4 * size].copy().view(np.int32).astype(np.int64), some[:, 4 * size:].copy().view(np.float64)
            for p in range(parts):
                own = m[:, p * width:(p + 1) * width]
                yield slice(x, x + len(some)), p, own, *assign(own, d[:, p * n_pivots:(p + 1) * n_pivots], books[p], to_entries[p])

    for _ in range(rounds):
        now = books
        to_entries = [far(b, f) for b, f in zip(now, fixed, strict=True)]

        def summed(batches: Iterator[pa.RecordBatch], now=now, to_entries=to_entries) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((parts, len(now[0]), width), np.int64), np.zeros((parts, len(now[0])), np.int64)
            for b in batches:
                for _, p, own, index, _ in nearest(b.column("record"), now, to_entries):
                    order = np.argsort(index, kind="stable")
                    used, starts, counts = np.unique(index[order], return_index=True, return_counts=True)
                    total[p, used] += np.add.reduceat(own[order], starts)
                    n[p, used] += counts
            p, e = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e], pa.int64()),
                                              pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

        sums = (table.select("record").mapInArrow(summed, "part int, entry int, n long, total array<long>")
                .groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[k]) for k in range(width))).alias("total")))
        books = [b.copy() for b in now]
        for r in sums.collect():  # as many rows as codebooks have entries
            books[r.part][r.entry] = [x // r.n for x in r.total]
    to_entries = [far(b, f) for b, f in zip(books, fixed, strict=True)]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, error = np.zeros((b.num_rows, parts), np.uint8), np.zeros(b.num_rows, np.int64)
            for s, p, _, index, d in nearest(b.column("record"), books, to_entries):
                codes[s, p] = index
                error[s] += d
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)],
                                             ["vec_id", "label", "code", "error"])

    return cut_lineage(table.mapInArrow(coded, f"vec_id long, label {kind}, code string, error long")), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """``label_error`` added: the sum of ``error`` over equal labels, nulls together."""
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same")
    return codes.join(totals, F.col("label").eqNullSafe(F.col("same"))).drop("same")
