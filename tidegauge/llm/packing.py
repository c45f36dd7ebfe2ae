"""Fixed-length training rows: token ids packed by best fit decreasing.

Every document's ids are split without loss into pieces of at most the row's length. Pieces are
dealt into groups of bounded size by the hash of document, piece and content; each group is packed on its
own: pieces by falling length, each into the fullest row that still holds it. A segment tree over
room left, holding for each room the rows that have it, finds that row in the logarithm of the
row's length. A packed row carries its ids as one binary cell, the cumulative lengths of its
segments, and the position of each id, which starts anew with every segment.
"""

from __future__ import annotations

import base64
import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import batches
from tidegauge.session import cut_lineage

#: Ids in a packed row, the id that fills it up, and ids in a group that is packed together, about.
ROW, FILL, GROUP = 2048, 0, 1 << 21


class Rooms:
    """The open rows by room left, under a segment tree that finds the least room of at least n."""

    def __init__(self, row: int):
        self.size = 1 << row.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(row + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The row with the least room of at least ``least``, taken out; None if there is none."""
        at = least + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # up to where the next larger rooms hold a row
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        row = self.rows[room].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, row


def fitted(lengths: list[int], row: int) -> list[int]:
    """The row of each piece, in the order given (falling lengths make it best fit decreasing)."""
    rooms, out, opened = Rooms(row), [], 0
    for n in lengths:
        found = rooms.take(n)
        room, at = found if found else (row, opened)
        opened += found is None
        out.append(at)
        if room > n:
            rooms.add(room - n, at)
    return out


@functools.lru_cache(maxsize=4)
def encoder_of(ranks: bytes, pattern: str):
    """One byte-level encoder per worker and vocabulary (a line of base64 text and rank for each entry)."""
    import tiktoken

    table = {base64.b64decode(text): int(rank) for text, rank in map(bytes.split, ranks.splitlines())}
    if max(table.values()) >= 1 << 16:
        raise ValueError("a packed cell has 16 bits")
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def pieces(docs: DataFrame, ranks_path: str, pattern: str, row: int = ROW) -> DataFrame:
    """(doc_id, part, ids, copy): every text's ids in pieces of at most ``row``; a text without ids has none.

    ``copy`` counts from 0 the rows of a task that are equal in doc_id and text. The counts are the same
    in whatever order the task meets its rows, so a repeated task gives the same pieces.
    """
    with open(ranks_path, "rb") as f:  # the driver reads the vocabulary; workers get its bytes (under a MB)
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(model.value, pattern).encode_ordinary
        met: Counter = Counter()
        for part in batches.sliced(parts, "text"):
            texts = part.column("text").to_pylist()
            lists = [np.array(encode(text or ""), np.int32) for text in texts]
            copy = np.zeros(len(texts), np.int64)
            for i, row_key in enumerate(zip(part.column("doc_id").to_pylist(), map(hash, texts), strict=True)):
                copy[i] = met[row_key]
                met[row_key] += 1
            flat, bounds = np.concatenate(lists), np.cumsum([0, *map(len, lists)])
            n = -(-np.diff(bounds) // row)
            doc = np.repeat(np.arange(part.num_rows), n)
            no = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            starts = bounds[:-1][doc] + no * row
            ends = np.append(starts[1:], bounds[-1]) if len(starts) else starts
            cells = pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]), pa.int32()), pa.array(flat, pa.int32())) if len(starts) else pa.array([], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(no, pa.int64()), cells, pa.array(copy[doc])],
                                             ["doc_id", "part", "ids", "copy"])

    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(run, batches.schema_of(kept, ["doc_id"], "part long, ids array<int>, copy long"))


def packed(docs: DataFrame, ranks_path: str, pattern: str, row: int = ROW, fill: int = FILL, group: int = GROUP) -> DataFrame:
    """(pack_group, pack_row, ids, n_ids, cu_lens, positions, doc_ids, parts): the packed rows.

    ``ids`` holds ``row`` unsigned 16-bit numbers, little-endian; what is left
    at the end is ``fill``. ``cu_lens`` starts with 0 and has one entry more than there are
    segments; ``positions`` counts from 0 within each segment. Documents and their parts stand in
    the order of the segments, so that every document can be put together again. Null and empty
    texts have no ids and so no segment; rows may repeat, a null doc_id is kept as such. A group is the
    pieces of one hash value of id, part, content and copy, in a fixed order, so neither one id on
    many texts nor one text many times makes a group large. The same rows are packed alike on any
    cluster, but for the grouping of rows that are equal in id and text.
    """
    cut = cut_lineage(pieces(docs, ranks_path, pattern, row).withColumn("n", F.size("ids")))
    total = cut.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = max(1, -(-total // group))

    def run(part: pa.Table) -> pa.Table:
        lens = np.asarray(part["n"], np.int64)
        doc, no = np.asarray(part["doc_id"].fill_null(-1), np.int64), np.asarray(part["part"])
        order = np.lexsort((np.asarray(part["copy"]), np.asarray(part["digest"]), no, doc, -lens))
        cells = part["ids"].combine_chunks()
        flat, starts = np.asarray(cells.flatten(), np.int32), np.concatenate([[0], np.cumsum(lens)])[:-1]
        rows = np.array(fitted(lens[order].tolist(), row), np.int64)
        by_row = np.argsort(rows, kind="stable")
        order, rows = order[by_row], rows[by_row]
        n_rows = int(rows[-1]) + 1
        sizes = lens[order]
        ends = np.cumsum(sizes)
        first = np.searchsorted(rows, np.arange(n_rows + 1))
        base = np.concatenate([[0], ends])[first]
        ids = batches.gather(flat, starts[order], sizes)
        used = np.diff(base)
        matrix = np.full((n_rows, row), fill, np.uint16)
        place = np.arange(len(ids)) - np.repeat(base[:-1], used)
        matrix[np.repeat(np.arange(n_rows), used), place] = ids
        positions = np.arange(len(ids), dtype=np.int64) - np.repeat(ends - sizes, sizes)
        # cumulative lengths: a leading zero for each row, then the ends of its segments
        inside = ends - np.repeat(base[:-1], np.diff(first))
        cu = np.insert(inside, first[:-1], 0)
        lists = lambda bounds, values, kind: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
        return pa.table({
            "pack_group": pa.array(np.full(n_rows, part["pack_group"][0].as_py())), "pack_row": pa.array(np.arange(n_rows)),
            "ids": pa.array([r.tobytes() for r in matrix.astype("<u2")], pa.binary()), "n_ids": pa.array(used, pa.int32()),
            "cu_lens": lists(first + np.arange(n_rows + 1), cu, pa.int32()), "positions": lists(base, positions, pa.int32()),
            "doc_ids": pa.ListArray.from_arrays(pa.array(first, pa.int32()), part["doc_id"].combine_chunks().cast(pa.int64()).take(pa.array(order))),
            "parts": lists(first, no[order], pa.int64())})

    dealt = F.pmod(F.xxhash64("doc_id", "part", "ids", "copy"), F.lit(groups))
    return (cut.withColumn("pack_group", dealt).withColumn("digest", F.xxhash64("ids")).groupBy("pack_group")
            .applyInArrow(run, "pack_group long, pack_row long, ids binary, n_ids int, cu_lens array<int>, positions array<int>, doc_ids array<long>, parts array<long>"))


def write(docs: DataFrame, ranks_path: str, pattern: str, path: str, row: int = ROW) -> None:
    """Write the packed rows as Parquet, a folder of files per cluster's tasks."""
    packed(docs, ranks_path, pattern, row).write.mode("overwrite").parquet(path)


def unpacked(rows: DataFrame) -> DataFrame:
    """(doc_id, part, ids) of packed rows again."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[tuple] = []
            for ids, cu, doc_ids, numbers in zip(*(part.column(c).to_pylist() for c in ("ids", "cu_lens", "doc_ids", "parts")), strict=True):
                cells = np.frombuffer(ids, "<u2")
                out += [(d, p, cells[a:b].tolist()) for d, p, a, b in zip(doc_ids, numbers, cu[:-1], cu[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int32()))],
                                             ["doc_id", "part", "ids"])

    return rows.select("ids", "cu_lens", "doc_ids", "parts").mapInArrow(run, "doc_id long, part long, ids array<int>")
