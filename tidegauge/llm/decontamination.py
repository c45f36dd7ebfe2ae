"""Benchmark passages in documents, in spite of small edits.

Edit distance over words is turned into Hamming distance by a random walk (CGK): position after
position a shared random bit of the word met decides whether the walk steps on, so two sequences
that differ by an insertion fall into step again. Positions of the embedding are sampled as hash
keys (bit-sampling LSH), each repetition with a walk and a sample of its own, as often as the wanted
recall needs. Windows of the size of an item are looked up under the keys of the items of that
size, and a window that meets an item is compared by exact edit distance.

A window at most d edits away from an item with p distinct word pairs holds p - 2d of them, so windows
with fewer pairs known from items of their size are not embedded; none within reach is lost by that.
(A pair met again one or two words on is not counted, which costs a window two pairs at its start.)
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import batches

#: Edits allowed as a share of an item's words; items with fewer words than ``SHORTEST`` tell nothing.
EDITS, SHORTEST = 0.2, 5
#: Wanted recall at that distance, words in a key, and the share of positions that agree at least.
RECALL, KEY, AGREE = 0.99, 3, 0.6
#: Words of items compared in one pass over the documents; a larger benchmark takes several passes.
ITEM_WORDS = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[np.r_[48:58, 65:91, 97:123, 128:256]] = True


def repetitions(recall: float = RECALL, key: int = KEY, agree: float = AGREE) -> int:
    """How many keys must be tried so that one of them agrees with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agree ** key))


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (letters and digits, A-Z lower-cased), and where each text starts."""
    data, bounds = batches.raw(column)
    starts, ends = batches.runs(_INSIDE[data], bounds)
    return batches.hashes(_LOWER[data], starts, ends), np.searchsorted(starts, bounds)


@functools.cache
def _draw(size: int, repetition: int, key: int) -> tuple[set[int], np.ndarray]:
    """Sampled positions and the walk's random numbers, the same wherever they are drawn."""
    draw = np.random.default_rng([repetition, size])
    samples = draw.choice(3 * size, min(key, 3 * size), replace=False).tolist()
    return set(samples), draw.integers(0, 1 << 63, 3 * size, dtype=np.int64).astype(np.uint64)


def keys(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, repetition: int, key: int = KEY) -> np.ndarray:
    """One key per window: sampled positions of the walk over its words, of up to ``size`` of them."""
    samples, salts = _draw(size, repetition, key)
    at = starts.copy()
    out = np.full(len(starts), size, np.uint64)
    for j in range(max(samples) + 1):
        inside = at < ends
        word = np.where(inside, words[np.minimum(at, len(words) - 1)], np.uint64(0))
        if j in samples:
            out = batches.mixed(out * np.uint64(0x9E3779B97F4A7C15) + word)
        at += inside & ((batches.mixed(word + salts[j]) >> np.uint64(17)) & np.uint64(1)).astype(bool)
    return out


def _last_row(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Fewest edits that turn an item into a run of a text's words, by the end of the run."""
    place = np.arange(len(text) + 1, dtype=np.int32)
    gain = (item[:, None] == text[None, :]).astype(np.int32)
    row = -place  # every entry less its place, so that a running minimum spreads along the row
    new = np.empty_like(row)
    for i in range(len(item)):
        new[0] = i + 1
        np.subtract(row[:-1], gain[i], out=new[1:])
        row += 1
        np.minimum(new[1:], row[1:], out=new[1:])
        np.minimum.accumulate(new, out=row)
    return row + place


def alignment(item: np.ndarray, text: np.ndarray, edits: int) -> tuple[int, int]:
    """(begin, fewest edits) of the first run of a text's words that an item turns into with fewest edits.

    Of runs with one end the longest counts. Beyond ``edits`` the begin is not looked for.
    """
    row = _last_row(item, text)
    end = int(row.argmin())
    away = int(row[end])
    if away == 0 or away > edits:
        return end - len(item), away
    back = _last_row(item[::-1], text[max(0, end - len(item) - away):end][::-1])
    return end - int(np.flatnonzero(back == away)[-1]), away


@dataclass
class Items:
    """A block of items by size: their words, word pairs, and keys of every repetition."""

    ids: list[int]
    words: list[np.ndarray]
    share: float
    repeat: int
    sizes: list[int] = field(default_factory=list)
    tables: dict = field(default_factory=dict)

    def __post_init__(self):
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            if len(w) >= SHORTEST:
                by_size.setdefault(len(w), []).append(i)
        self.sizes = sorted(by_size)
        pairs: dict[int, int] = {}
        self.own_pairs = [np.unique(batches.chained(w, 2)) for w in self.words]
        for bit, size in enumerate(self.sizes):
            flat = np.concatenate([self.words[i] for i in by_size[size]])
            at = np.arange(len(by_size[size])) * size
            for p in np.unique(np.concatenate([batches.chained(self.words[i], 2) for i in by_size[size]])).tolist():
                pairs[p] = pairs.get(p, 0) | 1 << bit
            for r in range(self.repeat):
                k = keys(flat, at, at + size, size, r)
                order = np.argsort(k, kind="stable")
                self.tables[size, r] = (k[order], np.array(by_size[size])[order])
        self.fewest = {size: min(len(self.own_pairs[i]) for i in by_size[size]) for size in self.sizes}
        self.pairs = np.array(sorted(pairs), np.uint64)
        masks = [pairs[int(p)] for p in self.pairs]
        self.masks = [np.array([m >> 64 * g & (1 << 64) - 1 for m in masks], np.uint64) for g in range(-(-len(self.sizes) // 64))]

    def hits(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first word of the best run, edits) of each text and item within reach, once."""
        if not len(self.pairs) or len(words) < 2:  # no item within reach of a single word
            return
        met = batches.chained(words, 2)
        at = np.minimum(np.searchsorted(self.pairs, met), len(self.pairs) - 1)
        known = self.pairs[at] == met
        last = bounds[1:-1] - 1
        known[last[(last >= 0) & (last < len(known))]] = False  # no pair crosses from one text to the next
        known[1:] &= met[1:] != met[:-1]
        known[2:] &= met[2:] != met[:-2]
        some = np.flatnonzero(known)
        doc_of = np.searchsorted(bounds, some, "right") - 1
        masks = [m[at[some]] for m in self.masks]
        done: set[tuple[int, int]] = set()
        for bit, size in enumerate(self.sizes):
            edits = int(self.share * size)
            own = np.flatnonzero((masks[bit // 64] >> np.uint64(bit % 64)) & np.uint64(1))
            least = max(self.fewest[size] - 2 * edits - 2, 1)
            if len(own) < least:
                continue
            # from the first to the last of enough pairs: windows that begin at the first or so far before it that they end with the last
            head, tail = own[:len(own) - least + 1], own[least - 1:]
            near = (some[tail] - some[head] <= size - 2) & (doc_of[tail] == doc_of[head])
            low, high = np.maximum(some[tail[near]] - (size - 2), bounds[doc_of[head[near]]]), some[head[near]]
            starts = np.unique(batches.gather(np.arange(len(words)), low, high - low + 1))
            doc = np.searchsorted(bounds, starts, "right") - 1
            ends = np.minimum(starts + size, bounds[doc + 1])
            if not len(starts):
                continue
            # windows in a row are compared as one stretch of text
            stretch = np.cumsum(np.concatenate([[True], (np.diff(starts) > 1) | (np.diff(doc) != 0)])) - 1
            first = np.flatnonzero(np.concatenate([[True], np.diff(stretch) > 0]))
            final = np.append(first[1:], len(starts)) - 1
            tried: set[tuple[int, int]] = set()
            for r in range(self.repeat):
                table, which = self.tables[size, r]
                found = keys(words, starts, ends, size, r)
                low, high = np.searchsorted(table, found, "left"), np.searchsorted(table, found, "right")
                hit = np.flatnonzero(high > low)
                met_items = [(int(x), int(i)) for w, x in zip(hit.tolist(), stretch[hit].tolist(), strict=True) for i in which[low[w]:high[w]]]
                for x, item in dict.fromkeys(met_items):
                    d = int(doc[first[x]])
                    if (x, item) in tried or (d, item) in done:
                        continue
                    tried.add((x, item))
                    a, b = max(int(bounds[d]), int(starts[first[x]]) - edits), min(int(bounds[d + 1]), int(ends[final[x]]) + edits)
                    if np.isin(self.own_pairs[item], met[a:b - 1]).sum() < len(self.own_pairs[item]) - 2 * edits:
                        continue
                    begin, away = alignment(self.words[item], words[a:b], edits)
                    if away <= edits:
                        done.add((d, item))
                        yield d, item, a + begin - int(bounds[d]), away


def item_blocks(benchmark: DataFrame, share: float = EDITS, recall: float = RECALL, item_words: int = ITEM_WORDS) -> Iterator[Items]:
    """The items in blocks of bounded size, one after the other. Null and empty items are left out."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    letters = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-letters // (4 * item_words)))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        words, bounds = words_of(pa.array([r["text"] for r in rows], pa.string()))
        yield Items([r["item_id"] for r in rows], [words[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], share, repetitions(recall))


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = EDITS, recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, first_word, edits, item_words): each item met in each row of ``docs`` (doc_id, text).

    ``edits`` counts words inserted, left out or exchanged, at most ``share`` of the item's; ``first_word`` is where
    the run begins that comes closest, in the stretch of text where the item is first met. Null or
    empty texts and items give nothing, nor do items of under five words; an item met more than once
    in a text is given once, repeated rows are given each. No benchmark, or no documents, no rows.
    """
    kept = docs.select("doc_id", "text")
    schema = batches.schema_of(kept, ["doc_id"], "item_id long, first_word long, edits int, item_words int")
    out = None
    for items in item_blocks(benchmark, share, recall):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for part in batches.sliced(parts, "text", 8 * batches.SLICE):
                found = list(items.hits(*words_of(part.column("text"))))
                cols = list(zip(*found, strict=True)) if found else [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array([items.ids[i] for i in cols[1]], pa.int64()), pa.array(cols[2], pa.int64()),
                     pa.array(cols[3], pa.int32()), pa.array([len(items.words[i]) for i in cols[1]], pa.int32())], schema.names)

        found = kept.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = EDITS, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs``, with all columns, in which no item is met; null and empty texts stay."""
    for items in item_blocks(benchmark, share, recall):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in batches.sliced(parts, "text", 8 * batches.SLICE):
                bad = {d for d, *_ in shared.value.hits(*words_of(part.column("text")))}
                yield part.take(pa.array([i for i in range(part.num_rows) if i not in bad], pa.int64()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
