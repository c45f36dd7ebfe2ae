"""Whole-word occurrences of many keywords in one pass over each text.

A keyword is a literal that must begin and end at a word edge (letters, digits and underscores of
ASCII are word characters, as in the usual regular expressions). Texts and keywords fall into runs of
word characters and runs of others. The index lays keywords out by their first word and, where they go
on, by the run and the word that follow; every word of a text is looked up by its first eight letters,
alone and with what follows, and the few hits are compared letter by letter, edges included. The cost
of a text depends on its length and hits, not on the number of keywords, and no text leaves its row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.session import cut_lineage, reachable

#: Keywords of one pass; a larger taxonomy takes more passes.
KEYWORDS = 200_000
#: Bytes of text worked on at a time; a longer text is taken alone.
SLICE = 1 << 21
#: Hits, each once for every topic of its keyword, summed at a time; a text of more is taken alone.
HITS = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = True


def _heads(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of each run as one number; shorter runs end in zeros."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(8):
        at = starts + k
        inside = at < ends
        out[inside] |= data[at[inside]].astype(np.uint64) << np.uint64(8 * k)
    return out


def _runs(word: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of one kind; no run crosses from one text to the next."""
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(word) + 1, bool)
    edge[1:-1] = word[1:] != word[:-1]
    edge[bounds] = True
    at = np.flatnonzero(edge)
    return at[:-1], at[1:]


def _mix(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = (out ^ p) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class KeywordIndex:
    """Distinct keywords (lower case), laid out by their first word and what follows it, each with its topics' numbers."""

    def __init__(self, keywords: list[str], topics: list[int]):
        pairs = sorted((k.encode(), t) for k, t in zip(keywords, topics, strict=True) if k)
        kept = sorted({k for k, _ in pairs})
        number = {k: i for i, k in enumerate(kept)}
        self.topics = np.array([t for _, t in pairs], np.int64)
        self.topic_starts = np.searchsorted(np.array([number[k] for k, _ in pairs], np.int64), np.arange(len(kept) + 1))
        self.lens = np.array([len(k) for k in kept], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.data = np.frombuffer(b"".join(kept), np.uint8)
        starts, ends = _runs(_WORD[self.data], np.append(self.starts, len(self.data)))
        owner = np.searchsorted(self.starts, starts, "right") - 1
        # the first word of a keyword, or its only run if it has none
        words = _WORD[self.data[starts]] if len(starts) else np.zeros(0, bool)
        best = np.lexsort((starts, ~words, owner))
        first = best[np.flatnonzero(np.diff(owner[best], prepend=-1))]
        self.lead = starts[first] - self.starts  # bytes before that word
        self.kinds = {bool(x) for x in words[first]}
        heads = _heads(self.data, starts, ends)
        # a keyword that goes on to a second word is found by both words and what stands between them
        long = np.zeros(len(kept), bool)
        if len(starts) > 2:
            reach = np.minimum(first + 2, len(starts) - 1)
            long = (first + 2 < len(starts)) & (owner[reach] == np.arange(len(kept)))
        self.tables = []
        for several, some in ((False, np.flatnonzero(~long)), (True, np.flatnonzero(long))):
            if len(some):
                at = first[some]
                keys = _mix(heads[at], heads[at + 1], heads[at + 2]) if several else heads[at]
                order = np.argsort(keys, kind="stable")
                self.tables.append((several, keys[order], some[order]))

    def places(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, keyword, start) of every occurrence; those of one keyword never overlap, the first one counts."""
        word = _WORD[data]
        starts, ends = _runs(word, bounds)
        if len(self.kinds) == 1 and not any(several for several, *_ in self.tables) and len(starts):
            kind = word[starts] == next(iter(self.kinds))
            starts, ends = starts[kind], ends[kind]
        heads = _heads(data, starts, ends)
        runs, keywords = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for several, keys, owners in self.tables:
            look = (_mix(heads[:-2], heads[1:-1], heads[2:]) if len(heads) > 2 else heads[:0]) if several else heads
            low, high = np.searchsorted(keys, look, "left"), np.searchsorted(keys, look, "right")
            hit = np.flatnonzero(low < high)
            times = (high - low)[hit]
            run = np.repeat(hit, times)
            runs.append(run)
            keywords.append(owners[np.repeat(low[hit], times) + np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)])
        run, keyword = np.concatenate(runs), np.concatenate(keywords)
        begin = starts[run] - self.lead[keyword]
        end = begin + self.lens[keyword]
        text = np.searchsorted(bounds, starts[run], "right") - 1
        fits = (begin >= bounds[text]) & (end <= bounds[text + 1])
        keyword, begin, end, text = keyword[fits], begin[fits], end[fits], text[fits]

        def word_at(at: np.ndarray) -> np.ndarray:  # beyond a text there is no word
            out = np.zeros(len(at), bool)
            inside = (at >= bounds[text]) & (at < bounds[text + 1])
            out[inside] = word[at[inside]]
            return out

        fits = (word_at(begin - 1) != word_at(begin)) & (word_at(end - 1) != word_at(end))
        keyword, begin, end, text = keyword[fits], begin[fits], end[fits], text[fits]
        lens = self.lens[keyword]
        at = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
        same = data[at + np.repeat(begin, lens)] == self.data[at + np.repeat(self.starts[keyword], lens)]
        fits = np.logical_and.reduceat(same, np.cumsum(lens) - lens) if len(lens) else np.zeros(0, bool)
        keyword, begin, end, text = keyword[fits], begin[fits], end[fits], text[fits]
        order = np.lexsort((begin, keyword, text))
        keyword, begin, end, text = keyword[order], begin[order], end[order], text[order]
        clash = np.zeros(len(text), bool)
        clash[1:] = (keyword[1:] == keyword[:-1]) & (text[1:] == text[:-1]) & (begin[1:] < end[:-1])
        keep = np.ones(len(text), bool)
        last = np.where(clash, 0, end)  # only runs of overlapping places are walked
        for i in np.flatnonzero(clash).tolist():
            before = last[i - 1]
            keep[i] = begin[i] >= before
            last[i] = end[i] if keep[i] else before
        return text[keep], keyword[keep], begin[keep]

    def hits(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, keyword, occurrences), by text and keyword, without zeros."""
        text, keyword, _ = self.places(data, bounds)
        first = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(keyword, prepend=-1) != 0))
        return text[first], keyword[first], np.diff(first, append=len(text))

    def _by_topic(self, text: np.ndarray, keyword: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """text * width + topic of each hit and each topic of its keyword, and its occurrences."""
        times = (self.topic_starts[1:] - self.topic_starts[:-1])[keyword]
        again = np.repeat(np.arange(len(keyword)), times)
        topic = self.topics[np.repeat(self.topic_starts[keyword] - np.cumsum(times) + times, times) + np.arange(len(again))]
        return text[again] * width + topic, n[again]

    def summed(self, columns: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, topic, occurrences in each column), without rows of zeros, for a few texts at a time.

        ``columns`` holds the letters and the starts of the same texts, column by column. A keyword of
        many topics makes many of each hit, so only ``HITS`` of those are made before they are summed.
        """
        found = [self.hits(*c) for c in columns]
        width = int(self.topics.max()) + 1 if len(self.topics) else 1
        texts = len(columns[0][1]) - 1
        size = np.zeros(texts, np.int64)
        for text, keyword, _ in found:
            size += np.bincount(text, (self.topic_starts[1:] - self.topic_starts[:-1])[keyword], texts).astype(np.int64)
        part = np.cumsum(size) // HITS
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1)).tolist() if texts else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            spread = []
            for text, keyword, n in found:
                low, high = np.searchsorted(text, (a, b))
                spread.append(self._by_topic(text[low:high] - a, keyword[low:high], n[low:high], width))
            every = np.concatenate([k for k, _ in spread])
            if not len(every):
                continue
            if (b - a) * width <= 8 * len(every):  # dense enough to count in place
                key = np.flatnonzero(np.bincount(every, minlength=(b - a) * width))
                sums = [np.bincount(k, n, (b - a) * width)[key] for k, n in spread]
            else:
                key = np.unique(every)
                sums = [np.bincount(np.searchsorted(key, k), n, len(key)) for k, n in spread]
            yield key // width + a, key % width, np.array(sums).astype(np.int64)

    def counts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, topic, occurrences), without zeros."""
        some = [(text, topic, sums[0]) for text, topic, sums in self.summed([(data, bounds)])]
        return tuple(np.concatenate(x) for x in zip(*some, strict=True)) if some else (np.zeros(0, np.int64),) * 3


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All letters of a column (null: empty) and where each text starts, one more at the end."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, bounds - bounds[0]


def _slices(batch: pa.RecordBatch, columns: list[str]) -> Iterator[pa.RecordBatch]:
    size = np.zeros(batch.num_rows, np.int64)
    for c in columns:
        size += np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0), np.int64)
    part = np.cumsum(size) // SLICE
    at = np.flatnonzero(np.diff(part, prepend=-1, append=-1)).tolist()
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield batch.slice(a, b - a)


def keyword_counts(texts: DataFrame, columns: list[str], keywords: DataFrame) -> DataFrame:
    """video_id, topic_id and one count for each column, for topics with a keyword in any of them.

    ``texts`` has video_id and the columns (null: empty), ``keywords`` has topic_id and keyword; both are compared in
    lower case. A keyword that a topic lists twice counts twice; null and empty keywords never occur. Rows of ``texts``
    stay apart. The keywords are a table of any size: up to ``KEYWORDS`` of them travel with one pass.
    """
    reachable(texts.sparkSession)
    clean = cut_lineage(keywords.where("topic_id IS NOT NULL AND length(keyword) > 0").select("topic_id", F.lower("keyword").alias("keyword")))
    passes = max(1, -(-clean.count() // KEYWORDS))
    # a topic goes with one pass, so that it has one row for a text; only one of very many keywords is divided
    share = F.pmod(F.xxhash64("keyword"), F.ceil(F.col("listed") * 4 / KEYWORDS))
    clean = clean.join(clean.groupBy("topic_id").agg(F.count(F.lit(1)).alias("listed")), "topic_id")
    part = F.pmod(F.xxhash64("topic_id", share), F.lit(passes))
    kind = texts.schema["video_id"].dataType
    schema = T.StructType([T.StructField("video_id", kind), T.StructField("topic_id", T.StringType()),
                           *(T.StructField(c, T.LongType()) for c in columns)])
    lowered = texts.select("video_id", *(F.lower(F.col(c)).alias(c) for c in columns))
    found = None
    for p in range(passes):
        rows = clean.where(part == p).select("topic_id", "keyword").collect()
        names = sorted({r.topic_id for r in rows})
        number = {t: i for i, t in enumerate(names)}
        index = KeywordIndex([r.keyword for r in rows], [number[r.topic_id] for r in rows])

        def run(parts: Iterator[pa.RecordBatch], index=index, names=names) -> Iterator[pa.RecordBatch]:
            ids = pa.array(names, pa.string())
            for batch in parts:
                for some in _slices(batch, columns):
                    for text, topic, sums in index.summed([_bytes(some.column(c)) for c in columns]):
                        yield pa.RecordBatch.from_arrays(
                            [some.column("video_id").take(pa.array(text)), ids.take(pa.array(topic)), *(pa.array(x) for x in sums)],
                            ["video_id", "topic_id", *columns])

        one = lowered.mapInArrow(run, schema)
        found = one if found is None else found.unionByName(one)
    return found  # a topic of very many keywords can have several rows for a text
