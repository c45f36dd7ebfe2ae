"""Language of a text: bit-sliced Bloom filters of letter n-grams, one bit per language.

Row j of the filter is a word with a bit for each language. An n-gram is put into the filters of
the languages in which it is more common than on average, under the same few rows for all of them;
looked up, the bitwise AND of its rows tells at once all languages that hold it. Per language the
bits are counted over the n-grams of a text, the count expected from chance hits is taken off, and
the largest remainder decides.

n-grams are runs of three and four bytes of a word with its edges; A-Z are lower-cased, and every
byte that is no letter (nor part of one) is an edge.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import batches
from tidegauge.llm.quality import held_out
from tidegauge.session import cut_lineage

#: Rows of the filter as a power of two: 8 MB for each 64 languages, whatever the corpus.
ROWS_LOG2 = 20
#: Rows an n-gram is put under.
PROBES = 3
#: How often an n-gram must occur in a language at least, and how many times the mean over languages.
LEAST, LIFT = 3, 1.25

_LETTER = np.full(256, 32, np.uint32)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """n-gram codes of all texts one after the other, and where each text starts (one more at the end)."""
    data, bounds = batches.raw(column)
    edges = np.arange(len(bounds))
    padded = np.full(len(data) + len(bounds), 32, np.uint32)
    padded[np.arange(len(data)) + np.repeat(edges[1:], np.diff(bounds))] = _LETTER[data]
    padded = np.concatenate([padded, np.full(3, 32, np.uint32)])
    blank = padded == 32
    size = len(data) + len(bounds) - 1
    a, b, c, d = (padded[k:size + k] for k in range(4))
    three = ~blank[1:size + 1]
    four = three & ~blank[2:size + 2]
    code3, code4 = a << 16 | b << 8 | c, a << 24 | b << 16 | c << 8 | d
    codes = np.empty(2 * size, np.uint32)
    codes[0::2], codes[1::2] = code3, code4
    used = np.empty(2 * size, bool)
    used[0::2], used[1::2] = three, four
    starts = np.concatenate([[0], np.cumsum(used, dtype=np.int64)])[2 * (bounds + edges)[:-1]] if size else np.zeros(len(bounds) - 1, np.int64)
    return codes[used], np.concatenate([starts, [int(used.sum())]])


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    values, at = np.unique(codes, return_inverse=True)
    return values, np.bincount(at, weights=counts).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, code, c): occurrences of each n-gram by language, summed within each task first."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list] = {}
        for part in batches.sliced(parts, "text"):
            codes, bounds = grams(part.column("text"))
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in set(langs.tolist()):
                mine = np.flatnonzero(langs == lang)
                own = batches.gather(codes, bounds[:-1][mine], np.diff(bounds)[mine])
                kept.setdefault(lang, []).append(np.unique(own, return_counts=True))
                if len(kept[lang]) >= 32:
                    kept[lang] = [_counted(kept[lang])]
        for lang, found in kept.items():
            values, counts = _counted(found)
            for at in range(0, len(values), 50_000):
                some = values[at:at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int64)), pa.array(counts[at:at + 50_000])],
                                                 ["lang", "code", "c"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, code long, c long").groupBy("lang", "code").agg(F.sum("c").alias("c"))


def places(codes: np.ndarray, rows_log2: int, probes: int) -> np.ndarray:
    """The filter rows of each n-gram, one column per probe."""
    h = batches.mixed(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = batches.mixed(h) | np.uint64(1)
    return np.stack([((h + np.uint64(k) * step) >> np.uint64(64 - rows_log2)).astype(np.int64) for k in range(probes)], 1)


@dataclass
class Filters:
    """Languages by bit, filter rows (one column per 64 languages), and each language's rate of chance hits."""

    langs: list[str]
    rows: np.ndarray
    chance: np.ndarray
    probes: int
    rows_log2: int

    def found(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        codes, bounds = grams(column)
        n = np.diff(bounds)
        counts = np.zeros((len(n), len(self.langs)))
        if len(codes):
            at = places(codes, self.rows_log2, self.probes)
            mask = self.rows[at[:, 0]]
            for k in range(1, self.probes):
                mask &= self.rows[at[:, k]]
            for i in range(len(self.langs)):
                bit = (mask[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                counts[:, i] = np.diff(np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])[bounds])
        true = np.maximum((counts - n[:, None] * self.chance) / (1 - self.chance), 0)
        best = true.argmax(1)
        total = true.sum(1)
        score = np.where(total > 0, true[np.arange(len(n)), best] / np.where(total > 0, total, 1), 0)
        return [self.langs[i] for i in best], score


def fitted(docs: DataFrame, rows_log2: int = ROWS_LOG2, probes: int = PROBES) -> Filters | None:
    """Filters learned from (text, lang); the driver receives the filter's rows, whose number is fixed."""
    counts = cut_lineage(gram_counts(docs))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("c").alias("n")).collect()}
    if not totals:
        return None
    langs = sorted(totals)
    spark = docs.sparkSession
    known = spark.createDataFrame([(lang, i, float(totals[lang])) for i, lang in enumerate(langs)], "lang string, bit int, n double")
    rates = counts.join(known, "lang").select("code", "bit", "c", (F.col("c") / F.col("n")).alias("rate"))
    means = rates.groupBy("code").agg((F.sum("rate") / len(langs)).alias("mean"))
    marks = (rates.join(means, "code").where((F.col("c") >= LEAST) & ((F.col("rate") >= LIFT * F.col("mean")) | F.lit(len(langs) == 1)))
             .groupBy("code", F.floor(F.col("bit") / 64).cast("int").alias("slice"))
             .agg(F.expr("bit_or(shiftleft(1L, bit % 64))").alias("mask")))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = places(np.asarray(part.column("code")), rows_log2, probes)
            for k in range(probes):
                yield pa.RecordBatch.from_arrays([part.column("slice"), pa.array(at[:, k]), part.column("mask")], ["slice", "at", "mask"])

    rows = np.zeros((1 << rows_log2, -(-len(langs) // 64)), np.uint64)
    table = marks.mapInArrow(run, "slice int, at long, mask long").groupBy("slice", "at").agg(F.bit_or("mask").alias("mask")).toArrow()
    rows[np.asarray(table["at"]), np.asarray(table["slice"])] = np.asarray(table["mask"]).view(np.uint64)
    fill = np.array([((rows[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))])
    return Filters(langs, rows, np.minimum(fill ** probes, 0.999), probes, rows_log2)


def identify(docs: DataFrame, learn: DataFrame, rows_log2: int = ROWS_LOG2, probes: int = PROBES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text).

    Filters are learned from the rows of ``learn`` (doc_id, text, lang) with a non-null lang outside
    the held-out fifth. A null text, or one without a letter, is ``und`` with score 0; so is every
    text when there is nothing to learn from. A text with letters of which no n-gram is known gets
    the first language with score 0. Ties go to the first language by name. Rows may repeat.
    """
    filters = fitted(learn.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()), rows_log2, probes)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in batches.sliced(parts, "text"):
            texts = part.column("text")
            langs, scores = model.found(texts) if model else (["und"] * part.num_rows, np.zeros(part.num_rows))
            lettered = pa.compute.match_substring_regex(texts.fill_null(""), r"\pL").to_pylist()
            langs = [lang if has else "und" for lang, has in zip(langs, lettered, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(np.where(lettered, scores, 0.0))], ["doc_id", "lang_pred", "score"])

    kept = docs.select("doc_id", "text")
    found = kept.mapInArrow(run, batches.schema_of(kept, ["doc_id"], "lang_pred string, score double"))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
