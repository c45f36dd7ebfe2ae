"""Severity of toxic language: cumulative-link ordinal regression over sparse word features.

P(grade <= k) is the logistic of threshold k minus one weighted sum, so all thresholds share the
weights. Grades come from the toxic label and, among toxic rows, from how often words occur that
are far more common in toxic rows than in others. The model puts out the expected grade.
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

#: Labelled rows a model is fitted on at most, taken by the hash of their ids.
SAMPLE = 20_000
#: Words kept as features: those that tell toxic rows apart best.
FEATURES = 1024
#: Occurrences of telling words from which a toxic row has grade 2, and grade 3.
GRADES = (3, 8)
#: Labelled rows that must hold a word before it can be a feature.
SUPPORT = 5
#: A word tells when its log odds between toxic and other rows reach this.
TELLING = 3.0
#: Weight of the squared norm of the weights against the log likelihood of all rows.
RIDGE = 0.2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[np.r_[65:91, 97:123, 128:256]] = True


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of letters, A-Z lower-cased), and where each text starts."""
    data, bounds = batches.raw(column)
    starts, ends = batches.runs(_INSIDE[data], bounds)
    return batches.hashes(_LOWER[data], starts, ends).view(np.int64), np.searchsorted(starts, bounds)


@dataclass
class Ordinal:
    """Feature hashes (sorted), shared weights, and ascending thresholds."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def chances(self, sums: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - sums[:, None], -40, 40)))

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, occurrences) where a text holds a feature, in the order of the texts."""
        words, bounds = words_of(column)
        if not len(self.features) or not len(words):
            return (np.zeros(0, np.int64),) * 3
        at = np.minimum(np.searchsorted(self.features, words), len(self.features) - 1)
        hit = np.flatnonzero(self.features[at] == words)
        doc = np.searchsorted(bounds, hit, "right") - 1
        cell, count = np.unique(doc * len(self.features) + at[hit], return_counts=True)
        return cell // len(self.features), cell % len(self.features), count

    def sums(self, column: pa.Array) -> np.ndarray:
        """The weighted sum of log counts of each text's features."""
        doc, feature, count = self.counts(column)
        return np.bincount(doc, weights=np.log1p(count) * self.weights[feature], minlength=len(column))


def descend(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int, ridge: float = RIDGE, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model by adaptive full gradient descent.

    Thresholds are a first one and the logarithms of the gaps after it, so they stay in order.
    """
    n, levels = len(grades), int(grades.max())
    w = np.zeros(width)
    share = np.array([(grades <= k).mean() for k in range(levels)])
    start = np.log(share / (1 - share))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    first, second = np.zeros(width + levels), np.zeros(width + levels)
    for step in range(1, steps + 1):
        gaps = np.exp(free[1:])
        theta = free[0] + np.concatenate([[0], np.cumsum(gaps)])
        s = np.bincount(rows, weights=values * w[cols], minlength=n)
        low = np.where(grades > 0, 1 / (1 + np.exp(np.clip(s - theta[np.maximum(grades - 1, 0)], -40, 40))), 0.0)
        high = np.where(grades < levels, 1 / (1 + np.exp(np.clip(s - theta[np.minimum(grades, levels - 1)], -40, 40))), 1.0)
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p  # of the log likelihood, by the thresholds above and below
        d_theta = np.array([d_high[grades == k].sum() - d_low[grades == k + 1].sum() for k in range(levels)])
        d_free = np.concatenate([[d_theta.sum()], [d_theta[k + 1:].sum() * gaps[k] for k in range(levels - 1)]])
        d_w = np.bincount(cols, weights=values * (d_low - d_high)[rows], minlength=width) if width else np.zeros(0)
        grad = -np.concatenate([d_w, d_free]) / n + np.concatenate([2 * ridge / n * w, np.zeros(levels)])
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        move = 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-10)
        w, free = w - move[:width], free - move[width:]
    return w, free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))])


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Ordinal | None:
    """The model of a sample of labelled rows of bounded number; None where one class is missing."""
    chosen = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
              .select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample))
    plain = docs.select("doc_id", "text")
    # of equal texts one teaches; at most ``sample`` pairs of numbers are broadcast
    chosen = cut_lineage(plain.join(F.broadcast(cut_lineage(chosen)), "doc_id").groupBy(F.xxhash64("text"), "toxic").agg(F.min("doc_id").alias("doc_id"))
                         .select("doc_id", "toxic"))
    text = plain.join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    totals = {r["toxic"]: r["n"] for r in text.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return None

    def holding(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches.sliced(parts, "text", 8 * batches.SLICE):
            words, bounds = words_of(part.column("text"))
            doc = np.repeat(np.arange(part.num_rows), np.diff(bounds))
            word, at = np.unique(words, return_inverse=True)
            cell = np.unique(at * part.num_rows + doc)  # each word of a document once
            toxic = np.asarray(part.column("toxic"))[cell % part.num_rows] == 1
            a, b = (np.bincount(cell[x] // part.num_rows, minlength=len(word)) for x in (toxic, ~toxic))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (word, a, b)], ["word", "a", "b"])

    odds = F.log((F.col("a") + 0.5) / (totals[1] + 1.0)) - F.log((F.col("b") + 0.5) / (totals[0] + 1.0))
    top = (text.mapInArrow(holding, "word long, a long, b long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
           .where(F.col("a") + F.col("b") >= SUPPORT).withColumn("odds", odds)
           .withColumn("z", F.abs("odds") / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5)))
           .orderBy(F.desc("z"), "word").limit(features).select("word", "odds").collect())
    vocabulary = np.array(sorted(r["word"] for r in top), np.int64)
    tells = np.array(sorted(r["word"] for r in top if r["odds"] >= TELLING), np.int64)
    found = Ordinal(vocabulary, np.zeros(len(vocabulary)), np.zeros(1))

    def counting(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches.sliced(parts, "text"):
            doc, feature, count = found.counts(part.column("text"))
            sizes = np.cumsum(np.bincount(doc + 1, minlength=part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column("toxic"), *(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(x, pa.int32())) for x in (feature, count))],
                                             ["toxic", "feature", "count"])

    rows = text.mapInArrow(counting, "toxic int, feature array<int>, count array<int>").toArrow()  # bounded by sample and features
    toxic = np.asarray(rows["toxic"])
    at = np.repeat(np.arange(len(toxic)), np.asarray(pa.compute.list_value_length(rows["feature"])))
    feature, count = (np.asarray(pa.compute.list_flatten(rows[c])) for c in ("feature", "count"))
    heard = np.bincount(at, weights=count * np.isin(vocabulary, tells)[feature], minlength=len(toxic))
    grades = np.where(toxic == 1, 1 + (heard >= GRADES[0]) + (heard >= GRADES[1]), 0)
    grades = np.searchsorted(np.unique(grades), grades)  # without gaps
    weights, thresholds = descend(at, feature, np.log1p(count), grades, len(vocabulary))
    return Ordinal(vocabulary, weights, thresholds)


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: DataFrame | None = None, at: float = 0.25) -> DataFrame:
    """(doc_id, severity, chance, toxic) for every row of ``docs`` (doc_id, text).

    ``severity`` is the expected grade, ``chance`` that of any grade above 0, and ``toxic`` is 1 from
    ``at`` on. Labels are learned from ``learn`` (``docs`` if None) outside the held-out fifth. Null
    or empty texts hold no feature and get the score of that; with one class alone to learn from,
    all scores are 0. Rows may repeat; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs if learn is None else learn, labels))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinal = model.value
        for part in batches.sliced(parts, "text"):
            above = ordinal.chances(ordinal.sums(part.column("text"))) if ordinal else np.zeros((part.num_rows, 1))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array((above[:, 0] >= at).astype(np.int32))],
                                             ["doc_id", "severity", "chance", "toxic"])

    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(run, batches.schema_of(kept, ["doc_id"], "severity double, chance double, toxic int"))


def mild(docs: DataFrame, labels: DataFrame, at: float = 0.25) -> DataFrame:
    """The rows of ``docs``, with all columns, whose chance of being toxic stays under ``at``; learned as in ``score_toxicity``."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinal = model.value
        for part in batches.sliced(parts, "text"):
            yield part.filter(pa.array(ordinal.chances(ordinal.sums(part.column("text")))[:, 0] < at)) if ordinal else part

    return docs.mapInArrow(run, docs.schema)
