"""Quality of documents: a regularised quadratic discriminant over statistics of the text.

Each document becomes a short vector of transformed statistics. One aggregate over the labelled
rows gives count, mean and covariance of both classes; the covariances are shrunk towards the
pooled one and towards a sphere, and factored once. A score is the logistic of the difference of
two log densities, each a Mahalanobis distance by forward substitution with the kept factor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import batches
from tidegauge.session import cut_lineage

STATISTICS = ["words", "word_length", "length_spread", "capitals", "symbols", "stops", "digits", "repeats", "echoes", "bare", "short", "lines"]
#: Shares by which a class covariance moves to the pooled one and to a sphere.
TO_POOLED, TO_SPHERE = 0.3, 0.05
#: Log density differences are divided by this before the logistic, as the statistics hang together; the sign stays.
SOFTER = 12.0
#: Beyond this a difference counts as certain.
CERTAIN = 30.0

_KIND = np.zeros(256, np.uint8)  # 0 symbol, 1 letter, 2 digit, 3 blank, 4 stop, 5 middle of a letter
_KIND[np.r_[65:91, 97:123, 192:256]] = 1
_KIND[48:58] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_KIND[[33 + 1, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 4
_KIND[128:192] = 5
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds]


def statistics(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text; an empty or null text gives zeros."""
    data, bounds = batches.raw(column)
    kind = _KIND[data]
    starts, ends = batches.runs(kind != 3, bounds)
    first = np.searchsorted(starts, bounds)
    words = np.diff(first).astype(float)
    per_word = np.maximum(words, 1)
    letters_to = np.concatenate([[0], np.cumsum(kind != 5, dtype=np.int64)])  # letters, whatever their bytes
    lens = letters_to[ends] - letters_to[starts]
    hashed = batches.hashes(data, starts, ends)
    same = {}
    for step in (1, 2):
        flag = np.zeros(len(starts), bool)
        flag[step:] = hashed[step:] == hashed[:-step]
        for k in range(step):
            inside = first[:-1] + k
            flag[inside[inside < first[1:]]] = False
        same[step] = np.diff(_sums(flag, first))
    alnum = np.concatenate([[0], np.cumsum((kind == 1) | (kind == 2), dtype=np.int64)])
    bare = np.diff(_sums(alnum[ends] == alnum[starts], first))
    count = {k: np.diff(_sums(kind == k, bounds)) for k in (0, 1, 2, 4)}
    chars = np.maximum(np.diff(letters_to[bounds]), 1)
    total = np.diff(_sums(lens, first))
    mean = total / per_word
    spread = np.sqrt(np.maximum(np.diff(_sums(lens * lens, first)) / per_word - mean * mean, 0))
    upper = np.diff(_sums(_UPPER[data], bounds))
    out = [np.log1p(words), np.log1p(mean), np.log1p(spread), np.sqrt(upper / np.maximum(count[1], 1)), np.sqrt(count[0] / chars),
           np.sqrt(count[4] / chars), np.sqrt(count[2] / chars), np.sqrt(same[1] / per_word), np.sqrt(same[2] / per_word),
           np.sqrt(bare / per_word), np.sqrt(np.diff(_sums(lens <= 3, first)) / per_word), np.sqrt(np.diff(_sums(data == 10, bounds)) / per_word)]
    return np.stack(out, 1)


@dataclass
class Discriminant:
    """Class means, factors of the inverse covariances, and the constant of the log density ratio."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray] | None = None
    factors: tuple[np.ndarray, np.ndarray] | None = None
    constant: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """How likely each row is of class 1; one half where the model saw fewer than two classes."""
        if self.means is None:
            return np.full(len(x), 0.5)
        z = (x - self.centre) / self.scale
        away = [(((z - m) @ f.T) ** 2).sum(1) for m, f in zip(self.means, self.factors, strict=True)]
        return 1 / (1 + np.exp(-np.clip((self.constant + (away[0] - away[1]) / 2) / SOFTER, -CERTAIN, CERTAIN)))


def fitted(rows: DataFrame, label: str, to_pooled: float = TO_POOLED, to_sphere: float = TO_SPHERE) -> Discriminant:
    """The discriminant of rows (statistics, label 0 or 1): two rows of sums come to the driver."""
    d = len(STATISTICS)
    x = [F.col("x")[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = (rows.where(F.col(label).isin(0, 1)).groupBy(label)
            .agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in x]).alias("s"), F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("p")))
    found = {r[label]: r for r in sums.collect()}
    if len(found) < 2:
        return Discriminant(np.zeros(d), np.ones(d))
    means, covs, counts = [], [], []
    for k in (0, 1):
        n, m = found[k]["n"], np.array(found[k]["s"]) / found[k]["n"]
        p = np.zeros((d, d))
        for (i, j), v in zip(pairs, found[k]["p"], strict=True):
            p[i, j] = p[j, i] = v
        means.append(m)
        covs.append(p / n - np.outer(m, m))
        counts.append(n)
    share = np.array(counts) / sum(counts)
    pooled = share[0] * covs[0] + share[1] * covs[1]
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    centre = share[0] * means[0] + share[1] * means[1]
    factors, logs = [], []
    for c in covs:
        c = ((1 - to_pooled) * c + to_pooled * pooled) / np.outer(scale, scale)
        c = (1 - to_sphere) * c + to_sphere * max(np.trace(c) / d, 1e-3) * np.eye(d)
        root = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(root))
        logs.append(2 * np.log(np.diag(root)).sum())
    return Discriminant(centre, scale, tuple((m - centre) / scale for m in means), tuple(factors), float(np.log(share[1] / share[0]) + (logs[0] - logs[1]) / 2))


def held_out(column: str = "doc_id"):
    """Whether a document's label is kept from training: CRC-32 of its id as text, modulo five."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", at: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    Only text enters a score. Labels are learned from the rows outside the held-out fifth; null
    labels are not used, a document labelled more than once counts as often. A null text counts as
    an empty one, an empty one has a score like any other, and rows with a null doc_id are scored
    but teach nothing. With fewer than two classes to learn from, every score is one half.
    """
    rows = _measured(docs)
    model = _learned(rows, labels, label)

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = np.asarray(part.column("x").flatten()).reshape(part.num_rows, -1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(x))], ["doc_id", "score"])

    scored = rows.mapInArrow(judge, batches.schema_of(rows, ["doc_id"], "score double"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))


def good(docs: DataFrame, labels: DataFrame, label: str = "quality", at: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all columns, that score at least ``at``; learned as in ``score_quality``."""
    model = _learned(_measured(docs), labels, label)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches.sliced(parts, "text"):
            yield part.filter(pa.array(model.scores(statistics(part.column("text"))) >= at))

    return docs.mapInArrow(run, docs.schema)


def _measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every row, written once."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches.sliced(parts, "text"):
            x = statistics(part.column("text"))
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), cells], ["doc_id", "x"])

    kept = docs.select("doc_id", "text")
    return cut_lineage(kept.mapInArrow(run, batches.schema_of(kept, ["doc_id"], "x array<double>")))


def _learned(rows: DataFrame, labels: DataFrame, label: str) -> Discriminant:
    known = labels.where(F.col(label).isNotNull() & ~held_out()).select("doc_id", F.col(label).alias("label"))
    return fitted(rows.join(known, "doc_id"), "label")
