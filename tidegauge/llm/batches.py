"""Array work on batches of texts inside a task: slices of bounded size, words, hashes, gathers."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidegauge.session import prepare

#: Bytes of text handled at a time; a single longer text is one slice of its own.
SLICE = 1 << 20
#: Records Spark hands to Python at a time, so that a batch of long texts stays small.
RECORDS = 512


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: those of the library, small Arrow batches, and shuffle files deleted with their query."""
    spark = prepare(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(RECORDS))
    root = str(Path(__file__).resolve().parents[2])  # workers on this machine find the package as the driver does
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [paths, root]))
    return spark


def schema_of(df: DataFrame, kept: list[str], *new: str) -> T.StructType:
    """Schema of kept columns followed by new ones given as DDL."""
    out = T.StructType([df.schema[c] for c in kept])
    for ddl in new:
        for field in T._parse_datatype_string(ddl).fields:
            out = out.add(field)
    return out


def sliced(parts: Iterator[pa.RecordBatch], text: str | None, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text."""
    for part in parts:
        if part.num_rows == 0:
            continue
        if text is None:
            yield part
            continue
        ends = np.cumsum(np.asarray(pc.binary_length(part.column(text)).fill_null(0), np.int64))
        at = 0
        while at < part.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield part.slice(at, to - at)
            at = to


def packed(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each item, and all bytes in one array."""
    lens = np.array([len(x) for x in items], np.int64)
    return np.cumsum(lens) - lens, lens, np.frombuffer(b"".join(items), np.uint8)


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The runs (start, length) of an array, one after the other."""
    if not len(starts):
        return flat[:0]
    ends = np.cumsum(lens)
    index = np.arange(ends[-1], dtype=np.int64)
    index += np.repeat(starts - (ends - lens), lens)
    return flat[index]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of strings (null: empty), and where each starts (one more at the end)."""
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of marked bytes; a run never crosses from one text to the next."""
    size = len(inside)
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    firsts = bounds[:-1][bounds[:-1] < bounds[1:]]
    start[firsts] = inside[firsts]
    lasts = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    end[lasts] = inside[lasts]
    assert size == len(start)
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply, shift) over unsigned integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draws(seed: int, n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = _draws(11, 256) | np.uint64(1)
_PLACE = _draws(12, 1 << 12) | np.uint64(1)
_FAR = _draws(13, 1 << 16) | np.uint64(1)
_FAR[0] = 1  # the first places weigh the same whether or not a batch holds a long run
_ORDER = _draws(14, 64) | np.uint64(1)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes: random weights by byte and by place, summed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    total = int(lens.sum())
    place = np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(lens) - lens, lens)
    weight = _BYTE[data[place + np.repeat(starts, lens)]]
    weight *= _PLACE[place & 0xFFF]
    if int(lens.max()) > 0x1000:
        weight *= _FAR[(place >> 12) & 0xFFFF]
    return mixed(np.add.reduceat(weight, np.cumsum(lens) - lens) + lens.astype(np.uint64))


def chained(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbouring words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out += words[k:len(words) - n + 1 + k] * _ORDER[k]
    return mixed(out)
