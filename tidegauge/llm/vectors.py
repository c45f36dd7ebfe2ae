"""Vectors inside a task: which rows count, matrices of a batch, blocks that meet, whole-number components and scores."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole numbers below this are exact in a double.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1
#: Components in a block at most, and the blocks that rows are dealt into before blocks grow.
CELLS, BLOCKS = 1 << 21, 64


def sound(vector: str) -> Column:
    """Neither null nor with a null, NaN or infinite component."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def doubles(vector: str) -> Column:
    """The vector as array<double>."""
    return F.col(vector).cast("array<double>")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of doubles; a shorter vector ends in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lens = np.asarray(pc.list_value_length(column), np.int64)
    flat = np.asarray(column.flatten(), np.float64)
    if len(lens) and (lens == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lens), dims))
    out[np.arange(dims) < lens[:, None]] = flat
    return out


def whole(m: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, for a scale that is a power of two: exact, as doubles hold such values whole.

    Components beyond 1e300 count as 1e300, so that the product stays finite.
    """
    return np.floor(np.clip(m, -1e300, 1e300) * scale)


def lengths(m: np.ndarray) -> np.ndarray:
    """Euclidean length of each row; infinite where it is beyond the doubles."""
    most = np.abs(m).max(1, initial=0.0)
    unit = m / np.where(most > 0, most, 1.0)[:, None]
    with np.errstate(over="ignore"):
        return most * np.sqrt((unit * unit).sum(1))


def scores(one: np.ndarray, many: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Integer inner products of one vector with each row, both of whole components.

    ``bound`` holds the product of the two lengths, which no partial sum exceeds: below 2^53 doubles are exact,
    beyond it Python's integers are used; a score beyond 64 bits counts as plus or minus 2^63 - 1.
    """
    narrow = bound < EXACT
    if narrow.all():
        return np.rint(many @ one).astype(np.int64)
    out = np.zeros(len(many), np.int64)
    out[narrow] = np.rint(many[narrow] @ one).astype(np.int64)
    ints = [int(x) for x in one.tolist()]
    for i in np.flatnonzero(~narrow).tolist():
        out[i] = max(-LONG, min(LONG, sum(a * int(b) for a, b in zip(ints, many[i].tolist(), strict=True))))
    return out


def cells(m: np.ndarray) -> bytes:
    return np.ascontiguousarray(m).tobytes()


def uncells(value: pa.Scalar, *shape: int, kind=np.float64) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind).reshape(shape)


def fitting(dims: int) -> int:
    """Vectors that a block has room for."""
    return max(1, CELLS // max(1, dims))


def block_size(count: int, dims: int, least: int) -> int:
    """Vectors in a block, ``least`` at least if they fit.

    Blocks grow with the table, so that what meets every block is copied to about ``BLOCKS`` of them.
    """
    return min(max(least, -(-count // BLOCKS)), fitting(dims))


def narrowed(m: np.ndarray) -> tuple[bytes, str]:
    """Whole numbers in the narrowest kind that holds them all, and that kind."""
    most = np.abs(m).max(initial=0)
    kind = next((k for k in ("<i2", "<i4") if most <= np.iinfo(k).max), m.dtype.str)
    return cells(m.astype(kind)), kind


def widened(value: pa.Scalar, kind: pa.Scalar, to: type = np.float64) -> np.ndarray:
    """What ``narrowed`` gave, as one row of numbers."""
    return np.frombuffer(value.as_buffer(), kind.as_py()).astype(to)


def meetings(asks: DataFrame, rows: DataFrame, keys: list[str], run: Callable[[pa.Table, pa.Table], list], names: list[str]) -> DataFrame:
    """Columns of longs: what ``run`` gives for the block of ``asks`` and the block of ``rows`` with the same keys.

    Both sides are shuffled by the keys. A join would broadcast one of them where its estimate is small, and Spark's
    estimate leaves out that a block is copied for each one it meets: all copies would pass through the driver.
    """
    def met(ask: pa.Table, row: pa.Table) -> pa.Table:
        found = run(ask, row) if ask.num_rows and row.num_rows else [[]] * len(names)
        return pa.table([pa.array(x, pa.int64()) for x in found], names)

    own = {k: f"met_{k}" for k in keys}  # names of their own, as both sides may hold columns of the same table
    return (asks.groupBy(*keys).cogroup(rows.withColumnsRenamed(own).groupBy(*own.values()))
            .applyInArrow(met, ", ".join(f"{x} long" for x in names)))


def records(m: np.ndarray) -> pa.Array:
    """Rows of bytes as a column of binaries."""
    m = np.ascontiguousarray(m)
    ends = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(m.tobytes())])


def record_bytes(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of binaries, each of ``width`` bytes, as rows of bytes."""
    column = column.combine_chunks()
    _, ends, data = column.buffers()
    first = np.frombuffer(ends, np.int32)[column.offset] if len(column) else 0
    return np.frombuffer(data, np.uint8)[first:first + len(column) * width].reshape(-1, width) if len(column) else np.zeros((0, width), np.uint8)
