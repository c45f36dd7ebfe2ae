"""Near duplicates of vectors by a subspace pigeonhole join.

Unit vectors with cosine c or more lie within a squared distance of 2 - 2c. After a rotation that
spreads the length evenly, the coordinates are cut into blocks of a few dimensions; if two vectors
are that near, at least one block lies within its share (in proportion to its dimensions) of the
squared distance. So each block is range-joined under its share, and what any block finds is
verified by the cosine itself, in double precision. None is lost, whatever the data.

The range join of a block is an equi-join on cells. The first coordinates of the block are cut at
their means, one bit each; a vector lives in the cell of its bits and visits the cells that it
could share with a partner: two vectors whose bits differ in some coordinates are apart by the sum of
their distances to those cuts, coordinate by coordinate, so for one of the two the squared distances add
up to half the block's share at most, and that one visits. The number of bits grows with the number of
vectors, which keeps cells at about ``CELL`` of them. A cell above ``RESIDENTS`` or ``VISITORS`` is dealt by hash, part meeting part.

Equal vectors are one class from the start. Pairs are counted where they are found and never
written: a task puts out, for each class it saw linked, the number of links and one edge of a tree
over those it joined. A pair counts in the first block that finds it, once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import vectors as V
from tidegauge.llm.components import connected
from tidegauge.session import cut_lineage

#: Dimensions of a block, about; vectors aimed at in a cell, and bits at most.
WIDTH, CELL, BITS = 16, 4096, 16
#: Vectors of a cell in one task: those that live in it, and those that visit it.
RESIDENTS, VISITORS = 4096, 16384
#: Vectors met at a time by a matrix product, and pairs verified at a time.
TILE, PAIRS = 256, 1 << 16


class Layout:
    """Rotation, blocks and cuts of a table of vectors; everything is computed element by element in a fixed order,
    so that a vector has the same coordinates in every batch and on every machine."""

    def __init__(self, dims: int, cosine: float, bits: int = 0, cuts: np.ndarray | None = None):
        self.dims = dims
        self.size = 1 << max(0, dims - 1).bit_length()
        rng = np.random.default_rng(12)
        self.signs = [rng.choice((-1.0, 1.0), self.size) for _ in range(2)]
        self.edges = np.linspace(0, self.size, max(1, round(self.size / WIDTH)) + 1).astype(int)
        self.blocks = len(self.edges) - 1
        # a little more than the share, as the coordinates are rounded
        self.shares = (2 - 2 * cosine) * np.diff(self.edges) / self.size * (1 + 1e-9) + 1e-12
        self.bits = min(bits, BITS, int(np.diff(self.edges).min()))
        self.cuts = np.zeros(self.size) if cuts is None else cuts

    def rotated(self, m: np.ndarray) -> np.ndarray:
        """Unit vectors along the rows, turned by two rounds of random signs and a Hadamard transform."""
        out = np.zeros((len(m), self.size))
        out[:, :self.dims] = m
        total = np.zeros(len(m))
        for k in range(self.dims):
            total += out[:, k] * out[:, k]
        out /= np.sqrt(total)[:, None]
        for signs in self.signs:
            out *= signs
            h = 1
            while h < self.size:
                pairs = out.reshape(len(m), -1, 2, h)
                out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(m), self.size)
                h *= 2
            out /= np.sqrt(self.size)
        return out

    def codes(self, r: np.ndarray, block: int) -> np.ndarray:
        """The cell of each vector in a block."""
        code = np.zeros(len(r), np.int64)
        for k in range(self.bits):
            at = self.edges[block] + k
            code |= (r[:, at] >= self.cuts[at]).astype(np.int64) << k
        return code

    def visits(self, r: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every cell that a vector visits, its own first."""
        row, code, far = np.arange(len(r)), self.codes(r, block), np.zeros(len(r))
        reach = self.shares[block] / 2
        for k in range(self.bits):
            at = self.edges[block] + k
            more = far + (r[row, at] - self.cuts[at]) ** 2
            near = more <= reach
            row, code, far = np.concatenate([row, row[near]]), np.concatenate([code, code[near] ^ (1 << k)]), np.concatenate([far, more[near]])
        return row, code

    def reaches(self, r: np.ndarray, own: np.ndarray, other: np.ndarray, block: int) -> np.ndarray:
        """Whether each vector, of cell ``own``, visits the cell ``other``."""
        far = np.zeros(len(r))
        for k in range(self.bits):
            at = self.edges[block] + k
            far = np.where((own ^ other) >> k & 1, far + (r[:, at] - self.cuts[at]) ** 2, far)
        return far <= self.shares[block] / 2

    def apart(self, a: np.ndarray, b: np.ndarray, block: int) -> np.ndarray:
        """Squared distance within a block, row by row."""
        out = np.zeros(len(a))
        for k in range(self.edges[block], self.edges[block + 1]):
            out += (a[:, k] - b[:, k]) ** 2
        return out


def tamed(m: np.ndarray) -> np.ndarray:
    """Rows scaled by a power of two, which is exact, so that no square leaves the doubles."""
    most = np.abs(m).max(1, initial=0.0)
    return np.ldexp(m, -np.frexp(most)[1][:, None])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of the rows of two matrices, in double precision."""
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place each of n places is joined with by the pairs."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        np.minimum.at(label, before, label)
        label = label[label]
        if (label == before).all():
            return label


def meet(layout: Layout, cosine: float, block: int, cell: int, node: np.ndarray, weight: np.ndarray, m: np.ndarray, part: np.ndarray,
         lives: np.ndarray):
    """(node, links, root) of those linked, when residents of a cell (``lives``) meet its visitors.

    ``part`` holds the coordinates of the block in single precision, which find candidates with room to spare.
    """
    half = (part * part).sum(1) / 2
    one = np.ones(len(m), np.float32)
    # a.b - |a|^2/2 - |b|^2/2 is minus half the squared distance
    at, to = np.flatnonzero(lives), np.flatnonzero(~lives)
    left, right = np.column_stack([part, -half, one])[at], np.column_stack([part, one, -half])[to].T.copy()
    least = np.float32(-layout.shares[block] / 2 - 1e-5)
    links = np.zeros(len(m), np.int64)
    pairs = []
    for x in range(0, len(at), TILE):
        i, j = np.nonzero(left[x:x + TILE] @ right >= least)
        i, j = at[x + i], to[j]
        keep = node[i] != node[j]
        i, j = i[keep], j[keep]
        for y in range(0, len(i), PAIRS):
            a, b = i[y:y + PAIRS], j[y:y + PAIRS]
            used, ab = np.unique(np.concatenate([a, b]), return_inverse=True)
            r = layout.rotated(m[used])
            ra, rb = r[ab[:len(a)]], r[ab[len(a):]]
            fine = layout.apart(ra, rb, block) <= layout.shares[block]
            for earlier in range(block):
                fine &= layout.apart(ra, rb, earlier) > layout.shares[earlier]
            fine[fine] = cosines(m[a[fine]], m[b[fine]]) >= cosine
            a, b, ra, rb = a[fine], b[fine], ra[fine], rb[fine]
            # the resident counts the pair here; the visitor does too if the resident does not visit its cell
            alone = ~layout.reaches(ra, np.full(len(a), cell), layout.codes(rb, block), block)
            links += np.bincount(a, weight[b], len(m)).astype(np.int64) + np.bincount(b[alone], weight[a][alone], len(m)).astype(np.int64)
            if len(a):
                up = roots(len(m), a, b)
                low = np.flatnonzero(up != np.arange(len(m)))
                pairs.append((low, up[low]))
    if not pairs:
        return node[:0], links[:0], node[:0]
    seen = np.unique(np.concatenate([y for p in pairs for y in p]))
    up = roots(len(m), *(np.concatenate(y) for y in zip(*pairs, strict=True)))
    return node[seen], links[seen], node[up[seen]]


def links(classes: DataFrame, dims: int, count: int, cosine: float) -> DataFrame:
    """(node, links, root) for linked classes, a row for each task that saw them; ``classes`` has node, weight and v."""
    flat = Layout(dims, cosine)

    def summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(flat.size)
        for p in parts:
            if p.num_rows:
                total += flat.rotated(tamed(V.matrix(p.column("v"), dims))).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(flat.size), pa.int32()), pa.array(total)], ["at", "total"])

    means = np.zeros(flat.size)  # one number for each dimension; where the cuts lie decides speed, never a result
    for at, total in classes.select("v").mapInArrow(summed, "at int, total double").groupBy("at").agg(F.sum("total")).collect():
        means[at] = total / max(count, 1)
    layout = Layout(dims, cosine, max(0, int(np.ceil(np.log2(max(count, 1) / CELL)))), means)

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << layout.bits
        found = np.zeros((layout.blocks, 2, size), np.int64)
        for p in parts:
            r = layout.rotated(tamed(V.matrix(p.column("v"), dims))) if p.num_rows else None
            for b in range(layout.blocks if p.num_rows else 0):
                found[b, 0] += np.bincount(layout.codes(r, b), minlength=size)
                found[b, 1] += np.bincount(layout.visits(r, b)[1], minlength=size)
        b, cell = np.nonzero(found[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (b, cell, found[b, 0, cell], found[b, 1, cell])], ["part", "cell", "live", "visit"])

    counts = (classes.select("v").mapInArrow(counted, "part long, cell long, live long, visit long").groupBy("part", "cell")
              .agg(F.sum("live").alias("live"), F.sum("visit").alias("visit")).where((F.col("live") > RESIDENTS) | (F.col("visit") > VISITORS)))
    # only cells above the bounds, of blocks * 2^bits at most
    large = {(r.part, r.cell): (-(-r.live // RESIDENTS) or 1, -(-r.visit // VISITORS)) for r in counts.collect()}
    cut = np.array(sorted(p << BITS | c for p, c in large), np.int64)
    by = np.array([large[c >> BITS, c & ((1 << BITS) - 1)] for c in cut.tolist()], np.int64).reshape(-1, 2)

    # a copy of a vector is a record: the vector as given, then its coordinates in the block in single precision
    kind = np.float32 if classes.schema["v"].dataType.elementType.simpleString() == "float" else np.float64
    own_bytes = np.dtype(kind).itemsize * dims

    def placed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            if not p.num_rows:
                continue
            node, weight = (np.asarray(p.column(c)) for c in ("node", "weight"))
            m = V.matrix(p.column("v"), dims)
            r = layout.rotated(tamed(m))
            own = m.astype(kind).view(np.uint8)
            mixed = node * np.int64(0x5851F42D4C957F2D) >> 33
            for b in range(layout.blocks):
                block = np.concatenate([own, r[:, layout.edges[b]:layout.edges[b + 1]].astype(np.float32).view(np.uint8)], 1)
                for lives, (row, cell) in ((True, (np.arange(len(r)), layout.codes(r, b))), (False, layout.visits(r, b))):
                    key = b << BITS | cell
                    at = np.minimum(np.searchsorted(cut, key), max(len(cut) - 1, 0))
                    is_cut = cut[at] == key if len(cut) else np.zeros(len(key), bool)
                    n_live, n_visit = np.ones(len(key), np.int64), np.ones(len(key), np.int64)
                    n_live[is_cut], n_visit[is_cut] = by[at[is_cut]].T
                    mine, times = (n_live, n_visit) if lives else (n_visit, n_live)
                    again = np.repeat(np.arange(len(key)), times)
                    other = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
                    home, row, key = (mixed[row] % mine)[again], row[again], key[again]
                    for x in range(0, len(row), 4096):
                        s = slice(x, x + 4096)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(y[s]) for y in (key, home if lives else other, other if lives else home, np.full(len(row), lives), node[row], weight[row])]
                            + [V.records(block[row[s]])], ["cell", "live_part", "visit_part", "lives", "node", "weight", "record"])

    spread = classes.select("node", "weight", "v").mapInArrow(
        placed, "cell long, live_part long, visit_part long, lives boolean, node long, weight long, record binary")

    def met(group: pa.Table) -> pa.Table:
        key = group["cell"][0].as_py()
        lives = np.asarray(group["lives"].combine_chunks().to_numpy(zero_copy_only=False), bool)
        node, weight = (np.asarray(group[c]) for c in ("node", "weight"))
        found = (node[:0],) * 3
        if lives.any():
            block = key >> BITS
            rows = V.record_bytes(group["record"], own_bytes + 4 * int(layout.edges[block + 1] - layout.edges[block]))
            m, part = (np.ascontiguousarray(x).view(k) for x, k in ((rows[:, :own_bytes], kind), (rows[:, own_bytes:], np.float32)))
            found = meet(layout, cosine, block, key & ((1 << BITS) - 1), node, weight, tamed(m.astype(np.float64)), part, lives)
        return pa.table(dict(zip(("node", "links", "root"), (pa.array(x, pa.int64()) for x in found), strict=True)))

    return spread.groupBy("cell", "live_part", "visit_part").applyInArrow(met, "node long, links long, root long")


def near_vectors(rows: DataFrame, cosine: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for each row of ``rows`` (vec_id, embedding).

    Two vectors link when their cosine, in double precision, is at least ``cosine``. ``n_links`` counts the other
    rows linked directly, ``component_id`` is the smallest vec_id reachable by links, the own one included, and
    ``kept`` tells whether that is the row's own. Vectors that are null, empty, zero, or hold a null, NaN or infinite
    component link with nothing; so do rows with a null vec_id, whose component is null and which are kept. Shorter
    vectors are filled up with zeros. A row that occurs several times, or an id with several vectors, counts row by
    row: copies link with each other. Other columns are ignored; an empty table gives no rows.
    """
    usable = F.col("vec_id").isNotNull() & V.sound("embedding")
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable & F.exists("embedding", lambda x: x != 0), F.col("embedding")).alias("v"))
    # equal vectors are one class; its number is fixed by writing it
    classes = cut_lineage(base.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
                          .withColumn("node", F.monotonically_increasing_id()))
    count, dims = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    found = cut_lineage(links(classes, dims or 1, count, cosine))
    component = connected(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    totals = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = classes.join(totals, "node", "left").join(component, "node", "left").select(
        "v", "least", "weight", "links", F.coalesce("component", "node").alias("component"))
    lowest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    known = joined.join(lowest, "component").select("v", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    return base.join(known, "v", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"))
