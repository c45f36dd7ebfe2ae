"""Exact top-k by inner product: branch and bound over vectors in vertical layout.

Vectors are packed into blocks, each a matrix of dimensions by vectors. A block of queries meets a
block of candidates in one task; scores grow by one group of dimensions at a time. After each group
what is still to come is bounded by the product of the remaining lengths of the two vectors
(Cauchy-Schwarz); candidates that cannot reach the k-th best sure score are dropped and the rest is
compacted. The best k of every meeting are merged per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm import vectors as V
from tidegauge.session import cut_lineage

#: Candidates in a block, about, while the table is small; dimensions accumulated between two compactions.
BLOCK, STEP = 4096, 16


def packed(vectors: DataFrame, blocks: int) -> DataFrame:
    """(block, ids, cells, kind, dims): the vectors of each block, dimension after dimension, in the narrowest kind of number.

    Blocks hold vectors by the hash of their row number, as many in each, about, whatever their ids.
    """
    def run(block: pa.Table) -> pa.Table:
        ids = np.asarray(block["id"])
        dims = max(1, pc.max(pc.list_value_length(block["v"])).as_py())
        order = np.argsort(ids)
        cells, kind = V.narrowed(V.matrix(block["v"], dims)[order].T)  # whole numbers below 2^31
        return pa.table({"block": block["block"][:1], "ids": pa.array([ids[order]], pa.list_(pa.int64())), "cells": pa.array([cells], pa.binary()),
                         "kind": pa.array([kind]), "dims": pa.array([dims], pa.int32())})

    return (vectors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
            .groupBy("block").applyInArrow(run, "block long, ids array<long>, cells binary, kind string, dims int"))


def best(queries: np.ndarray, query_ids: np.ndarray, cells: np.ndarray, ids: np.ndarray, k: int, step: int = STEP):
    """The k best candidates of each query, as (query id, candidate id, score); ids ascend.

    ``queries`` and ``cells`` are matrices of dimensions by vectors.
    """
    dims = min(len(queries), len(cells))
    edges = [*range(0, dims, step), dims]

    def remaining(m: np.ndarray) -> np.ndarray:  # length of what follows each group, a little more to be safe
        return np.stack([np.sqrt((m[e:dims].astype(float) ** 2).sum(0)) * (1 + 1e-9) for e in edges[1:]])

    rest, own_rest = remaining(cells), remaining(queries)
    for j, query_id in enumerate(query_ids.tolist()):
        alive = np.flatnonzero(ids != query_id)
        score = np.zeros(len(alive), np.int64)
        for g, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            block = cells[a:b] if len(alive) == cells.shape[1] else cells[a:b, alive]
            score = score + queries[a:b, j] @ block
            if len(alive) > k:
                slack = own_rest[g, j] * rest[g, alive]
                sure = np.partition(score - slack, len(alive) - k)[len(alive) - k]
                keep = score + slack >= sure
                if not keep.all():
                    alive, score = alive[keep], score[keep]
        order = np.lexsort((ids[alive], -score))[:k]
        for i in order.tolist():
            yield query_id, int(ids[alive[i]]), int(score[i])


def nearest(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query.

    ``vectors`` has vec_id and embedding; a component x counts as floor(256 x), x as double. Queries
    are the ids where ``is_query`` holds; candidates are all rows with another id. Vectors that are
    null, hold a null, NaN or infinite component, or have a null id take no part; vectors of unequal
    length, empty ones too, are filled up with zeros. A row is a candidate as often as it stands, also
    if its id has several vectors; an id asks once, with its smallest vector. Ties go to the smaller id.
    Fewer than k candidates give fewer rows. Components so large that a score could leave 62 bits are
    refused with an error.
    """
    sound = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = cut_lineage(vectors.where(sound).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"),
                                                    F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v")))
    asking = cut_lineage(whole.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v")).withColumn("row", F.col("id")))
    n, dims, most = whole.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.greatest(*(F.abs(m("v").cast("decimal(20,0)")) for m in (F.array_max, F.array_min))))).first()
    if (dims or 0) * int(most or 0) ** 2 >= 1 << 62:
        raise ValueError(f"{dims} components of up to {most} give scores beyond 62 bits")
    n_blocks, q_blocks = -(-max(n, 1) // V.block_size(n, dims or 0, BLOCK)), -(-max(asking.count(), 1) // V.fitting(dims or 0))
    here, asks = cut_lineage(packed(whole, n_blocks)), packed(asking, q_blocks).withColumnRenamed("block", "q_block")

    def run(ask: pa.Table, row: pa.Table) -> list:
        queries, cells = (V.widened(t["cells"][0], t["kind"][0], np.int64).reshape(t["dims"][0].as_py(), -1) for t in (ask, row))
        found = list(best(queries, np.asarray(ask["ids"][0].values), cells, np.asarray(row["ids"][0].values), k))
        return [[f[i] for f in found] for i in range(3)]

    # each block of queries meets each block of candidates: the stated queries against all rows
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))
    found = V.meetings(asks.withColumn("block", every(n_blocks)), here.withColumn("q_block", every(q_blocks)), ["q_block", "block"], run,
                       ["query_id", "vec_id", "score"])
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
