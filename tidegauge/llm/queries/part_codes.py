"""Codes of all vectors, with their errors and the codebooks' digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.part_codes import digest, part_codes, with_label_error
from tidegauge.llm.registry import table

NAME = "op13_part_codes"


def _rounds(n: int) -> str:
    """One step of the SQL twin for each round, then the last assignment."""
    steps = []
    for k in range(n + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT row_id, part, any_value(x) AS x, arg_min(e, 256 * d + e) AS entry, min(d) AS d
  FROM (SELECT p.*, c.entry AS e, CAST(list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x) AS BIGINT) AS d
        FROM p JOIN c{k} c USING (part))
  GROUP BY row_id, part)""")
        if k < n:
            steps.append(f"""
s{k} AS (
  SELECT part, entry, place, floor(sum(v) / count(*)) AS m
  FROM (SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS place FROM a{k}) GROUP BY part, entry, place),
c{k + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, COALESCE(s.x, c.x) AS x
  FROM c{k} c LEFT JOIN (SELECT part, entry, list(m ORDER BY place) AS x FROM s{k} GROUP BY part, entry) s USING (part, entry))""")
    return ",".join(steps)


ORACLE = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row_id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT row_id, part, x[part * len(x) // 4 + 1 : (part + 1) * len(x) // 4] AS x FROM v, (SELECT unnest(range(4)) AS part)),
c0 AS (SELECT part, row_id - 1 AS entry, x FROM p WHERE row_id <= 256),{_rounds(4)},
codes AS (
  SELECT v.vec_id, v.label, string_agg(printf('%02x', a.entry), '' ORDER BY a.part) AS code, CAST(sum(a.d) AS BIGINT) AS error
  FROM a4 a JOIN v USING (row_id) GROUP BY v.row_id, v.vec_id, v.label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       sha256((SELECT string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, place)
               FROM (SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS place FROM c4))) AS codebooks_sha256
FROM codes
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = part_codes(table(spark, sf_dir, "embeddings"))
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
