"""Vectors with a cosine of 0.9 or more, their links and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm.near_vectors import near_vectors
from tidegauge.llm.registry import table

NAME = "op12_near_vectors"

ORACLE = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS place, vec_id, CAST(embedding AS DOUBLE[]) AS v,
         COALESCE(vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS usable
  FROM embeddings),
links AS (
  SELECT a.place, b.place AS other, b.vec_id AS other_id
  FROM v a JOIN v b ON a.place <> b.place
  WHERE a.usable AND b.usable
    AND list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.9),
reached AS (
  SELECT place, other, other_id FROM links
  UNION
  SELECT r.place, l.other, l.other_id FROM reached r JOIN links l ON r.other = l.place),
counted AS (SELECT place, count(*) AS n_links FROM links GROUP BY place),
lowest AS (SELECT place, min(other_id) AS lowest FROM reached GROUP BY place)
SELECT vec_id, COALESCE(n_links, 0) AS n_links, least(vec_id, COALESCE(lowest, vec_id)) AS component_id,
       least(vec_id, COALESCE(lowest, vec_id)) IS NOT DISTINCT FROM vec_id AS kept
FROM v LEFT JOIN counted USING (place) LEFT JOIN lowest USING (place)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
