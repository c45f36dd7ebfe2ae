"""Licence labels of every document."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import licenses as L
from tidegauge.llm.registry import table

NAME = "op3_license_scan"

_HERE = " OR ".join("(" + " AND ".join(f"words[i + {k + 1}] = '{w}'" for k, w in enumerate(p.split())) + ")" for _, p in L.PHRASES)
_LABELLED = ", ".join(
    f"CASE WHEN len(list_filter(places, lambda i: {' AND '.join(f'''words[i + {k + 1}] = '{w}' ''' for k, w in enumerate(p.split()))})) > 0 THEN '{label}' END" for label, p in L.PHRASES)
_TEMPLATES = ", ".join(f"('{label}', {sorted(set(text.replace('.', ' ').split()))}, {math.ceil(L.CONTAINED * len(set(text.replace('.', ' ').split())) - 1e-9)})" for label, text in L.TEMPLATES)

ORACLE = f"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), '{L.UPPER}', '{L.LOWER}') AS t FROM documents),
worded AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM low),
placed AS (SELECT doc_id, t, words, list_filter(range(len(words)), lambda i: {_HERE}) AS places FROM worded),
base AS (SELECT *, list_filter([{_LABELLED}], lambda x: x IS NOT NULL) AS base FROM placed),
blocks AS (SELECT doc_id, unnest(string_split(regexp_replace(t, '([.!?])[\\t\\f\\r ]+', '\\1' || chr(10), 'g'), chr(10))) AS block FROM low),
held AS (SELECT doc_id, regexp_extract_all(block, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM blocks WHERE block LIKE '%a%' OR block LIKE '%e%' OR block LIKE '%i%'),
compared AS (
  SELECT doc_id, v.label, len(list_intersect(h.words, v.words)) AS shared, len(v.words) AS size, v.need
  FROM held h, (VALUES {_TEMPLATES}) v(label, words, need)),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(shared / size) AS best FROM compared WHERE shared >= need GROUP BY doc_id)
SELECT b.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word,
       CAST(list_max(places) AS BIGINT) AS last_word, array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, coalesce(f.labels, [])))), ',') AS labels,
       CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE coalesce(f.best, 0.0::DOUBLE) END AS score
FROM base b LEFT JOIN found f ON f.doc_id = b.doc_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.scan(table(spark, sf_dir, "documents"))
