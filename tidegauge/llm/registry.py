"""Queries of this subpackage and their SQL twins."""

from __future__ import annotations

import functools
import importlib

from tidegauge.llm.batches import ready

MODULES = ["decontamination", "toxicity", "licenses", "pieces", "ngram_join", "language", "urls", "packing", "quality", "topk",
           "hard_negatives", "near_vectors", "part_codes"]


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collect() -> tuple[dict, dict]:
    queries, oracle = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"tidegauge.llm.queries.{name}")
        fn, sql = module.query, getattr(module, "ORACLE", None)

        @functools.wraps(fn)
        def run(spark, sf_dir, fn=fn):
            return fn(ready(spark), sf_dir)

        queries[module.NAME] = run
        if sql:
            oracle[module.NAME] = sql
    return queries, oracle
