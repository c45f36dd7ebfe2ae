"""Registered queries and their SQL twins, one module per area."""

from __future__ import annotations

import importlib

AREAS = ["series", "counting", "campaigns", "formats", "catalogue", "text", "topics", "shop_speech", "io", "basics"]


def collect() -> tuple[dict, dict]:
    queries, oracle = {}, {}
    for area in AREAS:
        module = importlib.import_module(f"tidegauge.registry.{area}")
        queries.update(module.QUERIES)
        oracle.update(module.ORACLE)
    return queries, oracle
