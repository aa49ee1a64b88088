"""Queries over the driver's tables: each binds operators to columns, with SQL beside it where SQL can say it."""

from __future__ import annotations

import importlib

from tallyspark.plans.registry import ORACLES, QUERIES, Query

MODULES = ("history", "event_queries", "resolve_queries", "evaluation_queries", "guarded_queries", "material_queries")


def queries() -> dict[str, Query]:
    for name in MODULES:
        importlib.import_module(f"tallyspark.plans.{name}")
    return QUERIES


def oracles() -> dict[str, str]:
    queries()
    return ORACLES
