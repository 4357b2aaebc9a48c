"""Queries over the driver tables: one entry per operator, with the equivalent SQL where SQL can say it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

MODULES = [
    "findings",
    "scoring",
    "ranking",
    "scalars",
    "duplicates",
    "similarity",
    "review",
    "contracts",
    "ledger",
    "cleanup",
    "topology",
    "search",
    "sources",
    "extraction",
    "streams",
]


def register(name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
    """Register ``fn(t: Tables) -> DataFrame`` under ``name``; ``sql`` is the DuckDB equivalent."""
    from .views import Tables, with_views

    def keep(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return keep


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
