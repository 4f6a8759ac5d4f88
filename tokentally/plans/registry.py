"""Queries by name, each with its DuckDB twin where SQL can state it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tokentally.plans.binding import Tables
from tokentally.plans.oracle import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HOMES: dict[str, str] = {}
MODULES = ["pricing", "groups", "filters", "logs", "sessions", "reports", "rules", "labels", "sinks", "savings", "sources"]


def query(name: str, sql: str | None = None):
    """Register ``build(tables) -> DataFrame`` under a name."""

    def wrap(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        HOMES[name] = build.__module__.rsplit(".", 1)[1].removesuffix("_queries")
        if sql:
            ORACLES[name] = with_ctes(sql)
        return build

    return wrap


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"tokentally.plans.{module}_queries")
