"""Registered queries: each applies one operator to a projection and says the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``function(spark, sf_dir)`` under ``name``, with its SQL where there is any."""

    def register(function):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return register


def load() -> None:
    """Import the modules that register queries."""
    from . import counters, findings, measures, texts, graphs, rules, readers, live, archive  # noqa: F401
