"""Checked queries: every entry pairs a Spark query with SQL for the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, uses: str = "") -> Callable[[QueryFn], QueryFn]:
    """Register a query under its function name.

    ``uses`` names the derived tables of :mod:`catalog.derived` the SQL reads.
    """

    def register(fn: QueryFn) -> QueryFn:
        from catalog.derived import with_tables

        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = with_tables(uses.split(), sql)
        return fn

    return register


def load() -> None:
    """Import every module that registers queries."""
    from catalog import grouping, layouts, learning, predictions, ranking, sources, streams  # noqa: F401
