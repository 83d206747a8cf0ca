"""Registered queries: one per implemented operator, each with its DuckDB oracle.

Every query reads the driver's tables (or views Spark derives from them) at ``sf_dir``
and runs over whole tables. Oracles are DuckDB SQL over the same base tables; ``fx_*``
views are expanded as CTEs by :func:`weft.fixtures.with_fx`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.fixtures import with_fx

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with an optional oracle."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_fx(sql)
        return fn

    return deco


def load_all() -> None:
    from weft.catalog import adapters, choices, core, extras, filters, folders, joins, messages, metrics, ngram, plans, prefs, sources, streaming, windows  # noqa: F401
