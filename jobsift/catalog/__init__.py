"""Registry of named queries: one Spark callable and (where SQL can express
it) one DuckDB oracle string per operator of the inventory.

Query names follow the inventory ids (``p4_currency_filter``...).  Each
callable takes ``(spark, sf_dir)`` and returns a DataFrame whose columns are
aliased exactly as in its oracle SQL.
"""

from __future__ import annotations

from collections.abc import Callable
import importlib

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

_MODULES = ["basic", "sequences", "textsim", "evaluation", "vectors", "recommend",
            "resumes", "training", "statistics", "iostream", "models"]


def register(name: str, sql: str | None = None):
    """Decorator: register a query under ``name`` with its oracle SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(f"jobsift.catalog.{m}")
