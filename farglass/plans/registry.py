"""The library's queries and their DuckDB SQL, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
MODULES = ("money", "tables", "texts", "vectors", "more", "rest", "sources", "further", "joins")


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its DuckDB SQL if there is any."""

    def add(f):
        if f.__name__ in _QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"farglass.plans.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _QUERIES["t16_trends_table"](spark, sf_dir)
