"""Named queries over the given tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_FOUND: dict[str, tuple[Query, str | None]] = {}
_MODULES = ("scans", "elements", "joins", "aggregates", "windows", "inversion", "mosaics", "kernels", "streams")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; sql: its oracle."""

    def add(fn: Query) -> Query:
        if name in _FOUND:
            raise ValueError(f"{name} is registered twice")
        _FOUND[name] = fn, sql
        return fn

    return add


def _load() -> dict[str, tuple[Query, str | None]]:
    for module in _MODULES:
        importlib.import_module(f"fringeflow.plans.{module}")
    return _FOUND


def queries() -> dict[str, Query]:
    return {name: fn for name, (fn, _) in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _load().items() if sql}
