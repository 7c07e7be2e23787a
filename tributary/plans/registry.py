"""Every query by name, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query; sql is DuckDB SQL for the same rows, if SQL can express it."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        if key in _QUERIES:
            raise ValueError(f"two queries are named {key}")
        _QUERIES[key] = f
        if sql:
            _ORACLES[key] = sql
        return f

    return register


def _load() -> None:
    from importlib import import_module

    for module in MODULES:
        import_module(f"tributary.plans.{module}")


MODULES = ["trends", "relational", "texts", "vectors", "graphs", "conversations", "upserts", "streams", "records", "history", "state", "collections", "messages", "stores", "small", "feed", "merges", "scans"]


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
