"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
MODULES = ("text", "store", "sinks", "checks", "joins", "aggregates", "extraction", "records", "features", "dom", "streams", "sources", "keyed", "fields", "learned", "flows")


def query(name: str, sql: str | None = None):
    """Register a callable (spark, sf_dir) -> DataFrame, with the SQL for its rows if SQL can express them."""

    def put(f):
        assert name not in _QUERIES, name
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def _load() -> None:
    for m in MODULES:
        import_module(f"listwright.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
