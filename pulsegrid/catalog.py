"""Registry of the library's queries over the driver's tables, and the same queries in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) as a query, with its equivalent in DuckDB's SQL."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    """Import the modules that register queries."""
    from importlib import import_module
    from pkgutil import iter_modules

    from . import plans

    for m in iter_modules(plans.__path__):
        if m.name.endswith("_queries"):
            import_module(f"{plans.__name__}.{m.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all units around reference events: a range join, a histogram, and its empty bins."""
    return queries()["psth"](spark, sf_dir)
