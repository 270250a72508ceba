"""Where every query meets its oracle: ``@query(key, views, sql)`` registers both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rasterloom.fixtures import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, views: str = "", sql: str | None = None):
    """Register a query; ``sql`` may use the derived tables named in ``views``."""

    def register(fn):
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = with_views(views, sql) if views else sql.strip()
        return fn

    return register
