"""Queries by key, with the oracle SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .duck import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plan(key: str, oracle: str | None = None, views: dict[str, str] | None = None):
    """Register a query under a key; `oracle` may name the adapter views and those in `views`."""

    def keep(f: Query) -> Query:
        QUERIES[key] = f
        if oracle:
            ORACLES[key] = with_views(oracle, views)
        return f

    return keep
