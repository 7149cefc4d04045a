"""Named queries over the test tables, each with its SQL oracle when SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fraudlake.plans.fixtures import Fixture, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), extra: dict[str, str] | None = None):
    """Register ``fn(Fixture) -> DataFrame`` under ``name``; ``sql`` may read the named views."""
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Fixture(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(sql, *views, extra=extra) if (views or extra) else sql
        return fn
    return wrap
