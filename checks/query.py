"""Registration of queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.fixture import Fixture
from checks.views_sql import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
BUILDERS: dict[str, Callable[[Fixture], DataFrame]] = {}


def query(name: str, sql: str | None = None, views: dict[str, str] | None = None):
    """Register ``build(fixture) -> DataFrame``; ``views`` are extra views for the SQL."""

    def register(build: Callable[[Fixture], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Fixture(spark, sf_dir))

        run.__name__ = name
        BUILDERS[name] = build
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_views(sql, views)
        return build

    return register
