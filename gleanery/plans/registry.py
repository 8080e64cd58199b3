"""All queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanery.sources.package import ship_package
from gleanery.sources.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of Views as the query `name`, with its SQL for DuckDB."""

    def register(make: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return make(Views(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql)
        return make

    return register


from gleanery.plans import (  # noqa: E402, F401
    discovery_queries, health_queries, landing_queries, learning_queries, queue_queries, ranking_queries, streaming_queries, vector_queries,
)
