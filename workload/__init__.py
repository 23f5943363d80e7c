"""Registered queries, each with the SQL that gives the same answer where one exists."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL if it has one.

    Times are compared in UTC, whatever the session was set to.
    """

    def register(build: Query) -> Query:
        @wraps(build)
        def in_utc(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(spark, folder)

        QUERIES[build.__name__] = in_utc
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register
