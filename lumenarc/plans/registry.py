"""Registered queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lumenarc.session import reachable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) -> DataFrame, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = wraps(f)(lambda spark, sf_dir: (reachable(spark), f(spark, sf_dir))[1])
        if sql:
            ORACLE[name] = sql
        return f

    return add
