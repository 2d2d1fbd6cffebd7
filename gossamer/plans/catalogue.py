"""The registered queries, gathered from the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import derived_queries, log_queries, page_queries, stream_queries

QueryFn = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, QueryFn]:
    return page_queries.QUERIES | stream_queries.QUERIES | derived_queries.QUERIES | log_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return page_queries.SQL | stream_queries.SQL | derived_queries.SQL | log_queries.SQL
