"""How plans register: a function of (spark, folder), and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


#: The log in SQL, as ``sources.views.log`` has it.
LOG = """log AS (SELECT 'user:' || user_id AS key, event_type AS op, CAST(floor(value) AS BIGINT) AS delta,
  CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS txt, value AS score, epoch_us(ts) AS us, event_id AS seq, user_id, props FROM events)"""
NOW = 1_706_659_200_000_000
TTL = 432_000_000_000
