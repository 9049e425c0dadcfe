"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans import problems, problems_sql, store_queries, store_sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return problems.QUERIES | store_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return problems_sql.SQL | store_sql.SQL
