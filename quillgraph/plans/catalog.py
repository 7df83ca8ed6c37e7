"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import star_queries, table_queries, vault_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return star_queries.queries() | table_queries.queries() | vault_queries.queries()


def oracle_sql() -> dict[str, str]:
    return star_queries.oracle_sql() | table_queries.oracle_sql() | vault_queries.oracle_sql()
