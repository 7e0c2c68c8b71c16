"""All registered queries of the library, with their SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans import documents, relational, tables

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    """By name: functions of (spark, sf_dir)."""
    return {**relational.QUERIES, **documents.QUERIES, **tables.QUERIES}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {**relational.SQL, **documents.SQL, **tables.SQL}
