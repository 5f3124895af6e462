"""All queries of the engine, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.queries import QUERIES, SQL, load

load()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """A query for each operator."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """The same in SQL."""
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query that the driver runs first."""
    return QUERIES["flagship_large_customers_reopened"](spark, sf_dir)
