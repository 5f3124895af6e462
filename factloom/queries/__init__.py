"""Registered queries: each reference operator on the test tables, beside SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a table reader; ``sql`` is what DuckDB runs beside it."""

    def add(build: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        QUERIES[build.__name__] = lambda spark, sf_dir: build(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[build.__name__] = sql
        return build

    return add


def load() -> None:
    """Import the modules that register queries."""
    from factloom.queries import algebra, engine, graphs, rulebook, text  # noqa: F401
