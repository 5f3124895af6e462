"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bpe, decontaminate, html, pii, quality, rules, simhash, suffixtree, toxicity, urls

_MODULES = (bpe, simhash, urls, pii, quality, toxicity, rules, suffixtree, decontaminate, html)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """A query for each operator, over its whole table."""
    return {m.NAME: m.query for m in _MODULES}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express an operator."""
    return {m.NAME: m.ORACLE_SQL for m in _MODULES if getattr(m, "ORACLE_SQL", None)}
