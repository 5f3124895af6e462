"""Catalog operators: exact name resolution, lineage endpoints, impact and test gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.relations import unambiguous


def normalized(name: Column) -> Column:
    """A name as it is compared: trimmed, lower case, without quotes."""
    return F.lower(F.trim(F.regexp_replace(name, r"[\"`\[\]]", "")))


def suffixes(name: Column) -> Column:
    """A dotted name and its endings, longest first."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def resolved(references: DataFrame, reference: str, assets: DataFrame, asset: str) -> DataFrame:
    """Add ``resolved``: the one asset whose name or ending equals the reference; null if none or several do."""
    names = assets.select(F.explode(suffixes(normalized(F.col(asset)))).alias("__name"), F.col(asset).alias("resolved")).distinct()
    return references.withColumn("__name", normalized(F.col(reference))).join(unambiguous(names, "__name", "resolved"), "__name", "left").drop("__name")


def endpoint_gaps(edges: DataFrame, assets: DataFrame, asset: str) -> DataFrame:
    """Each end of an edge (``src``, ``dst``) that is no asset."""
    ends = edges.select("src", "dst", F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("src").alias("name")), F.struct(F.lit("target").alias("side"), F.col("dst").alias("name")))).alias("end")).select("src", "dst", "end.*")
    return ends.join(assets.select(F.col(asset).alias("name")).distinct(), "name", "left_anti")


def test_gap(impacted: DataFrame, tested: DataFrame, keys: Sequence[str]) -> DataFrame:
    """By change: impacted pairs, untested ones, and their percentage."""
    rows = impacted.select(*keys, "asset").distinct().join(tested.select(*keys, "asset").distinct().withColumn("tested", F.lit(True)), [*keys, "asset"], "left")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("impacted"), F.count_if(F.col("tested").isNull()).alias("untested")).withColumn("gap", 100.0 * F.col("untested") / F.col("impacted"))
