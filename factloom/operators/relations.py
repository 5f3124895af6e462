"""Algebra on identity rows and their child relations; every fact is kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted(facts: DataFrame, children: DataFrame, key: str | Sequence[str], value: Column | None = None, name: str = "integer_value") -> DataFrame:
    """Number of child rows of each fact, or the sum of a value; 0 without any."""
    keys = [key] if isinstance(key, str) else list(key)
    number = F.count(F.lit(1)) if value is None else F.sum(value)
    sums = children.groupBy(*keys).agg(number.cast("bigint").alias(name))
    return facts.join(sums, keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def coverage(facts: DataFrame, children: DataFrame, key: str | Sequence[str], complete: Column, name: str = "float_value") -> DataFrame:
    """Percentage of complete child rows of each fact; 0.0 without any."""
    keys = [key] if isinstance(key, str) else list(key)
    shares = children.groupBy(*keys).agg((100.0 * F.count_if(complete) / F.count(F.lit(1))).alias(name))
    return facts.join(shares, keys, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def listed(facts: DataFrame, children: DataFrame, key: str, value: str, order: str, name: str) -> DataFrame:
    """A fact's child values in their order; an empty list without any.  For children that their fact bounds."""
    rows = children.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias(name))
    return facts.join(rows, key, "left").withColumn(name, F.coalesce(name, F.array()))


def first_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group, by a partial aggregate instead of a sort of all rows."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min(F.struct(*order, F.struct(*rest).alias("__row"))).alias("__best")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__best.__row.{c}").alias(c) for c in rest])


def largest_per_group(rows: DataFrame, keys: Sequence[str], value: str, n: int) -> DataFrame:
    """The rows with the ``n`` largest values of each group; Spark prunes within partitions first."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(F.desc(value), *[c for c in rows.columns if c not in (*keys, value)])
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def missing(rows: DataFrame, known: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows without a partner."""
    return rows.join(known.select(*on).distinct(), list(on), "left_anti")


def unambiguous(names: DataFrame, name: str, target: str) -> DataFrame:
    """Names that lead to one target alone."""
    return names.groupBy(name).agg(F.count_distinct(target).alias("__n"), F.min(target).alias(target)).where("__n = 1").drop("__n")
