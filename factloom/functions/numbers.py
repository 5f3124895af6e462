"""Number expressions: rounding to figures, shares, and quantiles by the nearest value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def significant(value: Column, figures: int) -> Column:
    """Round half to even at a number of significant figures; zero and null stay."""
    step = F.pow(F.lit(10.0), F.lit(figures - 1) - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.bround(value * step, 0) / step)


def percentage(part: Column, whole: Column) -> Column:
    """Part of a whole in percent; 0.0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(100.0 * part / whole)


def total(value: Column) -> Column:
    """Sum that is 0 over no rows."""
    return F.coalesce(F.sum(value), F.lit(0))


def distinct_with_null(value: Column) -> Column:
    """Number of distinct values, null being one of them."""
    return F.count_distinct(value) + F.max(value.isNull().cast("int"))


def nearest_quantile(value: str, share: float) -> Column:
    """The smallest value of a column that at least this share of its values reaches up to."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})")
