"""Verdict timelines: transitions, flaps and current states of subjects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def transitions(events: DataFrame, subject: Sequence[str], order: Sequence[str], state: str) -> DataFrame:
    """Events at which a subject's state differs from the one before, repeats left out; the first has ``previous`` null."""
    w = W.partitionBy(*subject).orderBy(*order)
    return events.withColumn("previous", F.lag(state).over(w)).where(F.col("previous").isNull() | (F.col("previous") != F.col(state)))


def flaps(events: DataFrame, subject: Sequence[str], order: Sequence[str], state: str, bad: str = "fail", good: str = "pass") -> DataFrame:
    """By subject: changes of state, and alternations bad, good, bad within the collapsed sequence."""
    w = W.partitionBy(*subject).orderBy(*order)
    steps = transitions(events, subject, order, state).withColumn("before", F.lag(state, 2).over(w))
    return steps.groupBy(*subject).agg(
        F.count_if(F.col("previous").isNotNull()).alias("changes"),
        F.count_if((F.col(state) == bad) & (F.col("previous") == good) & (F.col("before") == bad)).alias("alternations"),
        F.max_by(state, F.struct(*order)).alias("state"),
    )
