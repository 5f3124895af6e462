"""Run events as a stream (an extension): verdict counts in windows, and the last state of a subject."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, time: str, state: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by window and state; state older than the watermark is dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), F.col(state).alias("state")).agg(F.count(F.lit(1)).alias("n"))


def distinct_events(events: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Each event once, within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def folded(events: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand each batch to an idempotent merge, which a restart may repeat."""
    writer = events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
