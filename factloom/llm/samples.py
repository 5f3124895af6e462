"""A bounded sample of labelled rows, from which the classifiers learn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import fold, written

#: Most labelled rows that a model learns from; those with the smallest hashes of their ids.
MOST = 12_000
HELD_OUT = 5


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int = MOST, text: str = "text") -> DataFrame:
    """``doc_id``, ``text`` and ``label`` (0 or 1) of at most ``most`` labels that aren't held out.

    Ids whose crc32 modulo 5 is 0 are held out.  A repeated label counts once, as the larger
    one; null labels don't count.  The result is written to the shared folder, as it is read
    several times.  Of several texts of one id, the one with the smallest hash is taken."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .where(fold(F.col("doc_id"), HELD_OUT) != 0)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    # the sample's rows are bounded by ``most`` numbers, so it may be broadcast
    found = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "label")).alias("of"))
    return written(one.select("doc_id", "of.text", "of.label").repartition(24), "sample")
