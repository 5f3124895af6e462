"""Tables that the text operators are tested on."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

LONG = "word " * 30_000
ODD = [None, "", " ", "x", "Été \x1c ñ 北京 😀", LONG, "the the the\nthe the the\n", "a@b.co and a@b.co", "x"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [(None if i == 3 else i % 8, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = ["score", "print", "ids", "pii", "hits", "kept", "component_id", "__held"]
    return df.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"), *[F.lit(1).alias(c) for c in clash])


@pytest.fixture(scope="session")
def tables(spark, odd, tmp_path_factory, sf_dir):
    """Folders of tables: the odd rows, and no rows at all."""
    folders = {}
    for kind in ("odd", "empty"):
        folder = folders[kind] = str(tmp_path_factory.mktemp(kind))
        for name in ("documents", "labels", "pages", "benchmark"):
            df = odd if name == "documents" else spark.read.parquet(f"{sf_dir}/{name}.parquet")
            (df.limit(0) if kind == "empty" else df).write.parquet(f"{folder}/{name}.parquet")
    return folders
