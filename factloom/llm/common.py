"""Helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that one Arrow batch carries to a Python worker.  Texts are a few kB each,
#: so a batch stays at a few MB, and at some 60 MB if all of its texts are long.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark alone so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` that driver and executors share.

    Only where a session names none (tests on one machine) is a temporary one set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives a lost executor.

    Reading again also forgets how the rows were dealt, so that a following join can
    be split by adaptive execution where one key is hot."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the rows don't have."""
    while name in df.columns:
        name += "_"
    return name


def fold(col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % F.lit(modulus)


def map_lists(
    df: DataFrame,
    keep: list[str],
    schema: str,
    columns: list[str],
    start: Callable[[], Callable[..., list]],
) -> DataFrame:
    """Apply a function of lists to Arrow batches: ``keep`` columns pass, ``schema`` fields are added.

    ``start()`` runs once in each task and returns a function of a list of values for each of
    ``columns`` (nulls as None); that returns a list with a tuple for each row."""
    small_batches(df.sparkSession)
    added = T._parse_datatype_string(schema)
    out = T.StructType([*(df.schema[c] for c in keep), *added.fields])
    names = [f.name for f in out.fields]
    taken = [*keep, *(c for c in columns if c not in keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in added.fields]
        apply = start()
        for batch in batches:
            rows = apply(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns])
            made = list(zip(*rows)) if rows else [()] * len(types)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            arrays += [pa.array(v, type=t) for v, t in zip(made, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.select(*taken).mapInArrow(run, out)


def map_rows(
    df: DataFrame,
    keep: list[str],
    schema: str,
    columns: list[str],
    start: Callable[[], Callable[..., Iterable]],
) -> DataFrame:
    """``map_lists`` with a function of one row's values, which returns that row's tuple."""

    def started() -> Callable[..., list]:
        apply = start()
        return lambda *lists: [apply(*row) for row in zip(*lists)]

    return map_lists(df, keep, schema, columns, started)
