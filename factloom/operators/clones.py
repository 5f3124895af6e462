"""Clone groups: equal windows of normalized tokens, grown to maximal runs.

Windows are hashed and grouped; a hash that stands once goes no further.  Runs of neighbouring
windows with the same group step are joined by a gap over ordinals, so the work is one sort of
windows by document, and no pair of documents is compared."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 40
#: Documents that a Python worker takes at once, and windows that it gives back at once.
BATCH_ROWS, OUT_ROWS = 200, 50_000


def tokens(text: Column) -> Column:
    """Tokens with identifiers, strings and numbers replaced by their kinds, for any language."""
    text = F.regexp_replace(text, r"""("([^"\\\n]|\\.)*"|'([^'\\\n]|\\.)*')""", " \\$s ")
    text = F.regexp_replace(text, r"\b[0-9][\w.]*\b", " \\$n ")
    text = F.regexp_replace(text, r"\b(true|false|True|False|null|None|nil)\b", " \\$b ")
    keep = "if|else|for|while|return|def|class|import|from|try|except|finally|raise|with|as|in|not|and|or|is|lambda|yield|break|continue|pass|fn|let|function|var|const|new|switch|case|throw|catch"
    text = F.regexp_replace(text, rf"(?<![$\w])(?!(?:{keep})\b)[A-Za-z_]\w*", " \\$id ")
    return F.filter(F.regexp_extract_all(text, F.lit(r"\$\w+|\w+|[^\s\w]"), F.lit(0)), lambda t: t != "")


def windows(docs: DataFrame, key: str, items: Column, size: int = WINDOW) -> DataFrame:
    """``key``, ``at`` and ``hash`` of every window of ``size`` items; shorter documents have none.

    Windows are equal if their items, joined by a unit separator, are.  A window's hash is put together
    from those of its halves, so it costs as many steps as ``size`` has binary digits."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    rows = docs.select(key, items.alias("items")).where(F.size("items") >= size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, hashes = hashed(batch.column(1), size)
            per = np.maximum(np.diff(offsets) - size + 1, 0)
            place = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
            found = hashes[np.repeat(offsets[:-1], per) + place].view(np.int64) if len(place) else np.empty(0, np.int64)
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(per)), per)))
            for i in range(0, len(place), OUT_ROWS):
                part = slice(i, i + OUT_ROWS)
                yield pa.RecordBatch.from_arrays([keys[part], pa.array(place[part].astype(np.int32)), pa.array(found[part])], names=[key, "at", "hash"])

    return rows.mapInArrow(run, T.StructType([docs.schema[key], T.StructField("at", T.IntegerType()), T.StructField("hash", T.LongType())]))


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashes."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + right
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _joined(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` of a row of hashes."""
    n, length, done, made = len(hashes) - size + 1, 1, 0, None
    while n > 0 and done < size:
        if size & length:
            part = hashes[done : done + n]
            made = part if made is None else _pair(made, part)
            done += length
        hashes, length = _pair(hashes[:-length], hashes[length:]), 2 * length
    return np.empty(0, np.uint64) if made is None else made


def _of_text(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def hashed(lists: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each list starts and ends in the row of all items, and the hash of the window at each item of that row."""
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets = offsets - offsets[0]
    words = flat.dictionary.to_pylist()
    codes = flat.indices.fill_null(len(words)).to_numpy(zero_copy_only=False)
    hashes = np.array([*map(_of_text, words), 0], np.uint64)[codes]
    made = _joined(hashes, size).copy()
    odd = np.array([*("\x1f" in w for w in words), True])  # a missing item joins as nothing, a separator as several
    if odd[:-1].any() or flat.null_count:
        near = np.convolve(odd[codes], np.ones(size, np.int64))[size - 1 : size - 1 + len(made)] > 0
        for i in np.flatnonzero(near):
            parts = "\x1f".join(words[c] for c in codes[i : i + size] if c < len(words)).split("\x1f")
            made[i] = _joined(np.array([*map(_of_text, parts)], np.uint64), size)[0] if len(parts) == size else _of_text("\x1f".join(parts))
    return offsets, made


def repeated(found: DataFrame, key: str) -> DataFrame:
    """Windows whose hash stands twice or more, with the number of its places; windows are made and moved once."""
    return found.withColumn("places", F.count(F.lit(1)).over(W.partitionBy("hash"))).where("places > 1")


def fragments(found: DataFrame, key: str, size: int = WINDOW) -> DataFrame:
    """Maximal runs of repeated windows of a document: ``key``, ``start``, ``end`` (items, end exclusive), ``places``, ``group``.

    ``group`` is the hash of the run's window hashes, so equal runs share it."""
    w = W.partitionBy(key).orderBy("at")
    rows = found.withColumn("run", F.col("at") - F.row_number().over(w))
    runs = rows.groupBy(key, "run").agg(F.min("at").alias("start"), (F.max("at") + size).alias("end"), F.max("places").alias("places"), F.xxhash64(F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda x: x["hash"])).alias("group"))
    return runs.drop("run")


def duplicated_share(runs: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """Percentage of each document's items (``key``, ``n``) inside repeated runs."""
    covered = runs.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    return sizes.join(covered, key, "left").select(key, F.when(F.col("n") == 0, 0.0).otherwise(100.0 * F.coalesce("covered", F.lit(0)) / F.col("n")).alias("share"))
