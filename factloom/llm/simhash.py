"""Near-duplicates by SimHash, found in a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes.  If two differ in at most two bits, at least six
positional bytes agree, so of four blocks of two bytes at least two agree.  The index has a
posting list for each pair of blocks and its four bytes.  Pairs within a list are tallied by
the positional bytes that they share; those with six or more are verified by their bits.

Lists longer than ``POSTINGS`` would make too many pairs.  There, every fingerprint is put
under itself and under each fingerprint one bit away within the list's other four bytes: two
are at most two bits apart exactly if they meet under one of these, and at most 33 different
ones meet under any.  So those lists cost as many rows as they have entries, times 33, and
no link between different fingerprints is lost.

Copies count once: all this works on different fingerprints.

Cases: null and empty texts have the fingerprint zero and link like any other; fewer than
three words are hashed as one sequence; long texts are hashed whole; repeated rows have equal
fingerprints; an empty table gives an empty one; other columns don't matter.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import map_rows, table, written
from factloom.llm.components import components

NAME = "op6_simhash"
SEED = 42
#: Longest posting list that is searched pair by pair; longer ones have their exact way.
POSTINGS = 48
#: Differing bits of a link, and the positional bytes that must agree then.
BITS, LEAST_BYTES = 2, 6
_BLOCKS = list(combinations(range(4), 2))


def simhash(text: str | None, words: int = 3) -> int:
    """Fingerprint of a whole text as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode().lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = list(map(b" ".join, zip(*(found[i:] for i in range(words)))))
    hashes = np.array([xxh64_intdigest(s, SEED) for s in shingles], dtype=np.uint64)
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bits += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``print``, the fingerprint of each row's whole text."""
    kept = keep if keep is not None else [c for c in df.columns if c != "print"]
    return map_rows(df, kept, "print bigint", [text], lambda: lambda t: (simhash(t),))


def _block(col: Column, i: int) -> Column:
    return F.shiftrightunsigned(col, 16 * i).bitwiseAND(F.lit(0xFFFF))


def links(prints: DataFrame) -> DataFrame:
    """Links between the different values of ``print``: columns ``a``, ``b``.

    Between them they connect just the fingerprints that are at most two bits apart."""
    col = F.col("print")
    keys = F.array(*[F.struct(F.lit(n).alias("blocks"), (F.shiftleft(_block(col, i), 16).bitwiseOR(_block(col, j))).alias("bytes")) for n, (i, j) in enumerate(_BLOCKS)])
    index = prints.select("print", F.explode(keys).alias("key")).select("print", "key.blocks", "key.bytes")
    long = written(index.groupBy("blocks", "bytes").count().where(F.col("count") > POSTINGS).drop("count"), "postings")
    lists = index.join(long, ["blocks", "bytes"], "left_anti").groupBy("blocks", "bytes").agg(F.collect_list("print").alias("list")).where(F.size("list") > 1)

    def shared(x: Column, y: Column) -> Column:
        other = x.bitwiseXOR(y)
        tally = sum(F.when(F.shiftrightunsigned(other, 8 * k).bitwiseAND(F.lit(0xFF)) == 0, 1).otherwise(0) for k in range(8))
        return (tally >= LEAST_BYTES) & (F.bit_count(other) <= BITS)

    def pairs(x: Column, i: Column) -> Column:
        rest = F.slice("list", i + 2, F.greatest(F.size("list") - i - 1, F.lit(0)))
        return F.transform(F.filter(rest, lambda y: shared(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))

    short = lists.select(F.explode(F.flatten(F.transform("list", pairs))).alias("pair")).select("pair.*")
    other = {n: [16 * k + bit for k in range(4) if k not in two for bit in range(16)] for n, two in enumerate(_BLOCKS)}
    masks = F.create_map(*[x for n, bits in other.items() for x in (F.lit(n), F.array(*[F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("bigint") for b in bits], F.lit(0).cast("bigint")))])
    near = index.join(long, ["blocks", "bytes"]).select("print", "blocks", F.explode(masks[F.col("blocks")]).alias("mask")).select("print", "blocks", F.col("print").bitwiseXOR(F.col("mask")).alias("at"))
    met = near.groupBy("blocks", "at").agg(F.collect_list("print").alias("list")).where(F.size("list") > 1)
    starred = met.select(F.array_min("list").alias("a"), F.explode("list").alias("b")).where("a <> b")
    return short.unionByName(starred)


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **more: Column) -> DataFrame:
    """``doc_id``, ``print``, ``component_id`` (smallest id reachable) and ``root`` (smallest
    print reachable, which rows without an id have too) of each row, with more columns of it."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *[c.alias(name) for name, c in more.items()])
    prints = written(fingerprints(rows, keep=["doc_id", *more]), "prints")
    least = written(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(least.select("print")))
    of_root = least.join(roots, least["print"] == roots["node"]).groupBy("root").agg(F.min("least").alias("component_id"))
    linked = roots.join(of_root, "root").select(F.col("node").alias("print"), "component_id", "root")
    named = written(least.join(linked, "print", "left").select("print", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "print").alias("root")), "classes")
    return prints.join(named, "print")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
