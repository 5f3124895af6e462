"""The corpus pipeline: quality, near-duplicates, decontamination, personal data, encoding.

Each stage takes the session, the rows that the stage before kept, and the folder of the
tables, and returns a DataFrame; all but the last return the columns of ``documents``.
Clean rows pass unchanged through the first three stages.

Cases: null texts count as empty; rows without a ``doc_id`` are judged by their text alone and
give way to near copies with one; of repeated rows one stays, while different texts under one
id are different documents; an empty table gives an
empty one with the same columns; columns beyond those of ``documents`` pass as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm import bpe, decontaminate, pii, quality, simhash
from factloom.llm.common import fresh, table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier does not reject."""
    scored = quality.score(docs, quality.fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), to=(score := fresh(docs, "__score")))
    return scored.where(F.col(score) >= quality.THRESHOLD).drop(score)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the row with the smallest id; of several with that id one.

    A row is known by the digest of its id and text, so that an id may have several texts.  The
    texts are dealt by it once, which serves both the join and the search for repeated rows."""
    of_row = F.sha2(F.concat(F.coalesce(F.concat(F.col("doc_id").cast("string"), F.lit(":")), F.lit("")), F.coalesce("text", F.lit(""))), 256)
    found = simhash.near_duplicates(docs, digest=of_row)
    stays = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("first")).select("first.digest")
    digest, row = fresh(docs, "__digest"), fresh(docs, "__row")
    rest = docs.withColumn(digest, of_row).join(stays.withColumnRenamed("digest", digest), digest, "left_semi")
    numbered = rest.withColumn(row, F.row_number().over(W.partitionBy(digest).orderBy(digest)))
    return numbered.where(F.col(row) == 1).select(*docs.columns)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no test item."""
    return decontaminate.without(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with placeholders for personal data; ``n_chars`` counts the new text."""
    done = pii.redact(docs)
    return done.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows as token ids, with the digest of what they decode to."""
    kept = [c for c in docs.columns if c not in ("text", "ids", "decoded", "n_tokens", "decoded_sha256")]
    done = bpe.encode(docs, bpe.default_tokenizer(), keep=kept)
    return done.select(*kept, "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_clean),
    ("personal_data", redact),
    ("encoding", encode),
]
#: SQL can't express these stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
