"""History from the text of ``git log --name-status``, and history facts from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.graph import saved

FORMAT = "--no-merges -M --relative --name-status --format=%x01%H%x02%an%x02%ct"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``commit``, ``author``, ``time``, ``status``, ``path``, ``previous`` of each changed file.

    Records end at a mark, so a log of any length is split by Spark; renames keep the old name."""
    rows = spark.read.option("lineSep", "\x01").text(path).where(F.trim("value") != "")
    head = F.split(F.get(F.split("value", "\n"), 0), "\x02")
    files = F.filter(F.slice(F.split("value", "\n"), F.lit(2), F.size(F.split("value", "\n"))), lambda x: F.trim(x) != "")
    changed = rows.select(F.get(head, 0).alias("commit"), F.get(head, 1).alias("author"), F.get(head, 2).cast("bigint").alias("time"), F.explode(files).alias("line"))
    parts = F.split("line", "\t")
    return changed.select("commit", "author", "time", F.substring("line", 1, 1).alias("status"), F.element_at(parts, -1).alias("path"), F.when(F.size(parts) > 2, F.get(parts, 1)).alias("previous"))


def followed(log: DataFrame) -> DataFrame:
    """The log with each change under the newest name of its file.

    A change takes the name that the first later rename of its path gives, as of that rename, until
    none is left; times only rise, so rounds end after as many as the longest chain of renames.
    Of renames of one path at one time, the least new name counts."""
    moves = log.where(F.col("previous").isNotNull() & (F.col("previous") != F.col("path")))
    moves = saved(moves.groupBy(F.col("previous").alias("path"), F.col("time").alias("at")).agg(F.min("path").alias("to")))
    columns = log.columns
    rows = log.withColumn("as_of", F.col("time"))
    done = None
    while True:
        # renames of the paths at hand: a path's are few, its changes may be many
        next_of = rows.select("path", "as_of").distinct().join(moves, "path").where(F.col("at") > F.col("as_of"))
        next_of = next_of.groupBy("path", "as_of").agg(F.min(F.struct("at", "to")).alias("next"))
        rows = saved(rows.join(next_of, ["path", "as_of"], "left"))
        still = rows.where("next is null").select(*columns)
        done = still if done is None else done.unionByName(still)
        moved = rows.where("next is not null")
        if moved.isEmpty():
            return done
        rows = moved.select(*[F.col("next.to").alias(c) if c == "path" else c for c in columns], F.col("next.at").alias("as_of"))


def by_file(log: DataFrame, present: DataFrame) -> DataFrame:
    """Commits, authors and days since the last change of each file that still exists (``path``),
    with those under its former names."""
    log = followed(log)
    rows = log.groupBy("path").agg(F.count_distinct("commit").alias("commit_count"), F.count_distinct("author").alias("author_count"), F.max("time").alias("last"))
    newest = log.agg(F.max("time").alias("newest"))
    days = F.floor((F.col("newest") - F.col("last")) / 86400).cast("bigint")
    return rows.join(present.select("path").distinct(), "path", "left_semi").crossJoin(F.broadcast(newest)).select("path", "commit_count", "author_count", days.alias("days_since_last_change"))
