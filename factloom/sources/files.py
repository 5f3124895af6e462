"""Files of repositories as rows, read by Spark from any store."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes of source languages.
LANGUAGES = {".py": "python", ".pyi": "python", ".rs": "rust", ".ts": "typescript", ".tsx": "typescript", ".cu": "cuda", ".cuh": "cuda", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".go": "go", ".md": "markdown", ".toml": "toml", ".json": "json", ".yaml": "yaml", ".yml": "yaml"}
EXCLUDED = (".git/", "__pycache__/", "node_modules/", ".venv/", "build/", "dist/")


def glob_pattern(glob: str) -> str:
    """A pattern for an ignore glob: ``**`` crosses folders, a final ``/`` means all below."""
    anchored, glob = glob.startswith("/"), glob.strip("/") + ("/**" if glob.endswith("/") else "")
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] in "*?":
            out, i = out + ("[^/]*" if glob[i] == "*" else "[^/]"), i + 1
        else:
            out, i = out + ("\\" + glob[i] if not glob[i].isalnum() and glob[i] != "/" else glob[i]), i + 1
    return ("^" if anchored or "/" in glob.rstrip("/*") else "(?:^|/)") + out + "$"


def kept(path: Column, ignored: Iterable[str] = EXCLUDED, included: Iterable[str] = ()) -> Column:
    """Whether a path is not ignored, or is included again."""
    out = F.lit(False)
    for g in ignored:
        out = out | path.rlike(glob_pattern(g))
    for g in included:
        out = out & ~path.rlike(glob_pattern(g))
    return ~out


def scan(spark: SparkSession, root: str, ignored: Iterable[str] = EXCLUDED, suffixes: Iterable[str] | None = None) -> DataFrame:
    """``path``, ``language`` and ``text`` of the files below ``root`` with a known suffix, one row each.

    Spark's readers hide names that start with an underscore and files without a byte.  So a
    folder that is mounted on all machines is listed by the driver, names alone, and read by
    the executors; any other store is left to Spark's reader, without those files."""
    scheme, _, rest = root.rpartition("://")
    rows = _mounted(spark, rest) if scheme in ("", "file") else _stored(spark, root)
    kinds = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    rows = rows.withColumn("language", F.try_element_at(kinds, F.lower(F.regexp_extract("path", r"\.[^./]*$", 0))))
    rows = rows.where(F.col("language").isNotNull() & kept(F.col("path"), ignored))
    if suffixes is not None:
        rows = rows.where(F.regexp_extract("path", r"\.[^./]*$", 0).isin(*suffixes))
    return _read(rows, rest) if scheme in ("", "file") else rows


def _stored(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(root)
    base = "/" + root.split("://", 1)[-1].strip("/") + "/"
    full = F.regexp_replace(F.col("_metadata.file_path"), "^[a-z]+:/+", "/")
    return rows.select(F.regexp_replace(F.url_decode(F.regexp_replace(full, r"\+", "%2B")), f"^.*?{base}", "").alias("path"), F.col("value").alias("text"))


def _mounted(spark: SparkSession, root: str) -> DataFrame:
    names = [os.path.relpath(os.path.join(folder, n), root).replace(os.sep, "/") for folder, below, found in os.walk(root) if (below.sort() or True) for n in sorted(found)]
    return spark.createDataFrame([(n,) for n in names], "path string").repartition(max(1, min(1000, len(names) // 200 + 1)))


def _read(rows: DataFrame, root: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for path in batch["path"]:
                with open(os.path.join(root, path), encoding="utf-8", errors="replace", newline="") as file:
                    texts.append(file.read())
            yield batch.assign(text=pd.Series(texts, dtype=object))[["path", "text", "language"]]

    return rows.select("path", "language").mapInPandas(run, "path string, text string, language string")


def directories(files: DataFrame) -> DataFrame:
    """Directory facts of scanned files: direct files, modules and folders of each."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i - 1), "/").alias("folder"), F.get(parts, i - 1).alias("entry"), (i == F.size(parts)).alias("is_file")))
    rows = files.select("language", F.explode(above).alias("x")).select("x.*", "language").dropDuplicates(["folder", "entry", "is_file"])
    by = rows.groupBy("folder").agg(
        F.count(F.lit(1)).alias("entry_count"), F.count_if("is_file").alias("direct_file_count"), F.count_if(~F.col("is_file")).alias("direct_directory_count"),
        F.min(F.when(~F.col("is_file"), F.col("entry"))).alias("child"), F.count_if(F.col("is_file") & ~F.col("language").isin("markdown", "toml", "json", "yaml")).alias("direct_module_count"),
    )
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/"))).cast("bigint")
    only = F.when((F.col("direct_directory_count") == 1) & (F.col("direct_file_count") == 0), F.col("child"))
    return by.select(F.concat(F.lit("directory:"), "folder").alias("fact_id"), F.col("folder").alias("path"), F.lit("").alias("language"), F.lit(1).cast("bigint").alias("start_line"), F.lit(1).cast("bigint").alias("end_line"), "entry_count", depth.alias("source_depth"), "direct_file_count", "direct_directory_count", only.alias("only_child_directory"), "direct_module_count", F.lit(False).alias("is_definition_catalog"))
