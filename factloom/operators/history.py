"""History operators: churn, co-change with support and confidence, and mentions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import escape_regex


def churn(changes: DataFrame, change: str, path: str, author: str, day: Column) -> DataFrame:
    """By path: commits, authors, last day, and days from then to the newest day of all."""
    rows = changes.groupBy(F.col(path).alias("path")).agg(F.count_distinct(change).alias("commit_count"), F.count_distinct(author).alias("author_count"), F.max(day).alias("last_day"))
    newest = changes.agg(F.max(day).alias("newest"))
    return rows.crossJoin(F.broadcast(newest)).select("path", "commit_count", "author_count", F.datediff("newest", "last_day").alias("days_since_last_change"))


def co_change(changes: DataFrame, change: Sequence[str], path: str, most: int, within: Sequence[str] = ()) -> DataFrame:
    """Pairs of paths that share changes: ``left``, ``right``, ``shared`` and the changes of each.

    Only changes of up to ``most`` paths pair, so a change makes at most ``most`` squared rows,
    whatever the history's size; counts of each side are over the same changes."""
    keys, within = list(change), list(within)
    rows = changes.select(*keys, F.col(path).alias("path")).distinct()
    narrow = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most).drop("n")
    rows = rows.join(narrow, keys)
    left, right = rows.withColumnRenamed("path", "left"), rows.withColumnRenamed("path", "right")
    pairs = left.join(right, keys).where("left < right").groupBy(*within, "left", "right").agg(F.count(F.lit(1)).alias("shared"))
    counts = rows.groupBy(*within, "path").agg(F.count(F.lit(1)).alias("n"))
    of = lambda side: counts.withColumnsRenamed({"path": side, "n": f"{side}_count"})
    return pairs.join(of("left"), [*within, "left"]).join(of("right"), [*within, "right"])


def stem(path: Column) -> Column:
    """The name by which imports know a file; a package's own file goes by its folder."""
    base = F.split(F.element_at(F.split(path, "/"), -1), r"\.")[0]
    folder = F.regexp_extract(path, r"(?:^|/)([^/]+)/[^/]+$", 1)
    return F.when(base.isin("__init__", "mod", "lib", "index", "main") & path.contains("/"), folder).otherwise(base)


def references(pairs: DataFrame, imports: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Pairs with ``import_reference_count``: import lines (``path``, ``imported``) of either side that name the other's stem.

    Each file's lines are gathered once, with the words in them, and meet the pairs by the file that holds
    them; the pairs themselves are made once.  For files that bound their import lines."""
    within = list(within)
    text = F.col("imported").cast("string")
    gathered = imports.where(F.col("path").isNotNull() & text.isNotNull()).select(*within, F.col("path").alias("__reader"), F.struct(text.alias("line"), F.regexp_extract_all(text, F.lit(rf"{_WORD}+"), F.lit(0)).alias("words")).alias("line"))
    gathered = gathered.groupBy(*within, "__reader").agg(F.collect_list("line").alias("__lines"))
    of = lambda side: gathered.withColumnsRenamed({"__reader": side, "__lines": f"__{side}_lines"})
    met = pairs.select("*", *[stem(F.col(side).cast("string")).alias(f"__{side}_stem") for side in ("left", "right")])
    met = met.join(of("left"), [*within, "left"], "left").join(of("right"), [*within, "right"], "left")
    number = _naming("__left_lines", F.col("__right_stem")) + _naming("__right_lines", F.col("__left_stem"))
    return met.select(*pairs.columns, number.cast("bigint").alias("import_reference_count"))


_WORD = r"[\p{L}\p{N}_]"


def _naming(lines: str, name: Column) -> Column:
    """How many lines mention a name; one that is a word is looked for among a line's words, any other by a pattern."""
    word = name.rlike(rf"\A{_WORD}+\z")
    found = lambda x: F.when(word, F.array_contains(x["words"], name)).otherwise(mentions(x["line"], name))
    return F.coalesce(F.size(F.filter(F.coalesce(F.col(lines), F.array()), lambda x: F.coalesce(found(x), F.lit(False)))), F.lit(0))


def uncoupled(pairs: DataFrame, imports: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Pairs of which no import line of either side names the other."""
    return references(pairs, imports, within).where("import_reference_count = 0").drop("import_reference_count")


def mentions(text: Column, name: Column) -> Column:
    """Whether a text names something as a word of its own, of any script's letters."""
    return F.regexp_like(text, F.concat(F.lit(r"(^|[^\p{L}\p{N}_])"), escape_regex(name), F.lit(r"($|[^\p{L}\p{N}_])")))
