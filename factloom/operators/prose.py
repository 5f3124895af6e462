"""Prose measures: sentences, paragraphs, uniform lengths and dominant openers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prose_only(text: Column) -> Column:
    """Text without code fences, comments, headings, tables, quotations and list items."""
    text = F.regexp_replace(text, r"(?s)(```|~~~).*?(\1|$)", "\n\n")
    text = F.regexp_replace(text, r"(?s)<!--.*?(-->|$)", "")
    return F.regexp_replace(text, r"(?m)^[ \t]*(#.*|>.*|\|.*|[-*+] .*|[0-9]+[.)] .*)$", "")


def sentences(text: Column) -> Column:
    """Pieces that end at a mark and white space."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s.rlike(r"\S"))


def paragraphs(text: Column) -> Column:
    """Pieces between blank lines."""
    return F.filter(F.split(text, r"\n[ \t]*\n\s*"), lambda s: s.rlike(r"\S"))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def opener(sentence: Column) -> Column:
    """The first word in lower case, empty without one."""
    return F.lower(F.regexp_extract(sentence, r"([\p{L}\p{N}]+)", 1))


def uniformity(sizes: Column, least: int) -> Column:
    """100 less the mean deviation in percent of the mean, not under 0; null of fewer than ``least``."""
    n = F.size(sizes)
    mean = F.try_divide(F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x), n.cast("double"))
    off = F.try_divide(F.aggregate(F.transform(sizes, lambda x: F.abs(x - mean)), F.lit(0.0), lambda a, x: a + x), n.cast("double"))
    return F.when(n >= least, F.greatest(F.lit(0.0), 100.0 * (1 - F.try_divide(off, mean))))
