"""Text and list expressions whose results do not depend on an engine's dialect.

Every function takes and returns Columns, stays in generated code and reads no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = r"([\\^$.|?*+()\[\]{}])"


def literal_split(text: Column, separator: str) -> Column:
    """Split at a literal separator."""
    return F.split(text, "".join("\\" + c if not c.isalnum() else c for c in separator), -1)


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without a match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def escape_regex(text: Column) -> Column:
    """Text as a pattern that matches it."""
    return F.regexp_replace(text, _SPECIAL, r"\\$1")


def strip(text: Column, characters: str | None = None, side: str = "both") -> Column:
    """Remove characters, white space if none are named, from the ends."""
    of = r"\s" if characters is None else "[" + "".join("\\" + c for c in characters) + "]"
    if side in ("both", "start"):
        text = F.regexp_replace(text, f"^{of}+", "")
    if side in ("both", "end"):
        text = F.regexp_replace(text, f"{of}+$", "")
    return text


def strip_prefix(text: Column, prefix: str) -> Column:
    """Remove a prefix once."""
    return F.when(text.startswith(prefix), F.substring(text, F.lit(len(prefix) + 1), F.length(text))).otherwise(text)


def strip_suffix(text: Column, suffix: str) -> Column:
    """Remove a suffix once."""
    return F.when(text.endswith(suffix), F.substring(text, F.lit(1), F.length(text) - len(suffix))).otherwise(text)


def pad_start(text: Column, width: int, fill: str) -> Column:
    """Pad on the left; longer text stays whole."""
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, fill))


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether any of the words stands in the text."""
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def slice_bytes(text: Column, start: Column, length: Column) -> Column:
    """Text of a range of UTF-8 bytes, counted from zero."""
    return F.substring(F.encode(text, "UTF-8"), start + 1, length).cast("string")


def first_of(items: Column) -> Column:
    """The first item, null of an empty list."""
    return F.get(items, 0)


def last_of(items: Column) -> Column:
    """The last item, null of an empty list."""
    return F.try_element_at(items, F.lit(-1))


def range_of(start: Column, end: Column) -> Column:
    """Whole numbers from ``start`` up to and without ``end``; empty if there are none."""
    return F.when(end > start, F.sequence(start, end - 1)).otherwise(F.array().cast("array<bigint>"))


def plural(amount: Column, noun: str) -> Column:
    """A count with its noun."""
    return F.concat(amount.cast("string"), F.lit(" " + noun), F.when(amount == 1, "").otherwise("s"))
