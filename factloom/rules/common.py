"""Expressions that rules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.plans.rules import say

col = F.col


def given(value: Column) -> Column:
    """Whether a text says anything."""
    return F.coalesce(F.trim(value) != "", F.lit(False))


def filled(items: Column) -> Column:
    """Whether a list has an item."""
    return F.coalesce(F.size(items) > 0, F.lit(False))


def one_of(value: Column, words: tuple[str, ...]) -> Column:
    """Whether a value is one of the words; false for null and for no words."""
    return F.coalesce(value.isin(*words), F.lit(False)) if words else F.lit(False)


def any_of(items: Column, words: tuple[str, ...]) -> Column:
    """Whether a list holds one of the words."""
    return F.coalesce(F.arrays_overlap(items, F.array(*[F.lit(w) for w in words])), F.lit(False)) if words else F.lit(False)


def last_name(qualified: Column) -> Column:
    """What stands after the last dot."""
    return F.element_at(F.split(qualified, r"\."), -1)


def about(text: str, *fields: str):
    """A message that names fields of the item that it is about."""
    return lambda x: say(text + " ", *[v for f in fields for v in (x[f], " ")]) if fields else say(text)


def named(value: Column, of: Callable[[Column], Column]) -> Column:
    """An expression that reads a value more than once, or inside a list, and makes it once."""
    return F.element_at(F.transform(F.array(value), of), 1)
