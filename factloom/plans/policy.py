"""Policies judge a rule's scalar answer: pass, fail, or unassessed."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PASS, FAIL, UNASSESSED = "pass", "fail", "unassessed"


def _judged(value: Column, good: Column) -> Column:
    return F.when(value.isNull(), UNASSESSED).when(good, PASS).otherwise(FAIL)


@dataclass(frozen=True)
class Numeric:
    """A closed interval; an end that is missing is open.  Without either, nothing is assessed."""

    minimum: float | None = None
    maximum: float | None = None

    def __post_init__(self) -> None:
        if None not in (self.minimum, self.maximum) and self.minimum > self.maximum:
            raise ValueError("the minimum is over the maximum")

    def verdict(self, value: Column) -> Column:
        if self.minimum is None and self.maximum is None:
            return F.lit(UNASSESSED)
        good = F.lit(True)
        if self.minimum is not None:
            good = good & (value >= self.minimum)
        if self.maximum is not None:
            good = good & (value <= self.maximum)
        return _judged(value, good)


@dataclass(frozen=True)
class Boolean:
    """One expected truth value."""

    expected: bool = False

    def verdict(self, value: Column) -> Column:
        return _judged(value, value == self.expected)


@dataclass(frozen=True)
class Category:
    """Closed sets: good passes, bad fails, neutral is left unassessed."""

    good: frozenset[str] = frozenset()
    neutral: frozenset[str] = frozenset()
    bad: frozenset[str] = frozenset()

    @classmethod
    def closed(cls, domain: Iterable[str], good: Iterable[str], neutral: Iterable[str] = ()) -> Category:
        """What is listed neither as good nor as neutral is bad."""
        domain, good, neutral = frozenset(domain), frozenset(good), frozenset(neutral)
        if not good | neutral <= domain or good & neutral:
            raise ValueError("good and neutral must be disjoint parts of the domain")
        return cls(good, neutral, domain - good - neutral)

    @classmethod
    def advisory(cls, domain: Iterable[str]) -> Category:
        """Nothing is assessed."""
        return cls(neutral=frozenset(domain))

    @property
    def domain(self) -> frozenset[str]:
        return self.good | self.neutral | self.bad

    def verdict(self, value: Column) -> Column:
        neutral, bad = (reduce(Column.__or__, [value == c for c in sorted(names)], F.lit(False)) for names in (self.neutral, self.bad))
        return F.when(value.isNull() | neutral, UNASSESSED).when(bad, FAIL).otherwise(PASS)


Policy = Numeric | Boolean | Category


def default(kind: str) -> Policy:
    """The policy of a rule that names none: a flag must be false, a count zero."""
    if kind == "boolean":
        return Boolean(False)
    if kind == "integer":
        return Numeric(maximum=0)
    raise ValueError(f"a rule that answers with a {kind} must state its policy")
