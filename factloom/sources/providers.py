"""External evidence: providers own families, depend on each other, and are asked in order."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from factloom.facts import read_facts


@dataclass(frozen=True)
class Provider:
    """Gives facts of the families it owns, from the families it needs."""

    name: str
    owns: frozenset[str]
    tables: Callable[[Mapping[str, DataFrame]], Mapping[str, DataFrame]]
    needs: frozenset[str] = frozenset()


def snapshot(spark: SparkSession, name: str, folders: Mapping[str, str]) -> Provider:
    """A provider of recorded facts: a folder of JSON lines for each family."""
    return Provider(name, frozenset(folders), lambda _: {f: read_facts(spark, f, p) for f, p in folders.items()})


def gathered(providers: list[Provider], native: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """All families; a family has one owner, and a provider runs after those that it needs."""
    owners: dict[str, str] = dict.fromkeys(native, "native")
    for p in providers:
        for family in sorted(p.owns):
            if family in owners:
                raise ValueError(f"{family} is owned by {owners[family]} and {p.name}")
            owners[family] = p.name
    found, waiting = dict(native), sorted(providers, key=lambda p: p.name)
    while waiting:
        ready = [p for p in waiting if p.needs <= set(found)]
        if not ready:
            raise ValueError("providers wait for each other: " + ", ".join(p.name for p in waiting))
        for p in ready:
            made = p.tables(found)
            if set(made) != set(p.owns):
                raise ValueError(f"{p.name} must give just what it owns")
            found.update(made)
        waiting = [p for p in waiting if p not in ready]
    return found
