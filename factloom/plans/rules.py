"""Rules: one lazy expression over the facts of a family, with exact findings.

A rule is a function of its settings that returns an ``Answer`` in Columns over one fact, or,
where facts must meet, a function of the families' DataFrames.  All rules of a family are
evaluated in one projection, so that a family is scanned once however many rules read it, and
no rule of a single fact shuffles anything."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce
from inspect import signature

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.plans.policy import FAIL, UNASSESSED, Policy, default

FINDING = "struct<message:string,path:string,line:bigint,measure:double,unit:string>"
IDENTITY = ("fact_id", "path", "language", "start_line", "end_line")
RESULT = (
    f"rule_id string, fact_id string, path string, language string, boolean_value boolean, integer_value bigint, float_value double, category_value string, "
    f"finding_count bigint, verdict string, findings array<{FINDING}>"
)


def say(*parts: Column | str) -> Column:
    """A message from texts and values; a missing value reads as an empty one."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def finding(message: Column | str, path: Column | None = None, line: Column | None = None, measure: Column | None = None, unit: str = "count") -> Column:
    """One finding; by default it stands where its fact does."""
    return F.struct(
        (say(message) if isinstance(message, str) else message).alias("message"),
        (F.col("path") if path is None else path).alias("path"),
        (F.col("start_line") if line is None else line).cast("bigint").alias("line"),
        (F.lit(None) if measure is None else measure).cast("double").alias("measure"),
        F.lit(unit).alias("unit"),
    )


def no_findings() -> Column:
    return F.array().cast(f"array<{FINDING}>")


@dataclass(frozen=True)
class Answer:
    """A scalar and what it rests on; ``findings`` override a stated count.

    ``count`` gives their number from the value's column without making them; without it they are made and counted."""

    kind: str
    value: Column
    findings: Column
    count: Callable[[Column], Column] | None = None


def counted(items: Column, where: Callable[[Column], Column], message: Callable[[Column], Column], line: Callable[[Column], Column] | None = None, path: Callable[[Column], Column] | None = None) -> Answer:
    """The number of items for which a condition holds, each one a finding."""
    chosen = F.filter(F.coalesce(items, F.array()), lambda x: F.coalesce(where(x), F.lit(False)))
    found = F.transform(chosen, lambda x: finding(message(x), path(x) if path else None, line(x) if line else None))
    return Answer("integer", F.size(chosen).cast("bigint"), found, lambda v: v)


def flagged(condition: Column, message: Column | str) -> Answer:
    """A flag that is its own finding."""
    return Answer("boolean", condition, F.when(condition, F.array(finding(message))).otherwise(no_findings()), lambda v: F.when(v, 1).otherwise(0))


def measured(value: Column, message: Column | str, unit: str = "count") -> Answer:
    """A count that is its own finding."""
    value = value.cast("bigint")
    return Answer("integer", value, F.when(value.isNull(), no_findings()).otherwise(F.array(finding(message, measure=value, unit=unit))), lambda v: F.when(v.isNull(), 0).otherwise(1))


def shared(items: Column, where: Callable[[Column], Column], message: Callable[[Column], Column], complete: bool = True) -> Answer:
    """Percentage of items that meet a condition, 0.0 of none; the findings are the gaps."""
    items = F.coalesce(items, F.array())
    good = lambda x: F.coalesce(where(x), F.lit(False))
    n = F.size(items)
    value = F.when(n == 0, F.lit(0.0)).otherwise(100.0 * F.size(F.filter(items, good)) / n)
    gaps = F.filter(items, lambda x: ~good(x) if complete else good(x))
    return Answer("float", value, F.transform(gaps, lambda x: finding(message(x))), lambda _: F.size(gaps))


def gauged(value: Column, message: Column | str, unit: str = "percent") -> Answer:
    """A percentage that is its own finding."""
    return Answer("float", value.cast("double"), F.when(value.isNull(), no_findings()).otherwise(F.array(finding(message, measure=value, unit=unit))), lambda v: F.when(v.isNull(), 0).otherwise(1))


def categorized(cases: list[tuple[Column, str]], otherwise: str, message: Column | str) -> Answer:
    """The category of the first case that holds."""
    value = F.lit(otherwise)
    for condition, name in reversed(cases):
        value = F.when(condition, name).otherwise(value)
    return Answer("category", value, F.array(finding(message)), lambda _: F.lit(1))


@dataclass(frozen=True)
class Rule:
    """A rule of the registry; ``over_facts`` marks one that needs the whole family."""

    id: str
    name: str
    families: tuple[str, ...]
    kind: str
    policy: Policy
    build: Callable
    fix: str | None = None
    lane: str = "deterministic"
    over_facts: bool = False
    languages: tuple[str, ...] = ()
    settings: Mapping[str, object] = field(default_factory=dict)

    def stated(self, **settings: object) -> Rule:
        """The same rule with settings, checked against its signature."""
        known = signature(self.build).parameters
        for name, value in settings.items():
            if name not in known:
                raise ValueError(f"{self.id} has no setting {name}")
            wanted = known[name].default
            if isinstance(wanted, bool) != isinstance(value, bool) or isinstance(wanted, (int, float)) and not isinstance(value, (int, float)):
                raise ValueError(f"{self.id}: {name} must be like {wanted!r}")
        return replace(self, settings={**self.settings, **settings})


REGISTRY: dict[str, Rule] = {}


def rule(id: str, *families: str, kind: str = "integer", policy: Policy | None = None, fix: str | None = None, over_facts: bool = False, languages: tuple[str, ...] = ()):
    """Register a function as a rule."""

    def add(build: Callable) -> Callable:
        if id in REGISTRY:
            raise ValueError(f"{id} is registered twice")
        REGISTRY[id] = Rule(id, build.__name__, families, kind, policy or default(kind), build, fix, "contextual" if id.split("-")[1][4] == "1" else "deterministic", over_facts, languages)
        return build

    return add


def select(rules: Iterable[Rule], chosen: Iterable[str] = ("*",), ignored: Iterable[str] = (), lanes: Iterable[str] = ("deterministic",)) -> list[Rule]:
    """Rules by patterns on id or name, without the ignored ones, in the order of their ids."""
    fits = lambda r, patterns: any(fnmatch.fnmatch(r.id, p) or fnmatch.fnmatch(r.name, p) for p in patterns)
    return sorted((r for r in rules if r.lane in set(lanes) and fits(r, chosen) and not fits(r, ignored)), key=lambda r: r.id)


def batches(rules: Iterable[Rule]) -> list[list[Rule]]:
    """Rules joined by the families that they share; each batch reads its own inputs alone."""
    groups: list[tuple[set[str], list[Rule]]] = []
    for r in rules:
        families, members = set(r.families), [r]
        for group in [g for g in groups if g[0] & families]:
            groups.remove(group)
            families |= group[0]
            members = group[1] + members
        groups.append((families, members))
    return [sorted(members, key=lambda r: r.id) for _, members in groups]


def _result(r: Rule, value: Column, count: Column, findings: Column | None) -> Column:
    kinds = {"boolean": "boolean", "integer": "bigint", "float": "double", "category": "string"}
    values = [(value if k == r.kind else F.lit(None)).cast(t).alias(f"{k}_value") for k, t in kinds.items()]
    made = [F.lit(r.id).alias("rule_id"), *values, count.cast("bigint").alias("finding_count"), r.policy.verdict(value).alias("verdict")]
    return F.struct(*made, *([] if findings is None else [findings.cast(f"array<{FINDING}>").alias("findings")]))


def _checked(r: Rule, answer: Answer) -> Answer:
    if answer.kind != r.kind:
        raise ValueError(f"{r.id} answers with a {answer.kind}, not a {r.kind}")
    return answer


def _judged(rows: DataFrame, answers: list[tuple[Rule, Answer]], with_findings: bool) -> DataFrame:
    """One row for each rule and fact.

    Values become columns before anything reads them, as count and verdict would make them again."""
    within = lambda r, c: F.when(F.col("language").isin(*r.languages), c) if r.languages and not r.over_facts else c
    values = rows.select("*", *[within(r, a.value).alias(f"__v{i}") for i, (r, a) in enumerate(answers)])
    made = []
    for i, (r, a) in enumerate(answers):
        if with_findings or a.count is None:
            made.append(within(r, a.findings).alias(f"__f{i}"))
        else:
            made.append(within(r, a.count(F.col(f"__v{i}"))).alias(f"__n{i}"))
    made = values.select(*IDENTITY[:3], *[f"__v{i}" for i in range(len(answers))], *made)
    results = []
    for i, (r, a) in enumerate(answers):
        counted_only = not with_findings and a.count is not None
        count = F.col(f"__n{i}") if counted_only else F.size(f"__f{i}")
        results.append(within(r, _result(r, F.col(f"__v{i}"), count, F.col(f"__f{i}") if with_findings else None)))
    found = made.select(*IDENTITY[:3], F.explode(F.array_compact(F.array(*results))).alias("r"))
    return found.select("r.rule_id", "fact_id", "path", "language", *[f"r.{c}" for c in _VALUES if with_findings or c != "findings"])


def evaluate(facts: Mapping[str, DataFrame], rules: Iterable[Rule], with_findings: bool = True) -> DataFrame:
    """One row for each rule and fact: value, verdict and, unless only their number is wanted, findings.

    Rules over single facts share one scan for each family; the others bring their own plan."""
    parts: list[DataFrame] = []
    single: dict[str, list[tuple[Rule, Answer]]] = {}
    for r in rules:
        if not all(f in facts for f in r.families):
            continue
        if r.over_facts:
            rows, answer = r.build(facts, **r.settings)
            parts.append(_judged(rows, [(r, _checked(r, answer))], with_findings))
        else:
            single.setdefault(r.families[0], []).append((r, _checked(r, r.build(**r.settings))))
    parts += [_judged(facts[family], members, with_findings) for family, members in single.items()]
    if not parts:
        spark = next(iter(facts.values())).sparkSession
        empty = spark.createDataFrame([], RESULT)
        return empty if with_findings else empty.drop("findings")
    return reduce(DataFrame.unionByName, parts)


_VALUES = ("boolean_value", "integer_value", "float_value", "category_value", "finding_count", "verdict", "findings")


def summary(results: DataFrame) -> DataFrame:
    """By rule: observations, unassessed, failures and findings of the failures."""
    return results.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("observation_count"),
        F.count_if(F.col("verdict") == UNASSESSED).alias("unassessed_count"),
        F.count_if(F.col("verdict") == FAIL).alias("failure_count"),
        F.coalesce(F.sum(F.when(F.col("verdict") == FAIL, F.col("finding_count"))), F.lit(0)).alias("finding_count"),
    )


def failures(results: DataFrame, limit: int | None = None) -> DataFrame:
    """Failed observations in the order of facts, then rules; the first ``limit`` by a bounded sort."""
    found = results.where(F.col("verdict") == FAIL)
    return found.orderBy("fact_id", "rule_id").limit(limit) if limit is not None else found


def findings(failed: DataFrame) -> DataFrame:
    """The findings of retained failures, in their order."""
    rows = failed.select("rule_id", "fact_id", F.posexplode("findings").alias("finding_order", "finding"))
    return rows.select("rule_id", "fact_id", "finding_order", "finding.*")
