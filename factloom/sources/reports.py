"""Sinks: result tables, concise text, idempotent publication, diagrams of small graphs."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.rules import findings, summary


def write_results(results: DataFrame, path: str) -> None:
    """Results, dealt by rule, so that a reader of one rule reads its files alone."""
    results.write.mode("overwrite").partitionBy("rule_id").parquet(path)


def write_findings(failed: DataFrame, path: str) -> None:
    findings(failed).write.mode("overwrite").json(path)


def concise(results: DataFrame) -> str:
    """A line for each rule; the summary has one row a rule, whatever the facts."""
    rows = summary(results).orderBy("rule_id").collect()
    return "\n".join(f"{r['rule_id']}: {r['failure_count']} of {r['observation_count']} failed, {r['finding_count']} findings, {r['unassessed_count']} unassessed" for r in rows)


def summary_json(results: DataFrame) -> str:
    return json.dumps([r.asDict() for r in summary(results).orderBy("rule_id").collect()], sort_keys=True)


def published(known: DataFrame, results: DataFrame, run: str) -> DataFrame:
    """Known verdicts with a run's put over them, by rule and fact: publishing twice changes nothing."""
    new = results.select("rule_id", "fact_id", "verdict", F.lit(run).alias("run"))
    both = known.select("rule_id", "fact_id", "verdict", "run", F.lit(0).alias("turn")).unionByName(new.withColumn("turn", F.lit(1)))
    return both.groupBy("rule_id", "fact_id").agg(F.max_by(F.struct("verdict", "run"), F.struct("turn", "run", "verdict")).alias("x")).select("rule_id", "fact_id", "x.*")


def mermaid(edges: Iterable[tuple[str, str]]) -> str:
    rows = sorted(set(edges))
    names = {n: f"n{i}" for i, n in enumerate(sorted({n for e in rows for n in e}))}
    return "\n".join(["graph TD", *(f'  {i}["{n}"]' for n, i in names.items()), *(f"  {names[a]} --> {names[b]}" for a, b in rows)])


def d2(edges: Iterable[tuple[str, str]]) -> str:
    return "\n".join(f'"{a}" -> "{b}"' for a, b in sorted(set(edges)))


def matrix(order: list[str], edges: Iterable[tuple[str, str]]) -> str:
    """A text matrix: rows depend on columns; marks above the diagonal point back."""
    held = set(edges)
    width = max(map(len, order), default=0)
    return "\n".join(f"{a.ljust(width)} " + "".join("·" if a == b else "x" if (a, b) in held else " " for b in order) for a in order)
