"""Contextual queries: candidates as JSON, a pluggable classifier, and decision tables.

A candidate is one row with a subject; the backend answers with a category, or with yes, no
or unknown for each criterion, and a confidence.  Answers under the confidence gate, failures
and categories outside the domain count as uncertain.  Backends run over Arrow batches on the
executors; everything before and after is DataFrame expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_CONFIDENCE = 0.6
UNCERTAIN, UNKNOWN = "uncertain", "unknown"
#: Nested rows of one relation that a candidate carries at most, in their order.
MOST_ROWS = 200
#: Candidates that a Python worker holds at once; a subject has some kB, so a batch has a few MB.
BATCH_ROWS = 500


class Backend(Protocol):
    """Answers a batch of subjects; runs on executors, so it must be picklable."""

    name: str

    def answer(self, question: str, options: Sequence[str], subjects: Sequence[str]) -> list[tuple[str, float]]: ...


@dataclass(frozen=True)
class Keywords:
    """A local, deterministic backend: the option whose patterns match most often."""

    patterns: dict[str, str]
    name: str = "keywords"

    def answer(self, question: str, options: Sequence[str], subjects: Sequence[str]) -> list[tuple[str, float]]:
        out = []
        for subject in subjects:
            hits = {o: len(re.findall(self.patterns[o], subject, re.IGNORECASE)) for o in options if o in self.patterns}
            total = sum(hits.values())
            best = max(sorted(hits), key=lambda o: hits[o], default=UNCERTAIN)
            out.append((best, hits[best] / total) if total else (UNCERTAIN, 0.0))
        return out


@dataclass(frozen=True)
class Constant:
    """A backend that always gives one answer, for tests."""

    value: str
    confidence: float = 1.0
    name: str = "constant"

    def answer(self, question: str, options: Sequence[str], subjects: Sequence[str]) -> list[tuple[str, float]]:
        return [(self.value or options[0], self.confidence)] * len(subjects)


def bounded(items: Column, most: int = MOST_ROWS) -> Column:
    """The first rows of a nested relation, as a candidate carries them."""
    return F.slice(F.coalesce(items, F.array()), 1, most)


def subject(kinds: Mapping[str, str], fields: Sequence[str]) -> Column:
    """Fields of a fact as JSON; nulls stay visible, and nested lists are bounded.  ``kinds`` are the fact's types."""
    parts = [(bounded(F.col(f)) if kinds[f].startswith("array") else F.col(f)).alias(f) for f in fields]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def candidates(facts: DataFrame, identity: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Identity and ``subject_json``."""
    return facts.select(*identity, subject(dict(facts.dtypes), fields).alias("subject_json"))


def reply(backend: Backend, question: str, options: Sequence[str], subjects: Sequence[str]) -> list[tuple[str, float]]:
    """An answer and its confidence for each subject; what the backend fails to give is uncertain."""
    try:
        answers = list(backend.answer(question, options, subjects))
    except Exception:  # noqa: BLE001  a backend's failure is an uncertain answer, not a failed job
        answers = []
    return [(a, float(c)) for a, c in answers[: len(subjects)]] + [(UNCERTAIN, 0.0)] * (len(subjects) - len(answers))


def small_batches(rows: DataFrame) -> None:
    """Bound what a Python worker holds at once."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _ask(rows: DataFrame, asked: Sequence[tuple[str, Backend, str, Sequence[str]]]) -> DataFrame:
    """Add ``answer`` and ``confidence``, named after the prefixes of ``asked``, and ``tokens``.

    All questions are put in one pass, so that a task has one Python worker however many there are."""
    small_batches(rows)
    names = [*rows.columns, *[f"{p}{c}" for p, *_ in asked for c in ("answer", "confidence")], "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            subjects = batch.column(batch.schema.get_field_index("subject_json")).to_pylist()
            arrays = list(batch.columns)
            for _, backend, question, options in asked:
                answers = reply(backend, question, options, subjects)
                arrays += [pa.array([a for a, _ in answers], pa.string()), pa.array([c for _, c in answers], pa.float64())]
            arrays.append(pa.array([len(s) // 4 for s in subjects], pa.int64()))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + "".join(f", `{p}answer` string, `{p}confidence` double" for p, *_ in asked)
    return rows.mapInArrow(run, kinds + ", tokens bigint")


def gated(options: Sequence[str], fallback: str, least: float = LEAST_CONFIDENCE, answer: Column | None = None, confidence: Column | None = None) -> Column:
    """The answer if it is an option and sure enough."""
    answer, confidence = F.col("answer") if answer is None else answer, F.col("confidence") if confidence is None else confidence
    return F.when(answer.isin(*options) & (confidence >= least), answer).otherwise(fallback)


def classify(rows: DataFrame, backend: Backend, question: str, options: Sequence[str], least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Add ``category``, ``confidence``, ``backend`` and ``tokens``."""
    asked = _ask(rows, [("", backend, question, options)])
    return asked.select(*rows.columns, "confidence", F.lit(backend.name).alias("backend"), "tokens", gated(options, UNCERTAIN, least).alias("category"))


@dataclass(frozen=True)
class Decision:
    """A row of a decision table: if the criteria have these answers, this is the category."""

    answers: dict[str, bool]
    category: str


def decided(criteria: Sequence[str], table: Sequence[Decision], default: str, of: Callable[[str], Column] = F.col) -> Column:
    """The first row that fits; any unknown answer makes the whole uncertain.  ``of`` gives a criterion's answer."""
    unknown = F.lit(False)
    for c in criteria:
        unknown = unknown | ~of(c).isin("yes", "no") | of(c).isNull()
    value = F.lit(default)
    for row in reversed(table):
        fits = F.lit(True)
        for name, wanted in row.answers.items():
            fits = fits & (of(name) == ("yes" if wanted else "no"))
        value = F.when(fits, row.category).otherwise(value)
    return F.when(unknown, UNCERTAIN).otherwise(value)


def assess(rows: DataFrame, backends: Callable[[str], Backend] | Backend, criteria: dict[str, str], table: Sequence[Decision], default: str, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """One yes, no or unknown for each criterion, side by side, then the table's category."""
    one = hasattr(backends, "answer") or not callable(backends)
    asked = _ask(rows, [(f"{name}__", backends if one else backends(name), question, ("yes", "no")) for name, question in criteria.items()])
    gates = [gated(("yes", "no"), UNKNOWN, least, F.col(f"{name}__answer"), F.col(f"{name}__confidence")).alias(name) for name in criteria]
    return asked.select(*[c for c in rows.columns if c not in criteria], *gates).withColumn("category", decided(list(criteria), table, default))


def spent(answers: DataFrame, by: Sequence[str] = ("backend",)) -> DataFrame:
    """Turns and tokens of distinct subjects."""
    return answers.dropDuplicates([*by, "subject_json"]).groupBy(*by).agg(F.count(F.lit(1)).alias("turns"), F.sum("tokens").alias("tokens"))


def subject_of(row_json: str) -> dict:
    """A candidate's subject, for backends that read its fields."""
    return json.loads(row_json)
