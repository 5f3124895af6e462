"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

A document's statistics are standardised and mapped by random cosines, whose inner products
approximate a Gaussian kernel.  Each partition of the labelled sample sums its part of the
normal equations; the sums are of a fixed size and are added up for the ridge solution.
Scores of a part of the sample that the fit did not see are made monotone probabilities by
pooling adjacent violators.

Cases: null and empty texts have the statistics of the empty text and get a score; long texts
count whole; repeated rows score alike; without labelled rows of both kinds every score is
the share of label 1, or 0.5; an empty table gives an empty one; other columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import fold, map_rows, table
from factloom.llm.samples import HELD_OUT, labelled

NAME = "op2_quality"
FEATURES, RIDGE, WIDTH, SEED = 256, 1e-3, 4.0, 20240501
THRESHOLD = 0.3
_MARKS = "#*$%&|<>"
_N = 16


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a whole text."""
    text = text or ""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    count = max(1, n)
    seen = Counter(words)
    lower = text.lower()
    upper = sum(map(str.isupper, words))
    marks = [text.count(c) for c in _MARKS]
    lines = text.split("\n")
    repeats = sum(map(str.__eq__, words, words[1:])) if n > 1 else 0
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 1
    return [
        np.log1p(n),
        len(seen) / count**0.9,
        sum(marks) / count,
        (marks[2] + marks[3] + marks[4]) / count,
        marks[5] / count,
        upper / count,
        text.count("!") / count,
        repeats / count,
        1 - pairs / max(1, n - 1),
        max(seen.values(), default=0) / count,
        (chars - n) / count / 10,
        len(lines) / count,
        1 - len(set(lines)) / len(lines),
        (text.count(".") + text.count(",")) / count,
        sum(text.count(d) for d in "0123456789") / chars,
        sum(map(lower.count, ("http", "click", "copyright", "license"))) / count,
    ]


@dataclass(frozen=True)
class Model:
    """A fitted classifier: standardisation, cosines, ridge weights and calibration steps."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier(self.standard(x), self.omega, self.phase) @ self.weights

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -5, 5)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1."""
        if not len(self.steps):
            return np.full(len(x), self.values[0])
        return np.clip(np.interp(self.raw(x), self.steps, self.values), 0.0, 1.0)


def fourier(x: np.ndarray, omega: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Random Fourier features, with a constant and the statistics themselves."""
    return np.hstack([np.sqrt(2 / omega.shape[1]) * np.cos(x @ omega + phase), np.ones((len(x), 1)), x])


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: middle score and mean label of each pool."""
    pools: list[list[float]] = []
    for s, y in sorted(zip(score.tolist(), label.tolist())):
        pools.append([y, 1.0, s])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            y1, n1, s1 = pools.pop()
            pools[-1] = [pools[-1][0] + y1, pools[-1][1] + n1, pools[-1][2] + s1]
    return np.array([s / n for _, n, s in pools]), np.array([(y + 0.05) / (n + 0.1) for y, n, _ in pools])


def _measured(sample: DataFrame) -> DataFrame:
    return map_rows(sample, ["doc_id", "label"], "x array<double>", ["text"], lambda: lambda t: (statistics(t),))


def fit(sample: DataFrame) -> Model:
    """Fit on ``sample`` (doc_id, text, label), whose number of rows is bounded."""
    measured = _measured(sample).withColumn("fit", F.crc32(F.concat(F.lit("c"), F.col("doc_id").cast("string"))) % 4 != 0).persist()
    try:
        mean, spread = (np.zeros(_N), np.ones(_N))
        sums = measured.select(*[f(F.get("x", i)).alias(f"{n}{i}") for n, f in (("m", F.avg), ("s", F.stddev_pop)) for i in range(_N)], F.avg("label").alias("p"), F.count("*").alias("n")).first()
        if not sums["n"] or sums["p"] in (0, 1):
            return _flat(0.5 if not sums["n"] else float(sums["p"]))
        mean = np.array([sums[f"m{i}"] for i in range(_N)])
        spread = np.maximum(np.array([sums[f"s{i}"] for i in range(_N)]), 1e-6)
        rng = np.random.default_rng(SEED)
        omega, phase = rng.normal(size=(_N, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)
        model = Model(mean, spread, omega, phase, np.zeros(0), np.zeros(0), np.zeros(0))
        size = FEATURES + 1 + _N

        def normal(batches):
            gram, side = np.zeros((size, size)), np.zeros(size)
            for batch in batches:
                x = np.array(batch["x"].tolist()).reshape(-1, _N)
                z = fourier(model.standard(x), omega, phase)
                gram += z.T @ z
                side += z.T @ batch["label"].to_numpy()
            yield pd.DataFrame({"part": [np.concatenate([gram.ravel(), side]).tobytes()]})

        # the sample has 24 partitions, each of whose sums takes 600 kB
        parts = [np.frombuffer(r["part"]) for r in measured.where("fit").select("x", "label").mapInPandas(normal, "part binary").toLocalIterator()]
        total = np.sum(parts, axis=0)
        gram, side = total[: size * size].reshape(size, size), total[size * size :]
        weights = np.linalg.solve(gram + RIDGE * sums["n"] * np.eye(size) * 0.01, side)
        rest = measured.where("NOT fit").orderBy("doc_id").select("x", "label").toPandas()
        model = Model(mean, spread, omega, phase, weights, np.zeros(0), np.zeros(0))
        if not len(rest):
            return _flat(float(sums["p"]))
        steps, values = isotonic(model.raw(np.array(rest["x"].tolist())), rest["label"].to_numpy().astype(float))
        return Model(mean, spread, omega, phase, weights, steps, values)
    finally:
        measured.unpersist()


def _flat(share: float) -> Model:
    return Model(np.zeros(_N), np.ones(_N), np.zeros((_N, 1)), np.zeros(1), np.zeros(2 + _N), np.zeros(0), np.array([share]))


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, to: str = "score") -> DataFrame:
    """Add ``to``, the score (0 to 1) of each row's whole text."""
    kept = keep if keep is not None else [c for c in df.columns if c != to]
    sent = df.sparkSession.sparkContext.broadcast(model)

    def start():
        return lambda t: (float(sent.value.score(np.array([statistics(t)]))[0]),)

    return map_rows(df, kept, f"{to} double", [text], start)


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """A classifier fitted on the labels that aren't held out."""
    return fit(labelled(docs, labels, "quality"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fitted(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", (fold(F.col("doc_id"), HELD_OUT) == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
