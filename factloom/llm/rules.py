"""Quality rules: a linear-chain conditional random field marks lines as content or boilerplate.

Lines with a word are a sequence; the field scores each line's features and each step
between two labels, and Viterbi decoding gives the best labels of the whole sequence.  The
share of words in content lines decides on the document.  The field is trained here by
gradient ascent on the likelihood of a bounded sample.  Its lines take the quality label of
their document at first, from which a field without steps is fitted; a line that this one
holds for the other label by odds of ``ODDS`` changes sides, so that good texts have
boilerplate lines and poor ones content.  The field proper is fitted to the lines' labels.

Beside it stand fixed counts: words, symbols, repeated lines, words in repeated windows.

Cases: null and empty texts have no words and fail the fixed rules; long texts are read whole
and a long line is one line; repeated rows are treated alike; without labelled rows of both
kinds every line is content; an empty table gives an empty one; other columns don't matter.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import map_rows, table
from factloom.llm.samples import labelled

NAME = "op5_rules"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Labelled documents that the field learns from at most, and rounds of ascent.
SAMPLE, ROUNDS, RATE, RIDGE = 3000, 150, 0.5, 1e-3
#: Share of words in content lines from which a document is kept.
SHARE = 0.5
#: Lines of a training sequence.
PART = 40
#: Odds from which a line doesn't take the label of its document.
ODDS = 3.0
_N = 12


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in some window of eight which the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64)
    mixed = (ids + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        key = key * np.uint64(0x100000001B3F) + mixed[k : k + n]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.nonzero(twice)[0]
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbols, repeated lines, words in repeated windows."""
    text = text or ""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, " \t\n\r\v\f"))
    seen: set[str] = set()
    repeated = 0
    for line in text.split("\n"):
        if line in seen:
            repeated += 1
        elif line.strip(" \t\r\v\f"):
            seen.add(line)
    return len(words), chars, sum(map(text.count, SYMBOLS)), repeated, repeated_words(words)


def lines_of(text: str | None) -> tuple[list[int], np.ndarray]:
    """Words of each line that has any, and the lines' features."""
    sizes, rows = [], []
    seen: set[str] = set()
    for line in (text or "").split("\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        low = line.lower()
        rows.append((
            1.0,
            min(n, 60) / 60,
            float(n < 4),
            min(3.0, 3 * sum(map(line.count, "#*$%&<>")) / n),
            min(3.0, 3 * line.count("|") / n),
            sum(map(str.isupper, words)) / n,
            min(2.0, 2 * line.count("!") / n),
            sum(map(str.__eq__, words, words[1:])) / n,
            1 - len(set(words)) / n**0.9 if n > 3 else 0.0,
            float(line in seen),
            min(2.0, 10 * (line.count(".") + line.count(",")) / n),
            float("license" in low or "copyright" in low or "cookie" in low or "http" in low),
        ))
        sizes.append(n)
        seen.add(line)
    return sizes, np.array(rows).reshape(-1, _N)


class Field:
    """A linear-chain field with the labels 0 (boilerplate) and 1 (content)."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps

    def viterbi(self, rows: np.ndarray) -> list[int]:
        """The best labels of a sequence; equal scores go to content."""
        state = (rows @ self.weights.T).tolist()
        (s00, s01), (s10, s11) = self.steps.tolist()
        zero, one = state[0]
        back = []
        for a, b in state[1:]:
            z0, z1, o0, o1 = zero + s00, one + s10, zero + s01, one + s11
            back.append((int(z1 >= z0), int(o1 >= o0)))
            zero, one = max(z0, z1) + a, max(o0, o1) + b
        label = int(one >= zero)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]

    def content_share(self, text: str | None) -> float:
        """Share of words in lines that are marked as content."""
        sizes, rows = lines_of(text)
        if not sizes:
            return 0.0
        labels = self.viterbi(rows)
        return sum(n for n, label in zip(sizes, labels) if label) / sum(sizes)


def train(sequences: list[np.ndarray], labels: list[int]) -> Field:
    """A field for lines, from the labels of their documents."""
    if len(set(labels)) < 2:
        return Field(np.array([[0.0] * _N, [1.0] + [0.0] * (_N - 1)]), np.zeros((2, 2)))
    # documents of either label weigh the same in all, so do their lines
    lines = [sum(len(s) for s, y in zip(sequences, labels) if y == label) for label in (0, 1)]
    weigh = [0.5 / lines[y] for y in labels]
    alone = ascend(sequences, [np.full(len(s), y) for s, y in zip(sequences, labels)], weigh, stepping=False)
    return ascend(sequences, line_labels(sequences, labels, alone), weigh)


def line_labels(sequences: list[np.ndarray], labels: list[int], alone: Field) -> list[np.ndarray]:
    """Labels of lines: their document's, unless a field without steps is sure of the other."""
    found = []
    for rows, y in zip(sequences, labels):
        lean = rows @ (alone.weights[1] - alone.weights[0])
        found.append(np.where(lean >= math.log(ODDS), 1, np.where(lean <= -math.log(ODDS), 0, y)))
    return found


def ascend(sequences: list[np.ndarray], labels: list[np.ndarray], weigh: list[float], stepping: bool = True, rounds: int = ROUNDS) -> Field:
    """Likelihood ascent over all sequences at once; without ``stepping`` steps stay at zero."""
    most = max(map(len, sequences))
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    x, y = np.zeros((len(order), most, _N)), np.zeros((len(order), most), dtype=np.int64)
    size, weigh = np.array([len(sequences[i]) for i in order]), np.array([weigh[i] for i in order])
    for k, i in enumerate(order):
        x[k, : len(sequences[i])], y[k, : len(sequences[i])] = sequences[i], labels[i]
    weights, steps = np.zeros((2, _N)), np.zeros((2, 2))
    speed_w, speed_s = np.zeros_like(weights), np.zeros_like(steps)
    for _ in range(rounds):
        grad_w, grad_s = gradient(x, y, size, weigh, weights, steps)
        speed_w, speed_s = 0.9 * speed_w + grad_w - RIDGE * weights, 0.9 * speed_s + (grad_s - RIDGE * steps) * stepping
        weights, steps = weights + RATE * speed_w, steps + RATE * speed_s
    return Field(weights, steps)


def gradient(x: np.ndarray, y: np.ndarray, size: np.ndarray, weigh: np.ndarray, weights: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the weighted log likelihood, by forward and backward sums; the longest sequence comes first."""
    most = x.shape[1]
    open_at = [int((size > t).sum()) for t in range(most)]
    state = x @ weights.T
    ahead, behind = np.zeros_like(state), np.zeros_like(state)
    ahead[:, 0] = state[:, 0]
    for t in range(1, most):
        k = open_at[t]
        ahead[:k, t] = np.logaddexp(ahead[:k, t - 1, 0, None] + steps[0], ahead[:k, t - 1, 1, None] + steps[1]) + state[:k, t]
    for t in range(most - 2, -1, -1):
        k = open_at[t + 1]
        after = behind[:k, t + 1] + state[:k, t + 1]
        behind[:k, t] = np.logaddexp(after[:, 0, None] + steps[:, 0], after[:, 1, None] + steps[:, 1])
    total = np.logaddexp(ahead[:, 0, 0] + behind[:, 0, 0], ahead[:, 0, 1] + behind[:, 0, 1])
    mask = np.arange(most) < size[:, None]
    p = np.exp(ahead + behind - total[:, None, None]) * mask[:, :, None]
    true = np.stack([(y == 0) & mask, (y == 1) & mask], axis=2)
    grad_w = np.einsum("btl,btf,b->lf", true - p, x, weigh)
    grad_s = np.zeros_like(steps)
    for t in range(1, most):
        k = open_at[t]
        pair = np.exp(ahead[:k, t - 1, :, None] + steps + (state[:k, t] + behind[:k, t])[:, None, :] - total[:k, None, None])
        grad_s = grad_s + np.einsum("bij,b->ij", (true[:k, t - 1, :, None] & true[:k, t, None, :]) - pair, weigh[:k])
    return grad_w, grad_s


def fit(sample: DataFrame) -> Field:
    """Train on a bounded sample (doc_id, text, label); long sequences are cut into parts of ``PART`` lines."""
    measured = map_rows(sample, ["doc_id", "label"], "parts array<array<array<double>>>", ["text"], lambda: lambda t: (_parts(t),))
    rows = measured.where(F.size("parts") > 0).orderBy("doc_id").toLocalIterator()
    found = [(np.array(part), r["label"]) for r in rows for part in r["parts"]]
    return train([part for part, _ in found], [label for _, label in found])


def _parts(text: str | None) -> list[list[list[float]]]:
    rows = lines_of(text)[1].tolist()
    return [rows[at : at + PART] for at in range(0, len(rows), PART)]


def apply(df: DataFrame, field: Field, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the counts, ``content_share``, ``base_failed`` and ``kept`` of each row's whole text."""
    added = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, content_share double"
    names = [part.split()[0] for part in added.split(", ")]
    kept = keep if keep is not None else [c for c in df.columns if c not in (*names, "base_failed", "kept")]
    sent = df.sparkSession.sparkContext.broadcast(field)
    done = map_rows(df, kept, added, [text], lambda: lambda t: (*counts(t), sent.value.content_share(t)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return done.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("content_share") >= SHARE))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = fit(labelled(docs, table(spark, sf_dir, "labels"), "quality", SAMPLE))
    return apply(docs, field, keep=["doc_id"])
