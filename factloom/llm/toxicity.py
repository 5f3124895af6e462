"""Toxicity: a lexicon trie met by Levenshtein automata, and context windows.

The lexicon is learned: words and word beginnings that the labelled sample's toxic documents
hold far more often than the others.  A word is toxic if it or one of its beginnings is in the
lexicon; a misspelled one is caught by the terms' Levenshtein automata, intersected with the
trie of all of them and made deterministic as words are read.  Each hit is scored
by its window of words: marks of quotation or reporting around it weaken it, words of address
strengthen it.  A logistic regression turns a document's sums into a probability.

Cases: null and empty texts hit nothing and get the probability of that; long texts are read
whole; repeated rows score alike; without labelled rows of both kinds every score is the
share of label 1, or 0; an empty table gives an empty one; other columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import fold, map_rows, table
from factloom.llm.samples import HELD_OUT, labelled

NAME = "op7_toxicity"
#: Toxic documents that must hold a term, and how many times likelier it must be there.
LEAST_DOCS, LEAST_RATIO = 5, 15.0
#: The same as a share of the sample's toxic documents: copies of one must not make a term.
LEAST_SHARE = 0.01
#: Letters of the shortest beginning that counts as a term.
STEM = 3
WINDOW = 5
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*|[\"“”„«»:]")
_QUOTES = frozenset("\"“”„«»")
_REPORTING = frozenset("said says wrote quoted quote called reported term word meaning sagte schrieb zitat disait écrit citation dijo escribió cita".split())
_ADDRESS = frozenset("you your youre u du dich dein ihr tu toi ton vous votre tú tu usted eres".split())
_LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})


def allowed(size: int) -> int:
    """Edits that a term of this length may differ by."""
    return 0 if size < 5 else 1 if size < 9 else 2


class Automaton:
    """The Levenshtein automata of all terms, intersected with the trie that holds them.

    A state is a set of places: a node of the trie and the fewest edits with which the letters
    read so far lead there.  A place is given up as soon as its edits are more than any term
    below its node may differ by.  States are numbered and their steps remembered as words are
    read, so that a word costs one lookup a letter, mostly until no place is left."""

    #: Places and steps that are remembered at once; beyond that all are forgotten and made anew.
    MOST = 1_500_000

    def __init__(self, words, stems):
        self.next: list[dict[str, int]] = [{}]
        self.most = [0]  # edits that some term below the node may differ by
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        for ends, terms in ((self.word, words), (self.stem, stems)):
            for term in terms:
                if not allowed(len(term)):
                    continue
                node = 0
                for c in term:
                    self.most[node] = max(self.most[node], allowed(len(term)))
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        self.most.append(0)
                        self.word.append(None)
                        self.stem.append(None)
                    node = self.next[node][c]
                self.most[node] = max(self.most[node], allowed(len(term)))
                ends[node] = term
        self._forget()

    def _forget(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.places: list[dict[int, int]] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple] = []
        self.held = 0
        self.start = self._state({0: 0})

    def _state(self, places: dict[int, int]) -> int:
        """The number of the state with these places, to which those behind left-out letters are added."""
        todo = sorted(places.items(), key=lambda x: x[1])
        for node, edits in todo:  # grows while it is read, by rising edits
            if places[node] == edits:
                for child in self.next[node].values():
                    if edits < self.most[child] and edits + 1 < places.get(child, 99):
                        places[child] = edits + 1
                        todo.append((child, edits + 1))
        key = frozenset(places.items())
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.places)
            self.places.append(places)
            self.steps.append({})
            of = lambda ends: min(((e, ends[n]) for n, e in places.items() if ends[n] is not None and e <= allowed(len(ends[n]))), default=None)
            self.ends.append((of(self.word), of(self.stem)))
            self.held += 1 + len(places)
        return found

    def _step(self, state: int, c: str) -> int:
        made: dict[int, int] = {}
        for node, edits in self.places[state].items():
            if edits < self.most[node] and edits + 1 < made.get(node, 99):
                made[node] = edits + 1
            for letter, child in self.next[node].items():
                cost = edits + (letter != c)
                if cost <= self.most[child] and cost < made.get(child, 99):
                    made[child] = cost
        found = self.steps[state][c] = self._state(made) if made else -1
        self.held += 1
        return found

    def near(self, word: str) -> tuple[str | None, str | None]:
        """The closest whole term within its allowed distance of the word, and the closest
        beginning within its own of a beginning of it; the first in order among equals."""
        if self.held > self.MOST:
            self._forget()
        state, steps = self.start, self.steps
        stem = self.ends[state][1]
        for c in word:
            following = steps[state].get(c)
            state = self._step(state, c) if following is None else following
            if state < 0:
                return None, stem and stem[1]
            end = self.ends[state][1]
            if end is not None and (stem is None or end < stem):
                stem = end
        end = self.ends[state][0]
        return end and end[1], stem and stem[1]


class _Kinds(dict):
    """Kinds of the words met last, None for those that are no hit; bounded by what they hold."""

    LETTERS = 4_000_000

    def __init__(self, kind_of):
        self.kind_of, self.letters = kind_of, 0

    def __missing__(self, word: str) -> tuple[int, float] | None:
        found = self.kind_of(word)
        self.letters += len(word) + 20
        if self.letters > self.LETTERS:
            self.clear()
            self.letters = 0
        if len(word) < 1000:
            self[word] = found
        return found


@dataclass
class Lexicon:
    """Words and beginnings with their weights; ``kinds`` remembers the last words.

    ``fuzzy`` holds what is searched misspelled, beginnings with ``*`` behind them."""

    words: dict[str, float]
    stems: dict[str, float]
    fuzzy: dict[str, float]

    def __post_init__(self):
        self.kinds = _Kinds(self._kind_of)
        self.automaton: Automaton | None = None

    def __reduce__(self):
        return Lexicon, (self.words, self.stems, self.fuzzy)

    def kind_of(self, word: str) -> tuple[int, float]:
        """Kind (0 none, 1 word, 2 beginning, 3 misspelled) and weight of a word."""
        return self.kinds[word] or (0, 0.0)

    def _kind_of(self, word: str) -> tuple[int, float] | None:
        if word in self.words:
            return 1, self.words[word]
        for n in range(len(word), STEM - 1, -1):
            if word[:n] in self.stems:
                return 2, self.stems[word[:n]]
        term = self.meant(word)
        return (3, self.fuzzy[term]) if term else None

    def meant(self, word: str) -> str | None:
        """The term that a word outside the lexicon misspells, whole or in its beginning."""
        plain = word.translate(_LOOKALIKE)
        if plain != word:
            if plain in self.fuzzy:
                return plain
            for n in range(len(plain), STEM - 1, -1):
                if plain[:n] + "*" in self.fuzzy:
                    return plain[:n] + "*"
        if len(plain) < 4:
            return None
        if self.automaton is None:
            self.automaton = Automaton((t for t in self.fuzzy if t[-1] != "*"), (t[:-1] for t in self.fuzzy if t[-1] == "*"))
        term, stem = self.automaton.near(plain)
        return term or stem and stem + "*"


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Sums over a whole text: hits by kind, quoted hits, addressed hits, hits per word."""
    words = _WORD.findall((text or "").lower())
    kinds = lexicon.kinds
    sums = [0.0] * 8
    for i, found in [(i, k) for i, k in enumerate([kinds[w] for w in words]) if k]:
        kind, weight = found
        around = words[max(0, i - WINDOW) : i + WINDOW + 1]
        before = words[max(0, i - WINDOW) : i]
        quoted = not _QUOTES.isdisjoint(around) or not _REPORTING.isdisjoint(before)
        sums[kind - 1] += 1
        sums[3] += weight * (0.3 if quoted else 1.0)
        sums[4] += quoted
        sums[5] += not _ADDRESS.isdisjoint(around)
    hits = sum(sums[:3])
    n = max(1, len(words))
    return [math.log1p(sums[0]), math.log1p(sums[1]), math.log1p(sums[2]), math.log1p(sums[3]), math.log1p(sums[4]), math.log1p(sums[5]), min(1.0, 20 * hits / n), float(hits > 0)]


def _terms(sample: DataFrame) -> DataFrame:
    """Documents of each label with each word and each beginning (ending in ``*``)."""

    def count(batches):
        for batch in batches:
            seen: Counter = Counter()
            for text, label in zip(batch["text"], batch["label"]):
                words = {w for w in _WORD.findall((text or "").lower()) if len(w) > 2}
                stems = {w[:n] + "*" for w in words for n in range(STEM, min(len(w), 9))}
                seen.update((t, int(label)) for t in words | stems)
            rows = [(t, y, n) for (t, y), n in seen.items()]
            yield pd.DataFrame(rows, columns=["term", "label", "n"])

    counted = sample.select("text", "label").mapInPandas(count, "term string, label int, n bigint")
    return counted.groupBy("term").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("other"))


def learn(sample: DataFrame) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and weights of the regression, from a bounded sample."""
    total = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    if not bad or not good:
        return Lexicon({}, {}, {}), np.array([*[0.0] * 8, 30.0 if bad else -30.0])
    ratio = ((F.col("toxic") + 0.5) / (bad + 1)) / ((F.col("other") + 0.5) / (good + 1))
    strong = _terms(sample).withColumn("ratio", ratio).where((F.col("toxic") >= max(LEAST_DOCS, LEAST_SHARE * bad)) & (F.col("ratio") >= LEAST_RATIO))
    # a beginning must also be purer than chance: few other documents hold it
    rows = strong.where("other <= 0.2 * toxic").orderBy(F.desc("toxic"), "term").collect()
    words = {r["term"]: math.log(r["ratio"]) for r in rows if not r["term"].endswith("*")}
    held: dict[str, int] = {}  # most documents of a word with this beginning
    for r in rows:
        if r["term"] in words:
            for n in range(STEM, len(r["term"]) + 1):
                held[r["term"][:n]] = max(r["toxic"], held.get(r["term"][:n], 0))
    stems: dict[str, float] = {}
    for r in sorted((r for r in rows if r["term"].endswith("*")), key=lambda r: len(r["term"])):
        stem = r["term"][:-1]
        if not any(stem[:n] in stems for n in range(STEM, len(stem))) and not (stem in held and r["toxic"] <= 1.2 * held[stem]):
            stems[stem] = math.log(r["ratio"])
    plain = {w: v for w, v in words.items() if not any(w[:n] in stems for n in range(STEM, len(w) + 1))}
    lexicon = Lexicon(plain, stems, words | {t + "*": v for t, v in stems.items()})
    # a term whose near misses are common in other documents isn't searched for misspelled
    first = sample.sparkSession.sparkContext.broadcast(lexicon)
    misses = map_rows(sample, ["label"], "terms array<string>", ["text"], lambda: lambda t: (_misspelled(t, first.value),))
    per_term = misses.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).collect()
    noisy = {r["term"] for r in per_term if r["n"] - r["toxic"] > max(1, 0.2 * r["toxic"])}
    lexicon = Lexicon(plain, stems, {w: v for w, v in lexicon.fuzzy.items() if w not in noisy})
    second = sample.sparkSession.sparkContext.broadcast(lexicon)
    measured = map_rows(sample, ["doc_id", "label"], "x array<double>", ["text"], lambda: lambda t: (features(t, second.value),)).orderBy("doc_id").toPandas()
    first.unpersist()
    second.unpersist()
    x = np.hstack([np.array(measured["x"].tolist()), np.ones((len(measured), 1))])
    y = measured["label"].to_numpy().astype(float)
    weights = np.zeros(x.shape[1])
    for _ in range(50):  # Newton's steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        hessian = (x.T * (p * (1 - p))) @ x + 0.3 * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (y - p) - 0.3 * weights)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return lexicon, weights


def _misspelled(text: str | None, lexicon: Lexicon) -> list[str]:
    words = set(_WORD.findall((text or "").lower()))
    found = set()
    for w in words:
        if lexicon.kind_of(w)[0] == 3:
            found.add(lexicon.meant(w))
    return sorted(found)


def score(df: DataFrame, lexicon: Lexicon, weights: np.ndarray, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1) and ``hits`` of each row's whole text."""
    kept = keep if keep is not None else [c for c in df.columns if c not in ("score", "hits")]
    sent = df.sparkSession.sparkContext.broadcast((lexicon, [float(w) for w in weights]))

    def start():
        known, w = sent.value

        def one(t):
            x = features(t, known)
            z = sum(a * b for a, b in zip(x, w)) + w[-1]
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), round(sum(math.expm1(v) for v in x[:3]))

        return one

    return map_rows(df, kept, "score double, hits bigint", [text], start)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon, weights = learn(labelled(docs, table(spark, sf_dir, "labels"), "toxic"))
    scored = score(docs, lexicon, weights, keep=["doc_id"])
    return scored.select("doc_id", (fold(F.col("doc_id"), HELD_OUT) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "hits")
