"""Benchmark decontamination: BM25 over test items, found with block-max WAND, then verified.

The test items are indexed, and their questions and answers as entries of their own, so that
the two may stand in different passages: each term's postings are ordered by item and cut into blocks, of
which the largest contribution is kept.  Every training passage, a window of ``PASSAGE``
words, is a query; windows overlap by half, and cover every word of every document.  An item
is retrieved when a passage scores ``RETRIEVE`` of what one of its entries scores against
itself, times the share of that which must stand in one passage.  An entry's weakest terms, which add up to less
than ``SPARED`` of its threshold, are set aside as a bound; the others' scores are summed for
all passages of many texts at once.  A passage goes on only with blocks in which that sum and
the bound reach a threshold, then only if the block maxima of all its terms do; there the
postings are walked by pivots.

A retrieved item counts if question and answer overlap with the document: the question is
the item up to its last sentence, the answer that sentence.  Of the question's runs of five
words at least ``OVERLAP`` stand in the document, and of the answer's too; a part with fewer
than five words is one run.

Texts that lack too many of a part's rare words to be verified are set aside beforehand; this
is a bound of the verification itself and loses nothing.

The index is a broadcast of items whose words are bounded by ``BLOCK_WORDS``; more items are
taken in blocks of that size, each against all documents, with the statistics of all items.

Cases: null and empty texts match nothing, nor do items without words; an item given twice
matches under both ids; long texts and long items are taken whole, items longer than a
passage by several; repeated rows match alike; empty tables give empty results; other
columns don't matter.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import fresh, map_lists, table

NAME = "op1_decontaminate"
#: Words of a passage, and of the step between passages.
PASSAGE, STEP = 128, 64
K1, B = 1.2, 0.75
RETRIEVE, OVERLAP, RUN = 0.6, 0.8, 5
#: Share of an item's threshold that the terms set aside stay under.
SPARED = 0.7
#: Rare words of a part that a text must hold, beside those that it may lack.
SIEVE = 4
#: Words of the texts that are searched at once.
AT_ONCE = 250_000
#: Items in a block of postings, and words in a block of items, some 200 MB as an index with their parts.
POSTINGS, BLOCK_WORDS = 16, 500_000
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased words without punctuation."""
    return _WORD.findall((text or "").lower())


def runs(words: list[str]) -> set[tuple[str, ...]]:
    """Runs of five words; of fewer words, the one run there is."""
    if not words:
        return set()
    if len(words) < RUN:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(RUN))))


def parts_of(text: str | None) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer, which is the last sentence or line."""
    pieces = [p for p in re.split(r"(?<=[.!?])\s+|\n", text or "") if words_of(p)]
    if len(pieces) < 2:
        return words_of(text), []
    return [w for p in pieces[:-1] for w in words_of(p)], words_of(pieces[-1])


#: Items, words of one on average, and items that hold each word.
Statistics = tuple[int, float, Mapping[str, int]]


def statistics_of(texts: Iterable[list[str]]) -> Statistics:
    """Of all items with a word, from their words."""
    n, words, spread = 0, 0, Counter()
    for t in texts:
        if t:
            n, words = n + 1, words + len(t)
            spread.update(set(t))
    return n, words / max(1, n), spread


class Index:
    """Block-max BM25 index of test items."""

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        rows = [(i, t) for i, t in items if words_of(t)]
        self.ids = [i for i, _ in rows]
        texts = [words_of(t) for _, t in rows]
        self.parts = [tuple(p for p in map(runs, parts_of(t)) if p) for _, t in rows]
        self.terms: dict[str, int] = {}
        counts = [Counter(w) for w in texts]
        for c in counts:
            for w in c:
                self.terms.setdefault(w, len(self.terms))
        items_n, mean, spread = statistics or statistics_of(texts)
        #: The item of each entry: the whole items first, then the parts of those with two.
        self.of = list(range(len(texts)))
        for item, (_, t) in enumerate(rows):
            for part in (p for p in parts_of(t) if p and len(self.parts[item]) > 1):
                self.of.append(item)
                texts.append(part)
                counts.append(Counter(part))
        n = len(texts)
        self.blocks = max(1, -(-n // POSTINGS))
        self.postings: list[dict[int, list[tuple[int, float]]]] = [defaultdict(list) for _ in self.terms]
        self.most = np.zeros((len(self.terms), self.blocks), dtype=np.float64)
        own = np.zeros(n)
        weights: list[dict[int, float]] = [{} for _ in texts]
        for item, c in enumerate(counts):
            size = K1 * (1 - B + B * len(texts[item]) / mean)
            for w, k in c.items():
                idf = math.log(1 + (items_n - spread[w] + 0.5) / (spread[w] + 0.5))
                weight, t = idf * k * (K1 + 1) / (k + size), self.terms[w]
                own[item] += weight
                weights[item][t] = weight
                self.postings[t][item // POSTINGS].append((item, weight))
                self.most[t, item // POSTINGS] = max(self.most[t, item // POSTINGS], weight)
        # of a longer item, a passage half covered by it holds this share of its words at least
        share = np.array([min(1.0, STEP / len(t)) for t in texts]) if n else np.zeros(0)
        self.threshold = RETRIEVE * own * share
        least = np.full(self.blocks * POSTINGS, np.inf)
        least[:n] = self.threshold
        self.least = least.reshape(self.blocks, POSTINGS).min(axis=1)
        self._essential(weights)
        self._sieve([parts_of(t) for _, t in rows], spread)

    def _sieve(self, parts: list[tuple[list[str], list[str]]], spread: Mapping[str, int]) -> None:
        """Rare words of each part, of which a text must hold a stated number to be verified.

        Of a part with different runs, every missing word breaks a run of its own at least, so a
        text lacks no more words than it may lack runs."""
        rows: dict[str, list[int]] = defaultdict(list)
        need, item_of = [], []
        for item, of_item in enumerate(parts):
            for words in (w for w in of_item if w):
                n = len(runs(words))
                spare = int((1 - OVERLAP) * n + 1e-9)
                rare = sorted(set(words), key=lambda w: (spread.get(w, 0), w))[: spare + SIEVE]
                if n == max(1, len(words) - RUN + 1) and len(rare) > spare:
                    for w in rare:
                        rows[w].append(len(need))
                    need.append(len(rare) - spare)
                    item_of.append(item)
        self.rare = {w: k for k, w in enumerate(rows)}
        self.rare_row = np.concatenate([[0], np.cumsum([len(p) for p in rows.values()])]).astype(np.int64)
        self.rare_part = np.array([p for of in rows.values() for p in of], dtype=np.int64)
        self.need, self.item_of = np.array(need, dtype=np.int64), np.array(item_of, dtype=np.int64)
        self.sieved = np.bincount(self.item_of, minlength=len(self.ids)) if len(self.ids) else np.zeros(0, dtype=np.int64)
        self.free = set(np.flatnonzero(self.sieved == 0).tolist())

    def possible(self, texts: list[list[str]]) -> dict[int, set[int]]:
        """By text, the items that it could be verified to hold; texts without any are left out."""
        get = self.rare.get
        met = [np.unique(np.array([k for k in map(get, words) if k is not None], dtype=np.int64)) for words in texts]
        text, term = np.repeat(np.arange(len(met)), [len(m) for m in met]), np.concatenate([*met, np.zeros(0, dtype=np.int64)])
        size = self.rare_row[term + 1] - self.rare_row[term]
        at = np.repeat(self.rare_row[term] - np.cumsum(size) + size, size) + np.arange(size.sum())
        pair, held = np.unique(np.repeat(text, size) * max(1, len(self.need)) + self.rare_part[at], return_counts=True)
        part = pair % max(1, len(self.need))
        good = held >= self.need[part]
        n = max(1, len(self.ids))
        both, parts = np.unique(pair[good] // max(1, len(self.need)) * n + self.item_of[part[good]], return_counts=True)
        found: dict[int, set[int]] = {i: set(self.free) for i in range(len(texts))} if self.free else {}
        for key in both[parts == self.sieved[both % n]].tolist():
            found.setdefault(key // n, set()).add(key % n)
        return found

    def _essential(self, weights: list[dict[int, float]]) -> None:
        """Each item's terms but the weakest, as rows by term; ``rest`` bounds what those add."""
        rows: dict[int, list[tuple[int, float]]] = defaultdict(list)
        self.rest = np.zeros(len(weights))
        for item, of_term in enumerate(weights):
            for t, w in sorted(of_term.items(), key=lambda x: (x[1], x[0])):
                if self.rest[item] + w < SPARED * self.threshold[item]:
                    self.rest[item] += w
                else:
                    rows[t].append((item, w))
        terms = sorted(rows)
        self.essential = {w: k for w, t in self.terms.items() if (k := self._place(terms, t)) >= 0}
        self.row = np.concatenate([[0], np.cumsum([len(rows[t]) for t in terms])]).astype(np.int64)
        self.row_item = np.array([i for t in terms for i, _ in rows[t]], dtype=np.int64)
        self.row_weight = np.array([w for t in terms for _, w in rows[t]])

    @staticmethod
    def _place(terms: list[int], t: int) -> int:
        k = bisect_left(terms, t)
        return k if k < len(terms) and terms[k] == t else -1

    def hopeful(self, texts: list[list[str]], possible: list[set[int]]) -> list[tuple[int, int, int]]:
        """Texts, passages and blocks in which the essential terms and the rest could reach a
        threshold of an item that is possible for the text."""
        get = self.essential.get
        passages, terms, first = [], [], [0]
        for words in texts:
            last = max(0, -(-len(words) // STEP) - 2)  # a passage is two halves; a short text has one
            met = [(k, t) for k, t in enumerate(map(get, words)) if t is not None]
            if met:
                place, term = np.array(met, dtype=np.int64).T
                half = place // STEP
                passages += [np.minimum(half, last) + first[-1], np.clip(half - 1, 0, last) + first[-1]]
                terms += [term, term]
            first.append(first[-1] + last + 1)
        if not terms:
            return []
        key = np.unique(np.concatenate(passages) * len(self.row) + np.concatenate(terms))
        passage, term = key // len(self.row), key % len(self.row)
        size = self.row[term + 1] - self.row[term]
        at = np.repeat(self.row[term] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        n = len(self.of)
        pair, where = np.unique(np.repeat(passage, size) * n + self.row_item[at], return_inverse=True)
        total = np.bincount(where, weights=self.row_weight[at])
        item = pair % n
        good = total + self.rest[item] >= self.threshold[item] - 1e-6
        pair, item = pair[good], item[good]
        text = np.searchsorted(first, pair // n, side="right") - 1
        known = np.array([k * len(self.ids) + i for k, items in enumerate(possible) for i in items], dtype=np.int64)
        good = np.isin(text * len(self.ids) + np.array(self.of)[item], known)
        found = np.unique((pair[good] // n) * self.blocks + item[good] // POSTINGS)
        text = np.searchsorted(first, found // self.blocks, side="right") - 1
        return list(zip(text.tolist(), (found // self.blocks - np.array(first)[text]).tolist(), (found % self.blocks).tolist()))

    def retrieve(self, texts: list[list[str]]) -> dict[int, set[int]]:
        """By text, items of which some passage of it scores an entry over its threshold."""
        found: dict[int, set[int]] = defaultdict(set)
        possible = self.possible(texts)
        left = sorted(possible)
        for k, passage, block in self.hopeful([texts[i] for i in left], [possible[i] for i in left]):
            text = left[k]
            words = texts[text][passage * STEP : passage * STEP + PASSAGE]
            terms = sorted({self.terms[w] for w in words if w in self.terms})
            if self.most[terms, block].sum(dtype=np.float64) >= self.least[block] - 1e-6:
                found[text].update(item for entry in self.walk(terms, block) if (item := self.of[entry]) in possible[text])
        return found

    def walk(self, terms: list[int], block: int) -> list[int]:
        """Entries of a block at or over their thresholds, by pivots over postings."""
        lists = [(self.most[t, block], self.postings[t][block]) for t in terms if block in self.postings[t]]
        at = [0] * len(lists)
        found, bound = [], float(self.least[block])
        order = list(range(len(lists)))
        while order:
            order = [i for i in order if at[i] < len(lists[i][1])]
            order.sort(key=lambda i: lists[i][1][at[i]][0])
            total, pivot = 0.0, -1
            for k, i in enumerate(order):
                total += float(lists[i][0])
                if total >= bound - 1e-6:
                    pivot = k
                    break
            if pivot < 0:
                return found  # the lists left can't reach any threshold of the block
            item = lists[order[pivot]][1][at[order[pivot]]][0]
            score = 0.0
            for i in order:
                rows = lists[i][1]
                while at[i] < len(rows) and rows[at[i]][0] < item:
                    at[i] += 1
                if at[i] < len(rows) and rows[at[i]][0] == item:
                    score += rows[at[i]][1]
                    at[i] += 1
            if score >= self.threshold[item] - 1e-9:
                found.append(item)
        return found

    def verified(self, words: list[str], candidates: set[int]) -> list[tuple[int, float]]:
        """Of the items, those of which a text holds question and answer, with the smaller overlap."""
        # all runs of five words, and of any shorter part's length
        held = {RUN: runs(words) if len(words) >= RUN else set()}
        found = []
        for item in sorted(candidates):
            overlap = 1.0
            for part in self.parts[item]:
                size = len(next(iter(part)))
                if size not in held:
                    held[size] = set(zip(*(words[i:] for i in range(size))))
                overlap = min(overlap, len(part & held[size]) / len(part))
            if overlap >= OVERLAP:
                found.append((self.ids[item], overlap))
        return found

    def search(self, texts: list[str | None]) -> list[list[tuple[int, float]]]:
        """Items that each whole text holds."""
        out: list[list[tuple[int, float]]] = []
        group: list[list[str]] = []
        size = 0
        for k, text in enumerate(texts):
            group.append(words_of(text))
            size += len(group[-1])
            if size >= AT_ONCE or k == len(texts) - 1:
                met = self.retrieve(group)
                out += [self.verified(words, met[i]) if i in met else [] for i, words in enumerate(group)]
                group, size = [], 0
        return out


def blocks_of(items: DataFrame) -> list[tuple[list[tuple[int, str]], Statistics]]:
    """Items in blocks of a bounded number of words, in the order of their ids; with each, the
    statistics of all items for its words, so that scores don't depend on the blocks."""
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    rows = items.select("item_id", "text").orderBy(*items.select("item_id", "text").columns)
    n_all, mean, spread = statistics_of(words_of(r["text"]) for r in rows.toLocalIterator())
    for r in rows.toLocalIterator():
        n = len(words_of(r["text"]))
        if size and size + n > BLOCK_WORDS:
            blocks.append([])
            size = 0
        blocks[-1].append((r["item_id"], r["text"]))
        size += n
    return [(block, (n_all, mean, {w: spread[w] for _, t in block for w in words_of(t)})) for block in blocks]


def matches(df: DataFrame, items: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Rows of ``keep``, ``item_id`` and ``overlap`` for each item that a row's whole text holds."""
    kind = items.schema["item_id"].dataType.simpleString()
    out = None
    for block in blocks_of(items):
        sent = df.sparkSession.sparkContext.broadcast(block)

        def start(sent=sent):
            index = _index(sent.value)
            return lambda texts: [(hits,) for hits in index.search(texts)]

        hits = map_lists(df, keep, f"hits array<struct<item_id:{kind},overlap:double>>", [text], start)
        rows = hits.select(*keep, F.explode("hits").alias("hit")).select(*keep, "hit.item_id", "hit.overlap")
        out = rows if out is None else out.unionByName(rows)
    return out


def without(df: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose whole text holds no item, with their columns; nothing is shuffled."""
    for block in blocks_of(items):
        sent = df.sparkSession.sparkContext.broadcast(block)

        def start(sent=sent):
            index = _index(sent.value)
            return lambda texts: [(bool(hits),) for hits in index.search(texts)]

        held = fresh(df, "__held")
        df = map_lists(df, df.columns, f"{held} boolean", [text], start).where(~F.col(held)).drop(held)
    return df


_INDEX: dict[int, tuple[tuple, Index]] = {}


def _index(block: tuple[list[tuple[int, str]], Statistics]) -> Index:
    """The index of a block of items, built once in a process."""
    known = _INDEX.get(id(block))
    if known is None:
        if len(_INDEX) > 1:
            _INDEX.clear()
        known = _INDEX[id(block)] = (block, Index(*block))
    return known[1]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items that each document holds."""
    return matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), ["doc_id"])
