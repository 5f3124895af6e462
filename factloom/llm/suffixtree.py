"""Language-model scoring with a probabilistic suffix tree, beside a base score of words.

The tree predicts the bytes of a text's tokens, joined by one space and closed by an end
mark.  Its states are contexts of up to ``DEPTH`` bytes.  A context is a candidate if it
stands at ``LEAST_COUNT`` training positions, so the candidates grow with the corpus, and it
is retained if the next-byte distribution after it diverges from the one after its longest
proper suffix.  Distributions are smoothed towards that suffix's, the root's towards the
uniform one.  Contexts that share their last two bytes are judged together, each group in a
task.  As the retained ones grow with the corpus, their size is summed up first.  Up to ``TABLES``
bytes they are broadcast, and the longest suffix state is found by walking the trie of reversed
contexts, for all positions of many texts at once.  Beyond that no process holds them: each
different window is joined with the retained contexts among its suffixes, and its value goes
back to the chunks that hold it.  Both ways give the same scores.

The base score takes each token's count over all training documents.  Words are counted in
chunks of neighbouring rows, dealt by word and added up there, and the counts that a chunk
needs go back to it; so a frequent word is a row a chunk, and no vocabulary is gathered anywhere.

Cases: null and empty texts hold the end token alone; long texts are read whole; repeated
rows count as often as they stand there; a byte 0 is read as a byte 1; without training
rows every byte has probability 1/256 and every token the base probability 1; an empty table
gives an empty one; other columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import fold, small_batches, written

NAME = "op10_suffixtree"
MODULUS, REMAINDER = 7, 2
DEPTH = 5
#: Training positions of a candidate context; one seen once says nothing of what follows.
LEAST_COUNT = 2
#: A context is retained if both its divergence (in nats) and twice that times its count reach these.
LEAST_KL, LEAST_G = 0.002, 30.0
SMOOTH, SMOOTH_ROOT = 5.0, 0.1
#: Neighbouring rows of a chunk, fewer by half for each doubling of a text's length over LENGTH
#: code points, so that a chunk's texts have ROWS * 2 * LENGTH of them at most, or are one text.
ROWS, LENGTH = 2048, 32_768
#: Different grams that a task holds at once.
HELD = 1_500_000
#: Bytes of the retained contexts' tables, as ``table_bytes`` bounds them, that may be broadcast.
TABLES = 128 << 20
END = b"\n"


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, without the end token."""
    return (text or "").encode().lower().split()


def stream(words: list[bytes]) -> bytes:
    """The symbols of a text: words with one space between them, and the end mark."""
    return b" ".join(words).replace(b"\0", b"\1") + END


def windows(streams: list[bytes]) -> np.ndarray:
    """The (context, symbol) window of ``DEPTH`` + 1 bytes at each symbol; byte 0 stands before a text."""
    pad = b"\0" * DEPTH
    raw = np.frombuffer(b"".join([pad + END + s for s in streams]) or pad, dtype=np.uint8)
    if len(raw) <= DEPTH:
        return np.zeros(0, dtype=np.int64)
    key = np.zeros(len(raw) - DEPTH, dtype=np.int64)
    for k in range(DEPTH + 1):
        key <<= 8
        key |= raw[k : k + len(key)]
    return key[(raw[DEPTH:] != 0) & (raw[DEPTH - 1 : -1] != 0)]  # neither padding nor the mark before a text


def grams(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Different windows and their counts."""
    return np.unique(windows(streams), return_counts=True)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key."""
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def counted_words(docs: DataFrame) -> DataFrame:
    """``chunk, word, n`` of ``docs`` (chunk, size, text, train): a row for each word that a chunk
    holds, with its occurrences in training rows."""
    names = ["chunk", "word", "n"]

    def rows_of(chunk: int, seen: Counter, others: set[bytes]) -> pa.RecordBatch:
        words = [*seen, *(w for w in others if w not in seen)]
        n = np.zeros(len(words), dtype=np.int64)
        n[: len(seen)] = list(seen.values())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(words), chunk, dtype=np.int64)), pa.array(words, pa.binary()), pa.array(n)], names=names)

    def run(batches):
        open_chunks = {}  # by size class, each of which meets its chunks one after the other
        for batch in batches:
            for at, kind, text, train in zip(*(batch.column(k).to_pylist() for k in range(4))):
                chunk, seen, others = open_chunks.get(kind, (None, None, None))
                if at != chunk:
                    if chunk is not None:
                        yield rows_of(chunk, seen, others)
                    chunk, seen, others = open_chunks[kind] = (at, Counter(), set())
                words = tokens(text)
                if train:
                    seen.update(words)
                    seen[END] += 1
                else:
                    others.update(words)
                    others.add(END)
        for chunk, seen, others in open_chunks.values():
            yield rows_of(chunk, seen, others)

    small_batches(docs.sparkSession)
    return docs.select("chunk", "size", "text", "train").mapInArrow(run, "chunk bigint, word binary, n bigint")


def counted_grams(docs: DataFrame) -> DataFrame:
    """``gram, n`` of the training rows of ``docs``, added up in each task as far as ``HELD`` allows."""

    def batch_of(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["gram", "n"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            parts.append(grams([stream(tokens(t)) for t in batch.column(0).to_pylist()]))
            held += len(parts[-1][0])
            if held > HELD:
                parts = [merged(parts)]
                held = len(parts[0][0])
                if 2 * held > HELD:
                    yield batch_of(*parts[0])
                    parts, held = [], 0
        if parts:
            yield batch_of(*merged(parts))

    small_batches(docs.sparkSession)
    return docs.where("train").select("text").mapInArrow(run, "gram bigint, n bigint")


def held_windows(docs: DataFrame) -> DataFrame:
    """``chunk, gram`` of ``docs`` (chunk, size, text): a row for each window that a chunk holds, or a few of equal ones."""
    names = ["chunk", "gram"]

    def rows_of(chunk: int, keys: list[np.ndarray]) -> pa.RecordBatch:
        found = np.unique(np.concatenate(keys))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), chunk, dtype=np.int64)), pa.array(found)], names=names)

    def run(batches):
        open_chunks = {}  # by size class, as in counted_words
        for batch in batches:
            for at, kind, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                chunk, parts, held = open_chunks.get(kind, (None, [], 0))
                if chunk is not None and (at != chunk or held > HELD):
                    yield rows_of(chunk, parts)
                    parts, held = [], 0
                parts.append(np.unique(windows([stream(tokens(text))])))
                open_chunks[kind] = (at, parts, held + len(parts[-1]))
        for chunk, parts, _ in open_chunks.values():
            yield rows_of(chunk, parts)

    small_batches(docs.sparkSession)
    return docs.select("chunk", "size", "text").mapInArrow(run, "chunk bigint, gram bigint")


class Lookup:
    """Numbers by different keys of 0 and more, for whole arrays at once; open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(8, (3 * len(keys) // 2).bit_length())  # a third to two thirds are filled
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << bits, dtype=values.dtype)
        at, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == -1]
            self.keys[at[free]] = keys[free]  # of keys with the same slot one gets it
            placed = self.keys[at[left]] == keys[left]
            self.values[at[left[placed]]] = values[left[placed]]
            left = left[~placed]
            at[left] = at[left] + 1 & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which of the keys there are."""
        at = self._slots(keys)
        found = self.keys[at]
        known = found == keys
        left = np.flatnonzero(~known & (found != -1))
        while len(left):
            at[left] = at[left] + 1 & self.mask
            found = self.keys[at[left]]
            known[left] = found == keys[left]
            left = left[(found != keys[left]) & (found != -1)]
        return self.values[at], known


@dataclass
class Tables:
    """``children`` by (node, byte before), each node's longest retained suffix, ``logs`` by
    (state, symbol), and for symbols not seen after a state its suffix and what is added to that one's."""

    depth: int
    children: Lookup
    state: np.ndarray
    logs: Lookup
    parent: np.ndarray
    unseen: np.ndarray
    cache: object = None


@dataclass
class Tree:
    """Retained contexts with the counts of their next symbols; context 0 is the empty one."""

    contexts: list[bytes]
    starts: np.ndarray
    symbols: np.ndarray
    counts: np.ndarray

    def tables(self) -> Tables:
        """What ``log_probability`` reads; it grows with the retained contexts, not with their square."""
        number = {c: i for i, c in enumerate(self.contexts)}
        size = np.diff(self.starts)
        parent = np.array([number[_parent(c, number)] if c else -1 for c in self.contexts], dtype=np.int64)
        n = np.bincount(np.repeat(np.arange(len(size)), size), weights=self.counts, minlength=len(size))
        smooth = np.where(parent < 0, SMOOTH_ROOT * 256, SMOOTH)
        back = smooth / (n + smooth)
        state = np.repeat(np.arange(len(size)), size)
        key = state * 256 + self.symbols  # in order, as contexts and their symbols are
        p = self.counts / (n + smooth)[state]
        lengths = np.array([len(c) for c in self.contexts])[state]
        for k in range(int(lengths.max(initial=0)) + 1):
            rows = np.flatnonzero(lengths == k)
            at, factor = parent[state[rows]], back[state[rows]]
            while len(rows):
                root = at < 0
                p[rows[root]] += factor[root] / 256
                rows, at, factor = rows[~root], at[~root], factor[~root]
                wanted = at * 256 + self.symbols[rows]
                place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
                seen = key[place] == wanted
                p[rows[seen]] += factor[seen] * p[place[seen]]
                rows, at, factor = rows[~seen], at[~seen], factor[~seen]
                at, factor = parent[at], factor * back[at]
        nodes = sorted({c[k:] for c in self.contexts for k in range(len(c) + 1)}, key=lambda c: (len(c), c))
        place_of = {c: i for i, c in enumerate(nodes)}
        longest = np.zeros(len(nodes), dtype=np.int64)
        for i, c in enumerate(nodes):
            longest[i] = number[c] if c in number else longest[place_of[c[1:]]]
        children = np.array([place_of[c[1:]] * 256 + c[0] for c in nodes if c], dtype=np.int64)
        unseen = np.log10(back)
        unseen[0] -= np.log10(256)
        return Tables(max(map(len, nodes)), Lookup(children, np.arange(1, len(nodes))), longest, Lookup(key, np.log10(p)), parent, unseen)


def _parent(context: bytes, known) -> bytes:
    """The longest proper suffix that is known; the empty one always is."""
    return next(context[k:] for k in range(1, len(context) + 1) if context[k:] in known)


def retained(found: dict[bytes, tuple[np.ndarray, np.ndarray]], dense: dict[bytes, np.ndarray]) -> list[bytes]:
    """Candidate contexts that diverge from their longest suffix in ``dense``, to which their distributions are added."""
    kept = []
    for context in sorted((c for c in found if c), key=lambda c: (len(c), c)):
        symbols, n = found[context]
        base = dense[_parent(context, dense)]
        share = n / n.sum()
        kl = float((share * np.log(share / base[symbols])).sum())
        if kl >= LEAST_KL and 2 * n.sum() * kl >= LEAST_G:
            smooth = base * (SMOOTH / (n.sum() + SMOOTH))
            smooth[symbols] += n / (n.sum() + SMOOTH)
            dense[context] = smooth
            kept.append(context)
    return kept


def _root(found: dict[bytes, tuple[np.ndarray, np.ndarray]]) -> dict[bytes, np.ndarray]:
    """The distribution of the empty context, which is set where there is none."""
    symbols, n = found.setdefault(b"", (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)))
    root = np.full(256, SMOOTH_ROOT / (n.sum() + 256 * SMOOTH_ROOT))
    root[symbols] += n / (n.sum() + 256 * SMOOTH_ROOT)
    return {b"": root}


def _tree(found: dict[bytes, tuple[np.ndarray, np.ndarray]], kept: list[bytes]) -> Tree:
    contexts = sorted({b"", *kept}, key=lambda c: (len(c), c))
    sizes = [len(found[c][0]) for c in contexts]
    return Tree(
        contexts,
        np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
        np.concatenate([found[c][0] for c in contexts]).astype(np.int64),
        np.concatenate([found[c][1] for c in contexts]).astype(np.int64),
    )


def grow(found: dict[bytes, tuple[np.ndarray, np.ndarray]]) -> Tree:
    """Retain candidate contexts by their divergence from the distribution of their suffix."""
    dense = _root(found)
    return _tree(found, retained(found, dense))


def _found(rows: pa.Table) -> dict[bytes, tuple[np.ndarray, np.ndarray]]:
    """Symbols in order and their counts by context, of ``level, context, next`` rows."""
    found = {}
    pairs = rows.column("next").combine_chunks()
    flat, ends = pairs.flatten(), np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    symbols, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("symbol", "n"))
    for i, (level, context) in enumerate(zip(rows.column("level").to_pylist(), rows.column("context").to_pylist())):
        at = slice(ends[i], ends[i + 1])
        order = np.argsort(symbols[at])
        found[context.to_bytes(level, "big")] = (symbols[at][order], n[at][order])
    return found


def _suffix(level: int) -> Column:
    """``level, context`` of a window's last bytes before its symbol."""
    last = F.col("gram").bitwiseAND(F.lit((1 << 8 * (level + 1)) - 1))
    return F.struct(F.lit(level).alias("level"), F.shiftright(last, 8).alias("context"))


def _symbol() -> Column:
    return F.col("gram").bitwiseAND(F.lit(255)).alias("symbol")


_STATES = "level int, context bigint, symbols array<bigint>, counts array<bigint>, logs array<double>, unseen double"


def _states(kept: list[bytes], found: dict, dense: dict[bytes, np.ndarray]) -> pa.Table:
    """Rows of ``_STATES``: next symbols of retained contexts, their counts and the log10 of their
    probabilities, and what is added to the suffix's value for a symbol not seen there."""
    n = np.array([found[c][1].sum() for c in kept], dtype=float)
    root = np.array([not c for c in kept], dtype=bool)
    unseen = np.log10(np.where(root, SMOOTH_ROOT / (n + 256 * SMOOTH_ROOT), SMOOTH / (n + SMOOTH)))
    return pa.table({
        "level": pa.array([len(c) for c in kept], pa.int32()),
        "context": pa.array([int.from_bytes(c, "big") for c in kept], pa.int64()),
        "symbols": pa.array([found[c][0].tolist() for c in kept], pa.list_(pa.int64())),
        "counts": pa.array([found[c][1].tolist() for c in kept], pa.list_(pa.int64())),
        "logs": pa.array([np.log10(dense[c][found[c][0]]).tolist() for c in kept], pa.list_(pa.float64())),
        "unseen": pa.array(unseen, pa.float64()),
    })


def learn(rows: DataFrame) -> DataFrame:
    """The retained contexts of the corpus as ``_STATES``, from the rows of ``counted_grams``; the empty one is always there."""
    sums = rows.groupBy("gram").agg(F.sum("n").alias("n"))
    one = sums.select(F.explode(F.array(*[_suffix(k) for k in range(DEPTH + 1)])).alias("at"), _symbol(), "n").select("at.*", "symbol", "n")
    # a window that reaches before the text has a byte 0 in front, and is none of that length
    one = one.where((F.col("level") == 0) | F.expr("shiftright(context, 8 * (level - 1)) <> 0")).groupBy("level", "context", "symbol").agg(F.sum("n").alias("n"))
    # a context has at most 256 symbols
    by = one.groupBy("level", "context").agg(F.sum("n").alias("total"), F.collect_list(F.struct("symbol", "n")).alias("next"))
    by = written(by.where((F.col("level") == 0) | (F.col("total") >= LEAST_COUNT)).drop("total"), "contexts")
    found = _found(by.where("level < 2").toArrow())  # 257 contexts at most
    short = _root(found)
    kept = [b"", *retained(found, short)]

    def run(group: pa.Table) -> pa.Table:
        # all suffixes of a context but the shortest share its last two bytes
        held, dense = _found(group), dict(short)
        return _states(retained(held, dense), held, dense)

    tail = F.col("context").bitwiseAND(F.lit(0xFFFF)).alias("tail")
    longer = written(by.where("level > 1").groupBy(tail).applyInArrow(run, _STATES), "retained")
    return rows.sparkSession.createDataFrame(_states(kept, found, short), longer.schema).unionAll(longer)


def table_bytes(states: DataFrame) -> int:
    """No fewer bytes than the ``Tables`` of these contexts take: a slot of 16 bytes is a third
    filled at least, a node has two slots' worth of numbers, and a context has a node for each byte at most."""
    size = 48 * F.size("symbols") + 64 * F.col("level") + 64
    return states.agg(F.sum(size)).first()[0]


def gathered(states: DataFrame) -> Tree:
    """The tree of these contexts, on the driver; for those whose ``table_bytes`` are known to be few."""
    found = {}
    for r in states.select("level", "context", "symbols", "counts").toLocalIterator():
        found[r["context"].to_bytes(r["level"], "big")] = (np.array(r["symbols"], dtype=np.int64), np.array(r["counts"], dtype=np.int64))
    return _tree(found, list(found))


def valued(grams: DataFrame, states: DataFrame) -> DataFrame:
    """``gram, value`` of different windows: the log10 probability of the last byte after those before it.

    It is that of the longest retained suffix that has seen the byte, and what each longer one adds."""
    log = F.expr("element_at(logs, cast(nullif(array_position(symbols, symbol), 0) as int))")

    def met(levels: range, of: DataFrame) -> DataFrame:
        at = grams.select("gram", _symbol(), F.explode(F.array(*[_suffix(k) for k in levels])).alias("at"))
        return at.select("gram", "symbol", "at.*").join(of, ["level", "context"]).select("gram", "level", log.alias("log"), "unseen")

    rows = states.drop("counts")
    # 257 contexts at most are shorter than two bytes; every window has one of them
    both = met(range(2), F.broadcast(rows.where("level < 2"))).unionAll(met(range(2, DEPTH + 1), rows.where("level > 1")))
    seen = F.max(F.when(F.col("log").isNotNull(), F.struct("level", "log"))).alias("seen")
    by = both.groupBy("gram").agg(seen, F.collect_list(F.struct("level", "unseen")).alias("passed"))
    added = F.expr("aggregate(filter(passed, x -> x.level > coalesce(seen.level, -1)), 0D, (a, x) -> a + x.unseen)")
    return by.select("gram", (F.coalesce("seen.log", F.lit(0.0)) + added).alias("value"))


class _Cache:
    """Values of the windows met last, one for each slot; a process of a task holds one."""

    BITS = 20

    def __init__(self):
        self.keys = np.full(1 << self.BITS, -1, dtype=np.int64)
        self.values = np.zeros(1 << self.BITS)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).view(np.int64)


def log_probability(streams: list[bytes], tables: Tables) -> np.ndarray:
    """log10 probability of each stream of symbols."""
    if not streams:
        return np.zeros(0)
    raw = np.frombuffer(b"\0" * tables.depth + END + b"".join(streams), dtype=np.uint8)
    key = np.zeros(len(raw) - tables.depth - 1, dtype=np.int64)
    for k in range(tables.depth + 1):  # a symbol and what stands before it
        key <<= 8
        key |= raw[k + 1 : k + 1 + len(key)]
    if tables.cache is None:
        tables.cache = _Cache()
    cache = tables.cache
    slot = cache.slots(key)
    values = cache.values[slot]
    missed = np.flatnonzero(cache.keys[slot] != key)
    if len(missed):
        new, where = np.unique(key[missed], return_inverse=True)
        found = _log_of(new, tables)
        values[missed] = found[where]
        at, first = np.unique(cache.slots(new), return_index=True)
        cache.keys[at], cache.values[at] = new[first], found[first]
    return _sums(values, streams)


def _sums(values: np.ndarray, streams: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(s) for s in streams])
    return np.add.reduceat(values, np.concatenate([[0], ends[:-1]]))


def _log_of(key: np.ndarray, tables: Tables) -> np.ndarray:
    """log10 probability of the last byte of each window after those before it."""
    # a byte 0 is in no context, and none reaches over an end mark
    live, at = np.arange(len(key)), np.zeros(len(key), dtype=np.int64)
    node = at.copy()
    for k in range(1, tables.depth + 1):
        child, known = tables.children.get(at * 256 + (key[live] >> 8 * k & 255))
        live, at = live[known], child[known]
        node[live] = at
    state, symbol = tables.state[node], key & 255
    values, left = np.zeros(len(key)), np.arange(len(key))
    while len(left):
        logs, known = tables.logs.get(state[left] * 256 + symbol[left])
        values[left[known]] += logs[known]
        left = left[~known]
        values[left] += tables.unseen[state[left]]
        state[left] = tables.parent[state[left]]
        left = left[state[left] >= 0]
    return values


def score(docs: DataFrame) -> DataFrame:
    """Scores of ``docs`` (chunk, size, doc_id, text, train), each chunk a few MB of rows near each other."""
    spark = docs.sparkSession
    states = learn(counted_grams(docs))
    # dealt by word once: for each word's sum over its chunks, and for the numbers of all words
    words = counted_words(docs).repartition("word")
    c = F.sum("n").over(W.partitionBy("word"))
    needed = words.select("chunk", "word", c.alias("c"))
    # the least chunk is asked for so that both read the same columns, hence the same shuffled rows
    sums = words.groupBy("word").agg(F.sum("n").alias("c"), F.min("chunk").alias("least"))
    totals = sums.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if((F.col("c") > 0) & F.col("least").isNotNull()).alias("v"))
    if table_bytes(states) <= TABLES:
        sent = spark.sparkContext.broadcast(gathered(states).tables())

        def logs_by(right: pa.Table):
            return lambda streams: log_probability(streams, sent.value)
    else:
        held = written(held_windows(docs), "windows")
        # a window has a row for each chunk at most on one side and one on the other
        values = held.join(valued(held.select("gram").distinct(), states), "gram")
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("gram", "bigint"), ("value", "double"))]
        needed = needed.select("*", *nothing).unionByName(values, allowMissingColumns=True)

        def logs_by(right: pa.Table):
            right = right.filter(pc.is_valid(right.column("gram")))
            gram, at = np.unique(right.column("gram").to_numpy(), return_index=True)
            known = Lookup(gram, right.column("value").to_numpy()[at])
            return lambda streams: _sums(known.get(windows(streams))[0], streams)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        logs_of = logs_by(right)
        right = right.filter(pc.is_valid(right.column("word")))
        count_of = dict(zip(right.column("word").to_pylist(), right.column("c").to_pylist()))
        scores, numbers = [], []
        texts = left.column("text")
        for at in range(0, len(texts), 256):
            streams = []
            for text in texts.slice(at, 256).to_pylist():
                found = tokens(text)
                found.append(END)
                c = np.fromiter(map(count_of.__getitem__, found), dtype=np.int64, count=len(found))
                numbers.append((len(found), int(np.count_nonzero(c)), float(np.log10(c + 1).sum())))
                found.pop()
                streams.append(stream(found))
            scores.append(logs_of(streams))
        many = list(zip(*numbers)) if numbers else [(), (), ()]
        return pa.table({
            "doc_id": left.column("doc_id"), "held_out": pa.array([not t for t in left.column("train").to_pylist()], pa.bool_()),
            "n_tokens": pa.array(many[0], pa.int64()), "n_known": pa.array(many[1], pa.int64()),
            "logs": pa.array(many[2], pa.float64()), "score": pa.array(np.concatenate(scores) if scores else np.zeros(0)),
        })

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, logs double, score double"
    scored = docs.groupBy("chunk").cogroup(needed.groupBy("chunk")).applyInArrow(run, schema)
    # one subquery of one row, so that the words are counted once
    scored = scored.withColumn("of_all", totals.select(F.struct("n", "v")).scalar())
    unit = F.log10((F.col("of_all.n") + F.col("of_all.v") + 1).cast("double"))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.col("of_all.n").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * unit).alias("base_score"), "score",
    )


def chunked(df: DataFrame) -> DataFrame:
    """``chunk, size, doc_id, text, train`` of a table read from files; neighbouring rows of a size class share a chunk."""
    size = F.greatest(F.lit(0), F.floor(F.log2(F.coalesce(F.length("text"), F.lit(0)) / LENGTH))).cast("int")
    rows = F.greatest(F.lit(1), F.floor(ROWS / F.pow(F.lit(2), size)))
    chunk = F.xxhash64(F.col("_metadata.file_path"), size, F.floor(F.col("_metadata.row_index") / rows))
    return df.select(chunk.alias("chunk"), size.alias("size"), "doc_id", "text", (fold(F.col("doc_id"), MODULUS) != REMAINDER).alias("train"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    return score(chunked(spark.read.parquet(f"{sf_dir}/documents.parquet")))
