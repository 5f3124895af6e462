"""Exact byte-pair encoding by backtracking over longest token matches, and decoding.

A word's tokens are found from the left.  An Aho-Corasick automaton gives all tokens
inside the word, hence the longest at each place; a token is taken if it is compatible
with the one before it, which a table of pairs, filled as pairs are met, answers.  If no
token fits, the last one is given up for its next shorter prefix.  Each place is visited a
bounded number of times, so the time is linear, and the result is that of the merges in
their order of rank.  Decoding slices one text of all tokens by a table of offsets.

Cases: a null text counts as empty; an empty text has no ids and decodes to the empty
text; texts of any length are encoded whole; repeated rows are encoded alike; other columns
of the input are kept apart from the added ones, which replace columns of the same name.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import small_batches, table

NAME = "op3_bpe"
#: Characters with the Unicode property White_Space.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words whose tokens a worker remembers; beyond that it starts afresh.
REMEMBERED = 150_000
#: Letters and digits that are newer than the tokenizer's Unicode tables, which
#: take them for marks; ranges of code points.
_NEWER = (
    "558 58b-58c 88f c5c cdc 1c89 208f 209d-209f a7cb-a7cc a7ce-a7cf a7d2 a7d4 a7da a7dc-a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10d50-10d65 "
    "10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda "
    "18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 "
    "1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f "
)
_CONTROLS = frozenset("\x1c\x1d\x1e\x1f")


class Bpe:
    """Encoder and decoder of a tokenizer file with word-end marks and byte-level words."""

    def __init__(self, content: str):
        import ahocorasick

        model = json.loads(content)
        self.vocab: dict[str, int] = dict(model["model"]["vocab"])
        self.end = model["model"]["end_of_word_suffix"] or ""
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.special = special
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")")
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        newer = "".join("-".join(chr(int(c, 16)) for c in r.split("-")) for r in _NEWER.split())
        self.newer = regex.compile(f"[{newer}]")
        self.words_with_newer = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{newer}]]+|[\p{{N}}--[{newer}]]|[[^{SPACE}\p{{L}}\p{{N}}]||[{newer}]]+")
        self.to_symbols = self._symbols()
        size = max([*self.vocab.values(), *special.values()]) + 1
        text_of = [""] * size
        for word, i in [*self.vocab.items(), *special.items()]:
            text_of[i] = word
        # decoding: token i is blob[offsets[i]:offsets[i + 1]]
        self.blob, self.offsets = "".join(text_of), array("l", [0] * (size + 1))
        for i, word in enumerate(text_of):
            self.offsets[i + 1] = self.offsets[i] + len(word)
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for pair in model["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.halves.setdefault(z, (x, y))
            self.joined.setdefault((x, y), z)
        self.length: dict[int, int] = {}
        self.shapes: dict[str, int] = {}
        automaton = ahocorasick.Automaton()
        for word, i in self.vocab.items():
            shape = self._shape(word)
            self.length[i], self.shapes[shape] = len(shape), i
            automaton.add_word(shape, (i, len(shape)))
        automaton.make_automaton()
        self.automaton = automaton
        self.shorter: dict[int, int] = {}
        for shape, i in self.shapes.items():
            self.shorter[i] = next((self.shapes[shape[:k]] for k in range(len(shape) - 1, 0, -1) if shape[:k] in self.shapes), -1)
        self.compatible: dict[tuple[int, int], bool] = {}
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.by_word, self.by_chunk = _Memo(self._word), _Memo(self._chunk)
        self.texts = pa.array(text_of)

    @staticmethod
    def _symbols() -> list[str]:
        """The printable character that stands for each byte."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]

    def _shape(self, token: str) -> str:
        """A token with its word-end mark folded into the last character."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            token = token[: -len(self.end)]
            return token[:-1] + chr(ord(token[-1]) + 0x1000)
        return token

    def fits(self, one: int, two: int) -> bool:
        """Whether the merges leave the two tokens as they are side by side."""
        answer = self.compatible.get((one, two))
        if answer is None:
            if len(self.compatible) > 1_000_000:
                self.compatible.clear()
            answer = self.compatible[one, two] = self._fits(one, two)
        return answer

    def _fits(self, one: int, two: int) -> bool:
        limit, joined, halves = 1 << 62, self.joined, self.halves
        while True:
            made = joined.get((one, two))
            if made is not None and made < limit:
                return False
            if one > two:
                limit, one = one, halves.get(one, (one, one))[1]
                if one == limit:
                    limit, two = two + 1, halves.get(two, (two, two))[0]
                    if two + 1 == limit:
                        return True
            else:
                limit, two = two + 1, halves.get(two, (two, two))[0]
                if two + 1 == limit:
                    limit, one = one, halves.get(one, (one, one))[1]
                    if one == limit:
                        return True

    def encode_word(self, word: str) -> list[int]:
        """Tokens of one word of the splitting pattern."""
        symbols = word if word.isascii() and word.isprintable() else "".join([self.to_symbols[b] for b in word.encode()])
        if self.end:
            symbols = symbols[:-1] + chr(ord(symbols[-1]) + 0x1000)
        longest = [-1] * (len(symbols) + 1)
        for last, (token, size) in self.automaton.iter(symbols):
            longest[last - size + 1] = token  # a later end is a longer token
        tokens: list[int] = []
        open_at, place, token = bytearray(b"\1" * (len(symbols) + 1)), 0, longest[0]
        while token >= 0:
            before = tokens[-1] if tokens else -1
            while True:
                end = place + self.length[token]
                if open_at[end] and (before < 0 or self.fits(before, token)):
                    tokens.append(token)
                    place, token = end, longest[end]
                    break
                token = self.shorter[token]
                if token < 0:
                    open_at[place] = 0
                    tokens.pop()
                    place, token = place - self.length[before], before
                    break
        return tokens

    def _word(self, word: str) -> bytes:
        return array("i", self.encode_word(word)).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        words = self.words if chunk.isascii() or not self.newer.search(chunk) else self.words_with_newer
        return b"".join([self.by_word[w] for w in words.findall(chunk)])

    def packed(self, text: str | None) -> bytes:
        """Ids of a whole text as 32-bit integers.

        No word holds white space, so that what stands between it can be looked up whole."""
        out: list[bytes] = []
        for piece in self.split_special.split(text or "") if "<|" in (text or "") else [text or ""]:
            if piece in self.special:
                out.append(array("i", [self.special[piece]]).tobytes())
                continue
            if not piece.isascii():
                piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
            piece = piece.lower()
            # str.split() also parts at four control characters, which aren't White_Space
            chunks = piece.split() if _CONTROLS.isdisjoint(piece) else self.spaces.split(piece)
            out += map(self.by_chunk.__getitem__, chunks)
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text, without special tokens around it."""
        return array("i", self.packed(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids, joined as a tokenizer without a decoder joins them."""
        blob, at = self.blob, self.offsets
        return " ".join([blob[at[i] : at[i + 1]] for i in ids])


class _Memo(dict):
    """What a function gave for the last words, in two generations of a bounded size."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


_LOADED: dict[str, Bpe] = {}


def loaded(content: str) -> Bpe:
    """The tokenizer of a file's content, built once in a process."""
    if content not in _LOADED:
        _LOADED.clear()
        _LOADED[content] = Bpe(content)
    return _LOADED[content]


def encode(df: DataFrame, tokenizer_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``ids`` (array of int) and ``decoded`` (string) for each row's whole text.

    The driver reads the tokenizer file, whose size is fixed, and sends it to the workers."""
    with open(tokenizer_path, encoding="utf-8") as file:
        content = df.sparkSession.sparkContext.broadcast(file.read())
    kept = keep if keep is not None else [c for c in df.columns if c not in ("ids", "decoded")]
    small_batches(df.sparkSession)
    out = T.StructType([*(df.schema[c] for c in kept), *T._parse_datatype_string("ids array<int>, decoded string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(content.value)
        for batch in batches:
            packed = [bpe.packed(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
            values = pa.array(np.frombuffer(b"".join(packed), dtype=np.int32))
            ids = pa.ListArray.from_arrays(pa.array(ends), values)
            # the tokens' texts lie in one buffer with a table of offsets, which take() reads
            decoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), bpe.texts.take(values)), " ")
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, ids, decoded], names=[f.name for f in out.fields])

    return df.select(*dict.fromkeys([*kept, text])).mapInArrow(run, out)


def default_tokenizer() -> str:
    """Place of the tokenizer that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    done = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), default_tokenizer(), keep=["doc_id"])
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
