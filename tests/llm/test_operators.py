"""Text operators against brute force, exact round trips and held-out labels."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import bpe, components, decontaminate, html, pii, registry, rules, simhash, suffixtree, toxicity, urls

QUERIES = registry.queries()


def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def test_columns_of_clashing_names(spark, odd):
    """The general interfaces pass what they don't add or replace."""
    df = odd.withColumns({"url": odd["text"], "html": odd["text"], "__gaps": odd["doc_id"], "__found": odd["doc_id"], "host": odd["doc_id"]})
    for made, added in (
        (pii.find(df), {"pii"}), (urls.judge(df), {"host", "path", "rule", "score", "verdict"}), (html.extract(df), {"text", "n_chars"}),
        (bpe.encode(df, bpe.default_tokenizer()), {"ids", "n_tokens", "decoded"}), (pii.redact(df), {"text"}),
    ):
        assert set(df.columns) <= set(made.columns) | added and len(made.columns) == len(set(made.columns))
        rest = [c for c in df.columns if c not in added]
        plain = lambda rows: sorted((tuple(r) for r in rows), key=repr)
        assert plain(made.select(*rest).collect()) == plain(df.select(*rest).collect())


def test_sieve_loses_no_verified_item(spark, sf_dir):
    """Every item that the verification alone finds in a text passes the sieve, words left out or repeated."""
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(30)]
    parts = lambda: " ".join(rng.choice(vocabulary, rng.integers(1, 40)))
    items = [(i, f"{parts()}? {parts()}.") for i in range(150)] + [(150, "a a a a a a a. b b b b b b b."), (151, "one")]
    index = decontaminate.Index(items)
    texts = [decontaminate.words_of(t) for _, t in items]
    for words in list(texts):
        for _ in range(4):
            texts.append([w for w in words if rng.random() > 0.05])
    possible = index.possible(texts)
    found = [{i for i, _ in index.verified(words, set(range(len(index.ids))))} for words in texts]
    assert sum(map(len, found)) > 300 and all(f <= possible.get(k, set()) for k, f in enumerate(found))


def test_scores_do_not_depend_on_blocks(spark, sf_dir, monkeypatch):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = decontaminate.Index(*decontaminate.blocks_of(items)[0])
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 300)
    blocks = decontaminate.blocks_of(items)
    assert len(blocks) > 3
    least = {i: t for i, t in zip([whole.ids[i] for i in whole.of], whole.threshold)}
    for block in blocks:
        part = decontaminate.Index(*block)
        assert {part.ids[i]: t for i, t in zip(part.of, part.threshold)} == {i: pytest.approx(least[i]) for i in part.ids}
    found = decontaminate.matches(docs.select("doc_id", "text"), items, ["doc_id"]).collect()
    monkeypatch.undo()
    once = decontaminate.matches(docs.select("doc_id", "text"), items, ["doc_id"]).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, once)) != []


@pytest.mark.parametrize("name", ["op8_urls", "op9_html", "op1_decontaminate", "op2_quality", "op7_toxicity", "op5_rules"])
def test_odd_small_tables(name, spark, tables, tmp_path):
    """Nulls, repeats, ties and further columns in the tables beside ``documents``."""
    import shutil

    shutil.copytree(f"{tables['odd']}/documents.parquet", tmp_path / "documents.parquet")
    clash = "1 AS score, 'x' AS host, 'y' AS n_chars"
    for table, rows in {
        "pages": "SELECT * FROM VALUES (1L, null, null), (null, '', ''), (2L, 'no scheme', '<p>x'), (2L, 'http://a.com/en/', '<p>x') AS t(page_id, url, html)",
        "benchmark": "SELECT * FROM VALUES (1L, null), (null, 'the the the'), (1L, 'the the the'), (1L, 'the the the'), (3L, '') AS t(item_id, text)",
        "labels": "SELECT * FROM VALUES (0L, null, null), (null, 1, 1), (1L, 1, 0), (1L, 1, 0), (1L, 0, 1), (99L, 1, 1) AS t(doc_id, quality, toxic)",
    }.items():
        spark.sql(f"SELECT *, {clash} FROM ({rows})").write.parquet(str(tmp_path / f"{table}.parquet"))
    made = QUERIES[name](spark, str(tmp_path)).collect()
    if name == "op1_decontaminate":
        assert {r["item_id"] for r in made} == {None, 1}
    else:
        assert len(made) == (4 if name in ("op8_urls", "op9_html") else spark.read.parquet(f"{tables['odd']}/documents.parquet").count())


@pytest.mark.parametrize("name", sorted(QUERIES))
@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_odd_and_empty_tables(name, kind, spark, tables):
    rows = QUERIES[name](spark, tables[kind]).collect()
    n = spark.read.parquet(f"{tables[kind]}/{'pages' if name in ('op8_urls', 'op9_html') else 'documents'}.parquet").count()
    if name != "op1_decontaminate":
        assert len(rows) == n
    elif kind == "empty":
        assert not rows


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    wanted = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in wanted.description]
    made = QUERIES[name](spark, sf_dir).select(*columns)
    key = lambda r: tuple(round(v, 5) if isinstance(v, float) else v for v in r)
    assert sorted(map(key, made.collect()), key=repr) == sorted(map(key, wanted.fetchall()), key=repr)


# 1


def test_decontamination_equals_brute_force(spark, sf_dir):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    index = decontaminate.Index(items)
    wanted = set()
    for doc, text in texts(spark, sf_dir).items():
        words = decontaminate.words_of(text)
        passages = [set(words[at : at + decontaminate.PASSAGE]) for at in range(0, max(1, len(words) - decontaminate.STEP), decontaminate.STEP)] or [set()]
        for n, (item, _) in enumerate(items):
            weights = {w: dict(index.postings[t].get(n // decontaminate.POSTINGS, [])).get(n, 0.0) for w, t in index.terms.items() if w in set(decontaminate.words_of(items[n][1]))}
            if any(sum(weights.get(w, 0.0) for w in p) >= index.threshold[n] - 1e-9 for p in passages):
                held = lambda part: len(part & set(zip(*(words[i:] for i in range(len(next(iter(part)))))))) / len(part)
                if all(held(p) >= decontaminate.OVERLAP for p in index.parts[n]):
                    wanted.add((doc, item))
    assert {(r["doc_id"], r["item_id"]) for r in QUERIES["op1_decontaminate"](spark, sf_dir).collect()} == wanted and wanted


def test_planted_items_are_found(spark):
    items = spark.createDataFrame([(1, "What is the tall red tower in the old town called. It is called the lamp of the north wind."), (2, "Name three rivers that run through the green valley. The Ash, the Elm and the Oak.")], "item_id long, text string")
    filler = "nothing of note happens here while people walk about and talk of other things all day long " * 40
    docs = spark.createDataFrame([(1, filler + items.first()["text"].upper() + filler), (2, filler), (3, "It is called the lamp of the north wind.")], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, items, ["doc_id"]).collect()] == [(1, 1)]
    assert sorted(r["doc_id"] for r in decontaminate.without(docs, items).collect()) == [2, 3]


def test_question_and_answer_may_stand_apart(spark, sf_dir):
    """Two-part items, the parts several passages apart: what the verifier accepts is found."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    filler = " ".join(["zzfiller"] * 400)
    docs = [" ".join([filler, *question, filler, *answer, filler]) for question, answer in (decontaminate.parts_of(t) for _, t in items)]
    docs.append(" ".join("ash elm oak fir yew bay box fig".split()) + " " + filler + " nine old men met there")
    items.append((-1, "Ash elm oak fir yew bay box fig. Nine old men met there."))
    index = decontaminate.Index(items)
    everything = set(range(len(index.ids)))
    wanted = [index.verified(decontaminate.words_of(d), everything) for d in docs]
    assert index.search(docs) == wanted and all(i in [x for x, _ in w] for (i, t), w in zip(items, wanted) if decontaminate.words_of(t))


# 2, 7


@pytest.mark.parametrize(("name", "label"), [("op2_quality", "quality"), ("op7_toxicity", "toxic")])
def test_held_out_labels(name, label, spark):
    sf = "/root/testdata/sf0.1"  # enough held-out labels of both kinds
    scored = QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label), "doc_id").where(f"held_out AND {label} IS NOT NULL").collect()
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)
    good, bad = ([r["score"] for r in scored if r[label] == y] for y in (1, 0))
    pairs = [(a > b) + 0.5 * (a == b) for a in good for b in bad]
    assert sum(pairs) / len(pairs) >= 0.85


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        old, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(old[j + 1] + 1, row[-1] + 1, old[j] + (x != y)))
    return row[-1]


def _near(word, words, stems):
    """By full distances to every term, each within its own allowance."""
    close = lambda d, t: d <= toxicity.allowed(len(t)) and toxicity.allowed(len(t)) > 0
    whole = min(((_distance(word, t), t) for t in words if close(_distance(word, t), t)), default=(0, None))
    begun = min(((d, t) for t in stems for d in [min(_distance(word[:n], t) for n in range(len(word) + 1))] if close(d, t)), default=(0, None))
    return whole[1], begun[1]


@pytest.mark.parametrize("word", ["cat", "kitten", "kiten", "mitten", "kittens", "sitting", "unrelated", "kitetn", "dirtbag", "dirtba", "drtbagsx9", "abomnable", ""])
def test_automata_equal_edit_distance(word):
    terms = ["kitten", "sitting", "abominable", "dirtbags9", "cat"]
    assert toxicity.Automaton(terms, terms).near(word) == _near(word, terms, terms)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=11), max_size=6), st.lists(st.text("abc", max_size=12), max_size=4))
def test_automata_of_any_terms(terms, words):
    made = toxicity.Automaton(terms[::2], terms[1::2])
    made.MOST = 40  # forgets what it remembers now and then
    assert [made.near(w) for w in words] == [_near(w, terms[::2], terms[1::2]) for w in words]


def lexicon_of(spark, words, good="plain calm talk of the day"):
    """A lexicon learned from documents that hold all of ``words``, and from harmless ones."""
    rows = [(i, " ".join(words), 1) for i in range(10)] + [(i, good, 0) for i in range(10, 200)]
    return toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, label int"))[0]


def test_every_word_is_searched_misspelled(spark):
    rng = np.random.default_rng(2)
    words = sorted({"".join(rng.choice(list("bcdfghjklm"), 3)) + "".join(rng.choice(list("npqrstvwxz"), 5)) for _ in range(400)})
    lexicon = lexicon_of(spark, words)
    assert len(lexicon.words) > 300 and [w for w in lexicon.words if lexicon.kind_of(w[:-1] + "y")[0] != 3] == []


def test_beginnings_are_searched_misspelled(spark):
    rows = [(i, f"idiot{end} grumblewort{end}", 1) for i, end in enumerate(["s", "ic", "ischem", "e", "en"] * 6)] + [(i, "plain calm talk of the day", 0) for i in range(30, 230)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, label int"))[0]
    assert not lexicon.words and all(lexicon.kind_of(w)[0] == 2 for w in ("idiots", "grumblewort"))
    assert [lexicon.kind_of(w)[0] for w in ("1diots", "1di0tic", "ydiots", "calm", "day")] == [3, 3, 3, 0, 0]
    known = toxicity.Lexicon({}, {"grumble": 1.0}, {"grumble*": 1.0})
    assert [known.kind_of(w)[0] for w in ("grumblewort", "grunblewort", "grmblewort", "grxxblewort", "rumour")] == [2, 3, 3, 0, 0]


# 3


@pytest.fixture(scope="module")
def tokenizers_pair():
    from tokenizers import Tokenizer

    path = bpe.default_tokenizer()
    with open(path, encoding="utf-8") as file:
        return bpe.Bpe(file.read()), Tokenizer.from_file(path)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abcdeilnorst'’ .,!ßéΣς<|>endoftext0159", max_size=80))
def test_encoding_is_exact(tokenizers_pair, text):
    own, library = tokenizers_pair
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_encoding_of_the_table(spark, sf_dir, tokenizers_pair):
    library = tokenizers_pair[1]
    found = texts(spark, sf_dir)
    for r in QUERIES["op3_bpe"](spark, sf_dir).collect():
        ids = library.encode(found[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# 4

_EMAIL, _IP, _CARD, _PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    luhn = lambda d: sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0
    checks = (("email", _EMAIL, lambda m: True), ("ip", _IP, lambda m: all(int(p) <= 255 for p in m[0].split("."))), ("card", _CARD, lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", _PHONE, lambda m: 9 <= len(digits(m)) <= 15))
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in checks for m in p.finditer(text or "") if ok(m)]


def test_personal_data_equals_brute_force(spark, sf_dir):
    found = texts(spark, sf_dir)
    seen = 0
    for r in QUERIES["op4_pii"](spark, sf_dir).collect():
        wanted = base_spans(found[r["doc_id"]])
        seen += len(wanted)
        assert r["base_sha256"] == hashlib.sha256(",".join(wanted).encode()).hexdigest()
        assert set(wanted) <= set(r["spans"].split(",")) or not wanted
    assert seen


def test_redaction(spark):
    text = "mail a.b@c.org, call +49 (30) 1234-567, card 4111 1111 1111 1111, ssn 078-05-1120, IBAN DE89 3704 0044 0532 0130 00, 4111 1111 1111 1112"
    made = pii.redact(spark.createDataFrame([(text,), ("nothing",), (None,)], "text string")).collect()
    assert made[0]["text"].startswith("mail <EMAIL>, call <PHONE>, card <CARD>, ssn <SSN>, IBAN <IBAN>, ") and "1112" in made[0]["text"]
    assert [made[1]["text"], made[2]["text"]] == ["nothing", None]


# 5


@given(st.lists(st.sampled_from("a b c d e f g h".split()), max_size=60))
def test_repeated_windows_equal_brute_force(words):
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    wanted = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    assert rules.repeated_words([w.encode() for w in words]) == len(wanted)


def test_counts():
    assert rules.counts("a # b\n\na # b\n  x| ") == (7, 8, 3, 1, 0)
    assert rules.counts(None) == (0, 0, 0, 0, 0)


def _paths(n):
    return [[i >> k & 1 for k in range(n)] for i in range(1 << n)]


def _weight(rows, labels, weights, steps):
    return sum(weights[y] @ x for x, y in zip(rows, labels)) + sum(steps[a, b] for a, b in zip(labels, labels[1:]))


def test_field_equals_enumeration():
    """Viterbi against all labellings; the gradient against differences of the enumerated likelihood."""
    rng = np.random.default_rng(3)
    sizes, n = [5, 3, 1], rules._N
    x, y = np.zeros((3, 5, n)), np.zeros((3, 5), dtype=np.int64)
    for k, size in enumerate(sizes):
        x[k, :size], y[k, :size] = rng.normal(size=(size, n)), rng.integers(0, 2, size)
    weigh, weights, steps = np.array([0.2, 0.5, 0.3]), rng.normal(size=(2, n)), rng.normal(size=(2, 2))
    for k, size in enumerate(sizes):
        best = max(_paths(size), key=lambda p: _weight(x[k, :size], p, weights, steps))
        assert rules.Field(weights, steps).viterbi(x[k, :size]) == best

    def likelihood(weights, steps):
        return sum(w * (_weight(x[k, :s], y[k, :s], weights, steps) - np.logaddexp.reduce([_weight(x[k, :s], p, weights, steps) for p in _paths(s)])) for k, (s, w) in enumerate(zip(sizes, weigh)))

    made = rules.gradient(x, y, np.array(sizes), weigh, weights, steps)
    for which, values in enumerate((weights, steps)):
        for at in np.ndindex(*values.shape):
            moved = [[v.copy() for v in (weights, steps)] for _ in range(2)]
            moved[0][which][at] += 1e-5
            moved[1][which][at] -= 1e-5
            assert made[which][at] == pytest.approx((likelihood(*moved[0]) - likelihood(*moved[1])) / 2e-5, abs=1e-6)


def test_lines_of_one_text_may_differ(spark, sf_dir):
    """The field decides by lines: shares stand strictly between 0 and 1, and good texts are kept."""
    sf = "/root/testdata/sf0.01"
    rows = rules.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").collect()
    assert sum(0 < r["content_share"] < 1 for r in rows) > 20
    judged = [r for r in rows if r["quality"] is not None and not r["base_failed"]]
    assert sum(r["kept"] == bool(r["quality"]) for r in judged) / len(judged) > 0.97
    for r in rows:
        words = (r["n_words"], r["n_repeat_words"])
        assert r["base_failed"] == (words[0] < 20 or 100 * words[1] > 30 * words[0]) and r["kept"] == (not r["base_failed"] and r["content_share"] >= rules.SHARE)
    found = texts(spark, sf)
    for r in rows[:200]:
        text = found[r["doc_id"]] or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        seen = Counter(windows)
        repeated = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        wanted = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == wanted


# 6


def brute_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark, sf_dir):
    prints = {i: brute_print(t) for i, t in texts(spark, sf_dir).items()}
    wanted = brute_components(prints)
    rows = QUERIES["op6_simhash"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{p:016x}", wanted[i]) for i, p in prints.items()}


@pytest.mark.parametrize("longest", [48, 2])
def test_links_of_close_prints(spark, longest, monkeypatch):
    """Both ways of searching a posting list join just what is close."""
    monkeypatch.setattr(simhash, "POSTINGS", longest)
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 62, 6)]
    prints = sorted({p ^ (1 << int(a)) ^ (1 << int(b)) for p in base for a, b in rng.integers(0, 62, (12, 2))} | set(base))
    links = simhash.links(spark.createDataFrame([(p,) for p in prints], "print long"))
    found = {r["node"]: r["root"] for r in components.components(links).collect()}
    wanted = brute_components({p: p for p in prints})
    assert {p: found.get(p, p) for p in prints} == wanted


# 8


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://WWW.Example.com/en/1?x", "www.example.com", "/en/1", "www.example.com/en/", "allow"), ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        ("https://a.com", "a.com", "", None, None), ("https://a.com/", "a.com", "/", "com/", "allow"), ("x", "", "", None, None), ("http://b.net/es/a#b", "b.net", "/es/a", "net/es/", "block"), ("http://xnet/es/a", "xnet", "/es/a", None, None),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    r = urls.judge(spark.createDataFrame([(url,)], "url string")).first()
    assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block") and verdict in (None, r["verdict"])


# 9


def test_urls_of_names_held_out(spark):
    """A fifth of the names, by their digest, is kept from the fit; then they are told apart."""

    def held(url: str) -> bool:
        host = url.partition("://")[2].partition("/")[0]
        name = max(host.removeprefix("www.").split("."), key=len)
        return zlib.crc32(name.encode()) % 5 == 0

    rows = urls.labelled()
    weights, base = urls.fit([r for r in rows if not held(r[0])])
    rest = [r for r in rows if held(r[0])]
    right = {0: [], 1: []}
    for url, label in rest:
        host, slash, path = url.partition("://")[2].partition("/")
        grams = urls._grams(host, slash + path)
        score = sum(weights[urls._bucket(g)] for g in grams) / len(grams) + base
        right[label].append((score >= 0) == bool(label))
    assert len(rest) > 50 and len(right[1]) > 10
    assert sum(right[0]) >= 0.9 * len(right[0])
    assert sum(right[1]) >= 0.5 * len(right[1])


def test_pages_of_the_table(spark, sf_dir):
    import html as library

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in QUERIES["op9_html"](spark, sf_dir).collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(library.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


PROSE = "This is a long paragraph about something that is interesting and has many words in it."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<nav><a href=x>Home</a></nav>", ""), ("<p>just text", "just text"),
        (f'<div class="main-menu">Home | About</div><div class="content"><h2>Title</h2><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p></div><div class="sidebar"><p>{PROSE}</p></div><div id="comments"><p>{PROSE}</p></div>', f"Title\n\n{PROSE}\n\nShort.\n\n{PROSE}"),
        ("<article><h1>A&amp;B</h1><p>one&nbsp; two<br>three<p>four<form>mail</form><aside>more</aside></article><footer>f</footer>", "A&B\n\none two three\n\nfour"),
        ('<div class="ad">Buy<article><p>Words here.</p></article><div class="related"><article><p>Other</p></article></div></div>', "Words here."),
        ("<script>var a='</p>';</script><style>p{}</style><main><p>x</main>", "x"),
        ("<form>Enter your mail<input><p>and password</form>", ""),
        (f"<article><p>{PROSE}</p><ul><li><a href=a>one</a><a href=b>two</a></ul></article>", f"{PROSE}\n\nonetwo"),
        (f"<div><p>{PROSE}</p>" + "<ul>" + "<li>ab" * 7 + f"</ul><p>{PROSE}</p><p>end</div>", "\n\n".join([PROSE, *["ab"] * 7, PROSE, "end"])),
    ],
)
def test_pages(page, text):
    assert html.main_text(page) == text


# 10


def test_language_model(spark, sf_dir):
    found = texts(spark, sf_dir)
    train = {i for i in found if zlib.crc32(str(i).encode()) % 7 != 2}
    words = {i: [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"] for i, t in found.items()}
    count = Counter(w for i in train for w in words[i])
    n, v = sum(count.values()), len(count)
    rows = QUERIES["op10_suffixtree"](spark, sf_dir).collect()
    assert len(rows) == len(found)
    for r in rows:
        own = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (r["doc_id"] not in train, len(own), sum(count[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + 1 * (v + 1))) for w in own))
        assert r["score"] < 0
    held = [r for r in rows if r["held_out"]]
    size = sum(len(" ".join(words[r["doc_id"]]).encode()) for r in held)
    assert -sum(r["score"] for r in held) / size < 1.0  # far under log10(256) for a byte


def test_suffix_states_are_followed():
    """The automaton gives the same as a search for the longest suffix at each byte."""
    rng = np.random.default_rng(1)
    streams = [bytes(rng.integers(97, 100, 40).astype(np.uint8)) + b"\n" for _ in range(30)]
    raw, n = suffixtree.grams(streams)
    found: dict = {}
    for key, k in zip(raw.tolist(), n.tolist()):
        window = key.to_bytes(suffixtree.DEPTH + 1, "big")
        for size in range(suffixtree.DEPTH + 1):
            context = window[suffixtree.DEPTH - size : -1]
            if b"\0" not in context:
                found.setdefault(context, Counter())[window[-1]] += k
    tree = suffixtree.grow({c: (np.array(sorted(x)), np.array([x[s] for s in sorted(x)])) for c, x in found.items()})
    tables = tree.tables()
    number = {c: i for i, c in enumerate(tree.contexts)}
    p = np.zeros((len(number), 256))
    for i, c in enumerate(tree.contexts):
        at = slice(tree.starts[i], tree.starts[i + 1])
        total = tree.counts[at].sum()
        row, smooth = (np.full(256, 1 / 256), suffixtree.SMOOTH_ROOT * 256) if not c else (p[number[suffixtree._parent(c, number)]], suffixtree.SMOOTH)
        p[i] = row * smooth / (total + smooth)
        p[i, tree.symbols[at]] += tree.counts[at] / (total + smooth)
    text = streams[0]
    before, wanted = suffixtree.END, 0.0
    for s in text:
        context = next(before[-k:] for k in range(min(len(before), suffixtree.DEPTH), 0, -1) if before[-k:] in number) if any(before[-k:] in number for k in range(1, suffixtree.DEPTH + 1)) else b""
        wanted += math.log10(p[number[context], s])
        before = (before + bytes([s]))[-suffixtree.DEPTH :]
    assert suffixtree.log_probability([text], tables)[0] == pytest.approx(wanted, abs=1e-3)


def test_contexts_grow_with_the_corpus(spark):
    """A rare context is kept however much text stands beside it; every candidate is judged as ``grow`` does."""
    rare, common = "qzxqz " * 20, "the tall tree and the old road " * 200
    trees = []
    for copies in (1, 400):
        docs = spark.createDataFrame([(0, rare, True), *[(0, common, True)] * copies], "chunk long, text string, train boolean").coalesce(1)
        rows = suffixtree.counted_grams(docs).cache()
        trees.append(suffixtree.gathered(suffixtree.learn(rows)))
        found: dict = {}
        for r in rows.collect():
            window = r["gram"].to_bytes(suffixtree.DEPTH + 1, "big")
            for size in range(suffixtree.DEPTH + 1):
                context = window[suffixtree.DEPTH - size : -1]
                if b"\0" not in context:
                    found.setdefault(context, Counter())[window[-1]] += r["n"]
        whole = suffixtree.grow({c: (np.array(sorted(x)), np.array([x[s] for s in sorted(x)])) for c, x in found.items() if not c or x.total() >= suffixtree.LEAST_COUNT})
        assert trees[-1].contexts == whole.contexts and (trees[-1].counts == whole.counts).all()
    kept = {c for c in trees[1].contexts if b"q" in c or b"x" in c}
    assert kept and {c for c in trees[0].contexts if b"q" in c or b"x" in c} <= kept


@pytest.mark.parametrize("most", [suffixtree.TABLES, 0])
def test_model_score_equals_brute_force(spark, sf_dir, monkeypatch, most):
    """Contexts, divergence tests, smoothing and suffix search written out over strings of bytes,
    for retained contexts that are broadcast and for those that are too many for it."""
    monkeypatch.setattr(suffixtree, "TABLES", most)
    clean = lambda t: re.sub(rb"[\x20\x09-\x0d]+", b" ", (t or "").encode()).strip(b" ").replace(b"\0", b"\1")
    found = {i: re.sub(rb"[A-Z]", lambda m: m[0].lower(), clean(t)) + b"\n" for i, t in texts(spark, sf_dir).items()}
    depth, after = suffixtree.DEPTH, {}
    for i, text in found.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for at in range(len(text)):
                before = (b"\n" + text)[max(0, at + 1 - depth) : at + 1]
                for k in range(len(before) + 1):
                    after.setdefault(before[len(before) - k :], Counter())[text[at]] += 1
    tree = {}

    def state(context):
        return next(context[k:] for k in range(len(context) + 1) if context[k:] in tree)

    def p(context, symbol):
        n = after[context]
        smooth = suffixtree.SMOOTH if context else 256 * suffixtree.SMOOTH_ROOT
        return (n[symbol] + smooth * (p(state(context[1:]), symbol) if context else 1 / 256)) / (n.total() + smooth)

    tree[b""] = True
    for context in sorted(after, key=lambda c: (len(c), c)):
        n, total = after[context], after[context].total()
        if context and total >= suffixtree.LEAST_COUNT:
            kl = sum(k / total * math.log(k / total / p(state(context[1:]), s)) for s, k in n.items())
            if kl >= suffixtree.LEAST_KL and 2 * total * kl >= suffixtree.LEAST_G:
                tree[context] = True
    for r in suffixtree.query(spark, sf_dir).collect():
        text = found[r["doc_id"]]
        if len(text) < 3000:
            wanted = sum(math.log10(p(state((b"\n" + text)[max(0, at + 1 - depth) : at + 1]), text[at])) for at in range(len(text)))
            assert r["score"] == pytest.approx(wanted, rel=1e-9)


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_windows_are_valued_on_odd_tables(spark, tables, monkeypatch, kind):
    """Where no process holds the contexts, every row has the score that it has where one does."""
    expected = sorted(map(repr, suffixtree.query(spark, tables[kind]).select("doc_id", F.round("score", 6)).collect()))
    monkeypatch.setattr(suffixtree, "TABLES", 0)
    assert sorted(map(repr, suffixtree.query(spark, tables[kind]).select("doc_id", F.round("score", 6)).collect())) == expected


def test_table_bytes_bound_the_tables(spark, sf_dir):
    """What is compared with ``TABLES`` is no less than the arrays that are broadcast."""
    states = suffixtree.learn(suffixtree.counted_grams(suffixtree.chunked(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
    t = suffixtree.gathered(states).tables()
    arrays = [t.state, t.parent, t.unseen, *(a for x in (t.children, t.logs) for a in (x.keys, x.values))]
    assert sum(a.nbytes for a in arrays) <= suffixtree.table_bytes(states)


def test_scores_do_not_depend_on_chunks(spark, sf_dir, monkeypatch):
    """Small chunks of many size classes give the scores of large ones."""

    def rows():
        return sorted(map(tuple, suffixtree.query(spark, sf_dir).select("doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6), F.round("score", 6)).collect()))

    expected = rows()
    monkeypatch.setattr(suffixtree, "ROWS", 16)
    monkeypatch.setattr(suffixtree, "LENGTH", 200)
    sizes = suffixtree.chunked(spark.read.parquet(f"{sf_dir}/documents.parquet")).groupBy("chunk").agg(F.sum(F.length("text")).alias("n"), F.count("doc_id").alias("rows")).where("rows > 1").agg(F.max("n")).first()[0]
    assert sizes <= 16 * 2 * 200
    assert rows() == expected
