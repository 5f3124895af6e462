"""The pipeline against its stages in plain Python."""

from __future__ import annotations

import hashlib

import corpus_pipeline
from factloom.llm import bpe, decontaminate, quality, simhash
from tests.llm.test_operators import brute_components, brute_print


def test_pipeline_equals_brute_force(spark, sf_dir):
    documents = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    good = {r["doc_id"] for r in quality.query(spark, sf_dir).where("predicted = 1").collect()}
    kept = {i: t for i, t in documents.items() if i in good}
    roots = brute_components({i: brute_print(t) for i, t in kept.items()})
    kept = {i: t for i, t in kept.items() if roots[i] == i}
    index = decontaminate.Index([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    kept = {i: t for i, t in kept.items() if not index.search([t])[0]}
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(rows) == set(kept)
    with open(bpe.default_tokenizer(), encoding="utf-8") as file:
        own = bpe.Bpe(file.read())
    stages = dict(corpus_pipeline.STAGES)
    clean = {r["doc_id"]: r["text"] for r in stages["personal_data"](spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).collect()}
    for i, r in rows.items():
        assert r["ids"] == own.encode(clean[i])
        assert r["decoded_sha256"] == hashlib.sha256(own.decode(r["ids"]).encode()).hexdigest()


def test_stages_keep_the_columns(spark, tables, odd):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, tables["odd"]).columns == odd.columns, name
    once = corpus_pipeline.keep_one_of_each(spark, odd, tables["odd"])
    # the null text, " " and "" are one; "x" without an id gives way to the "x" with one
    texts = ["", "x", "Été \x1c ñ 北京 😀", "word " * 30_000, "the the the\nthe the the\n", "a@b.co and a@b.co"]
    assert once.count() == len({simhash.simhash(t) for t in texts})
    assert corpus_pipeline.run(spark, tables["empty"]).count() == 0


def test_one_id_with_two_texts(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta"))
    rows = [(1, one), (1, two), (2, one), (None, one), (None, "something else altogether"), (None, "something else altogether"), (1, two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.keep_one_of_each(spark, docs, "").collect()
    assert sorted((tuple(r) for r in kept), key=repr) == sorted([(1, one), (1, two), (None, "something else altogether")], key=repr)
