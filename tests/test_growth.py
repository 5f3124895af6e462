"""Steps whose cost must grow no faster than their input."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from factloom.facts import fact_table
from factloom.operators import clones, history
from factloom.plans.model import BATCH_ROWS, Constant, Keywords
from factloom.queries import evidence
import factloom.rules  # noqa: F401
from factloom.plans.rules import REGISTRY, evaluate
from factloom.rules.contextual import CONTEXTUAL, judged

AT = {"path": "a/b.py", "language": "python", "start_line": 1, "end_line": 9}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_are_dealt_by_their_number(spark, monkeypatch):
    """A small file of many keys is several tasks, and equal keys spread."""
    monkeypatch.setattr(evidence, "TASK_KEYS", 100)
    keys = spark.range(0, 1000, 1, 1).select((F.col("id") * 0).alias("p_partkey"), "id")
    rows = evidence.dealt(keys, "p_partkey")
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert rows.columns == ["p_partkey"] and sum(sizes) == 1000
    assert len(sizes) >= 10 and max(sizes) <= 150


def test_criteria_are_asked_in_one_pass(spark):
    """Four criteria are one Python worker in a task, over bounded batches."""
    rows = CONTEXTUAL["ALL-DEPL1001"].judge(fact_table(spark, "Deployment", [{**AT, "fact_id": "x", "is_applicable": True}]), Constant("yes"))
    assert len(re.findall(r"MapIn(?:Arrow|Pandas)", plan(rows))) == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS
    assert rows.first()["category"] == "verified"


class Broken:
    name = "broken"

    def answer(self, question, options, subjects):
        raise ValueError(question)


def test_rules_of_a_family_are_judged_in_one_scan(spark):
    """Each rule keeps its own candidates, question and backend; one that fails leaves the others."""
    groups = [[{"text": "because", "token_count": 5, "character_count": 30}], [{"text": "no", "token_count": 1, "character_count": 2}], None]
    facts = fact_table(spark, "Comment", [{**AT, "fact_id": str(i), "groups": g} for i, g in enumerate(groups)])
    rules = [CONTEXTUAL[i] for i in ("ALL-COMM1001", "ALL-COMM1002", "ALL-WRIT1001")]
    backends = [Keywords({"rationale": "because"}), Broken(), Constant("target")]
    rows = judged(facts, rules, backends)
    assert len(re.findall(r"MapIn(?:Arrow|Pandas)", plan(rows))) == 1
    assert "Filter" not in plan(rows)
    apart = [r for rule, backend in zip(rules, backends) for r in rule.judge(facts, backend).collect()]
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, apart))
    assert sorted((r["rule_id"], r["fact_id"], r["category"], r["verdict"]) for r in apart) == [("ALL-COMM1001", "0", "rationale", "pass"), ("ALL-COMM1002", "0", "uncertain", "unassessed"), ("ALL-WRIT1001", "0", "target", "pass")]


def test_windows_are_made_and_moved_once(spark):
    """Equal windows have equal hashes wherever they stand, and nothing is made again to count them."""
    rng = random.Random(5)
    texts = [[rng.choice(["a", "b", "c\x1fd", "c", "d", "é", None]) for _ in range(rng.randrange(0, 30))] for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key int, words array<string>")
    for size in (1, 2, 5, 7):
        found = clones.windows(docs, "key", F.col("words"), size)
        assert found.dtypes == [("key", "int"), ("at", "int"), ("hash", "bigint")]
        wanted = {(k, i): "\x1f".join(w for w in t[i : i + size] if w is not None) for k, t in enumerate(texts) for i in range(len(t) - size + 1)}
        made = {(r["key"], r["at"]): r["hash"] for r in found.collect()}
        assert made.keys() == wanted.keys()
        assert len(set(made.values())) == len(set(wanted.values())) == len({(made[k], wanted[k]) for k in made})
        again = clones.repeated(found, "key")
        assert len(re.findall(r"MapIn(?:Arrow|Pandas)", plan(again))) == 1
        places = Counter(wanted.values())
        assert {(r["key"], r["at"]): r["places"] for r in again.collect()} == {k: places[v] for k, v in wanted.items() if places[v] > 1}


def test_counted_findings_are_not_made(spark):
    """Without findings a rule gives the same numbers, and no message is put together."""
    facts = {f: evidence.facts(spark.range(40), "id", f) for f in ("TestFunction", "ProseSegment", "DataAsset", "TestSuite", "Function", "CloneGroup")}
    rules = [r for r in REGISTRY.values() if r.families[0] in facts and not r.over_facts]
    whole, short = evaluate(facts, rules), evaluate(facts, rules, with_findings=False)
    assert short.columns == [c for c in whole.columns if c != "findings"]
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(short) == rows(whole.drop("findings"))
    assert whole.where(F.size("findings") != F.col("finding_count")).count() == 0
    assert "legacy fixture" in plan(whole) and "legacy fixture" not in plan(short)


def test_uniformity_makes_its_list_once(spark):
    """A mean that stands inside a list is not made for each of its items."""
    value = REGISTRY["ALL-WRIT0003"].build().value
    rows = fact_table(spark, "ProseSegment", [{**AT, "fact_id": "x"}]).select(value.alias("v"))
    assert rows._jdf.queryExecution().analyzed().toString().count("sentence_word_counts") <= 2


def test_pairs_are_made_once_for_their_references(spark):
    """Words and other names are found as a pattern finds them; pairs that stand twice stay twice."""
    names = ["a", "a1", "é", "a-b", "x y", "", "Z_"]
    lines = ["import a", "a1.a", "é,a-b", "from x y", "", "xZ_", "a-b\n", None]
    pairs = spark.createDataFrame([(f"src/{x}.py", f"lib/{y}.py", 1) for x in names for y in names] + [("src/a.py", "lib/a.py", 1), (None, "lib/a.py", 2)], "left string, right string, shared int")
    imports = spark.createDataFrame([(f"{d}/{x}.py", line) for d in ("src", "lib") for x in names[:4] for line in lines], "path string, imported string")
    made = history.references(pairs, imports)
    assert made.columns == [*pairs.columns, "import_reference_count"] and plan(made).count("Scan ExistingRDD[left") == 1
    word = lambda line, name: line is not None and re.search(rf"(^|[^\w]){re.escape(name)}($|[^\w])", line) is not None
    of = lambda path, name: sum(word(line, name) for p, line in ((r["path"], r["imported"]) for r in given) if path is not None and p == path)
    given = imports.collect()
    base = lambda path: None if path is None else path.split("/")[-1].split(".")[0]
    wanted = [(r["left"], r["right"], r["shared"], (of(r["left"], base(r["right"])) if r["left"] else 0) + (of(r["right"], base(r["left"])) if r["left"] else 0)) for r in pairs.collect()]
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, wanted))
