"""The rule catalogue on facts given in memory."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import factloom.rules  # noqa: F401
from factloom.facts import FAMILIES, fact_table
from factloom.plans.model import Constant, Keywords
from factloom.plans.policy import Boolean, Category, Numeric
from factloom.plans.rules import REGISTRY, batches, evaluate, failures, findings, select, summary
from factloom.rules.contextual import CONTEXTUAL

AT = {"path": "a/b.py", "language": "python", "start_line": 1, "end_line": 9}


def run(spark, id, *rows, **settings):
    """Rows of one rule: value, findings."""
    rule = REGISTRY[id].stated(**settings)
    facts = {}
    for family in rule.families:
        given = [r for r in rows if r.get("family", rule.families[0]) == family]
        facts[family] = fact_table(spark, family, [{**AT, "fact_id": str(i), **{k: v for k, v in r.items() if k != "family"}} for i, r in enumerate(given)])
    found = evaluate(facts, [rule]).orderBy("fact_id").collect()
    value = f"{rule.kind}_value"
    return [(r[value], [f["message"] for f in r["findings"]], r["verdict"]) for r in found]


def test_catalogue_is_whole():
    assert len(REGISTRY) == 241 and len(CONTEXTUAL) == 44
    assert all(f in FAMILIES for r in REGISTRY.values() for f in r.families)


def test_every_rule_takes_bare_facts(spark):
    """Facts with nothing in them give no crash, and no findings of what isn't there."""
    facts = {f: fact_table(spark, f, [{**AT, "fact_id": "x"}]) for f in FAMILIES}
    rows = evaluate(facts, REGISTRY.values()).collect()
    assert {r["rule_id"] for r in rows} <= set(REGISTRY)
    empty = {f: t.limit(0) for f, t in facts.items()}
    assert evaluate(empty, REGISTRY.values()).count() == 0


def test_duplicate_route(spark):
    routes = [{"method": "GET", "path": "/users", "declared_in": "api_users.py", "line": 1, "references": []}, {"method": "get", "path": "/users", "declared_in": "api_b.py", "line": 3, "references": []}, {"method": "GET", "path": "/items", "declared_in": "c.py", "line": 5, "references": []}]
    assert run(spark, "ALL-ROUT0001", {"routes": routes}) == [(1, ["get /users is declared 2 times"], "fail")]


def test_route_style_and_reach(spark):
    routes = [{"method": "GET", "path": p, "declared_in": "a.py", "line": 1, "is_prefix_composed": False, "references": r} for p, r in (("/user-list", [{"path": "b.ts", "language": "typescript", "line": 2}]), ("/order-list", []), ("/part_list", []))]
    assert run(spark, "ALL-ROUT0003", {"routes": routes})[0][0] == 1
    assert run(spark, "ALL-ROUT0002", {"routes": routes})[0][0] == 2


def test_clones(spark):
    fact = {"fragments": [{"path": "a.py", "start_line": 1, "end_line": 10}, {"path": "b.py", "start_line": 1, "end_line": 10}, {"path": "c.py", "start_line": 1, "end_line": 2}], "token_length": 90, "repository_line_count": 100}
    assert run(spark, "ALL-DUPL0003", fact)[0][::2] == (1, "unassessed")
    assert run(spark, "ALL-DUPL0004", fact)[0][0] == pytest.approx(10.0)


def _coupled(shared, left, right):
    """Changes with both files, then those of one."""
    both = [{"other_file_count": 0, "paths": ["l.py", "r.py"]}] * shared
    return {"changes": both + [{"paths": ["l.py"]}] * (left - shared) + [{"paths": ["r.py"]}] * (right - shared), "files": [{"path": "l.py", "imports": []}, {"path": "r.py", "imports": []}]}


@pytest.mark.parametrize(("shared", "left", "right", "n"), [(5, 5, 5, 1), (4, 4, 4, 0), (5, 50, 5, 1), (5, 11, 11, 0)])
def test_co_change(spark, shared, left, right, n):
    assert run(spark, "ALL-HIST0003", _coupled(shared, left, right))[0][0] == n


def test_co_change_of_importing_files(spark):
    fact = _coupled(5, 5, 5)
    fact["files"][0]["imports"] = ["r.py"]
    assert run(spark, "ALL-HIST0003", fact)[0][0] == 0


def test_hotspots(spark):
    file = lambda p, **k: {"path": p, "author_count": 1, "additional_commit_count": 1, "days_since_last_change": 0, "line_count": 900, "is_test": False, **k}
    files = [file("busy.py", additional_commit_count=9), file("calm.py"), file("short.py", additional_commit_count=9, line_count=5), file("shared.py", author_count=4, additional_commit_count=1, line_count=1)]
    assert run(spark, "ALL-HIST0001", {"files": files})[0][0] == 1
    assert run(spark, "ALL-HIST0002", {"files": files})[0][0] == 1


def _member(name, *parameters, decorators=(), callable=True):
    kinds = {"/": "positional_only", "*": "keyword_only"}
    found = [{"name": p.strip("/*=@"), "kind": "var_keyword" if p.startswith("@") else kinds.get(p[0], "positional_or_keyword"), "has_default": p.endswith("=")} for p in parameters]
    return {"name": name, "parameters": found if callable else None, "decorators": list(decorators), "asynchronous": False, "line": 3}


@pytest.mark.parametrize(
    ("id", "base", "own", "n"),
    [
        ("ALL-OVER0001", _member("m", "self", "a", "b"), _member("m", "self", "a"), 1),
        ("ALL-OVER0001", _member("m", "self", "a"), _member("m", "self", "a", "b="), 0),
        ("ALL-OVER0001", _member("m", "self", "a"), _member("m", "self", "a", "b"), 1),
        ("ALL-OVER0001", _member("m", "self", "*k"), _member("m", "self", "@kw"), 0),
        ("ALL-OVER0002", _member("m", "self", "a"), _member("m", "self", "b"), 1),
        ("ALL-OVER0003", _member("m", "self", "a="), _member("m", "self", "a"), 1),
        ("ALL-OVER0004", _member("m", "self"), _member("m", decorators=["staticmethod"]), 1),
        ("ALL-OVER0005", _member("m", "self", decorators=["abc.abstractmethod"]), _member("n", "self"), 1),
        ("ALL-OVER0006", _member("__init__", "self"), _member("__init__", "self"), 1),
        ("ALL-OVER0008", _member("m", "self", decorators=["typing.final"]), _member("m", "self"), 1),
        ("ALL-OVER0010", _member("m", callable=False), _member("m", "self"), 1),
    ],
)
def test_overrides(spark, id, base, own, n):
    fact = {"derived": "p.D", "base": "p.B", "depth": 1, "base_names": ["B"], "ancestor_names": ["B"], "declared": [own], "inherited": [base], "initializer_calls": []}
    assert run(spark, id, fact)[0][0] == n


def test_catalog_rules(spark):
    assets = [{"identifier": "s.a", "description": "x", "owners": [], "domain": "d", "is_changed": True, "fields": [{"name": "f", "description": " ", "tags": ["PII"], "glossary_terms": []}]}, {"identifier": "s.b", "description": "y", "owners": ["me"], "domain": "", "is_changed": False, "fields": []}]
    edges = [{"source": a, "target": b, "source_exists": True, "target_exists": b != "s.z"} for a, b in (("s.a", "s.c"), ("s.c", "s.d"), ("s.d", "s.z"))]
    assert run(spark, "ALL-DATA0007", {"assets": assets})[0][0] == 1
    assert run(spark, "ALL-DATA0009", {"assets": assets})[0][0] == pytest.approx(100 / 3)
    assert run(spark, "ALL-DATA0012", {"assets": assets})[0][0] == 1
    assert run(spark, "ALL-DATA0010", {"edges": edges})[0][0] == 1
    assert run(spark, "ALL-DATA0011", {"assets": assets}, {"family": "LineageEdge", "edges": edges})[0][:2] == (1, ["nobody owns s.a, which 3 assets depend on"])
    change = {"changes": [{"asset_identifier": "a", "is_breaking": True, "downstream_assets": ["b", "c"], "tested_assets": ["b"]}, {"asset_identifier": "q", "is_breaking": False, "downstream_assets": ["z"]}]}
    assert run(spark, "ALL-DATA0008", change)[0][0] == pytest.approx(200 / 3)
    reference = {"references": [{"source_location": "x:1", "asset_identifier": "s.a", "asset_exists": True, "lifecycle": "deprecated", "upstream_health": {"u": "unhealthy", "v": "healthy"}}, {"source_location": "x:2", "asset_identifier": "s.q", "asset_exists": False, "lifecycle": "unknown"}]}
    for id, n in (("ALL-DATA0001", 1), ("ALL-DATA0004", 1), ("ALL-DATA0006", 1)):
        assert run(spark, id, reference)[0][0] == n
    assert run(spark, "ALL-DATA0013", reference, {"family": "DataAsset", "assets": assets})[0][0] == 1


def test_functions(spark):
    parameter = lambda name, **k: {"name": name, "type_name": "", "is_receiver": False, "has_default": False, **k}
    fact = {"name": "f", "scope": "module", "visibility": "public", "parameters": [parameter("self", is_receiver=True), parameter("a", type_name="str"), parameter("b", type_name="str"), parameter("c", type_name="bool", has_boolean_annotation=True, has_default=True)], "control_increments": [{"kind": "conditional", "nesting_depth": 0}, {"kind": "loop", "nesting_depth": 2}], "direct_statement_count": 11}
    assert run(spark, "ALL-FUNC0008", fact)[0][0] == 4
    assert run(spark, "ALL-FUNC0009", fact)[0][0] == 2
    assert run(spark, "ALL-FUNC0010", fact)[0][0] == 2
    assert run(spark, "ALL-PARA0001", fact)[0][0] == 1
    assert run(spark, "ALL-PARA0003", fact)[0][0] == 1
    assert run(spark, "ALL-FUNC0001", fact)[0] == (11, ["statements of f"], "fail")


def test_prose(spark):
    same = {"sections": [{"sentence_word_counts": [10] * 6, "paragraph_word_counts": [40] * 4, "sentence_openers": ["The"] * 3 + ["A"] + ["One", "Two", "Six"]}]}
    assert run(spark, "ALL-WRIT0003", same)[0][0] == 100.0
    assert run(spark, "ALL-WRIT0004", same)[0][0] == 100.0
    assert run(spark, "ALL-WRIT0005", same)[0][0] == 50.0
    assert run(spark, "ALL-WRIT0003", {"sections": [{"sentence_word_counts": [4]}]})[0][2] == "unassessed"


def test_policies_and_settings(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (None,)], "v double")
    of = lambda p: [r[0] for r in df.select(p.verdict(F.col("v"))).collect()]
    assert of(Numeric(1, 5)) == ["fail", "pass", "unassessed"] and of(Numeric()) == ["unassessed"] * 3
    flags = spark.createDataFrame([(True,), (False,), (None,)], "v boolean")
    assert [r[0] for r in flags.select(Boolean(False).verdict(F.col("v"))).collect()] == ["fail", "pass", "unassessed"]
    assert Category.closed("abc", "a", "b").bad == {"c"} and not Category.advisory("ab").bad
    with pytest.raises(ValueError):
        Category.closed("ab", "a", "a")
    with pytest.raises(ValueError):
        REGISTRY["ALL-FUNC0008"].stated(nope=1)
    with pytest.raises(ValueError):
        REGISTRY["ALL-FUNC0008"].stated(nesting_penalty="x")
    assert [r.id for r in select(REGISTRY.values(), ["ALL-MODU000[12]"], ["*2"])] == ["ALL-MODU0001"]
    assert sum(len(b) for b in batches(REGISTRY.values())) == len(REGISTRY)


def test_collection(spark):
    facts = {"Module": fact_table(spark, "Module", [{**AT, "fact_id": f"m{i}", "path": f"p/x{i}.py", "physical_line_count": 400 + 100 * i, "class_count": i, "function_count": 0, "is_test": False} for i in range(4)])}
    results = evaluate(facts, select(REGISTRY.values(), ["ALL-MODU0001", "ALL-MODU0005"]))
    rows = {r["rule_id"]: r for r in summary(results).collect()}
    assert (rows["ALL-MODU0001"]["observation_count"], rows["ALL-MODU0001"]["failure_count"]) == (4, 2)
    assert [r["fact_id"] for r in failures(results, 3).collect()] == ["m2", "m2", "m3"]
    assert findings(failures(results)).count() == 4


@pytest.mark.parametrize("id", sorted(CONTEXTUAL))
def test_contextual_rules_close_their_domain(spark, id):
    rule = CONTEXTUAL[id]
    assert "uncertain" in rule.policy.domain and not rule.policy.good & rule.policy.bad
    assert all(d.category in rule.policy.domain for d in rule.table)
    assert set(rule.fields) <= set(fact_table(spark, rule.family, []).columns)


def test_contextual_judgement(spark):
    facts = fact_table(spark, "Comment", [{**AT, "fact_id": "c", "groups": [{"text": "because of the old driver", "token_count": 5}]}])
    judged = CONTEXTUAL["ALL-COMM1001"].judge(facts, Keywords({"rationale": "because"})).collect()[0]
    assert (judged["category"], judged["verdict"]) == ("rationale", "pass")
    deployment = fact_table(spark, "Deployment", [{**AT, "fact_id": "d"}])
    assert CONTEXTUAL["ALL-DEPL1001"].judge(deployment, Constant("yes")).collect()[0]["category"] == "verified"
    assert CONTEXTUAL["ALL-DEPL1001"].judge(deployment, Constant("yes", 0.5)).collect()[0]["verdict"] == "unassessed"


def test_rulebook_covers_the_contextual_catalogue():
    from factloom.queries import rulebook

    assert {line.split()[0] for line in rulebook.CONTEXT.strip().split("\n")} == set(CONTEXTUAL)
    assert set(rulebook.BOOK) <= set(REGISTRY) and len(rulebook.BOOK) >= 210


@pytest.mark.parametrize(
    ("id", "node", "n"),
    [
        ("ALL-CONT0003", {"kind": "call", "name": "set_trace"}, 1), ("ALL-CONT0003", {"kind": "expression", "name": "", "text": "println!(x); dbg!(y)"}, 2), ("ALL-CONT0003", {"kind": "call", "name": "logger.debug"}, 0),
        ("ALL-ERRO0003", {"kind": "throw", "text": "throw new std::exception()"}, 1), ("ALL-ERRO0003", {"kind": "raise", "text": "raise KeyError(x)"}, 0),
        ("ALL-SECU0002", {"kind": "call", "name": "crypto.createHash", "text": "crypto.createHash('md5')"}, 1), ("ALL-SECU0002", {"kind": "call", "name": "hashlib.sha256", "text": "hashlib.sha256(b)"}, 0),
    ],
)
def test_restored_defaults(spark, id, node, n):
    nodes = [{"node_id": "0", "ordinal": 0, "subtree_end": 1, "depth": 0, "line": 1, **node}]
    assert run(spark, id, {"qualname": "f", "kind": "function", "nodes": nodes})[0][0] == n
