"""Rules on tests and their configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.plans.policy import Category, Numeric
from factloom.plans.rules import categorized, counted, flagged, measured, rule, say
from factloom.rules.common import about, any_of, col, filled

PYTHON = ("python",)
_STRICT = ("strict_config", "strict_markers", "strict_parametrization_ids", "strict_xfail")


def _collected():
    return F.filter("tests", lambda t: t["is_collected"])


def _line(t):
    return t["line"]


@rule("PY-TEST0002", "TestFunction", languages=PYTHON)
def legacy_tmpdir_fixture_count():
    uses = F.flatten(F.transform("tests", lambda t: F.transform(F.filter(F.concat(F.coalesce(t["fixture_names"], F.array()), F.coalesce(t["requested_fixture_names"], F.array())), lambda n: n.isin("tmpdir", "tmpdir_factory")), lambda n: F.struct(n.alias("fixture"), t["name"].alias("name"), t["line"].alias("line")))))
    return counted(uses, lambda x: F.lit(True), about("legacy fixture", "fixture", "name"), _line)


@rule("PY-TEST0003", "TestCaseGroup", languages=PYTHON)
def parametrization_candidate_group_count(minimum_cases: int = 3, maximum_cases: int = 9):
    n = lambda g: F.size(F.array_distinct(g["literal_vectors"]))
    return counted(col("groups"), lambda g: n(g).between(minimum_cases, maximum_cases), about("tests that differ in values alone"))


@rule("PY-TEST0017", "TestCaseGroup", languages=PYTHON)
def broad_example_property_candidate_count(minimum_cases: int = 10):
    return counted(col("groups"), lambda g: F.size(F.array_distinct(g["literal_vectors"])) >= minimum_cases, about("examples that are a property"))


@rule("PY-TEST0013", "TestCaseGroup", languages=PYTHON)
def manual_literal_test_case_loop_count(minimum_cases: int = 3):
    return counted(col("loops"), lambda x: (x["case_count"] >= minimum_cases) & x["owns_assertion"], about("loop over cases"))


@rule("PY-TEST0004", "TestSuite", kind="category", policy=Category(frozenset({"strict"}), frozenset(), frozenset({"partial", "permissive"})), languages=PYTHON)
def pytest_configuration_strictness():
    on = lambda name: F.coalesce(F.try_element_at("strict_controls", F.lit(name)), F.lit(False))
    number = sum((on(n).cast("int") for n in _STRICT), F.lit(0))
    return categorized([(on("strict") | (number == len(_STRICT)), "strict"), (number > 0, "partial")], "permissive", say("strict controls: ", number))


@rule("PY-TEST0005", "TestSuite", kind="category", policy=Category(frozenset({"isolated"}), frozenset(), frozenset({"appended", "prepended", "invalid"})), languages=PYTHON)
def pytest_import_isolation():
    mode = F.coalesce(F.nullif(F.trim("import_mode"), F.lit("")), F.lit("prepend"))
    return categorized([(mode == "importlib", "isolated"), (mode == "append", "appended"), (mode == "prepend", "prepended")], "invalid", say("import mode: ", mode))


@rule("PY-TEST0006", "TestSuite", kind="boolean", languages=PYTHON)
def async_runner_auto_mode_conflict():
    return flagged(F.coalesce((col("anyio_mode") == "auto") & (col("asyncio_mode") == "auto"), F.lit(False)), "two runners take every async test")


@rule("PY-TEST0007", "TestSuite", kind="boolean", languages=PYTHON)
def coverage_without_branch_measurement():
    return flagged(col("is_coverage_configured") & ~col("is_branch_coverage_enabled"), "coverage leaves out branches")


@rule("PY-TEST0008", "TestFunction", languages=PYTHON)
def direct_shared_test_state_mutation_count():
    times = F.flatten(F.transform(_collected(), lambda t: F.array_repeat(F.struct(t["name"].alias("name"), t["line"].alias("line")), t["module_state_mutation_count"].cast("int"))))
    return counted(times, lambda x: F.lit(True), about("changes shared state:", "name"), _line)


@rule("PY-TEST0009", "TestFunction", languages=PYTHON)
def synchronous_test_asyncio_run_count():
    runs = F.flatten(F.transform(F.filter("tests", lambda t: t["is_collected"] & ~t["is_async"]), lambda t: F.transform(F.filter(t["calls"], lambda c: c["qualified_name"] == "asyncio.run"), lambda c: F.struct(t["name"].alias("name"), t["line"].alias("line")))))
    return counted(runs, lambda x: F.lit(True), about("runs a loop by hand:", "name"), _line)


@rule("PY-TEST0010", "TestFunction", languages=PYTHON)
def unowned_async_test_count(discovery: str = "explicit"):
    owned = lambda t: F.exists(t["marks"], lambda m: m.rlike(r"(^|\.)(anyio|asyncio)$")) | any_of(t["fixture_names"], ("anyio_backend",))
    return counted(_collected(), lambda t: F.lit(discovery == "explicit") & t["is_async"] & ~owned(t), about("nothing runs", "name"), _line)


@rule("PY-TEST0011", "TestFunction", policy=Numeric(maximum=2), languages=PYTHON)
def conditional_test_branch_count():
    return measured(F.coalesce(F.array_max(F.transform(_collected(), lambda t: t["owned_conditional_count"])), F.lit(0)), "branches of one test", "branches")


@rule("PY-TEST0012", "TestFunction", policy=Numeric(maximum=10), languages=PYTHON)
def owned_test_statement_count():
    return measured(F.coalesce(F.array_max(F.transform(_collected(), lambda t: t["owned_statement_count"])), F.lit(0)), "statements of one test", "statements")


@rule("PY-TEST0014", "TestFunction", languages=PYTHON)
def finite_range_hypothesis_candidate_count(minimum_cases: int = 10):
    ranges = F.flatten(F.transform(_collected(), lambda t: F.transform(F.filter(t["parametrized_range_sizes"], lambda n: n >= minimum_cases), lambda n: F.struct(t["name"].alias("name"), t["line"].alias("line")))))
    return counted(ranges, lambda x: F.lit(True), about("range that a strategy covers:", "name"), _line)


@rule("PY-TEST0018", "TestFunction", languages=PYTHON)
def module_generated_parametrization_count():
    times = F.flatten(F.transform(_collected(), lambda t: F.array_repeat(F.struct(t["name"].alias("name"), t["line"].alias("line")), t["generated_parametrization_count"].cast("int"))))
    return counted(times, lambda x: F.lit(True), about("cases are generated for", "name"), _line)


def _clusters(facts, key: list, condition, text: str):
    """Clusters of collected tests: sizes come from grouped counts, members stay rows."""
    tests = facts["TestFunction"].select("fact_id", F.explode("tests").alias("t")).where("t.is_collected").select("fact_id", F.col("t.name").alias("name"), F.col("t.line").alias("line"), F.col("t.body_shape").alias("shape"), *[k(F.col("t")).alias(f"k{i}") for i, k in enumerate(key)])
    names = [f"k{i}" for i in range(len(key))]
    sizes = tests.groupBy("fact_id", *names, "shape").count().groupBy("fact_id", *names).agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("shapes"), F.min("shape").alias("least"))
    chosen = sizes.where(condition)
    first = tests.groupBy("fact_id", *names).agg(F.min(F.struct("line", "name")).alias("first"))
    rows = chosen.join(first, ["fact_id", *names]).groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct(F.col("first.line").alias("line"), F.col("first.name").alias("name"), "n"))).alias("found"))
    joined = facts["TestFunction"].select("fact_id", "path", "language", "start_line").join(rows, "fact_id", "left")
    return joined, counted(col("found"), lambda x: F.lit(True), lambda x: say(text, x["name"], ", ", x["n"], " tests"), _line)


def _set(field: str):
    return lambda t: F.to_json(F.array_sort(F.array_distinct(F.coalesce(t[field], F.array().cast("array<string>")))))


@rule("PY-TEST0015", "TestFunction", over_facts=True, languages=PYTHON)
def duplicate_test_intent_cluster_count(facts, minimum_tests: int = 2):
    key = [_set("reachable_targets"), _set("fixture_names"), lambda t: t["body_shape"], lambda t: F.to_json(F.coalesce(t["literal_values"], F.array().cast("array<string>"))), lambda t: F.to_json(F.coalesce(t["assertion_shapes"], F.array().cast("array<string>")))]
    return _clusters(facts, key, (F.col("n") >= minimum_tests) & (F.col("k0") != "[]"), "the same intent: ")


@rule("PY-TEST0016", "TestFunction", over_facts=True, languages=PYTHON)
def concentrated_test_reach_cluster_count(facts, minimum_tests: int = 4):
    return _clusters(facts, [_set("reachable_targets"), _set("fixture_names")], (F.col("n") >= minimum_tests) & (F.col("k0") != "[]") & (F.col("shapes") < F.col("n")), "the same reach: ")


@rule("PY-TEST0019", "TestFunction", over_facts=True, languages=PYTHON)
def production_reach_hotspot_count(facts, minimum_tests: int = 8):
    tests = facts["TestFunction"].select("fact_id", F.explode("tests").alias("t")).where("t.is_collected").select("fact_id", "t.body_shape", F.explode(F.array_distinct("t.reachable_targets")).alias("target"))
    by = tests.groupBy("fact_id", "target", "body_shape").count().groupBy("fact_id", "target").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("shapes"))
    rows = by.where((F.col("n") >= minimum_tests) & (F.col("shapes") * 2 <= F.col("n"))).groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("target", "n"))).alias("found"))
    joined = facts["TestFunction"].select("fact_id", "path", "language", "start_line").join(rows, "fact_id", "left")
    return joined, counted(col("found"), lambda x: F.lit(True), lambda x: say(x["target"], " is reached by ", x["n"], " tests"))
