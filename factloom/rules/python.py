"""Rules on Python imports, collections, try blocks, queries and annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.plans.policy import Numeric
from factloom.plans.rules import counted, flagged, measured, rule, say
from factloom.rules.common import about, any_of, col, given, last_name

PYTHON = ("python",)


def _is(name: str):
    return F.coalesce(col(name), F.lit(False))


@rule("PY-IMPO0001", "ImportBinding", kind="boolean", fix="safe", languages=PYTHON)
def internal_relative_import():
    """The own package is imported by its absolute name."""
    return flagged(_is("is_project_owned") & ~_is("is_relative") & (F.split("module", r"\.")[0] == F.split("importer_module", r"\.")[0]), say("absolute import of the own package: ", col("module")))


@rule("PY-IMPO0002", "ImportBinding", kind="boolean", languages=PYTHON)
def project_private_import():
    return flagged(_is("is_project_owned") & (_is("has_private_module_component") | _is("is_private_member")), say("crosses a private boundary: ", col("module")))


@rule("PY-IMPO0003", "ImportBinding", kind="boolean", fix="review", languages=PYTHON)
def unused_import():
    used = (F.coalesce(col("reference_count"), F.lit(0)) > 0) | _is("has_qualifying_use") | _is("is_reexported") | _is("has_documented_side_effect") | _is("is_wildcard")
    return flagged(~used & (F.coalesce(col("module"), F.lit("")) != "__future__"), say("nothing reads ", col("name")))


@rule("PY-IMPO0004", "ImportBinding", kind="boolean", languages=PYTHON)
def relative_import_beyond_package():
    depth = F.size(F.split("importer_module", r"\.")) - F.when(F.col("path").endswith("__init__.py"), 0).otherwise(1)
    return flagged(_is("is_relative") & (col("relative_level") > depth), say("climbs out of its package: ", col("module")))


@rule("PY-IMPO0005", "ImportBinding", policy=Numeric(maximum=3), fix="safe", languages=PYTHON)
def import_module_depth():
    names = F.filter(F.split(F.coalesce("module", F.lit("")), r"\."), lambda x: x != "")
    return measured(F.size(names), say("names in the import of ", col("module")), "names")


@rule("PY-CONS0002", "ImportBinding", kind="boolean", languages=PYTHON)
def cross_module_project_constant_import():
    constant = col("imported_name").rlike(r"^_?[A-Z][A-Z0-9_]*$")
    return flagged(_is("is_project_owned") & F.coalesce(constant, F.lit(False)), say("constant from another module: ", col("imported_name")))


@rule("PY-TEST0001", "ImportBinding", kind="boolean", languages=PYTHON)
def conftest_import(allowed_modules: tuple = ()):
    parts = F.split(F.coalesce("module", F.lit("")), r"\.")
    names = (last_name(F.coalesce(col("module"), F.lit(""))) == "conftest") | F.array_contains(parts, "conftest") | F.coalesce(col("imported_name") == "conftest", F.lit(False))
    return flagged(names & ~(col("importer_module").isin(*allowed_modules) if allowed_modules else F.lit(False)), "a conftest is imported by name")


@rule("PY-TYPE0001", "ImportBinding", kind="boolean", fix="review", languages=PYTHON)
def future_annotations_import(minimum_minor: int = 14):
    return flagged(F.lit(minimum_minor >= 14) & (col("module") == "__future__") & (col("imported_name") == "annotations"), "annotations are deferred anyway")


@rule("PY-COLL0002", "Collection", languages=PYTHON)
def literal_pair_sequence_mapping_candidate():
    return counted(col("pair_sequences"), lambda p: (p["pair_count"] >= 2) & p["keys_are_unique_literals"] & p["has_single_assignment"] & p["all_reads_are_lookup_loops"], about("pairs that are a mapping"))


@rule("PY-COLL0003", "Collection", languages=PYTHON)
def local_collection_representation_candidate(sequence_preference: str = "list", prefer_membership_set: bool = True):
    plain = lambda c: (c["value_count"] >= 2) & c["has_homogeneous_literals"]
    sets = lambda c: F.lit(prefer_membership_set) & c["all_reads_are_membership"] & c["values_are_unique"]
    return counted(col("local_collections"), lambda c: plain(c) & (sets(c) | (c["all_reads_are_iteration"] & (c["kind"] != sequence_preference))), about("another collection fits its use:", "name"))


@rule("PY-COMP0001", "Comprehension", policy=Numeric(maximum=2), languages=PYTHON)
def comprehension_loop_count():
    return measured(F.coalesce(F.array_max("loop_counts"), F.lit(0)), "loops of one comprehension", "loops")


@rule("PY-COMP0002", "Comprehension", fix="safe", languages=PYTHON)
def manual_set_comprehension():
    return counted(col("set_loop_candidates"), lambda s: s["has_unshadowed_set_initialization"] & s["loop_is_synchronous"] & s["only_effect_is_add"] & (s["conditional_count"] <= 1) & ~s["has_else"], about("loop that is a set:", "name"))


def _line(x):
    return x["line"]


@rule("PY-EXCE0001", "TryBlock", fix="safe", languages=PYTHON)
def broad_try_literal_setup():
    return counted(col("regions"), lambda r: (r["leading_literal_assignment_count"] > 0) & r["has_following_raising_operation"] & ~r["is_exception_group"], about("setup inside a try"), _line)


@rule("PY-EXCE0002", "TryBlock", policy=Numeric(maximum=1), languages=PYTHON)
def bounded_exception_region():
    return measured(F.coalesce(F.array_max(F.flatten(F.transform("regions", lambda r: r["clause_statement_counts"]))), F.lit(0)), "statements of one clause", "statements")


@rule("PY-EXCE0004", "TryBlock", fix="safe", languages=PYTHON)
def nullable_exception_return_suppression():
    one = lambda r: F.get(r["handlers"], 0)
    return counted(col("regions"), lambda r: r["protected_is_single_value_return"] & (F.size(r["handlers"]) == 1) & given(one(r)["caught"]) & ~one(r)["caught_is_tuple"] & one(r)["returns_none"] & ~r["has_else"] & ~r["has_finally"], about("suppress says the same"), _line)


def _operations(where, text: str):
    return counted(col("operations"), where, about(text, "kind"), lambda o: o["node"]["start_line"])


@rule("PY-SQLA0001", "Query", languages=PYTHON)
def async_session_expiration_policy():
    return _operations(lambda o: (o["kind"] == "async_sessionmaker") & F.coalesce(o["expire_on_commit"], F.lit(True)) & ~o["has_unknown_keywords"], "sessions expire:")


@rule("PY-SQLA0002", "Query", languages=PYTHON)
def session_commit_inside_loop():
    return _operations(lambda o: (o["kind"] == "session_commit") & o["is_inside_loop"], "commit in a loop:")


@rule("PY-SQLA0003", "Query", fix="safe", languages=PYTHON)
def sqlmodel_execute_scalars_api():
    return _operations(lambda o: (o["kind"] == "execute_scalars") & (o["framework"] == "sqlmodel") & (o["selected_expression_count"] == 1) & ~o["has_execution_options"], "exec says the same:")


@rule("PY-SQLA0004", "Query", fix="safe", languages=PYTHON)
def sqlmodel_redundant_scalars():
    return _operations(lambda o: (o["kind"] == "exec_scalars") & (o["framework"] == "sqlmodel") & (o["selected_expression_count"] == 1), "scalars twice:")


@rule("PY-SQLA0005", "Query", languages=PYTHON)
def sqlmodel_primary_key_get():
    return _operations(lambda o: (o["kind"] == "primary_key_first") & (o["framework"] == "sqlmodel") & o["has_primary_key_equality"] & ~o["has_execution_options"], "get says the same:")


@rule("PY-TYPE0002", "TypeAnnotation", languages=PYTHON)
def nullable_boolean_annotation():
    return counted(col("annotations"), lambda a: F.array_sort(F.array_distinct(a["union_members"])) == F.array(F.lit("None"), F.lit("bool")), about("Boolean with a third state:", "role"), lambda a: a["node"]["start_line"])


@rule("PY-TYPE0004", "TypeAnnotation", languages=PYTHON)
def prohibited_annotation(prohibited: tuple = ("Any", "object")):
    return counted(col("annotations"), lambda a: any_of(F.transform(a["resolved_names"], last_name), prohibited) & ~F.coalesce(a["is_external_boundary"], F.lit(False)), about("universal type:", "role"), lambda a: a["node"]["start_line"])


@rule("PY-TYPE0007", "TypeAnnotation", over_facts=True, languages=PYTHON)
def repeated_annotated_constraint(facts, minimum_repetitions: int = 3, minimum_files: int = 2, preferred_modules: tuple = ("typings.py",)):
    """Recipes are counted by file first, so that a common one is a row for each file in the shuffle."""
    rows = facts["TypeAnnotation"].select("fact_id", "path", F.explode("annotations").alias("a")).where(given(F.col("a.constraint_recipe")) & ~F.col("a.is_field_specific_metadata") & (F.col("a.role") != "alias"))
    rows = rows.where(~F.element_at(F.split("path", "/"), -1).isin(*preferred_modules))
    by_file = rows.groupBy(F.col("a.constraint_recipe").alias("recipe"), "path").count()
    common = by_file.groupBy("recipe").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("files")).where((F.col("n") >= minimum_repetitions) & (F.col("files") >= minimum_files))
    found = rows.select("fact_id", F.col("a.constraint_recipe").alias("recipe"), F.col("a.node.start_line").alias("line")).join(common, "recipe").groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("line", "recipe"))).alias("found"))
    joined = facts["TypeAnnotation"].select("fact_id", "path", "language", "start_line").join(found, "fact_id", "left")
    return joined, counted(col("found"), lambda x: F.lit(True), about("constraint to name:", "recipe"), _line)
