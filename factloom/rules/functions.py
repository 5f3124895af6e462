"""Rules on functions and their parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.plans.policy import Numeric
from factloom.plans.rules import counted, flagged, measured, rule, say
from factloom.rules.common import about, any_of, col, filled, given, one_of

_EXEMPT = ("is_abstract", "is_protocol_member", "is_overload", "is_property", "is_framework_hook", "is_polymorphic", "is_protocol_name", "is_recursive", "is_first_class_reference")


def _is(name: str):
    return F.coalesce(col(name), F.lit(False))


def _plain():
    """No decorator, and none of the reasons to be small."""
    good = ~filled(col("decorators"))
    for name in _EXEMPT:
        good = good & ~_is(name)
    return good


def _size():
    return F.coalesce(col("implementation_lines"), F.lit(0))


@rule("ALL-FUNC0001", "Function", policy=Numeric(maximum=10))
def function_statement_count():
    return measured(F.when(~_is("is_test"), col("direct_statement_count")), say("statements of ", col("name")), "statements")


@rule("ALL-FUNC0002", "Function", kind="boolean", fix="review")
def single_use_trivial_helper(maximum_lines: int = 1, ignore_names: tuple = ()):
    small = (col("direct_statement_count") == 1) & (_size() <= maximum_lines) & ~_is("is_pass_body") & ~_is("is_raise_body")
    return flagged(_plain() & (col("scope") == "module") & (col("visibility") != "public") & small & (col("reference_count") == 1) & ~one_of(col("name"), ignore_names), say("helper used once: ", col("name")))


@rule("ALL-FUNC0003", "Function", kind="boolean", fix="review")
def class_owned_module_helper(minimum_lines: int = 2, ignore_names: tuple = ()):
    private = col("name").startswith("_") & ~col("name").startswith("__")
    return flagged(_plain() & (col("scope") == "module") & private & (_size() >= minimum_lines) & given(col("sole_reference_owner_class")) & ~one_of(col("name"), ignore_names), say(col("name"), " belongs to ", col("sole_reference_owner_class")))


@rule("ALL-FUNC0004", "Function", kind="boolean", fix="review")
def unnecessary_one_line_concrete_function(minimum_references: int = 2):
    return flagged(_plain() & (col("scope") == "nested") & (_size() == 1) & (col("reference_count") < minimum_references) & ~_is("is_pass_body") & ~_is("is_raise_body"), say("nested function without reuse: ", col("name")))


@rule("ALL-FUNC0005", "Function", kind="boolean", fix="review")
def transparent_unary_wrapper():
    required = F.size(F.filter("parameters", lambda p: ~p["is_receiver"]))
    return flagged(~_is("is_async") & (col("visibility") == "public") & (required == 1) & (col("direct_statement_count") == 1) & _is("returns_single_call") & _is("forwards_only_parameter_unchanged") & ~_is("is_abstract") & ~_is("is_overload"), say("only forwards its argument: ", col("name")))


@rule("ALL-FUNC0006", "Function", kind="boolean")
def shallow_callable(minimum_references: int = 2, minimum_operations: int = 1, ignore_names: tuple = ()):
    return flagged(_plain() & (col("scope") == "module") & (col("visibility") == "public") & ~given(col("docstring")) & (_size() == 1) & (col("behavior_operation_count") < minimum_operations) & (col("reference_count") < minimum_references) & ~one_of(col("name"), ignore_names), say("no behaviour or reuse: ", col("name")))


@rule("ALL-FUNC0007", "Function", policy=Numeric(maximum=4))
def function_conditional_count():
    return measured(col("conditional_count"), say("branches of ", col("name")), "branches")


@rule("ALL-FUNC0008", "Function", policy=Numeric(maximum=8))
def cognitive_complexity(nesting_penalty: int = 1):
    nests = lambda c: c["kind"].isin("conditional", "loop", "switch", "catch")
    score = F.aggregate("control_increments", F.lit(0).cast("bigint"), lambda a, c: a + 1 + F.when(nests(c), nesting_penalty * c["nesting_depth"]).otherwise(F.lit(0)))
    return measured(score, say("effort to follow ", col("name")), "points")


@rule("ALL-FUNC0009", "Function", policy=Numeric(maximum=2))
def nesting_depth():
    return measured(F.coalesce(F.array_max(F.transform("control_increments", lambda c: c["nesting_depth"])), F.lit(0)), say("nesting of ", col("name")), "levels")


@rule("ALL-FUNC0010", "Function", policy=Numeric(maximum=5))
def required_parameter_count():
    needed = F.filter("parameters", lambda p: ~F.coalesce(p["has_default"], F.lit(False)) & ~F.coalesce(p["is_receiver"], F.lit(False)))
    return measured(F.size(needed), say("inputs that callers of ", col("name"), " must supply"), "parameters")


@rule("ALL-PARA0001", "Function")
def swappable_parameter_pair():
    taken = F.filter("parameters", lambda p: ~F.coalesce(p["is_receiver"], F.lit(False)) & ~F.coalesce(p["is_keyword_only"], F.lit(False)))
    pairs = F.transform(F.slice(taken, F.lit(1), F.greatest(F.size(taken) - 1, F.lit(0))), lambda p, i: F.struct(p.alias("one"), F.get(taken, i + 1).alias("two")))
    return counted(pairs, lambda x: given(x["one"]["type_name"]) & (x["one"]["type_name"] == x["two"]["type_name"]), lambda x: say("callers can swap ", x["one"]["name"], " and ", x["two"]["name"]))


@rule("ALL-PARA0003", "Function")
def positional_boolean_parameter():
    return counted(col("parameters"), lambda p: p["has_boolean_annotation"] & ~F.coalesce(p["is_keyword_only"], F.lit(False)) & ~F.coalesce(p["is_receiver"], F.lit(False)) & ~F.coalesce(p["is_required_by_external_contract"], F.lit(False)), about("passed by position:", "name"))


@rule("ALL-PARA0004", "Function", policy=Numeric(maximum=1))
def boolean_parameter_count():
    flags = F.filter("parameters", lambda p: (F.coalesce(p["has_boolean_annotation"], F.lit(False)) | F.coalesce(p["has_boolean_default"], F.lit(False))) & ~F.coalesce(p["is_receiver"], F.lit(False)))
    return measured(F.size(flags), say("flags of ", col("name")), "parameters")


@rule("ALL-PARA0002", "Parameter")
def configuration_object_parameter(minimum_reads: int = 2, configuration_markers: tuple = ("config", "settings", "options", "configuration")):
    marked = lambda p: F.lower(F.concat_ws(" ", p["name"], p["annotation"])).rlike("|".join(configuration_markers))
    only_reads = lambda p: F.forall(p["operations"], lambda o: o == "attribute_read")
    return counted(col("parameters"), lambda p: p["all_uses_known"] & marked(p) & only_reads(p) & (F.size(F.array_distinct(p["attribute_reads"])) >= minimum_reads), about("only attributes are read of", "name"), lambda p: p["span"]["start_line"])


@rule("PY-COLL0001", "Parameter", kind="boolean", languages=("python",))
def concrete_collection_parameter(mutating: tuple = ("append", "extend", "insert", "pop", "remove", "clear", "sort", "reverse", "setitem", "delitem", "add", "discard", "update", "setdefault")):
    concrete = lambda p: p["annotation"].rlike(r"^(list|dict|set|tuple)\b")
    return flagged(F.exists("parameters", lambda p: concrete(p) & p["all_uses_known"] & ~p["is_return_value"] & filled(p["operations"]) & ~any_of(p["operations"], mutating)), "an abstract collection would do")


@rule("PY-FUNC0001", "Function", languages=("python",))
def unjustified_positional_only_parameter_count(allowed_names: tuple = ()):
    contract = _is("is_protocol_name") | _is("is_protocol_member") | any_of(col("decorators"), ("override",)) | F.exists("parameters", lambda p: p["name"].startswith("**"))
    return counted(F.when(~contract, col("parameters")), lambda p: p["is_positional_only"] & ~F.coalesce(p["is_receiver"], F.lit(False)) & ~one_of(p["name"], allowed_names), about("positional without a reason:", "name"))


@rule("PY-ASYN0002", "Function", kind="boolean", languages=("python",))
def task_group_candidate():
    return flagged(_is("is_async") & (col("created_task_count") > 0) & _is("gather_consumes_created_tasks") & ~_is("gather_returns_exceptions") & ~_is("has_task_group"), say("tasks gathered by hand in ", col("name")))


@rule("PY-CACH0001", "Function", kind="boolean", languages=("python",))
def instance_independent_cached_property():
    return flagged((col("cache_decorator") == "cached_property") & (col("direct_statement_count") == 1) & ~_is("reads_receiver"), say("cache without the instance: ", col("name")))


@rule("PY-CACH0002", "Function", kind="boolean", languages=("python",))
def cached_instance_method():
    bound = F.exists("parameters", lambda p: p["is_receiver"]) & ~any_of(col("decorators"), ("staticmethod", "classmethod"))
    return flagged((col("scope") == "method") & col("cache_decorator").isin("cache", "lru_cache") & bound, say("cache keeps instances: ", col("name")))


@rule("PY-DEAD0001", "Function", kind="boolean", fix="review", languages=("python",))
def unreferenced_private_function():
    return flagged((col("scope") == "module") & col("name").startswith("_") & ~col("name").startswith("__") & ~filled(col("decorators")) & (col("reference_count") == 0), say("nothing uses ", col("name")))


@rule("PY-DOCU0001", "Function", kind="boolean", languages=("python",))
def compact_house_docstring(maximum_summary: int = 99):
    first = F.get(F.split(F.trim("docstring"), "\n"), 0)
    good = (F.length(first) <= maximum_summary) & first.rlike("[.!?]$")
    return flagged(given(col("docstring")) & ~F.coalesce(good, F.lit(False)), say("summary of ", col("name"), " is no short sentence"))


@rule("PY-DOCU0002", "Function", kind="boolean", languages=("python",))
def tensor_docstring_semantics():
    return flagged((col("visibility") == "public") & filled(col("recognized_tensor_roles")) & ~(_is("has_tensor_shape_semantics") & _is("has_tensor_dtype_semantics")), say("shape or type of tensors is left open: ", col("name")))


@rule("PY-PYDA0003", "Function", kind="boolean", languages=("python",))
def imperative_model_input_validation():
    return flagged(_is("is_model_method") & ~_is("is_pydantic_validator") & _is("checks_raw_input_type") & _is("raises_validation_exception") & _is("constructs_owner_model"), say("validates by hand: ", col("name")))
