"""Rules on inheritance links: what a subclass does with the members that it inherits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.plans.rules import counted, flagged, rule, say
from factloom.rules.common import about, any_of, col, filled, last_name

_PLAIN = ("positional_only", "positional_or_keyword")


def _ends(items: Column, *names: str) -> Column:
    return any_of(F.transform(F.coalesce(items, F.array()), last_name), names)


def _pairs() -> Column:
    """Inherited members beside the subclass's declarations of the same name."""
    declared = lambda m: F.get(F.filter("declared", lambda d: d["name"] == m["name"]), 0)
    both = F.transform(F.coalesce("inherited", F.array()), lambda m: F.struct(m["name"].alias("name"), m.alias("base"), declared(m).alias("own")))
    return F.filter(both, lambda p: p["own"].isNotNull())


def _methods() -> Column:
    """Pairs whose two sides are callables, private and initializing ones apart."""
    hidden = lambda p: p["name"].startswith("__") & ~p["name"].endswith("__")
    return F.filter(_pairs(), lambda p: p["base"]["parameters"].isNotNull() & p["own"]["parameters"].isNotNull() & ~hidden(p) & ~p["name"].isin("__init__", "__new__", "__post_init__"))


def _of(member: Column, *kinds: str) -> Column:
    return F.filter(member["parameters"], lambda q: q["kind"].isin(*kinds))


def _has(member: Column, kind: str) -> Column:
    return F.exists(member["parameters"], lambda q: q["kind"] == kind)


def _line(p: Column) -> Column:
    return p["own"]["line"]


@rule("ALL-OVER0001", "Override")
def overriding_method_accepts_different_arguments():
    """Fewer positions, a lost keyword, a new required input, or a lost catch-all."""

    def narrower(p):
        base, own = p["base"], p["own"]
        positions = F.size(_of(own, *_PLAIN)) < F.size(_of(base, *_PLAIN))
        lost_position = positions & ~_has(own, "var_positional")
        names = F.transform(own["parameters"], lambda q: q["name"])
        lost_keyword = F.exists(_of(base, "keyword_only"), lambda q: ~F.array_contains(names, q["name"])) & ~_has(own, "var_keyword")
        extra = F.slice(_of(own, *_PLAIN), F.size(_of(base, *_PLAIN)) + 1, F.greatest(F.size(_of(own, *_PLAIN)) - F.size(_of(base, *_PLAIN)), F.lit(0)))
        base_names = F.transform(base["parameters"], lambda q: q["name"])
        demanded = F.exists(extra, lambda q: ~q["has_default"]) | F.exists(_of(own, "keyword_only"), lambda q: ~q["has_default"] & ~F.array_contains(base_names, q["name"]))
        lost_rest = (_has(base, "var_positional") & ~_has(own, "var_positional")) | (_has(base, "var_keyword") & ~_has(own, "var_keyword"))
        return lost_position | lost_keyword | demanded | lost_rest

    return counted(_methods(), narrower, about("accepts different arguments:", "name"), _line)


def _aligned(p: Column) -> Column:
    own = _of(p["own"], *_PLAIN)
    return F.filter(F.transform(_of(p["base"], *_PLAIN), lambda q, i: F.struct(p["name"].alias("name"), p["own"].alias("own"), q.alias("was"), F.get(own, i).alias("now"))), lambda x: x["now"].isNotNull())


@rule("ALL-OVER0002", "Override")
def overriding_method_renames_a_parameter():
    rows = F.flatten(F.transform(_methods(), _aligned))
    return counted(rows, lambda x: (x["was"]["kind"] == "positional_or_keyword") & (x["was"]["name"] != x["now"]["name"]), lambda x: say(x["name"], " renames ", x["was"]["name"], " to ", x["now"]["name"]), _line)


@rule("ALL-OVER0003", "Override")
def overriding_method_demands_an_argument_the_base_defaulted():
    return counted(_methods(), lambda p: F.exists(_aligned(p), lambda x: (x["was"]["name"] == x["now"]["name"]) & x["was"]["has_default"] & ~x["now"]["has_default"]), about("withdraws a default:", "name"), _line)


@rule("ALL-OVER0004", "Override")
def overriding_method_changes_its_call_protocol():
    kinds = ("staticmethod", "classmethod", "property", "cached_property")
    bound = lambda m: F.array_sort(F.array_intersect(F.transform(F.coalesce(m["decorators"], F.array()), last_name), F.array(*[F.lit(k) for k in kinds])))
    return counted(_methods(), lambda p: (p["base"]["asynchronous"] != p["own"]["asynchronous"]) | (bound(p["base"]) != bound(p["own"])), about("is reached another way:", "name"), _line)


@rule("ALL-OVER0005", "Override")
def abstract_member_left_unimplemented(abstract_bases: tuple = ("ABC", "ABCMeta", "Protocol")):
    concrete = ~_ends(col("base_names"), *abstract_bases) & ~F.exists(F.coalesce("declared", F.array()), lambda d: _ends(d["decorators"], "abstractmethod"))
    own = F.transform(F.coalesce("declared", F.array()), lambda d: d["name"])
    return counted(F.when(concrete, col("inherited")), lambda m: _ends(m["decorators"], "abstractmethod") & ~F.array_contains(own, m["name"]), about("promise not kept:", "name"), lambda m: F.col("start_line"))


@rule("ALL-OVER0006", "Override")
def subclass_initializer_skips_its_base():
    simple = F.element_at(F.split("base", r"\."), -1)
    calls = F.coalesce("initializer_calls", F.array())
    reached = F.exists(calls, lambda c: c.startswith("super") | (c == F.concat(simple, F.lit(".__init__"))))
    return counted(F.when((col("depth") == 1) & ~reached, _pairs()), lambda p: p["name"] == "__init__", about("base is never initialized:", "name"), _line)


@rule("ALL-OVER0007", "Override")
def initializer_called_on_a_stranger():
    """Stated at the link to the first base, as the calls are the subclass's."""
    first = (col("depth") == 1) & (F.get("base_names", F.lit(0)) == F.element_at(F.split("base", r"\."), -1))
    family = F.transform(F.concat(F.coalesce("base_names", F.array()), F.coalesce("ancestor_names", F.array())), last_name)
    calls = F.transform(F.filter(F.coalesce("initializer_calls", F.array()), lambda c: c.endswith(".__init__") & ~c.startswith("super")), lambda c: F.struct(c.alias("call"), last_name(F.regexp_replace(c, r"\.__init__$", "")).alias("owner")))
    return counted(F.when(first, calls), lambda c: ~F.array_contains(family, c["owner"]) & (c["owner"] != "self"), about("initializes a stranger:", "call"))


@rule("ALL-OVER0008", "Override")
def final_method_overridden():
    return counted(_pairs(), lambda p: _ends(p["base"]["decorators"], "final"), about("sealed member is overridden:", "name"), _line)


@rule("ALL-OVER0009", "Override", kind="boolean")
def final_class_subclassed():
    return flagged((col("depth") == 1) & _ends(col("base_decorators"), "final"), say("sealed class has a subclass: ", col("base")))


@rule("ALL-OVER0010", "Override")
def inherited_attribute_hides_a_method():
    return counted(_pairs(), lambda p: p["base"]["parameters"].isNull() & p["own"]["parameters"].isNotNull() & ~filled(p["own"]["decorators"]), about("data hides a method:", "name"), _line)
