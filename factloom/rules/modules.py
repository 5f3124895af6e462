"""Rules on modules, directories, routes, reach, coupling, literals, clones, history and prose."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.numbers import percentage
from factloom.plans.policy import Numeric
from factloom.plans.rules import counted, flagged, gauged, measured, rule, say
from factloom.rules.common import about, any_of, col, filled, given, last_name, named, one_of


def _words(path, separator: str):
    return F.filter(F.split(path, separator), lambda x: x != "")


@rule("ALL-MODU0001", "Module", policy=Numeric(maximum=500))
def module_line_count():
    return measured(col("physical_line_count"), "physical lines of the module", "lines")


@rule("ALL-MODU0002", "Module", policy=Numeric(maximum=12))
def module_member_count():
    return measured(F.when(~F.coalesce("is_test", F.lit(False)), col("class_count") + col("function_count")), "classes and functions of the module")


@rule("ALL-MODU0003", "Module", kind="boolean")
def module_inception():
    parts = _words(col("path"), "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return flagged(F.coalesce(F.get(parts, F.size(parts) - 2) == stem, F.lit(False)), say("the module repeats the name of its folder: ", stem))


@rule("ALL-MODU0004", "Module")
def non_ascii_source_path():
    return counted(F.transform(_words(col("path"), "/"), lambda p: F.struct(p.alias("part"))), lambda x: x["part"].rlike(r"[^\x00-\x7f]"), about("not ASCII:", "part"))


@rule("ALL-MODU0005", "Module", policy=Numeric(maximum=1))
def module_class_count():
    return measured(col("class_count"), "classes at module scope")


@rule("ALL-MODU0006", "Module", policy=Numeric(maximum=200))
def module_statement_count():
    return measured(col("statement_count"), "statements of the module", "statements")


@rule("ALL-TEST0003", "Module", policy=Numeric(maximum=20))
def test_module_member_count():
    return measured(F.when(F.col("is_test"), col("class_count") + col("function_count")), "classes and functions of the test module")


@rule("PY-MODU0001", "Module", kind="boolean", languages=("python",))
def non_init_reexport_module():
    return flagged(col("has_only_imports_and_all") & ~col("is_package_initializer"), "the module only repeats imports")


@rule("PY-MODU0002", "Module", kind="boolean", languages=("python",))
def empty_package_initializer():
    return flagged(col("is_package_initializer") & ~col("is_test") & (col("executable_statement_count") == 0), "the initializer states nothing")


@rule("PY-MODU0003", "Module", fix="review", languages=("python",))
def initializer_declaration():
    return counted(F.when(col("is_package_initializer"), col("members")), lambda m: ~m["name"].isin("__getattr__", "__dir__"), about("declaration in an initializer:", "kind", "name"), lambda m: m["line"])


@rule("PY-MODU0004", "Module", kind="boolean", fix="review", languages=("python",))
def explicit_all_only_in_initializer():
    return flagged(col("declares_all") & ~col("is_package_initializer"), "an ordinary module states __all__")


@rule("PY-CONS0003", "Module", languages=("python",))
def dependency_safe_constant_order():
    return counted(col("constant_placements"), lambda x: x["intervening_statement_count"] > 0, about("constant stands below other statements:", "name"))


@rule("ALL-FILE0001", "Directory", kind="boolean", fix="safe")
def empty_directories():
    return flagged(col("entry_count") == 0, "the folder is empty")


@rule("ALL-FILE0002", "Directory", policy=Numeric(maximum=5))
def package_depth(framework_roots: tuple = ()):
    parts = F.size(_words(col("path"), "/")).cast("bigint")
    depth = F.coalesce(col("source_depth"), parts)
    for root in sorted(framework_roots, key=len):
        depth = F.when(col("path").startswith(root.rstrip("/") + "/"), parts - len([p for p in root.split("/") if p])).otherwise(depth)
    return measured(depth, "levels below the source root", "levels")


@rule("ALL-FILE0003", "Directory", policy=Numeric(maximum=3))
def directory_module_count(allow_definition_catalogs: bool = True):
    return measured(F.when(F.lit(not allow_definition_catalogs) | ~F.coalesce("is_definition_catalog", F.lit(False)), col("direct_module_count")), "modules directly in the folder", "modules")


@rule("ALL-FILE0004", "Directory", kind="boolean")
def directory_pathway():
    return flagged((col("direct_directory_count") == 1) & (col("direct_file_count") == 0), say("the folder only leads to ", col("only_child_directory")))


def _route(r):
    return F.concat(F.lower(r["method"]), F.lit(" "), r["path"])


@rule("ALL-ROUT0001", "Route")
def duplicate_route_declaration():
    """Counts each route that is declared again, at its first declaration."""
    keys = F.transform("routes", _route)
    chosen = F.filter(F.array_distinct(keys), lambda k: F.size(F.filter(keys, lambda o: o == k)) > 1)
    firsts = F.transform(chosen, lambda k: F.struct(k.alias("key"), F.size(F.filter(keys, lambda o: o == k)).alias("n"), F.get(F.filter("routes", lambda r: _route(r) == k), 0).alias("first")))
    return counted(firsts, lambda x: F.lit(True), lambda x: say(x["key"], " is declared ", x["n"], " times"), lambda x: x["first"]["line"], lambda x: x["first"]["declared_in"])


@rule("ALL-ROUT0002", "Route")
def unreached_declared_route():
    elsewhere = lambda r: F.exists(r["references"], lambda x: x["path"] != r["declared_in"])
    some = F.exists("routes", elsewhere)
    return counted(col("routes"), lambda r: some & ~elsewhere(r) & ~r["is_prefix_composed"], lambda r: say("no client names ", _route(r)), lambda r: r["line"], lambda r: r["declared_in"])


@rule("ALL-ROUT0003", "Route")
def inconsistent_route_path_style():
    """Words of path segments are parted by the separator that most segments use; a tie goes to the hyphen."""
    segments = F.flatten(F.transform("routes", lambda r: F.transform(F.filter(_words(r["path"], "/"), lambda s: ~s.rlike(r"[{}:<>*]")), lambda s: F.struct(s.alias("text"), r["declared_in"].alias("file"), r["line"].alias("line")))))
    uses = lambda mark: F.size(F.filter(segments, lambda s: s["text"].contains(mark)))
    wrong = F.when(uses("_") > uses("-"), "-").otherwise("_")
    return counted(segments, lambda s: (uses("_") > 0) & (uses("-") > 0) & F.contains(s["text"], wrong), about("segment against the convention:", "text"), lambda s: s["line"], lambda s: s["file"])


@rule("ALL-REAC0001", "SymbolReach")
def unreferenced_public_declaration():
    return counted(F.when(~F.coalesce("is_test_module", F.lit(False)), col("declarations")), lambda d: (d["visibility"] == "public") & d["is_module_scope"] & ~d["is_decorated"] & (d["own_file_references"] + d["other_file_references"] == 0) & (d["unresolved_name_references"] == 0), about("nothing reaches", "qualname"), lambda d: d["span"]["start_line"])


@rule("ALL-REAC0002", "SymbolReach")
def file_local_public_declaration():
    return counted(F.when(~F.coalesce("is_test_module", F.lit(False)), col("declarations")), lambda d: (d["visibility"] == "public") & d["is_module_scope"] & (d["own_file_references"] > 0) & (d["other_file_references"] == 0) & (d["unresolved_name_references"] == 0), about("only its own file uses", "qualname"), lambda d: d["span"]["start_line"])


@rule("ALL-REAC0003", "SymbolReach")
def repository_wide_declaration(maximum_packages: int = 3):
    return counted(col("declarations"), lambda d: d["referencing_packages"] > maximum_packages, about("reached from many packages:", "qualname"), lambda d: d["span"]["start_line"])


@rule("PY-NAMI0002", "SymbolReach", languages=("python",))
def attribute_visibility():
    return counted(col("declarations"), lambda d: (d["kind"] == "method") & (d["visibility"] == "public") & ~d["owner_has_inheritance"] & ~d["is_decorated"] & (d["owner_references"] > 0) & (d["non_owner_references"] == 0) & (d["unresolved_name_references"] == 0), about("only its own class calls", "qualname"), lambda d: d["span"]["start_line"])


@rule("ALL-CLAS0004", "SymbolReach", policy=Numeric(maximum=7))
def declared_field_count():
    owners = F.transform(F.filter("declarations", lambda d: d["kind"].isin("attribute", "variable") & d["qualname"].contains(".")), lambda d: F.regexp_replace(d["qualname"], r"\.[^.]*$", ""))
    largest = F.array_max(F.transform(F.array_distinct(owners), lambda o: F.size(F.filter(owners, lambda x: x == o))))
    return measured(F.coalesce(largest, F.lit(0)), "fields of the widest type", "fields")


def _instability(x):
    return F.try_divide(x["efferent_count"].cast("double"), (x["afferent_count"] + x["efferent_count"]).cast("double"))


@rule("ALL-ARCH0003", "ModuleCoupling")
def dependency_on_a_less_stable_module(tolerance: float = 0.0):
    own = F.try_divide(col("efferent_count").cast("double"), (col("afferent_count") + col("efferent_count")).cast("double"))
    return counted(col("dependencies"), lambda d: _instability(d) > own + tolerance, about("depends on a less stable module:", "module"))


@rule("ALL-ARCH0005", "ModuleCoupling", kind="boolean")
def abstraction_nothing_depends_on(minimum_abstractness: float = 0.5):
    abstract = F.try_divide(col("abstract_declaration_count").cast("double"), col("declaration_count").cast("double"))
    return flagged(F.coalesce(abstract >= minimum_abstractness, F.lit(False)) & (col("afferent_count") == 0), say("no module imports ", col("module")))


@rule("ALL-ARCH0002", "DependencyComponent")
def import_cycles():
    """Groups are edges that stay in one component; self-imports count where they stand."""
    inside = F.filter("import_edges", lambda e: e["source_component"] == e["target_component"])
    groups = F.array_sort(F.array_distinct(F.transform(inside, lambda e: e["source_component"])))
    rows = F.transform(groups, lambda g: F.get(F.array_sort(F.filter(inside, lambda e: e["source_component"] == g)), 0))
    return counted(rows, lambda e: F.lit(True), about("cycle through", "source", "target"), lambda e: e["line"], lambda e: e["path"])


@rule("ALL-BIND0001", "Interop", kind="boolean")
def unreached_cross_language_artifact():
    return flagged(~F.exists("references", lambda r: r["language"] != col("declared_language")), say("nothing outside its language names ", col("name")))


@rule("ALL-BIND0002", "Interop", policy=Numeric(maximum=1))
def cross_language_boundary_width(manifests: tuple = ("toml", "json", "yaml")):
    others = F.array_distinct(F.transform(F.filter("references", lambda r: (r["language"] != col("declared_language")) & ~r["language"].isin(*manifests)), lambda r: r["language"]))
    return measured(F.size(others), say("languages that name ", col("name")), "languages")


@rule("ALL-BRAN0001", "Branch")
def value_dispatch_candidate(minimum_arms: int = 3):
    def lookup(c):
        literals = F.transform(c["arms"], lambda a: a["literal"])
        return given(c["subject"]) & (F.size(c["arms"]) >= minimum_arms) & F.forall(c["arms"], lambda a: (a["comparison"] == "==") & given(a["literal"]) & a["reads_subject_only"]) & (F.size(F.array_distinct(literals)) == F.size(literals))

    return counted(col("chains"), lookup, about("a lookup written as branches over", "subject"), lambda c: c["node"]["start_line"])


@rule("ALL-DUPL0001", "MethodGroup")
def repeated_class_method_count():
    return counted(col("groups"), lambda g: (F.size(g["locations"]) > 1) & given(g["direct_base"]), about("siblings repeat a method of", "direct_base"))


@rule("ALL-DUPL0002", "LiteralGroup")
def repeated_semantic_string_literal(minimum_occurrences: int = 3, minimum_files: int = 2, minimum_length: int = 12):
    return counted(col("string_groups"), lambda g: given(g["role"]) & ~g["is_excluded_vocabulary"] & (g["occurrence_count"] >= minimum_occurrences) & (F.size(F.array_distinct(g["files"])) >= minimum_files) & (F.length(g["value"]) >= minimum_length), about("repeated in one role:", "value"))


@rule("ALL-DUPL0005", "LiteralGroup")
def module_repeated_string_literal(minimum_occurrences: int = 4, minimum_length: int = 8):
    """Occurrences of a value add up over its roles."""
    groups = F.filter("string_groups", lambda g: ~g["is_excluded_vocabulary"] & ~g["is_callee_vocabulary"])
    values = F.array_distinct(F.transform(groups, lambda g: g["value"]))
    sums = F.transform(values, lambda v: F.struct(v.alias("value"), F.aggregate(F.filter(groups, lambda g: g["value"] == v), F.lit(0).cast("bigint"), lambda a, g: a + g["occurrence_count"]).alias("n")))
    return counted(sums, lambda x: (x["n"] >= minimum_occurrences) & (F.length(x["value"]) >= minimum_length), about("written over and over:", "value"))


@rule("PY-ENUM0002", "LiteralGroup", kind="boolean", languages=("python",))
def parallel_enum_metadata():
    return flagged(F.exists("enum_metadata_maps", lambda m: (F.size(m["keys"]) >= 2) & m["all_keys_resolve_to_enum"] & (F.size(m["values"]) == F.size(m["keys"]))), "a dictionary mirrors an enum")


def _lines(f):
    return f["end_line"] - f["start_line"] + 1


@rule("ALL-DUPL0003", "CloneGroup", policy=Numeric())
def pasted_block_copy_count(minimum_token_length: int = 60, minimum_line_count: int = 4):
    long = F.filter("fragments", lambda f: _lines(f) >= minimum_line_count)
    return counted(F.when(col("token_length") >= minimum_token_length, F.slice(long, F.lit(2), F.greatest(F.size(long) - 1, F.lit(0)))), lambda f: F.lit(True), about("copy of a block in", "path"), lambda f: f["start_line"], lambda f: f["path"])


@rule("ALL-DUPL0004", "CloneGroup", kind="float", policy=Numeric(maximum=3))
def duplicated_repository_share(minimum_line_count: int = 4):
    long = F.filter("fragments", lambda f: _lines(f) >= minimum_line_count)
    copies = F.slice(long, F.lit(2), F.greatest(F.size(long) - 1, F.lit(0)))
    lines = F.aggregate(F.transform(copies, _lines), F.lit(0).cast("bigint"), lambda a, n: a + n)
    return gauged(percentage(lines, col("repository_line_count")), say("copied lines: ", lines))


def _commits(f):
    return f["author_count"] + f["additional_commit_count"]


@rule("ALL-HIST0001", "RepositoryHistory", policy=Numeric())
def large_file_the_team_keeps_reopening(minimum_lines: int = 400, minimum_commits: int = 2, busy_share: float = 0.5, stale_days: int = 180):
    busiest = F.array_max(F.transform("files", _commits))
    return counted(col("files"), lambda f: ~F.coalesce(f["is_test"], F.lit(False)) & (f["line_count"] > minimum_lines) & (_commits(f) >= minimum_commits) & (_commits(f) >= busy_share * busiest) & (f["days_since_last_change"] <= stale_days), lambda f: say(f["path"], " keeps being reopened: ", _commits(f), " commits"), None, lambda f: f["path"])


@rule("ALL-HIST0002", "RepositoryHistory")
def file_too_many_hands_have_touched(minimum_authors: int = 4, minimum_commits: int = 5):
    return counted(col("files"), lambda f: (f["author_count"] >= minimum_authors) & (_commits(f) >= minimum_commits), lambda f: say(f["path"], " has ", f["author_count"], " authors"), None, lambda f: f["path"])


@rule("ALL-HIST0003", "RepositoryHistory", over_facts=True)
def coupled_files_that_never_name_each_other(facts, minimum_shared_commits: int = 5, minimum_confidence: float = 0.5, maximum_commit_files: int = 30):
    """Pairs meet in a join of changes with themselves, which the width of a change bounds."""
    from factloom.operators.history import co_change, uncoupled

    history = facts["RepositoryHistory"]
    changes = history.select("fact_id", F.posexplode("changes").alias("change", "c")).select("fact_id", "change", F.explode("c.paths").alias("path"))
    pairs = co_change(changes, ["fact_id", "change"], "path", maximum_commit_files, within=["fact_id"])
    imports = history.select("fact_id", F.explode("files").alias("f")).select("fact_id", F.col("f.path").alias("path"), F.explode("f.imports").alias("imported"))
    found = uncoupled(pairs.where((F.col("shared") >= minimum_shared_commits) & (F.col("shared") >= minimum_confidence * F.least("left_count", "right_count"))), imports, ["fact_id"])
    rows = found.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("left", "right", "shared"))).alias("pairs"))
    joined = history.select("fact_id", "path", "language", "start_line").join(rows, "fact_id", "left")
    return joined, counted(col("pairs"), lambda p: F.lit(True), lambda p: say(p["left"], " and ", p["right"], " changed together ", p["shared"], " times"), None, lambda p: p["left"])


@rule("ALL-WRIT0003", "ProseSegment", kind="float", policy=Numeric(maximum=90))
def sentence_length_uniformity(minimum_sentences: int = 5, minimum_words: int = 3):
    return _uniformity("sentence_word_counts", minimum_sentences, minimum_words, "sentences")


@rule("ALL-WRIT0004", "ProseSegment", kind="float", policy=Numeric(maximum=90))
def paragraph_length_uniformity(minimum_paragraphs: int = 4, minimum_words: int = 30):
    return _uniformity("paragraph_word_counts", minimum_paragraphs, minimum_words, "paragraphs")


def _uniformity(field: str, least: int, words: int, noun: str):
    """100 less the mean absolute deviation from the mean, in percent of the mean; not under 0."""
    sizes = F.filter(F.flatten(F.transform("sections", lambda s: s[field])), lambda n: n >= words)
    average = lambda items: F.try_divide(F.aggregate(items, F.lit(0.0), lambda a, x: a + x), F.size(items).cast("double"))
    share = lambda items, mean: F.greatest(F.lit(0.0), 100.0 * (1 - F.try_divide(average(F.transform(items, lambda x: F.abs(x - mean))), mean)))
    value = named(sizes, lambda items: F.when(F.size(items) >= least, named(average(items), lambda mean: share(items, mean))))
    return gauged(value, say(noun + " of much the same length: ", F.size(sizes)))


@rule("ALL-WRIT0005", "ProseSegment", kind="float", policy=Numeric(maximum=30))
def sentence_opener_concentration(minimum_sentences: int = 6, ignored_openers: tuple = ("a", "i")):
    openers = F.filter(F.transform(F.flatten(F.transform("sections", lambda s: s["sentence_openers"])), F.lower), lambda w: ~w.isin(*ignored_openers) & (w != ""))
    most = lambda items: F.array_max(F.transform(F.array_distinct(items), lambda w: F.size(F.filter(items, lambda x: x == w))))
    return gauged(named(openers, lambda items: F.when(F.size(items) >= minimum_sentences, percentage(most(items), F.size(items)))), "sentences that open with one word")


@rule("ALL-ENCA0001", "AttributeAccess")
def external_nonpublic_attribute_access_count(allowed: tuple = ()):
    return counted(col("accesses"), lambda a: a["name"].startswith("_") & ~a["is_protocol_name"] & ~a["is_inside_owning_class"] & ~a["receiver_kind"].isin("self", "owner", "super") & ~one_of(a["name"], allowed), about("nonpublic member used from outside:", "receiver_text", "name"), lambda a: a["node"]["start_line"])


@rule("PY-ENUM0005", "AttributeAccess", fix="safe", languages=("python",))
def prefer_enum_conversion():
    return counted(col("accesses"), lambda a: (a["name"] == "value") & any_of(F.transform(a["receiver_type_bases"], last_name), ("StrEnum", "IntEnum")), about("read through .value:", "receiver_text"), lambda a: a["node"]["start_line"])


@rule("PY-MODU0005", "Export", fix="review", languages=("python",))
def unused_explicit_export():
    export = F.array(col("public_export"))
    return counted(export, lambda e: e["consumer_count"] == 0, about("no consumer of the export", "name"), lambda e: e["span"]["start_line"])


@rule("PY-IMPO0006", "Export", fix="safe", languages=("python",))
def bypassed_public_import():
    return counted(col("bypasses"), lambda b: b["is_cycle_safe"], about("import bypasses", "public_module", "name"), lambda b: b["span"]["start_line"], lambda b: b["span"]["path"])


@rule("ALL-STRI0001", "StringExpression", fix="safe")
def fragmented_multiline_literal(minimum_fragments: int = 2):
    return counted(col("expressions"), lambda e: e["contains_newline"] & (e["fragment_count"] >= minimum_fragments), about("multiline text in pieces"), lambda e: e["node"]["start_line"])


@rule("ALL-STRI0002", "StringExpression")
def decorative_repeated_separator_count(minimum_repetitions: int = 3):
    return counted(col("expressions"), lambda e: e["text"].rlike(r"^[-=_*#~.+]+$") & (e["repetition"] >= minimum_repetitions), about("decorative separator", "text"), lambda e: e["node"]["start_line"])


@rule("PY-CONS0001", "Symbol", languages=("python",))
def public_module_constant():
    return counted(col("symbols"), lambda s: (s["scope"] == "module") & s["is_constant_assignment"] & s["name"].rlike(r"^[A-Z][A-Z0-9_]*$"), about("constant without a leading underscore:", "name"))


@rule("PY-NAMI0001", "Symbol", kind="boolean", fix="review", languages=("python",))
def boolean_predicate_name(prefixes: tuple = ("is_", "has_", "can_", "should_", "supports_")):
    named = lambda s: F.regexp_replace(s["name"], "^_+", "").rlike("^(" + "|".join(prefixes) + ")")
    return flagged(F.exists("symbols", lambda s: s["returns_boolean"] & ~s["name"].startswith("__") & ~named(s)), "a Boolean does not read as a question")


@rule("PY-EXCE0003", "Exception", languages=("python",))
def shared_exception_placement(minimum_importing_modules: int = 2, preferred_module: str = "exceptions"):
    return counted(col("exceptions"), lambda e: (F.size(F.array_distinct(e["importing_modules"])) >= minimum_importing_modules) & (last_name(e["defining_module"]) != preferred_module), about("shared exception belongs elsewhere:", "name", "defining_module"))


@rule("PY-INTE0001", "RuntimeTypeCheck", kind="boolean", languages=("python",))
def concrete_isinstance_capability(concrete: tuple = ("int", "float", "complex", "list", "tuple", "dict", "set", "frozenset")):
    return flagged(F.exists("checks", lambda c: one_of(c["concrete_type"], concrete) & (filled(c["guarded_operations"]) | c["can_use_eafp"])), "a concrete check stands in for a capability")
