"""Rules on classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.plans.policy import Numeric
from factloom.plans.rules import counted, flagged, measured, rule, say
from factloom.rules.common import about, any_of, col, filled, last_name, one_of

_VISIBILITY = ("public", "protected", "internal", "private")
_KINDS = ("constructor", "property", "static_method", "class_method", "method")
_LIFECYCLE = ("__init_subclass__", "__new__", "__init__", "__post_init__", "model_post_init")


def _start(x):
    return x["span"]["start_line"]


def _bases(c):
    return F.transform(c["direct_bases"], lambda b: last_name(F.regexp_replace(b, r"\[.*$", "")))


@rule("ALL-CLAS0001", "Class", fix="review")
def class_method_order(lifecycle: tuple = _LIFECYCLE, visibility_order: tuple = _VISIBILITY, kind_order: tuple = _KINDS, alphabetical: bool = True):
    """Lifecycle names first in their order, protocol members next, then by visibility, kind and name."""
    place = lambda value, names: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), value), F.lit(0)), F.lit(len(names) + 1).cast("bigint"))

    def key(m):
        first = F.when(one_of(m["name"], lifecycle), 0).when(m["is_protocol_name"], 1).otherwise(2)
        rest = F.when(first == 2, F.struct(place(m["visibility"], visibility_order).alias("v"), place(m["kind"], kind_order).alias("k"), (m["name"] if alphabetical else F.lit("")).alias("n")))
        return F.struct(first.alias("a"), F.when(first == 0, place(m["name"], lifecycle)).otherwise(F.lit(0).cast("bigint")).alias("b"), rest.alias("c"))

    keys = lambda c: F.transform(c["methods"], key)
    return counted(col("classes"), lambda c: keys(c) != F.array_sort(keys(c)), about("methods out of order in", "name"), _start)


@rule("ALL-CLAS0003", "Class", policy=Numeric(maximum=10))
def public_method_count():
    sizes = F.transform("classes", lambda c: F.size(F.filter(c["methods"], lambda m: (m["visibility"] == "public") & ~F.coalesce(m["is_protocol_name"], F.lit(False)))))
    return measured(F.coalesce(F.array_max(sizes), F.lit(0)), "public methods of the widest class", "methods")


@rule("PY-CLAS0001", "Class", kind="boolean", languages=("python",))
def explicit_registry_name(registry_bases: tuple = ("Registry", "Strategy", "Backend", "Provider", "Component")):
    return flagged(F.exists("classes", lambda c: c["has_explicit_registry_name"] & any_of(_bases(c), registry_bases)), "a registry class overrides its derived key")


@rule("PY-CLAS0002", "Class", languages=("python",))
def coupled_nested_type_candidate(suffixes: tuple = ("Content", "Kind"), minimum_types: int = 2, minimum_coimports: int = 2, maximum_type_lines: int = 30, minimum_prefix_length: int = 3):
    return counted(col("coupled_groups"), lambda g: (g["type_count"] >= minimum_types) & (g["coimporting_module_count"] >= minimum_coimports) & (g["maximum_type_lines"] <= maximum_type_lines) & (F.length(g["prefix"]) >= minimum_prefix_length) & any_of(g["role_suffixes"], suffixes), about("types that belong together:", "prefix"), _start)


@rule("PY-CLAS0003", "Class", languages=("python",))
def utility_namespace_class_count():
    stateless = lambda c: F.forall(c["methods"], lambda m: (m["kind"] == "static_method") | ~F.coalesce(m["reads_receiver"], F.lit(True)))
    return counted(col("classes"), lambda c: filled(c["methods"]) & stateless(c) & ~filled(c["direct_bases"]) & ~filled(c["decorators"]) & ~c["has_instance_fields"] & (F.coalesce(c["field_count"], F.lit(0)) == 0) & ~c["is_protocol"], about("class that only holds functions:", "name"), _start)


@rule("PY-CLAS0004", "Class", languages=("python",))
def staticmethod_calling_classmethod_count():
    def calling(c):
        siblings = F.transform(F.filter(c["methods"], lambda m: m["kind"] == "class_method"), lambda m: m["name"])
        return F.transform(F.filter(c["methods"], lambda m: (m["decorators"] == F.array(F.lit("staticmethod"))) & F.arrays_overlap(F.transform(m["owner_qualified_calls"], last_name), siblings)), lambda m: F.struct(c["name"].alias("owner"), m["name"].alias("name"), m["span"].alias("span")))

    return counted(F.flatten(F.transform("classes", calling)), lambda m: F.lit(True), about("static method names its owner:", "owner", "name"), _start)


@rule("PY-CLAS0005", "Class", languages=("python",))
def artificial_single_subclass_base_count():
    return counted(col("classes"), lambda c: (F.size(c["direct_subclasses"]) == 1) & (c["descendant_count"] == 1) & ~filled(c["decorators"]) & ~filled(c["class_keywords"]) & ~c["is_protocol"] & ~c["is_instantiated"] & ~c["is_exported"] & c["only_cross_module_reference_is_subclass"] & c["base_is_removable_overlap"], about("base for one subclass:", "name"), _start)


@rule("PY-CLAS0006", "Class", languages=("python",))
def pass_through_inheritance_layer_count(contract_suffixes: tuple = ("Backend", "Error", "Exception", "Mixin", "Plugin", "Port", "Protocol", "Provider", "Registry", "Strategy")):
    return counted(col("classes"), lambda c: c["is_pass_through_layer"] & ~c["name"].rlike("(" + "|".join(contract_suffixes) + ")$"), about("layer that adds nothing:", "name"), _start)


@rule("PY-CLAS0007", "Class", languages=("python",))
def hazardous_multiple_inheritance_mro_count():
    return counted(col("classes"), lambda c: (F.size(c["direct_bases"]) >= 2) & ~filled(c["decorators"]) & (c["has_redundant_direct_base"] | c["has_noncooperative_concrete_collision"]), about("bases collide in", "name"), _start)


@rule("PY-CLAS0009", "Class", policy=None, languages=("python",))
def duplicate_component_attribute_alias_count():
    copies = F.flatten(F.transform("classes", lambda c: F.array_repeat(F.struct(c["name"].alias("name"), c["span"].alias("span")), F.coalesce(c["duplicate_component_alias_count"], F.lit(0)).cast("int"))))
    return counted(copies, lambda c: F.lit(True), about("copies an attribute of its component:", "name"), _start)


@rule("PY-INTE0002", "Class", languages=("python",))
def single_implementation_abstract_base():
    abstract = lambda c: any_of(_bases(c), ("ABC",)) | F.exists(c["class_keywords"], lambda k: k.contains("ABCMeta")) | F.exists(c["methods"], lambda m: F.exists(m["decorators"], lambda d: d.endswith("abstractmethod")))
    return counted(col("classes"), lambda c: abstract(c) & (c["descendant_count"] == 1) & (c["scope"] == "module"), about("one implementation of", "name"), _start)


@rule("PY-MODE0001", "Class", languages=("python",))
def shared_model_file_shape():
    inside = lambda f: f["path"].rlike(r"(^|/)models/[^/]+\.py$")
    return counted(col("model_files"), lambda f: inside(f) & ~f["is_package_initializer"] & ((f["model_class_count"] != 1) | (f["top_level_class_count"] != 1)), about("not one model:", "path"), _start, lambda f: f["path"])


@rule("PY-MODE0003", "Class", languages=("python",))
def approved_model_foundation():
    return counted(F.when(col("has_approved_model_foundation_policy"), col("classes")), lambda c: c["directly_inherits_pydantic_base_model"] & ~c["inherits_approved_model_foundation"], about("not on the approved foundation:", "name"), _start)


@rule("PY-MODE0004", "Class", languages=("python",))
def manual_model_attribute_projection_count(minimum_attributes: int = 4):
    return counted(col("projection_groups"), lambda p: F.size(F.array_intersect(p["attribute_names"], F.transform(p["output_keys"], lambda k: F.replace(k, F.lit("-"), F.lit("_"))))) >= minimum_attributes, about("fields repeated by hand of", "root"), _start)


@rule("PY-MODE0005", "Class", languages=("python",))
def standard_dataclass_model():
    return counted(col("classes"), lambda c: c["is_dataclass"] & (c["field_count"] > 0) & ~c["has_ordinary_behavior"], about("dataclass that is a model:", "name"), _start)


@rule("PY-MODE0006", "Class", languages=("python",))
def empty_declarative_model():
    return counted(col("classes"), lambda c: (c["is_declarative_model"] | c["is_dataclass"]) & (F.coalesce(c["field_count"], F.lit(0)) == 0) & ~c["has_inherited_fields"], about("model without fields:", "name"), _start)


@rule("PY-ENUM0001", "Enum", kind="boolean", fix="safe", languages=("python",))
def redundant_enum_value():
    redundant = lambda e: ~F.coalesce(e["overrides_generate_next_value"], F.lit(False)) & F.exists(e["members"], lambda m: m["explicit_value"] == m["standard_auto_value"])
    return flagged(F.exists("enums", redundant), "auto() would give the same value")


@rule("PY-ENUM0003", "Enum", languages=("python",))
def shared_enums_module_candidate(minimum_definitions: int = 3, minimum_imported_definitions: int = 2, minimum_cross_module_imports: int = 3, preferred_modules: tuple = ("enums.py", "enums")):
    settled = lambda s: F.element_at(F.split(s["destination"], "/"), -1).isin(*preferred_modules)
    return counted(col("scopes"), lambda s: (s["enum_count"] >= minimum_definitions) & (s["reused_enum_count"] >= minimum_imported_definitions) & (s["cross_module_import_count"] >= minimum_cross_module_imports) & ~settled(s), about("enums to share in", "destination"))


@rule("PY-ENUM0004", "Enum", languages=("python",))
def shared_enum_file_shape():
    return counted(col("files"), lambda f: f["path"].rlike(r"(^|/)enums/") & ~f["is_package_initializer"] & ((f["enum_class_count"] != 1) | (f["top_level_class_count"] != 1)), about("not one enum:", "path"), None, lambda f: f["path"])


@rule("PY-PYDA0001", "PydanticModel", languages=("python",))
def single_field_model_validator():
    return _validators(lambda v: (v["kind"] == "model_after") & (F.size(F.array_distinct(v["fields_read"])) == 1) & ~v["has_self_call"] & ~v["has_nonfield_access"], "model validator of one field")


@rule("PY-PYDA0002", "PydanticModel", languages=("python",))
def declarative_field_constraint_candidate():
    return _validators(lambda v: (v["kind"] == "field") & (v["declarative_constraint_count"] > 0), "validator restates a constraint")


@rule("PY-PYDA0005", "PydanticModel", languages=("python",))
def optional_variant_discriminated_union_candidate(minimum_variants: int = 2):
    return _validators(lambda v: (v["kind"] == "model_after") & v["proves_disjoint_optional_variants"] & (v["variant_count"] >= minimum_variants), "optional fields are variants")


def _validators(where, text: str):
    rows = F.flatten(F.transform("models", lambda m: F.transform(F.filter(m["validators"], where), lambda v: F.struct(m["name"].alias("name")))))
    return counted(rows, lambda x: F.lit(True), about(text + " in", "name"))


@rule("PY-PYDA0006", "PydanticModel", languages=("python",))
def constructor_model_candidate(minimum_parameters: int = 3, minimum_attributes: int = 3, minimum_validations: int = 1, minimum_defaults: int = 1):
    return counted(col("models"), lambda m: m["is_undecorated_plain_class"] & (m["synchronous_init_count"] == 1) & (m["fixed_parameter_count"] >= minimum_parameters) & (m["stored_parameter_count"] >= minimum_attributes) & (m["validation_count"] >= minimum_validations) & (m["default_count"] >= minimum_defaults) & m["has_only_data_identity_methods"], about("constructor that is a model:", "name"))


@rule("PY-PYDA0007", "PydanticModel", languages=("python",))
def variadic_tuple_model_field():
    rows = F.flatten(F.transform(F.filter("models", lambda m: m["is_pydantic_model"]), lambda m: F.transform(F.filter(m["fields"], lambda f: f["is_variadic_tuple"] | f["annotation"].rlike(r"[tT]uple\[[^,\]]+,\s*\.\.\.\]")), lambda f: F.struct(m["name"].alias("model"), f["name"].alias("name")))))
    return counted(rows, lambda x: F.lit(True), about("variadic tuple field:", "model", "name"))


@rule("PY-PYDA0008", "PydanticModel", languages=("python",))
def implicit_arbitrary_type_model():
    return counted(col("models"), lambda m: m["uses_flexible_model"], about("permits any type:", "name"))


@rule("ALL-CLAS0005", "Override", policy=Numeric(maximum=5))
def ancestor_count():
    """Stated once for a class, at the link to its first base."""
    first = (col("depth") == 1) & (F.coalesce(F.get("base_names", F.lit(0)), F.lit("")) == F.element_at(F.split("base", r"\."), -1))
    return measured(F.when(first, F.size(F.array_distinct("ancestor_names"))), say("types above ", col("derived")), "ancestors")
