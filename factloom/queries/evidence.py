"""Facts of every family made from a table of keys, the same rows in Spark and in DuckDB.

Each field's value is a small function of the key and of the places in the lists around it, so
that a rule's SQL can be written against the same nested rows that the rule reads."""

from __future__ import annotations

import math
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.facts import FAMILIES

_PRIME = 9973
#: Keys that one task makes facts of.
TASK_KEYS = 10_000
#: Values that a field takes, by name or by family and name; other fields are numbers, flags or short texts.
OPTIONS: dict[str, list] = {
    "path": ["src/a.py", "src/tests/b.py", "lib/models/c.py", "app/enums/d.py", "x/x.py", "pkg/__init__.py", "döc/e.rs", "typings.py"],
    "language": ["python", "python", "python", "rust", "typescript", "cuda"],
    "visibility": ["public", "private", "protected", "public"], "owner_visibility": ["public", "private"], "scope": ["module", "method", "nested", "module"],
    "name": ["load", "_hidden", "is_ready", "x", "Config", "MAX_SIZE", "__init__", "value", "exclude_paths"],
    "decorators": ["staticmethod", "abc.abstractmethod", "property", "override", "typing.final"],
    **dict.fromkeys("is_abstract is_protocol_member is_overload is_property is_framework_hook is_polymorphic is_protocol_name is_recursive is_first_class_reference is_pass_body is_raise_body is_shadowed has_ambiguous_alias".split(), [False] * 9 + [True]),
    "attribute_names": ["a_b", "b", "c", "d", "e"], "output_keys": ["a-b", "b", "c", "d", "x"], "returned": ["'a"], "receiver": ["'a", ""], "parameters.parameters": ["'a"],
    "character_count": [10, 30, 90],
    "docstring": ["", "Short summary.", "No stop here", "A summary line that goes on. " * 5], "cache_decorator": ["", "cached_property", "lru_cache", "cache"],
    "sole_reference_owner_class": ["", "Owner"], "type_name": ["", "int", "str"], "annotation": ["list[int]", "Sequence[int]", "dict", "AppConfig", "tuple[int, ...]"],
    "operations": ["attribute_read", "append", "iterate"], "reference_count": [0, 1, 2, 5], "direct_statement_count": [1, 4, 11, 1], "implementation_lines": [1, 2, 9],
    "Function.control_increments.kind": ["conditional", "loop", "catch", "jump"], "Class.classes.methods.kind": ["method", "static_method", "class_method", "property"],
    "qualified_name": ["asyncio.run", "tuple", "logging.getLogger", "argparse.ArgumentParser", "Model.model_validate", "bool", "staticmethod", "cuda.core.Stream", "asyncio.iscoroutinefunction", "loop.run_in_executor", "__syncthreads", "cudaMemcpy", "cudaStreamCreate", "numba.cuda.stream", "numba.cuda.synchronize", "torch.as_tensor", "asyncio.get_event_loop_policy", "loguru.logger.info", "cuda.core.launch", "cudaDeviceSynchronize", "cuda.bindings.runtime.cudaMalloc", "cuda.bindings.runtime.cudaStreamCreate", "numba.cuda.to_device", "typing.cast"],
    "Call.calls.arguments.text": ["None", "dict(a=1)", "x > 3", "x.cpu()", "LEGACY_DEFAULT_STREAM"], "literal_kind": ["", "mapping", "boolean"], "resolved_type": ["", "bool", "int"], "keyword_names": ["stream", "timeout", "size"],
    "direct_bases": ["abc.ABC", "Registry", "Base[int]"], "class_keywords": ["metaclass=ABCMeta"], "direct_subclasses": ["A", "B"], "descendant_count": [1, 1, 2], "field_count": [0, 0, 3], "owner_qualified_calls": ["C.load", "C.x"], "role_suffixes": ["Content", "Other"],
    "physical_line_count": [10, 499, 501, 900], "statement_count": [3, 200, 201], "class_count": [0, 1, 2, 9], "function_count": [0, 6, 15], "executable_statement_count": [0, 3], "intervening_statement_count": [0, 0, 2],
    "entry_count": [0, 1, 4], "source_depth": [3, 6, None], "direct_module_count": [1, 3, 4], "direct_directory_count": [0, 1, 2], "direct_file_count": [0, 2],
    "fixture_names": ["tmpdir", "client", "anyio_backend"], "requested_fixture_names": ["tmpdir_factory", "db"], "marks": ["pytest.mark.anyio", "slow"], "literal_vectors": ["a"], "case_count": [1, 3, 12], "parametrized_range_sizes": [2, 10, 40], "owned_statement_count": [1, 10, 11], "import_mode": ["", "importlib", "append", "prepend", "odd"], "anyio_mode": ["auto", "strict"], "asyncio_mode": ["auto", None],
    "module": ["app.core.io", "__future__", "os", "tests.conftest", "app._private.x"], "importer_module": ["app.main", "lib.x", "app"], "imported_name": ["annotations", "conftest", "LIMIT", "load"], "relative_level": [0, 1, 3],
    "validators.kind": ["model_after", "field"], "fields_read": ["a", "a", "b"], "base_names": ["B", "abc.ABC"], "depth": [1, 1, 2], "base": ["p.B", "p.C"], "base_decorators": ["typing.final", "x"], "initializer_calls": ["super().__init__", "B.__init__", "Z.__init__"], "ancestor_names": ["B", "C", "D", "E", "F", "G", "H"],
    "RustSurface.annotations.kind": ["function", "struct"], "names": ["'a", "'b"], "position": ["demand", "hold"], "loop_depth": [0, 0, 1], "SymbolReach.declarations.kind": ["method", "attribute", "function"], "qualname": ["A.x", "A.y", "B.z", "free"], "own_file_references": [0, 0, 2], "other_file_references": [0, 0, 1], "unresolved_name_references": [0, 0, 0, 1], "referencing_packages": [1, 3, 4], "non_owner_references": [0, 1], "owner_references": [0, 2],
    "Query.operations.kind": ["async_sessionmaker", "session_commit", "execute_scalars", "exec_scalars", "primary_key_first"], "framework": ["sqlmodel", "sqlalchemy"], "selected_expression_count": [1, 2], "expire_on_commit": [True, False, None], "star_reexports": ["./a", "./b"], "deepest_relative_import": [0, 1, 3],
    "explicit_value": ["1", "2"], "standard_auto_value": ["1", "3"], "enum_count": [2, 3, 5], "reused_enum_count": [1, 2, 3], "cross_module_import_count": [2, 3], "destination": ["pkg/enums.py", "pkg/kinds.py"], "enum_class_count": [1, 2], "top_level_class_count": [1, 2], "model_class_count": [1, 1, 2],
    "lifecycle": ["active", "deprecated", "removed", "unknown"], "owners": ["me"], "domain": ["", "sales"], "description": ["", " ", "stated"], "tags": ["PII ", "public", "Sensitive"], "glossary_terms": ["t"], "expected_type": ["", "INT", "text"], "catalog_type": ["int", "text"], "identifier": ["s.a", "s.b", "s.c"], "asset_identifier": ["s.a", "s.b", "s.c"], "downstream_assets": ["s.b", "s.d"], "tested_assets": ["s.a", "s.d"],
    "method": ["GET", "get", "POST"], "Route.routes.path": ["/users", "/user-list", "/order_list", "/{id}"], "declared_in": ["a.py", "b.py"], "references.path": ["a.py", "c.ts"], "references.language": ["python", "typescript", "json"], "declared_language": ["python", "cuda"],
    "role": ["", "key", "permission", "alias"], "LiteralGroup.string_groups.value": ["a long enough literal", "medium one", "short"], "occurrence_count": [1, 3, 4], "files": ["a", "b", "c"],
    "line_count": [20, 401, 900], "author_count": [1, 3, 5], "days_since_last_change": [10, 180, 400], "sentence_word_counts": [10, 11, 12, 2, 30], "paragraph_word_counts": [40, 45, 80, 10], "sentence_openers": ["The", "the", "A", "One", ""],
    "resolved_release_day": [100, 300, None], "latest_compatible_release_day": [200, 500, None], "latest_compatible_version": ["2", None], "project_state": ["active", "archived"], "repository_state": ["active", "archived"], "resolved_release_state": ["ok", "yanked"],
    "Comment.groups.text": ["# TODO later", "# fixme", "# Copyright me", "# plain words"], "token_count": [5, 50, 90], "leading_literal_assignment_count": [0, 1], "clause_statement_counts": [1, 2], "caught": ["", "KeyError"], "union_members": ["None", "bool", "int"], "resolved_names": ["typing.Any", "int"],
    "afferent_count": [0, 1, 4], "efferent_count": [1, 3], "declaration_count": [2, 4], "abstract_declaration_count": [0, 1, 2], "token_length": [40, 60, 90], "repository_line_count": [100, 1000], "CloneGroup.fragments.start_line": [1, 10], "CloneGroup.fragments.end_line": [12, 30, 13],
    "receiver_kind": ["self", "other", "owner"], "receiver_type_bases": ["enum.StrEnum", "Other"], "consumer_count": [0, 2], "StringExpression.expressions.text": ["----", "text", "=="], "repetition": [1, 3, 9], "capability": ["setup", "lint", "typecheck", "test", "build"], "commands": ["make x"], "guidance_locations": ["README"],
    "AutomationTask.tasks.commands": ["make x"], "collection_kind": ["list", "other"], "ProjectConfiguration.assignments.values": ["a", "b", "c", "d"], "project_minimum_minor": [12, 14], "configured_tools": ["ruff", "mypy"], "tool_target_minors": [12, 14], "per_file_target_minors": [12, 14],
    "loop_counts": [1, 2, 3], "pair_count": [1, 2], "value_count": [1, 2], "Collection.local_collections.kind": ["list", "tuple"], "conditional_count": [0, 1, 6], "kernel": ["k"], "stream": ["", "0", "s", "nullptr"],
    "source_component": [1, 2], "target_component": [1, 2], "Branch.chains.subject": ["", "mode"], "comparison": ["==", "=="], "literal": ["a", "b", "c", "d"], "locations": ["p", "q"], "direct_base": ["", "Base"], "defining_module": ["app.exceptions", "app.io"], "importing_modules": ["m", "n"], "concrete_type": ["int", "Path"], "guarded_operations": ["add"],
    "objective": ["o", "o", ""], "check": ["c"], "retained_result": ["r"], "owner": ["me", "me", ""], "observation_age_days": [3, 30, 31], "verification": ["ci", "ci", "none"], "CIConfiguration.workflows.tasks": ["lint", "typecheck", "test", "other"], "duration_percentile_seconds": [100, 600, 601], "percentile": [0.9, 0.95, 0.5],
    "locked_inputs": ["lock"], "build_command": ["b", ""], "migrations": ["m"], "provenance": ["p", ""], "age_days": [5, 90, 91, None], "decision_due_days": [10, 0, None], "tested_states": ["on"], "cleanup_plan": ["p", ""], "audience": ["paging", "mail"], "recent_outcomes": ["ok"], "indicators": ["i"], "objectives": ["o"], "windows": ["w"], "error_budget_policy": ["p"],
    "design_evidence": ["d", ""], "verification_age_days": [10, 90, 91, None], "limit": [1.5, 2.5, None], "last_outcome": ["ok", ""], "reviewer": ["ann", "bob"], "author": ["ann", "bob"], "expires_in_days": [5, -1, None], "metadata": ["because", "", None], "provider": ["p", "q"], "upstream_health": ["healthy", "unhealthy"], "strict_controls": [True, True, False],
    "Syntax.nodes.kind": ["call", "assign", "raise", "name", "with_item"], "Syntax.nodes.name": ["print", "hashlib.md5", "os.system", "locals", "x", "password", "run", "super", "data"], "Syntax.nodes.text": ["raise Exception(x)", "raise ValueError(1)", "locals()", "password = 'hunter22'", "run(x, shell=True)", "super(type(self), self)", "hashlib.md5(b)"],
}
#: Keys of maps, and most items of lists that are longer than three.
_KEYS = {"upstream_health": ["u", "v"], "strict_controls": ["strict_config", "strict_markers", "strict_parametrization_ids", "strict_xfail", "strict"], "tool_target_minors": ["ruff"], "metadata": ["reason"]}
_MOST = {"decorators": 1, "class_keywords": 1, "attribute_names": 6, "output_keys": 6, "arguments": 2, "keyword_names": 1, "methods": 12, "nodes": 8, "sentence_word_counts": 8, "paragraph_word_counts": 6, "sentence_openers": 9, "ancestor_names": 8, "arms": 4, "tasks": 6, "declarations": 10, "literal_vectors": 13, "calls": 9, "workflows": 4, "members": 6, "definitions": 8, "reused_definitions": 5, "per_file_target_minors": 1}


def _literal(v: object) -> str:
    if v is None or isinstance(v, bool):
        return {None: "NULL", True: "true", False: "false"}[v]
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def _value(kind: T.DataType, at: str, places: str, duck: bool) -> str:
    """A field's value in SQL; ``at`` is family and names, ``places`` the variables of the lists around it."""
    seed = zlib.crc32(at.encode())
    number = "((" + " + ".join(f"{v} * {1 + (seed >> 3 * n) % 997}" for n, v in enumerate(("k", *places))) + f" + {seed % 7919}) % {_PRIME})"
    names = at.split(".")
    options = next((OPTIONS[n] for n in (at, ".".join(names[-2:]), names[-1]) if n in OPTIONS), None)
    if isinstance(kind, T.StructType):
        fields = [(f.name, _value(f.dataType, f"{at}.{f.name}", places, duck)) for f in kind.fields]
        return "{" + ", ".join(f"'{n}': {v}" for n, v in fields) + "}" if duck else "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in fields) + ")"
    if isinstance(kind, T.ArrayType):
        v, most = "ijlm"[len(places)], _MOST.get(names[-1], 3)
        one = _value(kind.elementType, at if isinstance(kind.elementType, T.StructType) else f"{at}", places + v, duck)
        size = f"({number} % {most + 1})"
        if duck:
            return f"list_transform(range(1, {size} + 1), lambda {v}: {one})"
        return f"transform(filter(sequence(1L, {most}L), x{v} -> x{v} <= {size}), {v} -> {one})"
    if isinstance(kind, T.MapType):
        entries = [(key, _value(kind.valueType, f"{at}.{key}.{names[-1]}", places, duck)) for key in _KEYS[names[-1]]]
        return "MAP {" + ", ".join(f"'{k}': {v}" for k, v in entries) + "}" if duck else "map(" + ", ".join(f"'{k}', {v}" for k, v in entries) + ")"
    if options is not None:
        texts = ", ".join(map(_literal, options))
        return f"([{texts}])[1 + {number} % {len(options)}]" if duck else f"element_at(array({texts}), cast(1 + {number} % {len(options)} AS int))"
    if isinstance(kind, T.BooleanType):
        return f"({number} % 2 = 0)"
    if isinstance(kind, T.StringType):
        return f"('v' || CAST({number} % 4 AS STRING))"
    return f"CAST({number} % 5 AS {'DOUBLE' if isinstance(kind, T.DoubleType) else 'BIGINT'})"


_SCALARS = {"string": T.StringType(), "boolean": T.BooleanType(), "bigint": T.LongType(), "double": T.DoubleType()}


def _parts(text: str) -> list[str]:
    """What stands between the commas that are outside all brackets."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _kind(text: str) -> T.DataType:
    """A type as the families state it; needs no session, as the SQL is asked for without one."""
    if text in _SCALARS:
        return _SCALARS[text]
    name, inside = text[: text.index("<")], text[text.index("<") + 1 : -1]
    if name == "array":
        return T.ArrayType(_kind(inside))
    if name == "map":
        return T.MapType(*map(_kind, _parts(inside)))
    return T.StructType([T.StructField(f, _kind(t)) for f, _, t in (x.partition(":") for x in _parts(inside))])


def _schema(family: str) -> list[T.StructField]:
    stated = _parts("fact_id string, path string, language string, start_line bigint, end_line bigint, " + FAMILIES[family])
    return [T.StructField(f, _kind(t.strip())) for f, _, t in (x.partition(" ") for x in stated)]


def _fields(family: str, duck: bool) -> list[tuple[T.StructField, str]]:
    made = {"fact_id": "CAST(k AS STRING)", "start_line": "(k % 50 + 1)", "end_line": "(k % 50 + 1 + k % 20)"}
    return [(f, made.get(f.name) or _value(f.dataType, f"{family}.{f.name}", "", duck)) for f in _schema(family)]


def dealt(keys: DataFrame, key: str) -> DataFrame:
    """The keys over as many tasks as their number asks for.

    A key is a few bytes in a file and some kB as a fact, so that the partitions of a file are too few.
    Keys are dealt in turn, so that equal ones spread as well."""
    spark = keys.sparkSession
    return keys.select(key).repartition(max(spark.sparkContext.defaultParallelism, math.ceil(keys.count() / TASK_KEYS)))


def facts(keys: DataFrame, key: str, family: str) -> DataFrame:
    """A fact for each key."""
    rows = keys.select(F.col(key).cast("bigint").alias("k"))
    return rows.select(*[F.expr(sql).cast(f.dataType).alias(f.name) for f, sql in _fields(family, False)])


def facts_sql(family: str) -> str:
    """The same in DuckDB, of rows with a column ``k``."""
    return f"{family} AS MATERIALIZED (SELECT " + ", ".join(f'{sql} AS "{f.name}"' for f, sql in _fields(family, True)) + " FROM keys)"
