"""Facts of Python source: one parse of each file, in batches on the executors.

The front end emits nested facts of the families Module, Function, Class, Call, ImportBinding,
Comment, TryBlock, Comprehension and Syntax as JSON; each family is then read by its schema.
A file that does not parse gives no facts."""

from __future__ import annotations

import ast
import io
import json
import tokenize
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.facts import schema

FAMILIES = ("Module", "Function", "Class", "Call", "ImportBinding", "Comment", "TryBlock", "Comprehension", "Syntax")
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_LOOPS = (ast.For, ast.AsyncFor, ast.While)
# Names of syntax nodes, as rules read them.
_KINDS = {
    "If": "if", "For": "for", "AsyncFor": "for", "While": "while", "With": "with", "AsyncWith": "with", "Try": "try", "TryStar": "try", "Match": "match", "ExceptHandler": "except_handler", "Raise": "raise", "Return": "return", "Pass": "pass",
    "Continue": "continue", "Break": "break", "Expr": "expr", "Call": "call", "Assign": "assign", "AnnAssign": "ann_assign", "NamedExpr": "named_expr", "Name": "name", "Compare": "compare", "Constant": "constant", "List": "list", "Tuple": "tuple",
    "Dict": "dict", "Set": "set", "Attribute": "attribute", "keyword": "keyword", "arg": "parameter", "withitem": "with_item", "FunctionDef": "function", "AsyncFunctionDef": "function", "ClassDef": "class",
}


def _visibility(name: str) -> str:
    return "public" if not name.startswith("_") or name.startswith("__") and name.endswith("__") else "private" if name.startswith("__") else "protected"


def _names(node: ast.expr) -> str:
    return ast.unparse(node.func if isinstance(node, ast.Call) else node)


class _File:
    def __init__(self, path: str, text: str):
        self.path, self.text = path, text
        self.tree = ast.parse(text)
        self.lines = text.split("\n")
        self.module = path.removesuffix(".py").removesuffix("/__init__").replace("/", ".")
        self.is_test = any(p in ("tests", "test") for p in path.split("/")) or path.split("/")[-1].startswith(("test_", "conftest"))
        self.aliases: dict[str, str] = {}
        for node in ast.walk(self.tree):
            if isinstance(node, ast.Import):
                self.aliases.update({(a.asname or a.name.split(".")[0]): (a.name if a.asname else a.name.split(".")[0]) for a in node.names})
            elif isinstance(node, ast.ImportFrom) and not node.level:
                self.aliases.update({(a.asname or a.name): f"{node.module}.{a.name}" for a in node.names})
        self.reads: dict[str, int] = {}
        for node in ast.walk(self.tree):
            if isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load):
                self.reads[node.id] = self.reads.get(node.id, 0) + 1

    def fact(self, kind: str, key: str, node: ast.AST | None = None, /, **fields) -> dict:
        first, last = (1, len(self.lines)) if node is None else (node.lineno, node.end_lineno)
        return {"fact_id": f"{kind}:{self.path}:{key}", "path": self.path, "language": "python", "start_line": first, "end_line": last, **fields}

    def span(self, node: ast.AST) -> dict:
        return {"path": self.path, "start_line": node.lineno, "end_line": node.end_lineno}

    def node(self, node: ast.AST) -> dict:
        return {"path": self.path, "start_line": node.lineno, "start_column": node.col_offset, "end_line": node.end_lineno, "end_column": node.end_col_offset, "kind": type(node).__name__}

    def qualified(self, node: ast.expr) -> str:
        text = ast.unparse(node)
        head, dot, rest = text.partition(".")
        return self.aliases.get(head, head) + dot + rest

    # one method a family

    def modules(self) -> Iterator[dict]:
        body = self.tree.body
        code = [s for s in body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str))]
        is_all = lambda s: isinstance(s, (ast.Assign, ast.AnnAssign, ast.AugAssign)) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in (s.targets if isinstance(s, ast.Assign) else [s.target]))
        members = [s for s in body if isinstance(s, (*_FUNCTIONS, ast.ClassDef))]
        yield self.fact(
            "module", self.module, module=self.module, physical_line_count=len(self.text.splitlines()), statement_count=sum(isinstance(n, ast.stmt) for n in ast.walk(self.tree)), class_count=sum(isinstance(s, ast.ClassDef) for s in body),
            function_count=sum(isinstance(s, _FUNCTIONS) for s in body), executable_statement_count=len(code), is_package_initializer=self.path.endswith("__init__.py"), is_test=self.is_test, declares_all=any(map(is_all, body)),
            has_only_imports_and_all=bool(code) and all(isinstance(s, (ast.Import, ast.ImportFrom)) or is_all(s) for s in code), members=[{"name": m.name, "kind": "class" if isinstance(m, ast.ClassDef) else "function", "line": m.lineno} for m in members], constant_placements=[],
        )

    def functions(self) -> Iterator[dict]:
        def visit(node: ast.AST, scope: str, prefix: str) -> Iterator[dict]:
            for child in ast.iter_child_nodes(node):
                if isinstance(child, _FUNCTIONS):
                    yield self._function(child, scope, prefix)
                    yield from visit(child, "nested", f"{prefix}{child.name}.")
                elif isinstance(child, ast.ClassDef):
                    yield from visit(child, "method", f"{prefix}{child.name}.")
                else:
                    yield from visit(child, scope, prefix)

        yield from visit(self.tree, "module", "")

    def _function(self, f: ast.FunctionDef | ast.AsyncFunctionDef, scope: str, prefix: str) -> dict:
        doc = ast.get_docstring(f)
        body = f.body[1:] if doc is not None else f.body
        decorators = [_names(d) for d in f.decorator_list]
        positional = [*f.args.posonlyargs, *f.args.args]
        defaults = {id(a) for a in positional[len(positional) - len(f.args.defaults) :]} | {id(a) for a, d in zip(f.args.kwonlyargs, f.args.kw_defaults) if d is not None}
        values = dict(zip((a.arg for a in positional[len(positional) - len(f.args.defaults) :]), f.args.defaults)) | {a.arg: d for a, d in zip(f.args.kwonlyargs, f.args.kw_defaults) if d is not None}
        parameters = []
        for i, a in enumerate([*positional, *f.args.kwonlyargs]):
            kind = ast.unparse(a.annotation) if a.annotation else ""
            default = values.get(a.arg)
            parameters.append({
                "name": a.arg, "type_name": kind, "is_positional_only": a in f.args.posonlyargs, "is_keyword_only": a in f.args.kwonlyargs, "is_receiver": scope == "method" and i == 0 and "staticmethod" not in decorators, "is_required_by_external_contract": False,
                "has_boolean_annotation": kind == "bool", "has_boolean_default": isinstance(default, ast.Constant) and isinstance(default.value, bool), "has_default": id(a) in defaults,
            })
        increments, conditionals = [], 0

        def walk(nodes: Iterable[ast.AST], depth: int, chained: bool = False) -> None:
            nonlocal conditionals
            for n in nodes:
                if isinstance(n, (*_FUNCTIONS, ast.ClassDef, ast.Lambda)):
                    continue
                if isinstance(n, ast.If):
                    conditionals += 1
                    increments.append({"kind": "alternative" if chained else "conditional", "nesting_depth": depth})
                    walk(n.body, depth + 1)
                    walk(n.orelse, depth if len(n.orelse) == 1 and isinstance(n.orelse[0], ast.If) else depth + 1, len(n.orelse) == 1 and isinstance(n.orelse[0], ast.If))
                elif isinstance(n, (*_LOOPS, ast.Match)):
                    increments.append({"kind": "switch" if isinstance(n, ast.Match) else "loop", "nesting_depth": depth})
                    walk(ast.iter_child_nodes(n), depth + 1)
                elif isinstance(n, ast.ExceptHandler):
                    increments.append({"kind": "catch", "nesting_depth": depth})
                    walk(n.body, depth + 1)
                else:
                    walk(ast.iter_child_nodes(n), depth)

        walk(body, 0)
        one = body[0] if len(body) == 1 else None
        lines = {n for s in body for n in range(s.lineno, s.end_lineno + 1) if self.lines[n - 1].strip() and not self.lines[n - 1].strip().startswith("#")}
        receiver = parameters[0]["name"] if parameters and parameters[0]["is_receiver"] else ""
        call = one.value if isinstance(one, (ast.Return, ast.Expr)) and isinstance(one.value, ast.Call) else None
        cached = [d.split(".")[-1] for d in decorators if d.split(".")[-1] in ("cached_property", "cache", "lru_cache")]
        plain = [p["name"] for p in parameters if not p["is_receiver"]]
        return self.fact(
            "function", prefix + f.name, f, name=f.name, scope=scope, visibility=_visibility(f.name), is_test=self.is_test, is_async=isinstance(f, ast.AsyncFunctionDef), docstring=doc or "", decorators=decorators, parameters=parameters, control_increments=increments,
            implementation_lines=len(lines), direct_statement_count=len(body), reference_count=self.reads.get(f.name, 0), behavior_operation_count=sum(isinstance(n, (ast.Call, ast.BinOp, ast.Compare, ast.BoolOp)) for s in body for n in ast.walk(s)), conditional_count=conditionals,
            created_task_count=0, gather_consumes_created_tasks=False, gather_returns_exceptions=False, has_task_group=False, reads_receiver=any(isinstance(n, ast.Name) and n.id == receiver for s in body for n in ast.walk(s)) if receiver else False, cache_decorator=cached[0] if cached else "",
            recognized_tensor_roles=[], has_tensor_shape_semantics=False, has_tensor_dtype_semantics=False, is_protocol_name=f.name.startswith("__") and f.name.endswith("__"), sole_reference_owner_class="", is_recursive=any(isinstance(n, ast.Name) and n.id == f.name for s in body for n in ast.walk(s)),
            is_first_class_reference=False, is_abstract=any(d.endswith("abstractmethod") for d in decorators), is_protocol_member=False, is_overload=any(d.endswith("overload") for d in decorators), is_property=any(d.endswith("property") for d in decorators), is_framework_hook=False, is_declarative_body=False,
            is_polymorphic=False, is_pass_body=isinstance(one, ast.Pass), is_raise_body=isinstance(one, ast.Raise), returns_single_call=call is not None, forwards_only_parameter_unchanged=call is not None and [ast.unparse(a) for a in call.args] == plain and not call.keywords,
            is_model_method=False, is_pydantic_validator=False, checks_raw_input_type=False, raises_validation_exception=False, constructs_owner_model=False,
        )

    def classes(self) -> Iterator[dict]:
        found = [(c, c in self.tree.body) for c in ast.walk(self.tree) if isinstance(c, ast.ClassDef)]
        bases = [ast.unparse(b) for c, _ in found for b in c.bases]
        rows = []
        for c, top in found:
            methods = []
            for m in c.body:
                if isinstance(m, _FUNCTIONS):
                    decorators = [_names(d) for d in m.decorator_list]
                    kind = "constructor" if m.name == "__init__" else "property" if any(d.endswith("property") for d in decorators) else "static_method" if "staticmethod" in decorators else "class_method" if "classmethod" in decorators else "method"
                    first = m.args.args[0].arg if m.args.args and kind != "static_method" else ""
                    methods.append({"name": m.name, "span": self.span(m), "kind": kind, "visibility": _visibility(m.name), "decorators": decorators, "is_protocol_name": m.name.startswith("__") and m.name.endswith("__"), "reads_receiver": any(isinstance(n, ast.Name) and n.id == first for s in m.body for n in ast.walk(s)) if first else False, "reads_receiver_state": False, "owner_qualified_calls": [_names(n) for s in m.body for n in ast.walk(s) if isinstance(n, ast.Call) and _names(n).startswith(c.name + ".")]})
            fields = sum(isinstance(s, ast.AnnAssign) for s in c.body)
            decorators = [_names(d) for d in c.decorator_list]
            dataclass = any(d.split(".")[-1] == "dataclass" for d in decorators)
            rows.append({
                "name": c.name, "path": self.path, "span": self.span(c), "is_test": self.is_test, "scope": "module" if top else "nested", "visibility": _visibility(c.name), "direct_bases": [ast.unparse(b) for b in c.bases], "is_protocol": any(ast.unparse(b).split("[")[0].endswith("Protocol") for b in c.bases),
                "decorators": decorators, "class_keywords": [f"{k.arg}={ast.unparse(k.value)}" for k in c.keywords], "methods": methods, "has_explicit_registry_name": any(isinstance(s, (ast.Assign, ast.AnnAssign)) and "registry_name" in ast.unparse(s) for s in c.body), "has_instance_fields": any(isinstance(n, ast.Attribute) and isinstance(n.ctx, ast.Store) for n in ast.walk(c)),
                "field_count": fields, "has_inherited_fields": bool(c.bases), "direct_subclasses": [o.name for o, _ in found if c.name in (ast.unparse(b) for b in o.bases)], "descendant_count": bases.count(c.name), "is_instantiated": bool(self.reads.get(c.name)), "is_exported": False, "only_cross_module_reference_is_subclass": False, "is_pass_through_layer": False,
                "base_is_removable_overlap": False, "has_redundant_direct_base": False, "has_noncooperative_concrete_collision": False, "duplicate_component_alias_count": 0, "is_declarative_model": any(ast.unparse(b).split(".")[-1] == "BaseModel" for b in c.bases), "is_dataclass": dataclass,
                "has_ordinary_behavior": any(not m["is_protocol_name"] for m in methods), "importing_modules": [], "directly_inherits_pydantic_base_model": any(ast.unparse(b).split(".")[-1] == "BaseModel" for b in c.bases), "inherits_approved_model_foundation": False,
            })
        yield self.fact("class", self.module, classes=rows, coupled_groups=[], model_files=[], projection_groups=[], has_approved_model_foundation_policy=False)

    def calls(self) -> Iterator[dict]:
        discarded = {id(n.value) for n in ast.walk(self.tree) if isinstance(n, ast.Expr)}
        rows = []
        for c in ast.walk(self.tree):
            if isinstance(c, ast.Call):
                kinds = {str: "string", bool: "boolean", int: "number", float: "number"}
                arguments = [{"text": ast.unparse(a), "qualified_name": "", "literal_kind": "mapping" if isinstance(a, ast.Dict) else "sequence" if isinstance(a, (ast.List, ast.Tuple, ast.Set)) else kinds.get(type(a.value), "none") if isinstance(a, ast.Constant) else "none", "resolved_type": "bool" if isinstance(a, (ast.Compare, ast.BoolOp)) and not isinstance(a, ast.BoolOp) or isinstance(a, ast.UnaryOp) and isinstance(a.op, ast.Not) else ""} for a in c.args]
                name = self.qualified(c.func)
                rows.append({"qualified_name": name, "path": self.path, "arguments": arguments, "keyword_names": [k.arg for k in c.keywords if k.arg], "assigned_target": "", "result_is_discarded": id(c) in discarded, "node": self.node(c), "target_id": "", "is_external": name.split(".")[0] in self.aliases.values() or name in self.aliases.values(), "is_standard_library": False, "is_first_party": False, "is_constructor": False, "is_shadowed": False, "has_ambiguous_alias": False, "has_starred_arguments": any(isinstance(a, ast.Starred) for a in c.args), "enclosing_is_async": False, "enclosing_function": ""})
        yield self.fact("call", self.module, calls=rows, module_bindings=sorted(self.aliases), is_test=self.is_test)

    def imports(self) -> Iterator[dict]:
        package = self.module.split(".")[0]
        for node in ast.walk(self.tree):
            if isinstance(node, (ast.Import, ast.ImportFrom)):
                level = getattr(node, "level", 0)
                for a in node.names:
                    name = a.asname or a.name.split(".")[0]
                    module = (node.module or "") if isinstance(node, ast.ImportFrom) else a.name
                    member = a.name if isinstance(node, ast.ImportFrom) else ""
                    private = lambda p: p.startswith("_") and not p.startswith("__")
                    yield self.fact(
                        "import", f"{node.lineno}:{name}", node, name=name, module=module, imported_name=member, importer_module=self.module, relative_level=level, reference_count=self.reads.get(name, 0), has_qualifying_use=False, is_external=not level and module.split(".")[0] != package,
                        is_reexported=self.path.endswith("__init__.py") or a.asname == a.name, is_type_only=False, has_documented_side_effect="noqa" in self.lines[node.lineno - 1], is_relative=level > 0, is_project_owned=level > 0 or module.split(".")[0] == package, is_sole_binding=len(node.names) == 1,
                        has_private_module_component=any(map(private, module.split("."))), is_private_member=private(member), is_private_uppercase_constant=private(member) and member.isupper(), is_wildcard=a.name == "*",
                    )

    def comments(self) -> Iterator[dict]:
        groups: list[list[tuple[int, str]]] = []
        for t in tokenize.generate_tokens(io.StringIO(self.text).readline):
            if t.type == tokenize.COMMENT:
                alone = not self.lines[t.start[0] - 1][: t.start[1]].strip()
                if groups and alone and groups[-1][-1][0] == t.start[0] - 1 and not self.lines[t.start[0] - 2].split("#")[0].strip():
                    groups[-1].append((t.start[0], t.string.lstrip("# ")))
                else:
                    groups.append([(t.start[0], t.string.lstrip("# "))])
        rows = []
        for g in groups:
            text = "\n".join(x for _, x in g)
            try:
                parsed = ast.parse(text)
                source = bool(parsed.body) and not all(isinstance(s, ast.Expr) and isinstance(s.value, (ast.Name, ast.Constant, ast.Tuple, ast.Compare, ast.BinOp)) or isinstance(s, ast.AnnAssign) and s.value is None for s in parsed.body)
            except (SyntaxError, ValueError):
                source = False
            rows.append({"text": text, "preceding_source": "", "following_source": "", "is_documentation": False, "line_count": len(g), "character_count": len(text), "token_count": len(text.split()), "parses_as_source": source, "is_directive": text.startswith(("type:", "noqa", "pragma", "!", "fmt:")), "node": {"path": self.path, "start_line": g[0][0], "start_column": 0, "end_line": g[-1][0], "end_column": 0, "kind": "comment"}})
        yield self.fact("comment", self.module, groups=rows)

    def tries(self) -> Iterator[dict]:
        size = lambda body: sum(isinstance(n, ast.stmt) for s in body for n in ast.walk(s))
        rows = []
        for t in ast.walk(self.tree):
            if isinstance(t, (ast.Try, ast.TryStar)):
                leading = 0
                for s in t.body:
                    if not (isinstance(s, ast.Assign) and isinstance(s.value, ast.Constant) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name)):
                        break
                    leading += 1
                none = lambda h: len(h.body) == 1 and isinstance(h.body[0], ast.Return) and (h.body[0].value is None or isinstance(h.body[0].value, ast.Constant) and h.body[0].value.value is None)
                rows.append({
                    "line": t.lineno, "leading_literal_assignment_count": leading, "has_following_raising_operation": leading < len(t.body) and any(isinstance(n, ast.Call) for n in ast.walk(t.body[leading])), "clause_statement_counts": [size(b) for b in (t.body, *(h.body for h in t.handlers), t.orelse, t.finalbody) if b],
                    "handlers": [{"caught": ast.unparse(h.type) if h.type else "", "caught_is_tuple": isinstance(h.type, ast.Tuple), "alias": h.name or "", "returns_none": none(h)} for h in t.handlers], "protected_is_single_value_return": len(t.body) == 1 and isinstance(t.body[0], ast.Return) and t.body[0].value is not None,
                    "has_else": bool(t.orelse), "has_finally": bool(t.finalbody), "is_exception_group": isinstance(t, ast.TryStar),
                })
        yield self.fact("try", self.module, regions=rows)

    def comprehensions(self) -> Iterator[dict]:
        loops = [len(n.generators) for n in ast.walk(self.tree) if isinstance(n, (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp))]
        yield self.fact("comprehension", self.module, loop_counts=loops, set_loop_candidates=[])

    def syntax(self) -> Iterator[dict]:
        for top in self.tree.body:
            if isinstance(top, (*_FUNCTIONS, ast.ClassDef)):
                nodes: list[dict] = []

                def visit(n: ast.AST, parent: str, depth: int) -> None:
                    kind = _KINDS.get(type(n).__name__)
                    here = parent
                    row = None
                    if kind:
                        at = len(nodes)
                        here = str(at)
                        name = self.qualified(n.func) if isinstance(n, ast.Call) else n.id if isinstance(n, ast.Name) else getattr(n, "name", None) or getattr(n, "arg", None) or ""
                        if isinstance(n, (ast.Assign, ast.AnnAssign, ast.NamedExpr)):
                            target = n.targets[0] if isinstance(n, ast.Assign) else n.target
                            name = target.id if isinstance(target, ast.Name) else getattr(target, "attr", "")
                        if isinstance(n, ast.withitem):
                            name = n.optional_vars.id if isinstance(n.optional_vars, ast.Name) else ""
                        text = ast.get_source_segment(self.text, n) if hasattr(n, "lineno") else ""
                        row = {"node_id": here, "parent_id": parent, "ordinal": at, "subtree_end": 0, "depth": depth, "kind": kind, "name": name, "text": text or "", "line": getattr(n, "lineno", top.lineno)}
                        nodes.append(row)
                    for d in getattr(n, "decorator_list", []):
                        nodes.append({"node_id": str(len(nodes)), "parent_id": here, "ordinal": len(nodes), "subtree_end": len(nodes) + 1, "depth": depth + 1, "kind": "decorator", "name": _names(d), "text": ast.unparse(d), "line": d.lineno})
                    if isinstance(n, ast.If):
                        visit(n.test, here, depth + 1)
                        for part in (n.body, n.orelse):
                            if part:
                                at = len(nodes)
                                nodes.append({"node_id": str(at), "parent_id": here, "ordinal": at, "subtree_end": 0, "depth": depth + 1, "kind": "block", "name": "", "text": "", "line": part[0].lineno})
                                for s in part:
                                    visit(s, str(at), depth + 2)
                                nodes[at]["subtree_end"] = len(nodes)
                    else:
                        for child in ast.iter_child_nodes(n):
                            if child not in getattr(n, "decorator_list", []):
                                visit(child, here, depth + (kind is not None))
                    if row:
                        row["subtree_end"] = len(nodes)

                visit(top, "", 0)
                yield self.fact("syntax", top.name, top, qualname=top.name, kind="class" if isinstance(top, ast.ClassDef) else "function", source=ast.get_source_segment(self.text, top), nodes=nodes)


_METHODS = dict(zip(FAMILIES, ("modules", "functions", "classes", "calls", "imports", "comments", "tries", "comprehensions", "syntax")))


def facts_of(path: str, text: str, family: str) -> list[dict]:
    """Facts of one family of a file; none of a file that does not parse."""
    try:
        return list(getattr(_File(path, text), _METHODS[family])())
    except (SyntaxError, ValueError, RecursionError, tokenize.TokenError):
        return []


def extracted(files: DataFrame, family: str) -> DataFrame:
    """Facts of one family from scanned files (``path``, ``text``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"fact": [json.dumps(f) for p, t in zip(batch["path"], batch["text"]) for f in facts_of(p, t, family)]}, dtype=object)

    rows = files.where("language = 'python'").select("path", "text").mapInPandas(run, "fact string")
    return rows.select(F.from_json("fact", schema(family)).alias("f")).select("f.*")
