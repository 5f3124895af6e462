"""Rules on syntax trees.

Nodes are listed in preorder, so that what stands below a node is a range of ordinals."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.plans.rules import counted, flagged, rule, say
from factloom.rules.common import about, col, last_name, one_of

# Settings name kinds of nodes as rules state them; parsers name them more narrowly.
_NARROWER = {
    "except": ("except_handler", "except_clause", "handler"), "catch": ("catch_clause",), "raise": ("raise_statement",), "throw": ("throw_statement",),
    "pass": ("pass_statement", "empty_statement", "comment"), "continue": ("continue_statement",), "...": (),
    "name": ("identifier",), "member": ("attribute",), "literal": ("constant",), "collection": ("list", "tuple", "dict", "set"), "operation": ("compare", "binary_operator"),
    "branch": ("if", "if_statement", "match", "switch_statement"), "loop": ("for", "for_statement", "while", "while_statement"), "guard": ("try", "try_statement", "with"), "scope": ("function", "class"),
}


def _kinds(names: tuple) -> tuple:
    """The kinds that settings mean."""
    return tuple(k for n in names for k in (n, *_NARROWER.get(n, ())))


_HANDLERS = ("except", "catch", "rescue")
_GUARDS = ("try", "try_statement")
_RAISES = ("raise", "throw")
_BODIES = ("branch", "loop", "guard", "scope")


def _below(n: Column) -> Column:
    """Nodes inside a node."""
    return F.filter("nodes", lambda x: (x["ordinal"] > n["ordinal"]) & (x["ordinal"] < n["subtree_end"]))


def _children(n: Column) -> Column:
    return F.filter("nodes", lambda x: x["parent_id"] == n["node_id"])


def _of(*kinds: str) -> Column:
    return F.filter("nodes", lambda n: n["kind"].isin(*kinds))


def _line(n: Column) -> Column:
    return n["line"]


def _calls(names: Column | str) -> Column:
    return F.filter(_of("call", "call_expression"), lambda n: n["name"].rlike(names) if isinstance(names, str) else names)


@rule("ALL-CONT0001", "Syntax")
def superfluous_else_after_jump(jumps: tuple = ("return", "raise", "throw", "break", "continue", "panic!")):
    """A branch has its test, its block, then its alternative as children in order."""

    def jumped(n):
        blocks = F.filter(_children(n), lambda c: c["kind"].isin("block", "else", "else_clause"))
        last = F.try_element_at(F.filter("nodes", lambda x: x["parent_id"] == F.get(blocks, 0)["node_id"]), F.lit(-1))
        return (F.size(blocks) > 1) & last["kind"].rlike("^(" + "|".join(jumps) + ")(_statement)?$")

    return counted(_of("if", "if_statement"), jumped, about("else after a jump"), _line)


@rule("ALL-CONT0002", "Syntax")
def statement_without_effect(inert_kinds: tuple = ("name", "member", "literal", "collection", "operation")):
    def inert(n):
        children = _children(n)
        return (F.size(children) == 1) & one_of(F.get(children, 0)["kind"], _kinds(inert_kinds)) & ~(F.get(children, 0)["text"].rlike(r"""^([rbuf]*["']|\.\.\.)"""))

    return counted(_of("expr", "expression_statement"), inert, about("computed and thrown away:", "text"), _line)


@rule("ALL-CONT0003", "Syntax")
def debug_artifact_left_behind(
    artifacts: tuple = ("print", "printf", "println!", "eprintln!", "dbg!", "console.log", "console.debug", "breakpoint", "debugger", "pdb.set_trace", "set_trace"),
    exempt_segments: tuple = ("test", "tests", "cli", "main", "bin", "script", "scripts", "example", "examples"),
):
    """A node without a name is searched for the words of its text, unless nodes below it are."""
    exempt = F.lower("path").rlike(r"(^|[\\/._-])(" + "|".join(map(re.escape, exempt_segments)) + r")($|[\\/._-])")
    words = lambda n: F.transform(F.filter(F.regexp_extract_all(n["text"], F.lit(r"[A-Za-z_][A-Za-z0-9_.]*!?"), F.lit(0)), lambda w: one_of(w, artifacts)), lambda w: F.struct(w.alias("name"), n["line"].alias("line")))
    named = lambda n: F.when(one_of(n["name"], artifacts) | (n["kind"] == "debugger_statement"), F.array(F.struct(n["name"].alias("name"), n["line"].alias("line"))))
    bare = lambda n: (F.coalesce(n["name"], F.lit("")) == "") & (F.size(_children(n)) == 0)
    nodes = _of("call", "call_expression", "debugger_statement", "macro_invocation", "effect", "expression")
    found = F.flatten(F.transform(nodes, lambda n: F.coalesce(F.when(bare(n) & (n["kind"] != "debugger_statement"), words(n)).otherwise(named(n)), F.array())))
    return counted(F.when(~exempt, found), lambda n: F.lit(True), about("left behind:", "name"), _line)


@rule("ALL-CONT0004", "Syntax", kind="boolean")
def deeply_nested_body(maximum_depth: int = 3, body_kinds: tuple = _BODIES):
    bodies = _of(*_kinds(body_kinds))
    deep = F.exists(bodies, lambda n: F.size(F.filter(bodies, lambda o: (o["ordinal"] < n["ordinal"]) & (n["ordinal"] < o["subtree_end"]))) >= maximum_depth)
    return flagged(deep, say("bodies within bodies in ", col("qualname")))


@rule("ALL-ERRO0001", "Syntax")
def swallowed_error(handlers: tuple = _HANDLERS, inert: tuple = ("pass", "continue", "..."), discard: str = "_", failures_as_values: tuple = ("rust", "go")):
    """Where failures are values, an assignment to the discard name swallows one."""

    def silent(n):
        body = F.filter(_below(n), lambda x: x["depth"] == n["depth"] + 1)
        body = F.filter(body, lambda x: ~x["kind"].isin("name", "attribute", "tuple", "identifier", "catch_parameter"))
        body = F.flatten(F.transform(body, lambda x: F.when(x["kind"].isin("block", "statement_block"), _children(x)).otherwise(F.array(x))))
        return F.forall(body, lambda x: one_of(x["kind"], _kinds(inert)) | ((x["kind"] == "expr") & one_of(x["text"], inert)))

    dropped = F.when(col("language").isin(*failures_as_values), F.filter(_of("assign", "let_declaration", "assignment_statement", "short_var_declaration"), lambda n: n["name"] == discard)).otherwise(F.array())
    return counted(F.concat(F.filter(_of(*_kinds(handlers)), silent), F.coalesce(dropped, F.array())), lambda n: F.lit(True), about("failure is swallowed"), _line)


@rule("ALL-ERRO0002", "Syntax")
def raise_without_cause(handlers: tuple = _HANDLERS, raises: tuple = _RAISES, causes: tuple = ("from", "cause")):
    def causeless(h):
        alias = F.coalesce(F.nullif(h["name"], F.lit("")), F.lit("\0"))
        return F.filter(_below(h), lambda n: one_of(n["kind"], _kinds(raises)) & n["text"].rlike(r"\(") & ~n["text"].rlike(r"\b(" + "|".join(causes) + r")\b") & ~n["text"].contains(alias))

    return counted(F.flatten(F.transform(_of(*_kinds(handlers)), causeless)), lambda n: F.lit(True), about("raised without its cause:", "text"), _line)


def _raised(n: Column) -> Column:
    return F.regexp_extract(n["text"], r"^\s*(?:raise|throw)\s+(?:new\s+)?([\w.:]+)", 1)


@rule("ALL-ERRO0003", "Syntax")
def vanilla_error_type(base_errors: tuple = ("Exception", "BaseException", "Error", "Throwable", "RuntimeException", "std::exception")):
    return counted(_of(*_kinds(_RAISES)), lambda n: one_of(_raised(n), base_errors), about("base error raised:", "text"), _line)


@rule("ALL-ERRO0004", "Syntax")
def raise_inside_guarded_region(handlers: tuple = _HANDLERS, catch_all: tuple = ("Exception", "BaseException", "Error", "Throwable")):
    def caught(t):
        clauses = F.filter(_children(t), lambda c: one_of(c["kind"], _kinds(handlers)))
        first = F.coalesce(F.array_min(F.transform(clauses, lambda c: c["ordinal"])), t["subtree_end"])
        thrown = F.transform(F.filter(_below(t), lambda n: n["kind"].isin(*_kinds(_RAISES)) & (n["ordinal"] < first)), lambda n: last_name(_raised(n)))
        named = F.flatten(F.transform(clauses, lambda c: F.regexp_extract_all(F.regexp_extract(c["text"], r"^[^:{]*", 0), F.lit(r"\b[A-Z]\w*"), F.lit(0))))
        bare = F.exists(clauses, lambda c: c["text"].rlike(r"^\s*except\s*:"))
        return F.arrays_overlap(thrown, named) | ((F.size(thrown) > 0) & (bare | F.exists(named, lambda x: one_of(x, catch_all))))

    return counted(_of(*_GUARDS), caught, about("catches what it throws"), _line)


@rule("ALL-FUNC0011", "Syntax")
def reflective_scope_read(reflections: tuple = ("locals", "vars", "globals", "eval", "exec")):
    bare = lambda n: (n["name"] != "vars") | n["text"].rlike(r"^vars\(\s*\)")
    return counted(_of("call", "call_expression"), lambda n: one_of(n["name"], reflections) & bare(n), about("reads its scope reflectively:", "name"), _line)


@rule("ALL-NAMI0001", "Syntax")
def uninformative_local_name(minimum_length: int = 3, conventional: tuple = ("_", "i", "j", "k", "n", "x", "y", "z", "id", "ok", "db", "fd", "io", "ip", "os", "pk", "tz", "up", "to", "by")):
    bound = F.array_distinct(F.transform(F.filter(_of("assign", "ann_assign", "with_item", "named_expr", "variable_declarator", "let_declaration"), lambda n: F.length(n["name"]) > 0), lambda n: F.struct(n["name"].alias("name"), n["line"].alias("line"))))
    return counted(bound, lambda n: (F.length(n["name"]) < minimum_length) & ~one_of(n["name"], conventional), about("name says little:", "name"), _line)


@rule("ALL-SECU0002", "Syntax")
def weak_hashing_primitive(also_broken: tuple = (), factories: tuple = ("createhash", "getinstance", "newdigest")):
    names = "|".join(("md5", "md4", "md2", "sha1", "sha_1", "ripemd160", *also_broken))
    direct = lambda n: F.lower(n["name"]).rlike(rf"(^|[.:_])({names})$")
    made = lambda n: (one_of(F.lower(last_name(n["name"])), factories) | (n["name"] == "hashlib.new")) & F.lower(n["text"]).rlike(rf"""\(\s*["']({names}|sha-1)["']""")
    return counted(_of("call", "call_expression"), lambda n: (direct(n) | made(n)) & ~n["text"].contains("usedforsecurity=False"), about("broken hash:", "name"), _line)


_SECRET = ("password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "private_key", "credential", "auth_token", "nonce", "session_id")


@rule("ALL-SECU0003", "Syntax")
def unseeded_randomness_for_secrets(also_predictable: tuple = ()):
    predictable = r"^(random\.\w+|Math\.random|rand|np\.random\.\w+|numpy\.random\.\w+" + "".join("|" + p for p in also_predictable) + ")$"
    secret = lambda n: F.lower(n["name"]).rlike("|".join(_SECRET))
    return counted(F.flatten(F.transform(F.filter(_of("assign", "ann_assign", "variable_declarator", "let_declaration"), secret), lambda n: F.filter(_below(n), lambda c: c["kind"].isin("call", "call_expression")))), lambda c: c["name"].rlike(predictable) & ~c["name"].contains("SystemRandom"), about("secret from an ordinary generator:", "name"), _line)


@rule("ALL-SECU0004", "Syntax")
def credential_written_into_source(also_secret: tuple = ()):
    secret = lambda n: F.lower(n["name"]).rlike("(" + "|".join((*[s for s in _SECRET if s not in ("nonce", "session_id")], *also_secret)) + ")$")
    literal = lambda n: F.regexp_extract(n["text"], r"""=\s*[rbu]*["']([^"']*)["']\s*$""", 1)
    placeholder = lambda v: v.rlike(r"^$|^<.*>$|^\$\{|^(changeme|example|test|dummy|placeholder|xxx+|none|null|\*+)$|\{[^}]*\}") | (F.length(v) < 4)
    return counted(_of("assign", "ann_assign", "keyword", "parameter", "default_parameter", "variable_declarator"), lambda n: secret(n) & ~placeholder(F.lower(literal(n))), about("credential in the source:", "name"), _line)


@rule("ALL-SECU0005", "Syntax")
def command_built_from_a_shell_string(also_through_a_shell: tuple = ()):
    shells = ("os.system", "os.popen", "subprocess.getoutput", "subprocess.getstatusoutput", "commands.getoutput", "child_process.exec", "execSync", "system", "popen", *also_through_a_shell)
    return counted(_of("call", "call_expression"), lambda n: one_of(n["name"], shells) | (n["name"].rlike(r"(^|\.)(run|call|check_call|check_output|Popen|spawn)$") & n["text"].rlike(r"shell\s*[=:]\s*[tT]rue")), about("through a shell:", "name"), _line)


@rule("PY-CLAS0010", "Syntax", languages=("python",))
def dynamic_super_receiver():
    return counted(_of("call"), lambda n: (n["name"] == "super") & n["text"].rlike(r"^super\(\s*(type\(\s*\w+\s*\)|\w+\.__class__)\s*,"), about("super on the receiver's own type"), _line)



def _kernel() -> Column:
    """Whether the declaration is compiled as a kernel, not as a device function."""
    return F.exists(_of("decorator"), lambda d: d["text"].rlike(r"cuda\.jit\b") & ~d["text"].rlike(r"device\s*=\s*True")) & (col("kind") == "function")


@rule("PY-NUMB0001", "Syntax", languages=("python",))
def kernel_return_value():
    return counted(F.when(_kernel(), _of("return")), lambda n: n["text"].rlike(r"^return\s+\S") & (n["text"] != "return None"), about("kernel returns a value"), _line)


@rule("PY-NUMB0002", "Syntax", languages=("python",))
def conditional_block_barrier():
    divergent = _of("if", "for", "while")
    return counted(F.when(_kernel(), _of("call")), lambda n: n["name"].rlike(r"(^|\.)syncthreads$") & F.exists(divergent, lambda o: (o["ordinal"] < n["ordinal"]) & (n["ordinal"] < o["subtree_end"])), about("barrier in divergent flow"), _line)


@rule("PY-NUMB0003", "Syntax", languages=("python",))
def unguarded_grid_index():
    grids = F.filter(_of("assign"), lambda n: n["text"].rlike(r"=\s*cuda\.grid\("))
    guarded = lambda n: F.exists(_of("if", "for", "while"), lambda o: F.rlike(F.regexp_extract(o["text"], r"^[^:]*", 0), F.concat(F.lit(r"\b"), n["name"], F.lit(r"\b"))))
    return counted(F.when(_kernel(), grids), lambda n: ~guarded(n), about("index without a bound:", "name"), _line)


@rule("PY-NUMB0004", "Syntax", languages=("python",))
def dynamic_kernel_array_shape():
    """The shape of a local or shared array is a parameter of its kernel."""
    names = F.transform(_of("parameter"), lambda p: p["name"])
    shape = lambda n: F.regexp_extract(n["text"], r"\(\s*(?:shape\s*=\s*)?\(?\s*(\w+)", 1)
    return counted(F.when(_kernel(), _of("call")), lambda n: n["name"].rlike(r"(^|\.)(local|shared)\.array$") & F.array_contains(names, shape(n)), about("shape is a parameter:", "name"), _line)


@rule("PY-NUMB0006", "Syntax", languages=("python",))
def default_stream_numba_kernel_launch():
    """A launch gives grid and block alone, in a declaration that makes a stream."""
    streams = F.exists(_of("call"), lambda c: c["name"].rlike(r"(^|\.)cuda\.stream$"))
    launch = lambda n: n["text"].rlike(r"^\w+\[[^\[\],]+,[^\[\],]+\]\(")
    return counted(F.when(streams, _of("call")), launch, about("launch names no stream"), _line)
