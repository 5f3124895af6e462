"""Rules on resolved calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.plans.rules import counted, rule
from factloom.rules.common import about, any_of, col, last_name, one_of


def _line(c: Column) -> Column:
    return c["node"]["start_line"]


def _calls(where, text: str):
    return counted(col("calls"), where, about(text, "qualified_name"), _line, lambda c: F.coalesce(c["path"], F.col("path")))


def _named(c: Column, *names: str) -> Column:
    return c["qualified_name"].isin(*names)


def _resolved(c: Column) -> Column:
    return ~F.coalesce(c["is_shadowed"], F.lit(False)) & ~F.coalesce(c["has_ambiguous_alias"], F.lit(False))


def _first(c: Column) -> Column:
    return F.get(c["arguments"], 0)


@rule("ALL-CALL0001", "Call")
def unchecked_result_call(checked_callables: tuple = (), checked_prefixes: tuple = ()):
    def checked(c):
        prefixed = F.lit(False)
        for p in checked_prefixes:
            prefixed = prefixed | c["qualified_name"].startswith(p)
        return (one_of(c["qualified_name"], checked_callables) | prefixed) & c["result_is_discarded"]

    return _calls(checked, "result is discarded:")


@rule("ALL-CALL0002", "Call")
def unbounded_blocking_call(bounded_callables: tuple = (), bound_names: tuple = ("timeout", "deadline", "duration")):
    return _calls(lambda c: one_of(c["qualified_name"], bounded_callables) & ~any_of(c["keyword_names"], bound_names) & ~c["has_starred_arguments"], "can wait for ever:")


@rule("ALL-DEPE0003", "Call", over_facts=True)
def repeated_external_unary_transformation(facts, minimum_repetitions: int = 3, minimum_files: int = 2, ignored_callables: tuple = (), first_party_modules: tuple = (), transformation_names: tuple = ("camelize", "canonicalize", "convert", "decode", "deserialize", "encode", "normalize", "parse", "sanitize", "serialize", "slugify", "underscore")):
    """Counts by callable come from sums over all files, so a callable is one row a partition in the shuffle."""
    calls = facts["Call"].select("fact_id", "path", F.explode("calls").alias("c"))
    unary = (F.size("c.arguments") == 1) & (F.size(F.coalesce("c.keyword_names", F.array())) == 0)
    chosen = calls.where(F.col("c.is_external") & ~F.col("c.is_standard_library") & unary & last_name(F.col("c.qualified_name")).isin(*transformation_names) & ~one_of(F.col("c.qualified_name"), ignored_callables) & ~one_of(F.split("c.qualified_name", r"\.")[0], first_party_modules))
    by_file = chosen.groupBy(F.col("c.qualified_name").alias("callable"), "path").count()
    repeated = by_file.groupBy("callable").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("files")).where((F.col("n") >= minimum_repetitions) & (F.col("files") >= minimum_files))
    rows = chosen.select("fact_id", F.col("c.qualified_name").alias("callable"), F.col("c.node.start_line").alias("line")).join(repeated, "callable").groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("line", "callable"))).alias("found"))
    joined = facts["Call"].select("fact_id", "path", "language", "start_line").join(rows, "fact_id", "left")
    return joined, counted(col("found"), lambda x: F.lit(True), about("repeated transformation:", "callable"), lambda x: x["line"])


@rule("PY-ASYN0001", "Call", languages=("python",))
def asyncio_run_boundary():
    return _calls(lambda c: _named(c, "asyncio.run") & _resolved(c), "asynchronous boundary:")


@rule("PY-ASYN0003", "Call", languages=("python",))
def deprecated_event_loop_policy_usage(python_minor: int = 14):
    names = ("get_event_loop_policy", "set_event_loop_policy", "AbstractEventLoopPolicy", "DefaultEventLoopPolicy", "WindowsSelectorEventLoopPolicy", "WindowsProactorEventLoopPolicy")
    return _calls(lambda c: F.lit(python_minor >= 14) & _named(c, *[f"asyncio.{n}" for n in names]), "deprecated policy:")


@rule("PY-ASYN0004", "Call", languages=("python",))
def default_executor_to_thread_candidate(python_minor: int = 14):
    return _calls(lambda c: F.lit(python_minor >= 9) & c["qualified_name"].endswith(".run_in_executor") & (_first(c)["text"] == "None") & (F.size(c["arguments"]) >= 2), "asyncio.to_thread would do:")


@rule("PY-ASYN0005", "Call", fix="safe", languages=("python",))
def deprecated_asyncio_coroutine_function_check(python_minor: int = 14):
    return _calls(lambda c: F.lit(python_minor >= 14) & _named(c, "asyncio.iscoroutinefunction"), "deprecated alias:")


@rule("PY-CLAS0008", "Call", languages=("python",))
def direct_method_descriptor_call_count():
    return _calls(lambda c: _named(c, "staticmethod", "classmethod", "builtins.staticmethod", "builtins.classmethod") & _resolved(c), "descriptor without decorator:")


@rule("PY-CLI0001", "Call", languages=("python",))
def argparse_cli_construction():
    return _calls(lambda c: _named(c, "argparse.ArgumentParser"), "parser built by hand:")


@rule("PY-COLL0004", "Call", fix="review", languages=("python",))
def explicit_tuple_construction():
    return _calls(lambda c: _named(c, "tuple", "frozenset", "builtins.tuple", "builtins.frozenset") & _resolved(c), "immutable collection:")


@rule("PY-CUDA0001", "Call", languages=("python",))
def direct_cuda_core_lifecycle_construction():
    return _calls(lambda c: c["qualified_name"].rlike(r"^cuda\.core(\.experimental)?\.(Stream|Context)$"), "unsupported construction:")


@rule("PY-CUDA0002", "Call", languages=("python",))
def legacy_default_stream_launch():
    return _calls(lambda c: c["qualified_name"].rlike(r"^cuda\.core(\.experimental)?\.launch$") & last_name(_first(c)["text"]).isin("LEGACY_DEFAULT_STREAM"), "launch on the legacy stream:")


def _streams(pattern: str) -> Column:
    """Whether the module creates a stream."""
    return F.exists("calls", lambda c: c["qualified_name"].rlike(pattern))


def _in_stream_scope(creates: str, pattern: str, text: str, more=lambda c: F.lit(True)):
    return counted(F.when(_streams(creates), col("calls")), lambda c: c["qualified_name"].rlike(pattern) & more(c), about(text, "qualified_name"), _line)


@rule("PY-CUDA0003", "Call", languages=("python",))
def device_wide_synchronization_in_stream_scope():
    return _in_stream_scope(r"^cuda\..*(create_stream|[sS]treamCreate)", r"(^|\.)(cudaDeviceSynchronize|cuCtxSynchronize)$", "waits for every stream:")


@rule("PY-CUDA0004", "Call", languages=("python",))
def blocking_raw_memory_operation_in_stream_scope():
    return _in_stream_scope(r"^cuda\..*(create_stream|[sS]treamCreate)", r"^cuda\.bindings\..*\.(cudaMalloc|cudaMemcpy|cudaFree|cuMemAlloc|cuMemcpy|cuMemFree)$", "blocks the stream:")


_NUMBA = r"^numba\.cuda\.(stream|external_stream|default_stream|per_thread_default_stream)$"


@rule("PY-NUMB0005", "Call", languages=("python",))
def synchronous_transfer_in_numba_stream_scope():
    return _in_stream_scope(_NUMBA, r"(^numba\.cuda\.(to_device|device_array))$|\.(to_device|copy_to_device|copy_to_host)$", "synchronous transfer:", lambda c: ~any_of(c["keyword_names"], ("stream",)))


@rule("PY-NUMB0007", "Call", languages=("python",))
def device_wide_numba_synchronization_in_stream_scope():
    return _in_stream_scope(_NUMBA, r"^numba\.cuda\.synchronize$", "waits for every stream:")


@rule("PY-LOGG0001", "Call", languages=("python",))
def logger_boundary_bypass_count(preferred_logger: str = "common.log.logger", direct_logger_symbols: tuple = ("logging.Logger", "logging.LoggerAdapter", "logging.getLogger", "logging.debug", "logging.info", "logging.warning", "logging.error", "logging.exception", "logging.critical", "logging.fatal", "logging.log", "loguru.logger", "structlog.get_logger")):
    module = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", ".")
    owns = F.lit(preferred_logger).startswith(module)
    return counted(F.when(~owns, col("calls")), lambda c: one_of(c["qualified_name"], direct_logger_symbols) | c["qualified_name"].startswith("loguru.logger."), about("logger outside the boundary:", "qualified_name"), _line)


@rule("PY-PYDA0004", "Call", fix="safe", languages=("python",))
def redundant_model_validate():
    sole = lambda c: (F.size(c["arguments"]) == 1) & (F.size(F.coalesce(c["keyword_names"], F.array())) == 0)
    return _calls(lambda c: c["qualified_name"].endswith(".model_validate") & sole(c) & ((_first(c)["literal_kind"] == "mapping") | _first(c)["text"].rlike(r"^dict\(\s*[A-Za-z_]\w*\s*=")), "spells out a constructor:")


@rule("PY-TYPE0005", "Call", languages=("python",))
def repeated_cast_patterns(minimum_repetitions: int = 3):
    """Casts of one target and producer; names and literals of the producer don't count."""
    casts = F.filter("calls", lambda c: _named(c, "typing.cast", "typing_extensions.cast"))
    keyed = F.transform(casts, lambda c: F.struct(F.concat_ws(" ", _first(c)["text"], F.regexp_replace(F.get(c["arguments"], 1)["text"], r"""'[^']*'|"[^"]*"|\b[0-9]+\b""", "_")).alias("key"), c["qualified_name"].alias("qualified_name"), c["node"].alias("node")))
    return counted(keyed, lambda c: F.size(F.filter(keyed, lambda o: o["key"] == c["key"])) >= minimum_repetitions, about("repeated cast:", "key"), _line)


@rule("PY-TYPE0008", "Call", fix="safe", languages=("python",))
def redundant_boolean_conversion():
    boolean = lambda a: (a["resolved_type"] == "bool") | (a["literal_kind"] == "boolean") | a["text"].rlike(r"^not\s|[^=!<>](==|!=|<=|>=|<|>)[^=]|\sin\s|\sis\s")
    return _calls(lambda c: _named(c, "bool", "builtins.bool") & _resolved(c) & (F.size(c["arguments"]) == 1) & F.coalesce(boolean(_first(c)), F.lit(False)), "already Boolean:")


@rule("PY-PERF0001", "Call", languages=("python",))
def tensor_interoperability_round_trip_count():
    destination = r"^(torch\.(tensor|as_tensor|from_numpy)|torch\.utils\.dlpack\.from_dlpack|cupy\.(asarray|array|from_dlpack)|cudf\.(from_pandas|DataFrame))$"
    return _calls(lambda c: c["qualified_name"].rlike(destination) & _first(c)["text"].rlike(r"\.(cpu|numpy|to_pandas|to_dlpack)\(\)|asnumpy\("), "round trip:")


@rule("PY-TORC0001", "Call", fix="safe", languages=("python",))
def fluent_tensor_call_chain(minimum_operations: int = 2):
    names = "abs|exp|log|sqrt|relu|sigmoid|tanh|sum|mean|squeeze|unsqueeze|flatten|transpose|reshape|softmax|clamp"
    depth = lambda c: F.size(F.regexp_extract_all(F.concat(c["qualified_name"], F.lit("("), _first(c)["text"]), F.lit(rf"\btorch\.(?:{names})\("), F.lit(0)))
    return _calls(lambda c: c["qualified_name"].rlike(rf"^torch\.({names})$") & (depth(c) >= minimum_operations), "nested tensor calls:")


@rule("CU-LAUN0001", "Call", languages=("cuda",))
def raw_barrier_over_cooperative_groups():
    return _calls(lambda c: c["qualified_name"].rlike(r"^__(syncthreads(_and|_or|_count)?|syncwarp|shfl(_up|_down|_xor)?_sync|ballot_sync|any_sync|all_sync)$"), "raw barrier:")


@rule("CU-MEMO0001", "Call", languages=("cuda",))
def synchronous_transfer_in_stream_scope():
    return _in_stream_scope(r"^(cudaStreamCreate|cuStreamCreate|cudaMemcpyAsync)", r"^(cudaMemcpy|cudaMemset|cudaMemcpy2D|cudaMemcpyToSymbol|cudaMemcpyFromSymbol)$", "synchronous transfer:")
