"""Rules on Rust, TypeScript and CUDA surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.numbers import percentage
from factloom.plans.policy import Numeric
from factloom.plans.rules import counted, flagged, gauged, measured, rule, say
from factloom.rules.common import about, col, filled


def _line(x):
    return x["line"]


@rule("RS-LIFE0001", "RustSurface", languages=("rust",))
def elidable_lifetime_annotation():
    """One lifetime, in one input or the receiver, that nothing else needs: elision says the same."""

    def elidable(a):
        name = F.get(a["names"], 0)
        inputs = F.size(F.filter(a["parameters"], lambda p: p == name))
        free = ~filled(a["beyond"]) & ~filled(a["required_by_syntax"])
        returned = ~filled(a["returned"]) | (a["receiver"] == name) | ((inputs == 1) & (F.size(a["parameters"]) == 1))
        return a["kind"].isin("function", "method") & (F.size(a["names"]) == 1) & free & (inputs <= 1) & returned

    return counted(col("annotations"), elidable, about("elision says the same:", "owner"), _line)


@rule("RS-LIFE0002", "RustSurface", languages=("rust",))
def demanded_static_lifetime():
    return counted(col("pins"), lambda p: p["position"] == "demand", about("demands data for the whole run:", "owner"), _line)


@rule("RS-LIFE0003", "RustSurface", policy=Numeric(maximum=2), languages=("rust",))
def lifetime_annotation_count():
    return counted(col("annotations"), lambda a: filled(a["names"]), about("names a lifetime:", "owner"), _line)


@rule("RS-OWNE0001", "RustSurface", policy=Numeric(), languages=("rust",))
def clone_inside_loop():
    return counted(col("clones"), lambda c: c["loop_depth"] > 0, about("copy in a loop:", "receiver"), _line)


@rule("RS-OWNE0002", "RustSurface", policy=Numeric(), languages=("rust",))
def clone_call_count():
    return counted(col("clones"), lambda c: F.lit(True), about("copy:", "receiver"), _line)


@rule("TS-MODU0001", "ModuleSurface", languages=("typescript",))
def star_reexport_surface():
    return counted(F.transform("star_reexports", lambda s: F.struct(s.alias("source"))), lambda x: F.lit(True), about("publishes all of", "source"))


@rule("TS-MODU0002", "ModuleSurface", policy=Numeric(maximum=1), languages=("typescript",))
def relative_import_depth():
    return measured(col("deepest_relative_import"), say("climbs out to ", col("deepest_relative_specifier")), "folders")


@rule("TS-TYPE0001", "ModuleSurface", policy=Numeric(maximum=0), languages=("typescript",))
def non_erasable_construct():
    return counted(col("erasable_violations"), lambda x: F.lit(True), about("survives type stripping:", "kind", "name"), _line)


@rule("TS-TYPE0002", "ModuleSurface", kind="float", policy=Numeric(maximum=2), languages=("typescript",))
def escape_hatch_density():
    lines = F.size(F.array_distinct(F.transform("escape_hatches", _line)))
    return gauged(percentage(lines, F.coalesce("physical_line_count", F.lit(0))), say("lines around the types: ", lines))


@rule("CU-LAUN0002", "KernelLaunch", kind="boolean", languages=("cuda",))
def default_stream_kernel_launch():
    none = F.coalesce(F.trim("stream"), F.lit("")).isin("", "0", "NULL", "nullptr", "cudaStreamLegacy")
    return flagged(col("unit_uses_streams") & none, say("launch names no stream: ", col("kernel")))
