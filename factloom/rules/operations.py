"""Rules on operations: alerts, changes, deployment, dependencies, objectives, automation."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.plans.policy import Category, Numeric
from factloom.plans.rules import categorized, counted, flagged, gauged, rule, say, shared
from factloom.rules.common import about, any_of, col, filled, given, one_of

MOST = Numeric(minimum=95)
GATES = ("lint", "typecheck", "test")
TASKS = ("setup", "lint", "typecheck", "test", "build")
CAPABILITIES = ("setup", "test", "architecture", "debug", "contribute")


@rule("ALL-ARCH0001", "ArchitectureCharacteristic", kind="float", policy=MOST)
def architecture_fitness_coverage(require_ci: bool = True, maximum_age_days: int = 30):
    def protected(x):
        fresh = x["observation_age_days"] <= maximum_age_days
        checked = x["verification"] == "ci" if require_ci else x["verification"] != "none"
        return given(x["objective"]) & given(x["check"]) & given(x["retained_result"]) & given(x["owner"]) & given(x["scope"]) & fresh & checked

    return shared(col("characteristics"), protected, about("no current executable evidence for", "name"))


@rule("ALL-CI0001", "CIConfiguration", kind="category", policy=Category(frozenset({"complete"}), frozenset({"partial"}), frozenset({"fragile", "absent"})))
def continuous_integration(required_tasks: tuple = GATES):
    """Blocking workflows that run a required task are the gates; all of them must be sound."""
    gates = F.filter(F.coalesce("workflows", F.array()), lambda w: w["is_change_blocking"] & any_of(w["tasks"], required_tasks))
    tasks = F.flatten(F.transform(gates, lambda w: w["tasks"]))
    present = F.size(F.array_intersect(F.array(*[F.lit(t) for t in required_tasks]).cast("array<string>"), tasks))
    sound = F.forall(gates, lambda w: w["uses_locked_dependencies"] & w["has_explicit_permissions"] & w["cancels_superseded_runs"])
    cases = [(present == 0, "absent"), (present < len(required_tasks), "partial"), (sound, "complete")]
    return categorized(cases, "fragile", say("required tasks with a blocking workflow: ", present))


@rule("ALL-CI0002", "CICheck", kind="float", policy=MOST)
def feedback_target_coverage(target_seconds: int = 600, percentile: float = 0.9):
    required = F.filter("checks", lambda x: x["is_required"])
    return shared(required, lambda x: (x["duration_percentile_seconds"] <= target_seconds) & (x["percentile"] >= percentile), about("feedback is slower than its target:", "name"))


@rule("ALL-DEPE0001", "Dependency", kind="float", policy=Numeric(maximum=5))
def dependency_technical_lag(maximum_release_lag_days: int = 180, include_development: bool = False):
    known = F.filter("dependencies", lambda x: x["resolved_release_day"].isNotNull() & x["latest_compatible_release_day"].isNotNull() & (F.lit(include_development) | ~x["is_development"]))
    return shared(known, lambda x: x["latest_compatible_release_day"] - x["resolved_release_day"] > maximum_release_lag_days, about("lags its latest compatible release:", "name"), complete=False)


@rule("ALL-DEPE0002", "Dependency")
def explicit_dependency_state_count(include_yanked: bool = True):
    adverse = lambda x: one_of(x["project_state"], ("archived", "deprecated", "quarantined")) | (x["repository_state"] == "archived") | (F.lit(include_yanked) & (x["resolved_release_state"] == "yanked"))
    return counted(col("dependencies"), adverse, about("adverse upstream state:", "name", "project_state"))


@rule("ALL-DEPE0004", "Dependency", kind="float", policy=Numeric(maximum=5))
def dependency_evidence_gap_percentage():
    gap = lambda x: x["resolved_release_day"].isNull() | x["latest_compatible_version"].isNull() | x["latest_compatible_release_day"].isNull()
    return shared(col("dependencies"), gap, about("release evidence is missing for", "name"), complete=False)


@rule("ALL-DEPL0001", "Deployment", kind="category", policy=Category(frozenset({"reproducible"}), frozenset({"not_applicable"}), frozenset({"partial", "nonreproducible"})))
def deployment_reproducibility(require_provenance: bool = True):
    parts = [filled(col("locked_inputs")), given(col("build_command")), given(col("environment")), given(col("artifact_identity")), filled(col("migrations")), filled(col("configuration_sources")), given(col("secrets_boundary")), given(col("rollback_command"))]
    parts += [given(col("provenance"))] if require_provenance else []
    stated = sum((p.cast("int") for p in parts), F.lit(0))
    cases = [(~F.coalesce("is_applicable", F.lit(False)), "not_applicable"), (stated == len(parts), "reproducible"), (stated == 0, "nonreproducible")]
    return categorized(cases, "partial", say("declared parts of a repeatable deployment: ", stated))


@rule("ALL-LIFE0001", "AutomationTask", kind="boolean")
def project_automation(required_tasks: tuple = TASKS):
    whole = F.filter("tasks", lambda x: (F.size("tasks") > 0) & (F.size(x["commands"]) == 1) & x["is_repository_owned"] & x["is_noninteractive"])
    missing = F.array_except(F.array(*[F.lit(t) for t in required_tasks]), F.transform(whole, lambda x: x["capability"]))
    return flagged(F.size(missing) > 0, say("no canonical task for ", F.array_join(missing, ", ")))


@rule("ALL-ONBO0001", "AutomationTask", kind="float", policy=MOST)
def onboarding_readiness(required_capabilities: tuple = CAPABILITIES):
    wanted = F.transform(F.array(*[F.lit(c) for c in required_capabilities]), lambda c: F.struct(c.alias("name")))
    return shared(wanted, lambda c: F.exists("tasks", lambda x: (x["capability"] == c["name"]) & (F.size(x["commands"]) == 1) & filled(x["guidance_locations"]) & x["is_repository_owned"] & x["is_noninteractive"]), about("a newcomer can't verify", "name"))


@rule("ALL-LIFE0002", "FeatureFlag")
def feature_flag_debt(maximum_age_days: int = 90, permanent_labels: tuple = ("operational", "permission")):
    kept = lambda x: one_of(x["role"], permanent_labels) & given(x["owner"]) & filled(x["tested_states"]) & given(x["cleanup_plan"])
    return counted(col("flags"), lambda x: F.coalesce(x["decision_due_days"] <= 0, F.lit(False)) | ((x["age_days"] > maximum_age_days) & ~kept(x)), about("flag without a current decision:", "name"))


@rule("ALL-OBSE0002", "Alert", kind="float", policy=MOST)
def alert_actionability():
    paging = F.filter("alerts", lambda x: x["enabled"] & (x["audience"] == "paging"))
    fields = ("condition", "severity", "impact", "owner", "destination", "action", "runbook")

    def whole(x):
        good = filled(x["recent_outcomes"])
        for f in fields:
            good = good & given(x[f])
        return good

    return shared(paging, whole, about("not actionable:", "name"))


@rule("ALL-OBSE0003", "ServiceObjective", kind="float", policy=MOST)
def service_objective_coverage():
    scope = F.filter("services", lambda x: x["in_scope"] & x["user_facing"])
    return shared(scope, lambda x: given(x["owner"]) & filled(x["indicators"]) & filled(x["objectives"]) & filled(x["windows"]) & given(x["error_budget_policy"]), about("no complete objective for", "name"))


@rule("ALL-OPER0001", "Runbook", kind="float", policy=MOST)
def runbook_coverage(maximum_age_days: int = 90):
    scope = F.filter("triggers", lambda x: x["in_scope"])
    healed = lambda x: x["self_healing"] & given(x["design_evidence"])
    guided = lambda x: given(x["owner"]) & filled(x["commands"]) & F.coalesce(x["verification_age_days"] <= maximum_age_days, F.lit(False))
    return shared(scope, lambda x: healed(x) | guided(x), about("no current runbook for", "name"))


@rule("ALL-PERF0001", "PerformanceDecision", kind="float", policy=MOST)
def regression_guard_coverage():
    critical = F.filter("budgets", lambda x: x["critical"])

    def guarded(x):
        good = x["limit"].isNotNull()
        for f in ("workload", "environment", "baseline", "variance_policy", "check_command", "owner", "last_outcome"):
            good = good & given(x[f])
        return good

    return shared(critical, guarded, about("no regression guard for", "name"))


@rule("ALL-REVI0001", "Change", kind="float", policy=MOST)
def review_coverage():
    required = F.filter("changes", lambda x: x["review_required"])
    return shared(required, lambda x: F.exists(x["approvals"], lambda a: a["approved"] & a["eligible"] & (a["reviewer"] != x["author"])), about("no independent approval:", "identifier"))


@rule("ALL-WAIV0001", "Waiver")
def waiver_debt(required_metadata: tuple = ("reason",), maximum_age_days: int = 90):
    def owed(x):
        missing = F.lit(False)
        for key in required_metadata:
            missing = missing | ~given(F.try_element_at(x["metadata"], F.lit(key)))
        return x["age_days"].isNull() | (x["age_days"] > maximum_age_days) | F.coalesce(x["expires_in_days"] < 0, F.lit(False)) | x["is_overly_broad"] | missing

    return counted(col("waivers"), owed, about("waiver without a current justification at", "location"))


@rule("ALL-WRIT0001", "AuthorshipSignal")
def ai_associated_pattern_count(providers: tuple = ()):
    return counted(col("matches"), lambda x: x["is_eligible"] & (one_of(x["provider"], providers) if providers else F.lit(True)), about("style pattern", "rule", "matched_text"))


@rule("ALL-CONF0001", "ProjectConfiguration")
def hardcoded_path_policy_count(minimum_paths: int = 3, policy_names: tuple = ("exclude", "excluded", "ignore", "ignored", "directory", "directories", "suffix", "suffixes")):
    words = lambda x: F.split(F.lower(x["name"]), "_")
    return counted(col("assignments"), lambda x: (x["collection_kind"] != "other") & ~x["is_typed_configuration_field"] & any_of(words(x), policy_names) & (F.size(F.array_distinct(x["values"])) >= minimum_paths), about("path policy written into source:", "name"))


@rule("PY-TYPE0003", "ProjectConfiguration")
def minimum_python_declaration(minimum_version: str = "3.14"):
    minor = int(minimum_version.split(".")[1])
    target = col("python_target")
    tools = F.filter(target["configured_tools"], lambda t: F.coalesce(F.try_element_at(target["tool_target_minors"], t) != target["project_minimum_minor"], F.lit(True)))
    problems = F.concat(
        F.when(F.coalesce(target["project_minimum_minor"] < minor, F.lit(True)), F.array(F.lit("project"))).otherwise(F.array()),
        F.coalesce(tools, F.array()),
        F.coalesce(F.transform(F.filter(target["per_file_target_minors"], lambda m: m != target["project_minimum_minor"]), lambda m: F.concat(F.lit("per file 3."), m.cast("string"))), F.array()),
    )
    return counted(F.when(target.isNotNull(), F.transform(problems, lambda p: F.struct(p.alias("name")))), lambda x: F.lit(True), about("Python target disagrees:", "name"))


@rule("ALL-COMM0001", "Comment", kind="float", policy=Numeric(maximum=20))
def comment_length(measure: str = "tokens", normalization_max: int = 200, notice_markers: tuple = ("spdx-license-identifier", "copyright", "licensed under", "all rights reserved")):
    size = {"tokens": "token_count", "characters": "character_count", "lines": "line_count"}[measure]
    notice = lambda g: F.coalesce(F.lower(g["text"]).rlike("|".join(notice_markers)), F.lit(False))
    sizes = F.transform(F.filter("groups", lambda g: ~g["is_documentation"] & ~g["is_directive"] & ~notice(g)), lambda g: g[size])
    longest = F.coalesce(F.array_max(sizes), F.lit(0))
    return gauged(F.least(F.lit(100.0), 100.0 * longest / normalization_max), say("longest comment: ", longest, " " + measure))


@rule("ALL-COMM0002", "Comment", fix="review")
def commented_out_code(minimum_lines: int = 1):
    return counted(col("groups"), lambda g: g["parses_as_source"] & ~g["is_directive"] & (g["line_count"] >= minimum_lines), about("comment holds source"), lambda g: g["node"]["start_line"])


@rule("ALL-COMM0003", "Comment")
def unresolved_work_marker(markers: tuple = ("todo", "fixme", "xxx", "hack")):
    return counted(col("groups"), lambda g: F.lower(F.regexp_extract(g["text"], r"^\W*(\w+)", 1)).isin(*markers), about("unresolved work:", "text"), lambda g: g["node"]["start_line"])


@rule("ALL-TEST0002", "TestFunction")
def flaky_test_quarantine_debt(maximum_age_days: int = 14, require_owner: bool = True):
    return counted(col("quarantined_tests"), lambda x: F.coalesce(x["age_days"] > maximum_age_days, F.lit(True)) | (F.lit(require_owner) & ~given(x["owner"])) | x["recurred_after_repair"] | ~x["has_remediation_evidence"], about("quarantined without timely remediation:", "name"))
