"""Contextual rules: what is judged, of which facts, into which closed categories.

A rule nominates candidates by an expression and hands them to a backend.  Rules with criteria
reduce yes and no answers by a decision table; the backend never chooses their category."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.plans.model import UNCERTAIN, UNKNOWN, Backend, Decision, decided, gated, reply, small_batches, subject
from factloom.plans.policy import Category


@dataclass(frozen=True)
class Contextual:
    """One contextual rule; ``policy`` closes its domain."""

    id: str
    name: str
    family: str
    question: str
    policy: Category
    fields: tuple[str, ...]
    nominate: Callable[[], Column] = lambda: F.lit(True)
    criteria: Mapping[str, str] = field(default_factory=dict)
    table: tuple[Decision, ...] = ()
    default: str = "uncertain"

    @property
    def options(self) -> tuple[str, ...]:
        return tuple(sorted(self.policy.domain))

    @property
    def asked(self) -> list[tuple[str, tuple[str, ...]]]:
        """Questions with the answers that they allow."""
        return [(q, ("yes", "no")) for q in self.criteria.values()] if self.criteria else [(self.question, self.options)]

    def category(self, answers: Column, confidences: Column) -> Column:
        """The category that the answers to ``asked`` make."""
        given = lambda i, options, fallback: gated(options, fallback, answer=answers[i], confidence=confidences[i])
        if not self.criteria:
            return given(0, self.options, UNCERTAIN)
        places = {name: i for i, name in enumerate(self.criteria)}
        return decided(list(places), self.table, self.default, lambda name: given(places[name], ("yes", "no"), UNKNOWN))

    def judge(self, facts: DataFrame, backend: Backend) -> DataFrame:
        """Identity, category and verdict of each nominated fact."""
        return judged(facts, [self], [backend])


def judged(facts: DataFrame, rules: Sequence[Contextual], backends: Sequence[Backend]) -> DataFrame:
    """The same for several rules of one family, in one scan of its facts and one pass through Python.

    Candidates are exploded, not filtered: a filter would move below the facts and make their lists twice."""
    small_batches(facts)
    identity, kinds = ["fact_id", "path", "language"], dict(facts.dtypes)
    subjects = facts.select(*identity, *[r.nominate().alias(f"__n{i}") for i, r in enumerate(rules)], *[subject(kinds, r.fields).alias(f"__s{i}") for i, r in enumerate(rules)])
    nominated = [F.when(F.col(f"__n{i}"), F.struct(F.lit(i).alias("rule"), F.col(f"__s{i}").alias("subject_json"))) for i in range(len(rules))]
    rows = subjects.select(*identity, F.explode(F.array_compact(F.array(*nominated))).alias("c")).select(*identity, "c.*")
    asked = [(b, r.asked) for b, r in zip(backends, rules, strict=True)]
    names = [*identity, "rule", "answers", "confidences"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_rule: dict[int, list[int]] = {}
            for at, rule in enumerate(batch.column(3).to_pylist()):
                of_rule.setdefault(rule, []).append(at)
            answers: list = [None] * batch.num_rows
            for rule, places in of_rule.items():
                backend, questions = asked[rule]
                texts = batch.column(4).take(pa.array(places)).to_pylist()
                for at, given in zip(places, zip(*[reply(backend, question, options, texts) for question, options in questions])):
                    answers[at] = given
            columns = [pa.array([[a[i] for a in given] for given in answers], pa.list_(kind)) for i, kind in enumerate((pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], names=names)

    given = rows.mapInArrow(run, "fact_id string, path string, language string, rule int, answers array<string>, confidences array<double>")
    made = given.select(*identity, "rule", _by_rule([r.category(F.col("answers"), F.col("confidences")) for r in rules]).alias("category"))
    verdict = _by_rule([r.policy.verdict(F.col("category")) for r in rules])
    return made.select(*identity, _by_rule([F.lit(r.id) for r in rules]).alias("rule_id"), "category", verdict.alias("verdict"))


def _by_rule(values: Sequence[Column]) -> Column:
    """The value of a row's rule."""
    made = F.lit(None).cast("string")
    for i, value in reversed(list(enumerate(values))):
        made = F.when(F.col("rule") == i, value).otherwise(made)
    return made


CONTEXTUAL: dict[str, Contextual] = {}


def _state(id: str, name: str, family: str, fields: str, domain: str, good: str, neutral: str = "uncertain", question: str = "", **more) -> None:
    names = domain.split()
    policy = Category.closed(names, good.split(), neutral.split()) if good else Category.advisory(names)
    CONTEXTUAL[id] = Contextual(id, name, family, question or name.replace("_", " "), policy, tuple(fields.split()), **more)


_many = lambda column, least: lambda: F.size(column) >= least
_yes = lambda category, **answers: Decision(answers, category)

# Ids, families and closed categories of the contextual catalogue.
_state("ALL-ABST1001", "abstraction_quality", "Class", "classes", "useful leaky premature wrong missing uncertain", "useful")
_state("ALL-ARCH1001", "module_cohesion", "Module", "module members", "cohesive mixed intentional_integration uncertain", "cohesive intentional_integration", nominate=_many("members", 4))
_state("ALL-ARCH1002", "dependency_boundary_alignment", "ModuleCoupling", "module dependencies", "aligned leaky intentional_bridge uncertain", "aligned intentional_bridge", nominate=_many("dependencies", 1))
_state("ALL-ARCH1003", "dependency_hub_quality", "ModuleCoupling", "module afferent_count efferent_count dependencies", "stable_abstraction intentional_coordinator dependency_magnet uncertain", "intentional_coordinator stable_abstraction", nominate=lambda: F.col("afferent_count") + F.col("efferent_count") > 0)
_state("ALL-ARCH1004", "mixed_class_responsibilities", "Class", "classes", "cohesive mixed intentional_coordinator uncertain", "cohesive intentional_coordinator", nominate=lambda: F.exists("classes", lambda c: F.size(c["methods"]) >= 4))
_state("ALL-ARCH1005", "change_locality", "Change", "changes", "localized scattered intentional_protocol_change transient uncertain", "intentional_protocol_change localized", "transient uncertain")
_state("ALL-ARCH1006", "maintenance_hotspot", "RepositoryHistory", "files", "healthy hotspot stable_complex transient uncertain", "healthy stable_complex", "transient uncertain")
_state("ALL-ARCH1007", "component_balance", "ModuleCoupling", "module declaration_count dependencies", "balanced oversized fragmented asymmetric uncertain", "balanced")
_state("ALL-CLAS1001", "inheritance_design", "Override", "derived base declared inherited", "subtype mixin composition framework uncertain", "subtype mixin framework", nominate=lambda: F.col("depth") == 1)
_state("ALL-CLAS1002", "substitutability", "Override", "derived base declared inherited", "preserved narrowed weakened refused uncertain", "preserved", nominate=lambda: F.col("depth") == 1)
_state("ALL-COMM1001", "comment_intent", "Comment", "groups", "rationale contract warning restatement todo disabled_code historical uncertain", "rationale contract warning", "historical uncertain", nominate=lambda: F.exists("groups", lambda g: g["token_count"] >= 3))
_state("ALL-COMM1002", "comment_accuracy", "Comment", "groups", "current stale ambiguous historical uncertain", "current historical", nominate=lambda: F.exists("groups", lambda g: g["token_count"] >= 3))
_DEPLOYMENT = "is_applicable locked_inputs build_command environment artifact_identity migrations configuration_sources secrets_boundary rollback_command provenance"
_state(
    "ALL-DEPL1001", "progressive_rollout", "Deployment", _DEPLOYMENT, "verified partial unsafe not_needed uncertain", "not_needed verified",
    criteria={"risky": "can this deployment harm users broadly?", "staged": "does exposure grow in stages?", "observed": "is each stage observed?", "gated": "does a failed stage stop the next?"},
    table=(_yes("not_needed", risky=False), _yes("verified", staged=True, observed=True, gated=True), _yes("unsafe", staged=False, observed=False)), default="partial",
)
_state(
    "ALL-DEPL1002", "exposure_control", "Deployment", _DEPLOYMENT, "controlled partial unbounded not_required uncertain", "controlled not_required",
    criteria={"needed": "must exposure be bounded?", "bounded": "is the audience bounded?", "stoppable": "can exposure be withdrawn?", "owned": "does someone own the bound?"},
    table=(_yes("not_required", needed=False), _yes("controlled", bounded=True, stoppable=True, owned=True), _yes("unbounded", bounded=False, stoppable=False)), default="partial",
)
_state(
    "ALL-DEPL1003", "rollout_success_criteria", "Deployment", _DEPLOYMENT, "decisive incomplete misaligned absent uncertain", "decisive",
    criteria={"stated": "are success criteria stated?", "measured": "can each be measured?", "aligned": "do they follow the intended outcome?", "deciding": "does each decide to go on or stop?"},
    table=(_yes("absent", stated=False), _yes("misaligned", aligned=False), _yes("decisive", measured=True, deciding=True)), default="incomplete",
)
_state(
    "ALL-DEPL1004", "rollback_readiness", "Deployment", _DEPLOYMENT, "ready partial unverified blocked not_required uncertain", "not_required ready",
    criteria={"needed": "is a way back needed?", "stated": "is a way back stated?", "tried": "has it been tried?", "reversible": "can its data changes be undone?"},
    table=(_yes("not_required", needed=False), _yes("blocked", reversible=False), _yes("ready", stated=True, tried=True), _yes("unverified", stated=True, tried=False)), default="partial",
)
_state("ALL-DESI1001", "primitive_obsession", "Function", "name parameters", "appropriate value_object domain_model modeled overmodeled uncertain", "appropriate domain_model modeled value_object", nominate=_many("parameters", 1))
_state("ALL-DESI1002", "design_pattern_fit", "Class", "classes", "useful missing premature misapplied not_needed uncertain", "not_needed useful")
_state("ALL-DESI1003", "extension_design", "Class", "classes", "extensible rigid speculative intentionally_closed uncertain", "extensible intentionally_closed")
_state("ALL-DUPL1001", "semantic_duplication", "CloneGroup", "fragments token_length", "shared_knowledge similar_shape intentional_boundary uncertain", "intentional_boundary similar_shape", nominate=lambda: F.col("token_length") >= 80)
_state("ALL-FUNC1001", "abstraction_level", "Function", "name control_increments direct_statement_count", "cohesive mixed boundary uncertain", "boundary cohesive")
_state("ALL-FUNC1002", "effect_visibility", "Function", "name parameters docstring", "explicit hidden purposeful uncertain", "explicit purposeful")
_state("ALL-INTE1001", "interface_segregation", "Class", "classes", "focused bloated fragmented facade uncertain", "facade focused")
_state("ALL-OBSE1001", "diagnostic_context", "Call", "calls", "actionable sparse noisy unsafe uncertain", "actionable", nominate=lambda: F.exists("calls", lambda c: c["qualified_name"].rlike("log|trace|metric")))
_state("ALL-OBSE1002", "operational_risk_coverage", "OperationalRisk", "risks", "actionable gaps noisy unsafe uncertain", "actionable")
_state("ALL-PERF1001", "profiling_evidence", "PerformanceDecision", "budgets", "sufficient stale incomplete absent not_needed uncertain", "not_needed sufficient")
_state("ALL-PERF1002", "optimization_justification", "PerformanceDecision", "budgets", "supported unsupported regression not_applicable uncertain", "not_applicable supported")
_state("ALL-PERF1003", "benchmark_quality", "PerformanceDecision", "budgets", "representative micro_only uncontrolled stale not_needed uncertain", "not_needed representative")
_state("ALL-PERF1004", "algorithmic_complexity", "Function", "name control_increments parameters", "proportionate risky avoidable tradeoff uncertain", "proportionate", "tradeoff uncertain", nominate=lambda: F.exists("control_increments", lambda c: c["kind"] == "loop"))
_state(
    "ALL-RELI1003", "bounded_work", "Function", "name control_increments parameters docstring", "bounded unbounded backpressured dropped uncertain", "backpressured bounded",
    criteria={"limited": "is the amount of work limited?", "waits": "does excess work wait at its source?", "drops": "is excess work dropped?"},
    table=(_yes("bounded", limited=True), _yes("backpressured", waits=True), _yes("dropped", drops=True)), default="unbounded",
)
_state("ALL-REVI1001", "change_reviewability", "Change", "changes", "focused entangled oversized mechanical incomplete uncertain", "focused mechanical")
_state("ALL-SECU1002", "vulnerability_response_readiness", "SecurityBoundary", "boundaries", "ready partial absent stale not_required uncertain", "not_required ready")
_state("ALL-SECU1003", "threat_model_coverage", "SecurityBoundary", "boundaries", "complete gaps stale misaligned inherited not_required uncertain", "complete inherited not_required")
_state("ALL-STAT1001", "state_ownership", "Class", "classes", "owned shared leaked immutable uncertain", "immutable owned")
_state("ALL-STAT1002", "temporal_coupling", "Class", "classes", "explicit hidden intrinsic avoidable uncertain", "explicit intrinsic")
_state(
    "ALL-STRI1001", "string_construction_mechanism", "StringExpression", "expressions", "literal f_string string_template jinja2 join f_string_join uncertain", "", nominate=lambda: F.exists("expressions", lambda e: e["character_count"] >= 80),
    criteria={"varies": "do values go into the text?", "repeats": "is a part repeated for many values?", "branches": "does the text branch?", "external": "is the text kept outside the source?"},
    table=(_yes("literal", varies=False), _yes("jinja2", branches=True), _yes("string_template", external=True), _yes("f_string_join", repeats=True)), default="f_string",
)
_state("ALL-TEST1001", "test_strategy", "TestStrategy", "requirements risks boundaries failure_scenarios test_types", "sufficient gaps overbuilt misaligned uncertain", "sufficient")
_state("ALL-TEST1002", "test_isolation", "TestStrategy", "state_controls external_services test_types", "isolated shared integrated overmocked uncertain", "integrated isolated", "shared uncertain")
_state("ALL-WRIT1001", "comment_language", "Comment", "groups", "target other uncertain", "target", nominate=lambda: F.exists("groups", lambda g: g["character_count"] >= 24))
_state("ALL-WRIT1002", "docstring_language", "ProseSegment", "sections", "target other uncertain", "target", nominate=lambda: F.exists("sections", lambda s: s["character_count"] >= 24))
_state("PY-INTE1001", "python_interface_form", "Class", "classes", "concrete protocol abc callable duck uncertain", "")
_state("PY-MODE1001", "model_foundation", "Class", "classes", "appropriate use_frozen_model use_model use_flex_model use_frozen_flex_model use_plain_class dataclass_exception uncertain", "appropriate dataclass_exception", nominate=lambda: F.exists("classes", lambda c: c["is_dataclass"] | c["is_declarative_model"]))
_state("PY-MODE1002", "shared_model_placement", "Class", "classes", "move_to_shared_boundary keep_with_owner uncertain", "keep_with_owner", nominate=lambda: F.exists("classes", lambda c: c["is_declarative_model"] & (F.size(c["importing_modules"]) >= 2)))
_state("PY-TYPE1001", "shared_typing_placement", "Symbol", "typing_scopes", "move_to_shared_module keep_with_owner uncertain", "keep_with_owner", nominate=lambda: F.exists("typing_scopes", lambda s: (F.size(s["definitions"]) >= 5) & (F.size(s["reused_definitions"]) >= 3)))
