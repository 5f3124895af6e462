"""Rules on a data catalog: references, lineage, governance and change impact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.policy import Numeric
from factloom.plans.rules import counted, rule, say, shared
from factloom.rules.common import about, any_of, col, filled, given

GAP = Numeric(maximum=5)


@rule("ALL-DATA0001", "DataAssetReference")
def missing_data_asset_reference():
    return counted(col("references"), lambda r: ~r["asset_exists"], about("no such asset:", "asset_identifier", "source_location"))


@rule("ALL-DATA0002", "DataFieldReference", fix="safe")
def missing_data_field_reference():
    return counted(col("references"), lambda r: r["asset_exists"] & ~r["field_exists"], about("no such field:", "asset_identifier", "field_name"))


@rule("ALL-DATA0003", "DataFieldReference")
def incompatible_data_field_type():
    return counted(col("references"), lambda r: r["field_exists"] & given(r["expected_type"]) & given(r["catalog_type"]) & (F.lower(r["expected_type"]) != F.lower(r["catalog_type"])), about("types disagree:", "asset_identifier", "field_name"))


@rule("ALL-DATA0004", "DataAssetReference")
def nonactive_data_asset_reference():
    return counted(col("references"), lambda r: r["asset_exists"] & r["lifecycle"].isin("deprecated", "removed"), about("asset is no longer active:", "asset_identifier", "lifecycle"))


@rule("ALL-DATA0006", "DataAssetReference")
def unhealthy_data_dependency():
    def pairs(r):
        bad = F.filter(F.map_entries(r["upstream_health"]), lambda e: e["value"] == "unhealthy")
        return F.transform(bad, lambda e: F.struct(r["asset_identifier"].alias("asset"), r["source_location"].alias("place"), e["key"].alias("upstream")))

    rows = F.array_distinct(F.flatten(F.transform(F.filter("references", lambda r: r["asset_exists"] & r["upstream_health"].isNotNull()), pairs)))
    return counted(rows, lambda x: F.lit(True), about("depends on an unhealthy asset:", "asset", "upstream"))


@rule("ALL-DATA0007", "DataAsset")
def data_asset_governance_gap(scope: str = "changed", domain: str = "required"):
    return counted(col("assets"), lambda a: (F.lit(scope == "all") | a["is_changed"]) & (~filled(a["owners"]) | (F.lit(domain == "required") & ~given(a["domain"]))), about("no owner or domain:", "identifier"))


@rule("ALL-DATA0008", "DataChange", kind="float", policy=GAP)
def data_change_test_gap_percentage():
    def impacted(c):
        both = F.array_distinct(F.concat(F.array(c["asset_identifier"]), F.coalesce(c["downstream_assets"], F.array())))
        return F.transform(both, lambda a: F.struct(c["asset_identifier"].alias("change"), a.alias("asset"), F.coalesce(c["tested_assets"], F.array()).alias("tested")))

    rows = F.flatten(F.transform(F.filter("changes", lambda c: c["is_breaking"]), impacted))
    return shared(rows, lambda x: ~F.array_contains(x["tested"], x["asset"]), about("impact without a test:", "change", "asset"), complete=False)


@rule("ALL-DATA0009", "DataAsset", kind="float", policy=GAP)
def data_definition_gap_percentage():
    of = lambda a: F.concat(F.array(F.struct(a["identifier"].alias("name"), a["description"].alias("description"))), F.transform(F.coalesce(a["fields"], F.array()), lambda f: F.struct(F.concat(a["identifier"], F.lit("."), f["name"]).alias("name"), f["description"].alias("description"))))
    return shared(F.flatten(F.transform("assets", of)), lambda x: ~given(x["description"]), about("no description:", "name"), complete=False)


@rule("ALL-DATA0010", "LineageEdge")
def unresolved_lineage_endpoint():
    ends = F.flatten(F.transform("edges", lambda e: F.array(F.struct(e["source"].alias("name"), e["source_exists"].alias("known")), F.struct(e["target"].alias("name"), e["target_exists"].alias("known")))))
    return counted(ends, lambda x: ~x["known"], about("endpoint is not in the catalog:", "name"))


@rule("ALL-DATA0011", "DataAsset", "LineageEdge", over_facts=True)
def unowned_high_impact_asset(facts, minimum_downstream: int = 3, maximum_depth: int = 3):
    """Hops are joins over edges; distinct pairs keep a frontier from growing with paths."""
    from factloom.operators.graph import reach

    edges = facts["LineageEdge"].select(F.explode("edges").alias("e")).select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"))
    wide = reach(edges, maximum_depth).groupBy("src").count().where(F.col("count") >= minimum_downstream)
    assets = facts["DataAsset"].select("fact_id", F.explode("assets").alias("a")).where(~filled(F.col("a.owners")))
    rows = assets.join(wide, F.col("a.identifier") == F.col("src")).groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("asset"), F.col("count").alias("n")))).alias("found"))
    joined = facts["DataAsset"].select("fact_id", "path", "language", "start_line").join(rows, "fact_id", "left")
    return joined, counted(col("found"), lambda x: F.lit(True), lambda x: say("nobody owns ", x["asset"], ", which ", x["n"], " assets depend on"))


@rule("ALL-DATA0012", "DataAsset")
def ungoverned_sensitive_field(sensitive_tags: tuple = ("pii", "sensitive", "confidential", "personal")):
    of = lambda a: F.transform(F.coalesce(a["fields"], F.array()), lambda f: F.struct(a["identifier"].alias("asset"), filled(a["owners"]).alias("owned"), f.alias("f")))
    rows = F.flatten(F.transform("assets", of))
    return counted(rows, lambda x: any_of(F.transform(x["f"]["tags"], lambda t: F.lower(F.trim(t))), sensitive_tags) & (~x["owned"] | ~filled(x["f"]["glossary_terms"])), lambda x: say("sensitive field without governance: ", x["asset"], ".", x["f"]["name"]))


@rule("ALL-DATA0013", "DataAssetReference", "DataAsset", over_facts=True)
def ungoverned_data_reference(facts, scope: str = "all"):
    assets: DataFrame = facts["DataAsset"].select(F.explode("assets").alias("a")).where(F.lit(scope == "all") | F.col("a.is_changed"))
    poor = assets.where(~filled(F.col("a.owners")) | ~given(F.col("a.description"))).select(F.col("a.identifier").alias("asset")).distinct()
    references = facts["DataAssetReference"].select("fact_id", F.explode("references").alias("r")).where("r.asset_exists")
    rows = references.join(poor, F.col("r.asset_identifier") == F.col("asset")).groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("asset", F.col("r.source_location").alias("place")))).alias("found"))
    joined = facts["DataAssetReference"].select("fact_id", "path", "language", "start_line").join(rows, "fact_id", "left")
    return joined, counted(col("found"), lambda x: F.lit(True), about("asset has no owner or description:", "asset", "place"))
