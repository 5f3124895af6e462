"""Queries on graphs, clones, history and the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import clones, graph, lineage
from factloom.operators.history import churn
from factloom.queries import query

_EDGES = """SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
WHERE l_quantity = 50 AND l_discount >= 0.09 AND s_nationkey <> c_nationkey AND (s_nationkey * 7 + c_nationkey * 3) % 5 = 0"""


def trade(table):
    """Nations that sell to others, by few lines; the lines are narrowed before they are joined."""
    lines = table("lineitem").where("l_quantity = 50 AND l_discount >= 0.09").select("l_orderkey", "l_suppkey")
    rows = lines.join(table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).where("src <> dst AND (src * 7 + dst * 3) % 5 = 0").distinct()


_COUPLING = f"WITH e AS ({_EDGES}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), c AS (SELECT node, (SELECT count(*) FROM e WHERE dst = node) AS afferent, (SELECT count(*) FROM e WHERE src = node) AS efferent FROM n), i AS (SELECT *, CAST(efferent AS DOUBLE) / (afferent + efferent) AS instability FROM c)"


@query(_COUPLING + " SELECT node, afferent, efferent, instability FROM i")
def e1_coupling(table):
    return graph.coupling(trade(table))


@query(_COUPLING + " SELECT e.src, e.dst FROM e JOIN i a ON a.node = e.src JOIN i b ON b.node = e.dst WHERE b.instability > a.instability")
def e2_less_stable_dependency(table):
    return graph.less_stable(trade(table)).select("src", "dst")


_REACH = f"WITH RECURSIVE e AS ({_EDGES}), r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)"


@query(_REACH + ", n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT node, least(node, coalesce((SELECT min(a.dst) FROM r a JOIN r b ON a.dst = b.src AND b.dst = a.src WHERE a.src = node), node)) AS component FROM n")
def e3_strong_components(table):
    return graph.strong_components(trade(table))


@query(f"WITH RECURSIVE e AS ({_EDGES}), d(node, distance) AS (SELECT CAST(0 AS INTEGER), 0 UNION SELECT e.src, d.distance + 1 FROM d JOIN e ON e.dst = d.node WHERE d.distance < 30) SELECT node, CAST(min(distance) AS INTEGER) AS distance FROM d WHERE node <> 0 GROUP BY node")
def e4_reverse_impact(table):
    edges = trade(table)
    changed = table("nation").where("n_nationkey = 0").select(F.col("n_nationkey").alias("node"))
    return graph.impact(edges, changed)


@query(_REACH + " SELECT src, count(DISTINCT dst) AS ancestors FROM r WHERE src <> dst GROUP BY src")
def e5_ancestor_count(table):
    return graph.reach(trade(table), 30).groupBy("src").agg(F.count(F.lit(1)).alias("ancestors"))


@query(f"WITH RECURSIVE e AS ({_EDGES}), r(src, dst, hops) AS (SELECT src, dst, 1 FROM e UNION SELECT r.src, e.dst, hops + 1 FROM r JOIN e ON r.dst = e.src WHERE hops < 2) SELECT src, count(DISTINCT dst) AS downstream FROM r WHERE src <> dst GROUP BY src HAVING count(DISTINCT dst) >= 3")
def e11_high_impact(table):
    return graph.reach(trade(table), 2).groupBy("src").agg(F.count(F.lit(1)).alias("downstream")).where("downstream >= 3")


@query("""
WITH w AS (SELECT n_regionkey AS src, r2.r_regionkey AS dst FROM nation JOIN region r2 ON (n_nationkey + r2.r_regionkey) % 4 = 0 WHERE n_regionkey <> r2.r_regionkey)
SELECT DISTINCT src, dst FROM w""")
def e12_package_edges(table):
    """Module edges folded into package edges."""
    pairs = table("nation").select("n_nationkey", "n_regionkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("r")).where("(n_nationkey + r) % 4 = 0")
    return graph.packages(pairs, F.col("n_regionkey"), F.col("r"))


_TOKENS = "list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')"


def _windows(table, size: int):
    items = F.array_remove(F.split(F.coalesce("text", F.lit("")), " ", -1), "")
    return clones.windows(table("benchmark").withColumnRenamed("item_id", "key").unionByName(table("documents").select((-1 - F.col("doc_id")).alias("key"), "text")), "key", items, size)


@query(f"""
WITH d AS (SELECT item_id AS key, text FROM benchmark UNION ALL SELECT -1 - doc_id, text FROM documents),
t AS (SELECT key, {_TOKENS} AS a FROM d), w AS (SELECT key, unnest(list_transform(range(1, len(a) - 38), lambda i: array_to_string(a[i:i + 39], chr(31)))) AS k FROM t WHERE len(a) >= 40),
r AS (SELECT k, count(*) AS places FROM w GROUP BY k HAVING count(*) > 1)
SELECT key, count(*) AS windows, max(places) AS places FROM w JOIN r USING (k) GROUP BY key""")
def e6_clone_windows(table):
    found = clones.repeated(_windows(table, 40), "key")
    return found.groupBy("key").agg(F.count(F.lit(1)).alias("windows"), F.max("places").alias("places"))


@query(f"""
WITH d AS (SELECT item_id AS key, text FROM benchmark UNION ALL SELECT -1 - doc_id, text FROM documents),
t AS (SELECT key, {_TOKENS} AS a FROM d), w AS (SELECT key, unnest(list_transform(range(1, len(a) - 38), lambda i: array_to_string(a[i:i + 39], chr(31)))) AS k, unnest(range(0, len(a) - 39)) AS place FROM t WHERE len(a) >= 40),
r AS (SELECT k, count(*) AS places FROM w GROUP BY k HAVING count(*) > 1),
g AS (SELECT key, place, place - row_number() OVER (PARTITION BY key ORDER BY place) AS run FROM w JOIN r USING (k))
SELECT key, CAST(min(place) AS INTEGER) AS start, CAST(max(place) + 40 AS INTEGER) AS "end" FROM g GROUP BY key, run""")
def e7_clone_fragments(table):
    return clones.fragments(clones.repeated(_windows(table, 40), "key"), "key", 40).select("key", "start", "end")


@query("SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def e8_exact_copies(table):
    rows = table("documents").where("text IS NOT NULL").select(F.md5("text").alias("digest"), "doc_id")
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("SELECT o_custkey AS path, count(DISTINCT o_orderkey) AS commit_count, count(DISTINCT o_orderpriority) AS author_count, CAST(date_diff('day', max(CAST(o_orderdate AS DATE)), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) AS INTEGER) AS days_since_last_change FROM orders GROUP BY o_custkey")
def e9_churn(table):
    return churn(table("orders"), "o_orderkey", "o_custkey", "o_orderpriority", F.to_date("o_orderdate"))


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS authors, count(*) AS commits FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) >= 4 AND count(*) >= 5")
def e10_many_authors(table):
    return table("orders").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("authors"), F.count(F.lit(1)).alias("commits")).where("authors >= 4 AND commits >= 5")


@query("SELECT o_orderkey, o_custkey + 40 AS reference FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey + 40)")
def g1_missing_reference(table):
    rows = table("orders").select("o_orderkey", (F.col("o_custkey") + 40).alias("reference"))
    return rows.join(table("customer").select(F.col("c_custkey").alias("reference")), "reference", "left_anti").select("o_orderkey", "reference")


_NAMES = "SELECT lower(r_name || '.' || n_name) AS asset, lower(n_name) AS short FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(f"WITH a AS ({_NAMES}), u AS (SELECT short AS k, min(asset) AS asset FROM (SELECT asset, short FROM a UNION SELECT asset, asset FROM a) GROUP BY short HAVING count(DISTINCT asset) = 1) SELECT c_custkey, asset AS resolved FROM (SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey + 1 UNION ALL SELECT -c_custkey, 'nowhere' FROM customer WHERE c_custkey <= 3) LEFT JOIN u ON k = lower(n_name)")
def g2_resolved_names(table):
    """Exact resolution by endings of dotted names; what leads to several assets stays open."""
    assets = table("nation").join(table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower(F.concat_ws(".", "r_name", "n_name")).alias("asset"))
    named = table("customer").join(table("nation"), F.col("n_nationkey") == F.col("c_nationkey") + 1).select("c_custkey", "n_name")
    named = named.unionByName(table("customer").where("c_custkey <= 3").select((-F.col("c_custkey")).alias("c_custkey"), F.lit("nowhere").alias("n_name")))
    return lineage.resolved(named, "n_name", assets, "asset").select("c_custkey", "resolved")


@query(f"WITH e AS ({_EDGES}), a AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey < 3) SELECT src, dst, side, name FROM (SELECT src, dst, 'source' AS side, src AS name FROM e UNION ALL SELECT src, dst, 'target', dst FROM e) WHERE name NOT IN (SELECT k FROM a)")
def g3_lineage_endpoint_missing(table):
    return lineage.endpoint_gaps(trade(table), table("nation").where("n_regionkey < 3"), "n_nationkey").select("src", "dst", "side", "name")


@query(f"WITH RECURSIVE e AS ({_EDGES}), r(src, dst, hops) AS (SELECT src, dst, 1 FROM e UNION SELECT r.src, e.dst, hops + 1 FROM r JOIN e ON r.dst = e.src WHERE hops < 3) SELECT n_name, count(DISTINCT dst) AS downstream FROM r JOIN nation ON n_nationkey = src WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = src AND s_acctbal > 9800) GROUP BY n_name HAVING count(DISTINCT dst) >= 3")
def g4_unowned_high_impact(table):
    wide = graph.reach(trade(table), 3).groupBy("src").agg(F.count(F.lit(1)).alias("downstream")).where("downstream >= 3")
    owned = table("supplier").where("s_acctbal > 9800").select(F.col("s_nationkey").alias("src")).distinct()
    return wide.join(owned, "src", "left_anti").join(table("nation"), F.col("src") == F.col("n_nationkey")).select("n_name", "downstream")


@query("""
WITH i AS (SELECT DISTINCT l_orderkey, l_partkey AS asset FROM lineitem WHERE l_returnflag = 'R'), t AS (SELECT DISTINCT l_orderkey, l_partkey AS asset FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 20)
SELECT l_orderkey, count(*) AS impacted, count(*) FILTER (WHERE t.asset IS NULL) AS untested, 100.0 * count(*) FILTER (WHERE t.asset IS NULL) / count(*) AS gap FROM i LEFT JOIN t USING (l_orderkey, asset) GROUP BY l_orderkey""")
def g5_test_gap(table):
    lines = table("lineitem").select("l_orderkey", F.col("l_partkey").alias("asset"), "l_returnflag", "l_linestatus", "l_quantity")
    return lineage.test_gap(lines.where("l_returnflag = 'R'"), lines.where("l_linestatus = 'F' AND l_quantity > 20"), ["l_orderkey"])
