"""Queries on joins, aggregates, windows and set operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.numbers import distinct_with_null, nearest_quantile, percentage, significant
from factloom.operators.history import co_change, references, uncoupled
from factloom.operators.relations import first_per_group, largest_per_group, unambiguous
from factloom.operators.timeline import flaps, transitions
from factloom.queries import query

D = "CAST({} AS DECIMAL(18, 2))".format


def _money(c: str):
    return F.col(c).cast("decimal(18,2)")


@query("SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def b1_inner_join(table):
    """Customers are added up before names are joined to their sums."""
    by = table("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    return by.join(table("nation"), "n_nationkey").join(table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", "customers")


@query("SELECT p_partkey, coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_partkey = p_partkey")
def b2_left_coalesce(table):
    by = table("lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    return table("part").select("p_partkey").join(by, "p_partkey", "left").fillna(0)


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def b3_anti_join(table):
    return table("customer").join(table("orders").where("o_totalprice > 450000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def b4_semi_join(table):
    return table("part").join(table("lineitem").where("l_quantity >= 49"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("p_partkey")


@query("SELECT k, coalesce(a, 0) AS customers, coalesce(b, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS a FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey AS k, count(*) AS b FROM supplier GROUP BY 1) USING (k)")
def b5_full_using(table):
    a = table("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = table("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "k", "full").fillna(0)


@query("SELECT r_name, level FROM region CROSS JOIN (VALUES ('low'), ('high')) AS t(level)")
def b6_literal_cross(table):
    """Each row with each of a few literals: an explode, which needs no join."""
    return table("region").select("r_name", F.explode(F.array(F.lit("low"), F.lit("high"))).alias("level"))


@query("SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45")
def b7_many_to_one(table):
    return table("lineitem").where("l_quantity > 45").join(table("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", "o_orderpriority")


_CO = """
WITH r AS (SELECT DISTINCT l_orderkey AS c, l_suppkey AS p FROM lineitem),
n AS (SELECT c FROM r GROUP BY c HAVING count(*) <= 5),
f AS (SELECT r.* FROM r SEMI JOIN n USING (c)),
k AS (SELECT p, count(*) AS n FROM f GROUP BY p),
pairs AS (SELECT a.p AS "left", b.p AS "right", count(*) AS shared FROM f a JOIN f b ON a.c = b.c AND a.p < b.p GROUP BY ALL)
"""


@query(_CO + 'SELECT "left", "right", shared, x.n AS left_count, y.n AS right_count FROM pairs JOIN k x ON x.p = "left" JOIN k y ON y.p = "right"')
def b8_co_change_pairs(table):
    return co_change(table("lineitem"), ["l_orderkey"], "l_suppkey", 5)


@query(_CO + """
, s AS (SELECT CAST(s_suppkey AS VARCHAR) AS i, CAST(s_nationkey AS VARCHAR) AS to_one FROM supplier), q AS (SELECT CAST("left" AS VARCHAR) AS l, CAST("right" AS VARCHAR) AS r, shared FROM pairs)
SELECT 'src/s' || l || '.py' AS "left", 'src/s' || r || '.py' AS "right", shared, CAST((a.to_one = r) AS BIGINT) + CAST((b.to_one = l) AS BIGINT) AS import_reference_count
FROM q JOIN s a ON a.i = l JOIN s b ON b.i = r""")
def b11_import_references(table):
    """Suppliers as files: one is in an import line of another if its number is the other's nation."""
    path = lambda c: F.concat(F.lit("src/s"), c.cast("string"), F.lit(".py"))
    pairs = co_change(table("lineitem"), ["l_orderkey"], "l_suppkey", 5).select(path(F.col("left")).alias("left"), path(F.col("right")).alias("right"), "shared")
    lines = table("supplier").select(path(F.col("s_suppkey")).alias("path"), F.concat(F.lit("from src.s"), F.col("s_nationkey").cast("string"), F.lit(" import ss1")).alias("imported"))
    return references(pairs, lines)


@query(_CO + 'SELECT "left", "right", shared FROM pairs JOIN k x ON x.p = "left" JOIN k y ON y.p = "right" WHERE shared >= 2 AND shared >= 0.05 * least(x.n, y.n) AND ("left" + 1 <> "right")')
def b9_co_change_confidence(table):
    pairs = co_change(table("lineitem"), ["l_orderkey"], "l_suppkey", 5).where("shared >= 2 AND shared >= 0.05 * least(left_count, right_count)")
    imports = table("supplier").select(F.col("s_suppkey").alias("path"), (F.col("s_suppkey") + 1).alias("imported"))
    return uncoupled(pairs, imports).select("left", "right", "shared")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS place FROM lineitem")
def c1_row_number(table):
    w = W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey")
    return table("lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("bigint").alias("place"))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, lead(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_returnflag) AS next FROM lineitem) WHERE next = l_returnflag")
def c2_lead_pair(table):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag")
    return table("lineitem").withColumn("next", F.lead("l_returnflag").over(w)).where("next = l_returnflag").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS running FROM orders")
def c3_running_count(table):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, 0)
    return table("orders").select("o_orderkey", F.count(F.lit(1)).over(w).alias("running"))


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")
def c4_ordinal_rank(table):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table("orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("bigint").alias("place")).where("place <= 3")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, max(l_quantity) OVER (PARTITION BY l_orderkey) AS most FROM lineitem) WHERE l_quantity = most")
def c5_partition_aggregate(table):
    return table("lineitem").withColumn("most", F.max("l_quantity").over(W.partitionBy("l_orderkey"))).where("l_quantity = most").select("l_orderkey", "l_linenumber")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def c6_first_per_group(table):
    return first_per_group(table("orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier")
def c7_union_diagonal(table):
    a = table("customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(table("supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)


@query("SELECT o_custkey, count(DISTINCT p) + CAST(max(CASE WHEN p IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS kinds FROM (SELECT o_custkey, nullif(o_orderpriority, '5-LOW') AS p FROM orders) GROUP BY 1")
def c8_distinct_with_null(table):
    rows = table("orders").select("o_custkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    return rows.groupBy("o_custkey").agg(distinct_with_null(F.col("p")).cast("bigint").alias("kinds"))


@query("WITH d AS (SELECT l_suppkey, count(*) AS degree FROM lineitem GROUP BY 1) SELECT l_suppkey, degree FROM d WHERE degree >= (SELECT quantile_disc(degree, 0.9) FROM d)")
def c9_hub_nomination(table):
    """The quantile is one row, so that the other side of its join is never shuffled."""
    degrees = table("lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("degree"))
    border = degrees.agg(nearest_quantile("degree", 0.9).cast("bigint").alias("border"))
    return degrees.join(F.broadcast(border), F.col("degree") >= F.col("border")).select("l_suppkey", "degree")


_EVENTS = "SELECT user_id, ts, event_id, CASE WHEN value >= 50 THEN 'fail' ELSE 'pass' END AS state FROM events"


@query(f"""
WITH e AS ({_EVENTS}), s AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM e),
t AS (SELECT * FROM s WHERE previous IS NULL OR previous <> state), u AS (SELECT *, lag(state, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM t)
SELECT user_id, count(*) FILTER (WHERE previous IS NOT NULL) AS changes, count(*) FILTER (WHERE state = 'fail' AND previous = 'pass' AND before = 'fail') AS alternations, arg_max(state, (ts, event_id)) AS state FROM u GROUP BY user_id""")
def c10_flap_detection(table):
    rows = table("events").withColumn("state", F.when(F.col("value") >= 50, "fail").otherwise("pass"))
    return flaps(rows, ["user_id"], ["ts", "event_id"], "state")


@query(f"WITH e AS ({_EVENTS}), s AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM e) SELECT user_id, event_id, previous, state FROM s WHERE previous IS NULL OR previous <> state")
def c11_state_transitions(table):
    rows = table("events").withColumn("state", F.when(F.col("value") >= 50, "fail").otherwise("pass"))
    return transitions(rows, ["user_id"], ["ts", "event_id"], "state").select("user_id", "event_id", "previous", "state")


@query(f"SELECT l_returnflag, l_linestatus, CAST(sum({D('l_quantity')}) AS DOUBLE) AS sum_qty, CAST(sum({D('l_extendedprice')}) AS DOUBLE) AS sum_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def c12_grouped_sums(table):
    rows = table("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum(_money("l_quantity")).cast("double").alias("sum_qty"), F.sum(_money("l_extendedprice")).cast("double").alias("sum_price"), F.count(F.lit(1)).alias("n"))


@query("SELECT s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier) WHERE n <= 2")
def c13_largest_per_group(table):
    return largest_per_group(table("supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), ["s_nationkey"], "s_acctbal", 2).select("s_nationkey", "s_suppkey")


@query("SELECT p_retailprice, min(p_brand) AS p_brand FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1")
def c14_unambiguous(table):
    return unambiguous(table("part"), "p_retailprice", "p_brand")


@query("SELECT p_partkey, CASE WHEN p_retailprice = 0 THEN 0.0 ELSE round_even(p_retailprice * p, 0) / p END AS figures, CASE WHEN p_size = 0 THEN 0.0 ELSE 100.0 * 3 / p_size END AS share FROM (SELECT *, pow(10.0, 2 - floor(log10(abs(p_retailprice)))) AS p FROM part)")
def c15_significant_figures(table):
    return table("part").select("p_partkey", significant(F.col("p_retailprice"), 3).alias("figures"), percentage(F.lit(3), F.col("p_size")).alias("share"))
