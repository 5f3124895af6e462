"""Queries on the rule engine: answers, verdicts, findings, summaries, normalization, models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.normalize import normalize
from factloom.operators.relations import counted as counted_rows
from factloom.operators.relations import coverage
from factloom.plans import model
from factloom.plans.policy import Boolean, Category, Numeric
from factloom.plans.rules import Answer, Rule, categorized, counted, evaluate, failures, findings, flagged, measured, say, shared, summary
from factloom.queries import query


def order_facts(table) -> DataFrame:
    """Orders as facts with their lines nested; an order bounds the list."""
    lines = table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("bigint").alias("number"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("bigint").alias("quantity"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")))).alias("lines")
    )
    orders = table("orders").select("o_orderkey", F.col("o_orderpriority").alias("path"), F.col("o_orderstatus").alias("language"), F.col("o_totalprice").alias("price"))
    facts = orders.join(lines, "o_orderkey", "left")
    return facts.select(F.col("o_orderkey").cast("string").alias("fact_id"), "path", "language", F.lit(1).cast("bigint").alias("start_line"), F.lit(1).cast("bigint").alias("end_line"), F.coalesce("lines", F.array()).alias("lines"), "price")


def _rule(id: str, kind: str, build, policy) -> Rule:
    return Rule(id, id, ("Order",), kind, policy, build)


def costly() -> Answer:
    return flagged(F.col("price") >= 250000, say("costly order"))


def returned_lines() -> Answer:
    return counted(F.col("lines"), lambda x: x["flag"] == "R", lambda x: say("returned part ", x["part"]), lambda x: x["number"])


def open_share() -> Answer:
    return shared(F.col("lines"), lambda x: x["status"] == "F", lambda x: say("line is open: ", x["number"]))


def size_class() -> Answer:
    n = F.size("lines")
    return categorized([(n == 0, "empty"), (n <= 2, "small"), (n <= 5, "medium")], "large", say("lines: ", n))


def widest_line() -> Answer:
    return measured(F.coalesce(F.array_max(F.transform("lines", lambda x: x["quantity"])), F.lit(0)), "widest line")


RULES = [
    _rule("ORD1", "boolean", costly, Boolean(False)),
    _rule("ORD2", "integer", returned_lines, Numeric(maximum=1)),
    _rule("ORD3", "float", open_share, Numeric(minimum=50)),
    _rule("ORD4", "category", size_class, Category.closed(["empty", "small", "medium", "large"], ["small", "medium"], ["empty"])),
    _rule("ORD5", "integer", widest_line, Numeric(minimum=10, maximum=45)),
]

_LINES = "SELECT o.o_orderkey, o.o_totalprice AS price, o.o_orderpriority AS path, o.o_orderstatus AS language, count(l_orderkey) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_linestatus = 'F') AS closed, coalesce(max(CAST(l_quantity AS BIGINT)), 0) AS widest FROM orders o LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"
_RESULTS = f"""
facts AS ({_LINES}),
results AS (
  SELECT 'ORD1' AS rule_id, CAST(o_orderkey AS VARCHAR) AS fact_id, CASE WHEN price >= 250000 THEN 'fail' ELSE 'pass' END AS verdict, CASE WHEN price >= 250000 THEN 1 ELSE 0 END AS finding_count FROM facts
  UNION ALL SELECT 'ORD2', CAST(o_orderkey AS VARCHAR), CASE WHEN returned <= 1 THEN 'pass' ELSE 'fail' END, returned FROM facts
  UNION ALL SELECT 'ORD3', CAST(o_orderkey AS VARCHAR), CASE WHEN (CASE WHEN n = 0 THEN 0.0 ELSE 100.0 * closed / n END) >= 50 THEN 'pass' ELSE 'fail' END, n - closed FROM facts
  UNION ALL SELECT 'ORD4', CAST(o_orderkey AS VARCHAR), CASE WHEN n = 0 THEN 'unassessed' WHEN n <= 5 THEN 'pass' ELSE 'fail' END, 1 FROM facts
  UNION ALL SELECT 'ORD5', CAST(o_orderkey AS VARCHAR), CASE WHEN widest BETWEEN 10 AND 45 THEN 'pass' ELSE 'fail' END, 1 FROM facts)"""


def _one(table, rule: Rule, column: str) -> DataFrame:
    return evaluate({"Order": order_facts(table)}, [rule]).select("fact_id", F.col(column).alias("value"), "finding_count", "verdict")


@query(f"WITH facts AS ({_LINES}) SELECT CAST(o_orderkey AS VARCHAR) AS fact_id, price >= 250000 AS value, CAST(CASE WHEN price >= 250000 THEN 1 ELSE 0 END AS BIGINT) AS finding_count, CASE WHEN price >= 250000 THEN 'fail' ELSE 'pass' END AS verdict FROM facts")
def a1_rule_boolean(table):
    return _one(table, RULES[0], "boolean_value")


@query(f"WITH facts AS ({_LINES}) SELECT CAST(o_orderkey AS VARCHAR) AS fact_id, returned AS value, returned AS finding_count, CASE WHEN returned <= 1 THEN 'pass' ELSE 'fail' END AS verdict FROM facts")
def a2_rule_integer(table):
    return _one(table, RULES[1], "integer_value")


@query(f"WITH facts AS (SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE 100.0 * closed / n END AS value FROM ({_LINES})) SELECT CAST(o_orderkey AS VARCHAR) AS fact_id, CAST(value AS DOUBLE) AS value, n - closed AS finding_count, CASE WHEN value >= 50 THEN 'pass' ELSE 'fail' END AS verdict FROM facts")
def a3_rule_float(table):
    return _one(table, RULES[2], "float_value")


@query(f"WITH facts AS ({_LINES}) SELECT CAST(o_orderkey AS VARCHAR) AS fact_id, CASE WHEN n = 0 THEN 'empty' WHEN n <= 2 THEN 'small' WHEN n <= 5 THEN 'medium' ELSE 'large' END AS value, CAST(1 AS BIGINT) AS finding_count, CASE WHEN n = 0 THEN 'unassessed' WHEN n <= 5 THEN 'pass' ELSE 'fail' END AS verdict FROM facts")
def a4_rule_category(table):
    return _one(table, RULES[3], "category_value")


@query(f"WITH {_RESULTS} SELECT rule_id, count(*) AS observation_count, count(*) FILTER (WHERE verdict = 'unassessed') AS unassessed_count, count(*) FILTER (WHERE verdict = 'fail') AS failure_count, CAST(coalesce(sum(finding_count) FILTER (WHERE verdict = 'fail'), 0) AS BIGINT) AS finding_count FROM results GROUP BY rule_id")
def a5_verdict_summary(table):
    return summary(evaluate({"Order": order_facts(table)}, RULES))


@query(f"WITH {_RESULTS} SELECT rule_id, fact_id, verdict, CAST(finding_count AS BIGINT) AS finding_count FROM results")
def a5_verdicts(table):
    return evaluate({"Order": order_facts(table)}, RULES).select("rule_id", "fact_id", "verdict", "finding_count")


@query("SELECT c_custkey, count(o_orderkey) AS integer_value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def a6_counted_zero_fill(table):
    return counted_rows(table("customer").select("c_custkey"), table("orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN 0.0 ELSE 100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(o_orderkey) END AS float_value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def a7_coverage_percentage(table):
    return coverage(table("customer").select("c_custkey"), table("orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", F.col("o_orderstatus") == "F")


@query(f"WITH {_RESULTS} SELECT rule_id, fact_id, CAST(finding_count AS BIGINT) AS finding_count FROM results WHERE verdict = 'fail' ORDER BY fact_id, rule_id LIMIT 50")
def a8_failures_topk(table):
    return failures(evaluate({"Order": order_facts(table)}, RULES), 50).select("rule_id", "fact_id", "finding_count")


@query("""
WITH bad AS (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey HAVING count(*) > 1)
SELECT 'ORD2' AS rule_id, CAST(l_orderkey AS VARCHAR) AS fact_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_linestatus) - 1 AS INTEGER) AS finding_order, 'returned part ' || l_partkey AS message, CAST(l_linenumber AS BIGINT) AS line
FROM lineitem JOIN bad USING (l_orderkey) WHERE l_returnflag = 'R'""")
def a9_findings_of_failures(table):
    return findings(failures(evaluate({"Order": order_facts(table)}, RULES[1:2]))).select("rule_id", "fact_id", "finding_order", "message", "line")


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 5 AND 40 THEN 'pass' ELSE 'fail' END AS verdict FROM part")
def a10_numeric_interval(table):
    return table("part").select("p_partkey", Numeric(5, 40).verdict(F.col("p_size")).alias("verdict"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'fail' WHEN '2-HIGH' THEN 'fail' WHEN '3-MEDIUM' THEN 'unassessed' ELSE 'pass' END AS verdict FROM orders")
def a11_category_outcomes(table):
    policy = Category(frozenset({"4-NOT SPECIFIED", "5-LOW"}), frozenset({"3-MEDIUM"}), frozenset({"1-URGENT", "2-HIGH"}))
    return table("orders").select("o_orderkey", policy.verdict(F.col("o_orderpriority")).alias("verdict"))


@query("SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE lang IN ('en', 'de') GROUP BY lang")
def a12_language_restricted(table):
    return table("documents").where(F.col("lang").isin("en", "de")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS fact_id, 'lines' AS relation, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag, l_linestatus) - 1 AS BIGINT) AS ordinal, CAST(l_partkey AS VARCHAR) AS part, l_returnflag AS flag FROM lineitem SEMI JOIN orders ON o_orderkey = l_orderkey")
def n1_normalized_records(table):
    records = normalize(order_facts(table))["records"]
    return records.select("fact_id", "relation", "ordinal", F.col("fields")["part"].alias("part"), F.col("fields")["flag"].alias("flag"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS fact_id, o_totalprice AS price, true AS \"lines.present\", count(l_orderkey) AS \"lines.length\" FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def n2_normalized_facts(table):
    return normalize(order_facts(table))["facts"].select("fact_id", "price", "`lines.present`", "`lines.length`")


@query("SELECT CAST(conv_id AS VARCHAR) AS fact_id, 'roles' AS relation, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS BIGINT) AS ordinal, role AS string_value, count(*) OVER (PARTITION BY conv_id) AS container_length FROM conversations")
def n3_normalized_values(table):
    """A conversation's turns are one fact's values, which a conversation bounds."""
    rows = table("conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    facts = rows.select(F.col("conv_id").cast("string").alias("fact_id"), F.lit("p").alias("path"), F.lit("l").alias("language"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), "roles")
    return normalize(facts)["values"].select("fact_id", "relation", "ordinal", "string_value", "container_length")


@query("""
WITH t AS (SELECT doc_id, lower(text) AS x, count(*) OVER () AS n FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, len(regexp_extract_all(x, 'license|copyright')) AS a, len(regexp_extract_all(x, 'you|your')) AS b FROM t)
SELECT doc_id, CASE WHEN a + b = 0 THEN 'uncertain' WHEN a >= b AND a >= 0.6 * (a + b) THEN 'legal' WHEN b > a AND b >= 0.6 * (a + b) THEN 'talk' ELSE 'uncertain' END AS category FROM h""")
def f2_classify(table):
    """A deterministic backend, behind the confidence gate."""
    rows = table("documents").where("text IS NOT NULL").select("doc_id", F.lower("text").alias("subject_json"))
    backend = model.Keywords({"legal": "license|copyright", "talk": "you|your"})
    return model.classify(rows, backend, "what is it?", ("legal", "talk")).select("doc_id", "category")


@query("""
WITH t AS (SELECT doc_id, quality, toxic FROM labels)
SELECT doc_id, CASE WHEN quality IS NULL OR toxic IS NULL THEN 'uncertain' WHEN quality = 1 AND toxic = 0 THEN 'keep' WHEN toxic = 1 THEN 'drop' ELSE 'review' END AS category FROM t""")
def f3_decision_table(table):
    answers = table("labels").select("doc_id", *[F.when(F.col(c) == 1, "yes").when(F.col(c) == 0, "no").otherwise("unknown").alias(c) for c in ("quality", "toxic")])
    rows = (model.Decision({"quality": True, "toxic": False}, "keep"), model.Decision({"toxic": True}, "drop"))
    return answers.select("doc_id", model.decided(["quality", "toxic"], rows, "review").alias("category"))


@query("SELECT vec_id, CASE WHEN label IN (0, 1, 2) AND abs(embedding[1]) >= 0.1 THEN 'c' || label ELSE 'uncertain' END AS category FROM embeddings")
def f4_confidence_gate(table):
    rows = table("embeddings").select("vec_id", F.concat(F.lit("c"), F.col("label").cast("string")).alias("answer"), F.abs(F.get("embedding", 0)).cast("double").alias("confidence"))
    return rows.select("vec_id", model.gated(("c0", "c1", "c2"), model.UNCERTAIN, 0.1).alias("category"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS fact_id, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def f1_candidate_json(table):
    rows = model.candidates(order_facts(table), ["fact_id"], ["lines", "price"])
    return rows.select("fact_id", F.json_array_length(F.get_json_object("subject_json", "$.lines")).cast("bigint").alias("n"))


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders),
c AS (SELECT c_nationkey, o_custkey, count(*) AS commits, count(DISTINCT o_orderkey) AS n, max(CAST(o_orderdate AS DATE)) AS last_day, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS spent FROM o JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
b AS (SELECT c_nationkey, max(commits) AS busiest FROM c GROUP BY c_nationkey)
SELECT o_custkey, commits FROM c JOIN b USING (c_nationkey) WHERE commits >= 2 AND commits >= 0.5 * busiest AND spent > 1000000""")
def flagship_large_customers_reopened(table):
    """Customers who keep coming back with large orders, measured against their nation's busiest."""
    orders = table("orders").select("o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    by = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("commits"), F.sum("price").alias("spent"))
    by = by.join(table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    busiest = by.groupBy("c_nationkey").agg(F.max("commits").alias("busiest"))
    return by.join(busiest, "c_nationkey").where("commits >= 2 AND commits >= 0.5 * busiest AND spent > 1000000").select("o_custkey", "commits")


