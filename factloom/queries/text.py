"""Queries on text: prose, paths, routes, secrets, markers, literals and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.text import extract, first_of, last_of, literal_split, pad_start, range_of, strip, strip_prefix
from factloom.operators import prose
from factloom.queries import query

_DOCS = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"
_SPLIT = "list_filter(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1\x01', 'g'), '\x01'), lambda s: regexp_matches(s, '\\S'))"


def _docs(table):
    return table("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


_UNIFORM = """
, m AS (SELECT *, len(sizes) AS n, list_sum(sizes) / len(sizes)::DOUBLE AS mean FROM w)
SELECT doc_id, CAST(n AS INTEGER) AS n, CASE WHEN n >= {least} THEN round(greatest(0.0, 100.0 * (1 - list_sum(list_transform(sizes, lambda x: abs(x - mean))) / n / mean)), 6) END AS uniformity FROM m"""
_WORDS = "list_transform({}, lambda s: len(regexp_extract_all(s, '[^ \\t\\n\\x0b\\f\\r]+')))"


@query(f"WITH s AS (SELECT doc_id, {_SPLIT} AS parts FROM {_DOCS}), w AS (SELECT doc_id, list_filter({_WORDS.format('parts')}, lambda n: n >= 3) AS sizes FROM s)" + _UNIFORM.format(least=5))
def d2_sentence_length_uniformity(table):
    rows = _docs(table).withColumn("sizes", F.filter(F.transform(prose.sentences(F.col("text")), prose.word_count), lambda n: n >= 3))
    return rows.select("doc_id", F.size("sizes").alias("n"), F.round(prose.uniformity(F.col("sizes"), 5), 6).alias("uniformity"))


@query(f"WITH s AS (SELECT doc_id, list_filter(string_split_regex(text, '\\n[ \\t]*\\n\\s*'), lambda s: regexp_matches(s, '\\S')) AS parts FROM {_DOCS}), w AS (SELECT doc_id, list_filter({_WORDS.format('parts')}, lambda n: n >= 2) AS sizes FROM s)" + _UNIFORM.format(least=2))
def d3_paragraph_length_uniformity(table):
    rows = _docs(table).withColumn("sizes", F.filter(F.transform(prose.paragraphs(F.col("text")), prose.word_count), lambda n: n >= 2))
    return rows.select("doc_id", F.size("sizes").alias("n"), F.round(prose.uniformity(F.col("sizes"), 2), 6).alias("uniformity"))


@query(f"""
WITH s AS (SELECT doc_id, unnest({_SPLIT}) AS sentence FROM {_DOCS}),
o AS (SELECT doc_id, lower(regexp_extract(sentence, '([\\p{{L}}\\p{{N}}]+)', 1)) AS opener FROM s),
c AS (SELECT doc_id, opener, count(*) AS n FROM o WHERE opener NOT IN ('', 'a', 'i') GROUP BY ALL)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS sentences, CAST(max(n) AS BIGINT) AS most FROM c GROUP BY doc_id HAVING sum(n) >= 6""")
def d1_opener_concentration(table):
    """Openers are added up within a document before the largest is taken."""
    rows = _docs(table).select("doc_id", F.explode(prose.sentences(F.col("text"))).alias("sentence")).select("doc_id", prose.opener(F.col("sentence")).alias("opener"))
    by = rows.where(~F.col("opener").isin("", "a", "i")).groupBy("doc_id", "opener").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("doc_id").agg(F.sum("n").alias("sentences"), F.max("n").alias("most")).where("sentences >= 6")


_PATH = "regexp_replace(url, '^[a-z]+://', '')"
_PARTS = f"list_filter(string_split(regexp_extract({_PATH}, '^[^?#]*', 0), '/'), lambda p: p <> '')"


def _parts():
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return F.filter(literal_split(F.regexp_extract(path, "^[^?#]*", 0), "/"), lambda p: p != "")


@query(f"SELECT page_id, CAST(len(list_filter({_PARTS}, lambda p: regexp_matches(p, '[^\\x00-\\x7f]'))) AS INTEGER) AS n FROM pages WHERE url IS NOT NULL")
def d4_non_ascii_components(table):
    return table("pages").where("url IS NOT NULL").select("page_id", F.size(F.filter(_parts(), lambda p: p.rlike(r"[^\x00-\x7f]"))).alias("n"))


@query(f"SELECT page_id, CAST(len({_PARTS}) - 1 AS INTEGER) AS depth, {_PARTS}[1] AS head, {_PARTS}[-1] AS tail FROM pages WHERE url IS NOT NULL")
def d5_path_depth(table):
    rows = table("pages").where("url IS NOT NULL").select("page_id", _parts().alias("parts"))
    return rows.select("page_id", (F.size("parts") - 1).alias("depth"), first_of(F.col("parts")).alias("head"), last_of(F.col("parts")).alias("tail"))


@query(f"""
WITH s AS (SELECT page_id, unnest({_PARTS}) AS part FROM pages), k AS (SELECT *, CASE WHEN contains(part, '-') THEN '-' WHEN contains(part, '_') THEN '_' WHEN regexp_matches(part, '[0-9]') THEN '0' ELSE '' END AS style FROM s)
SELECT style, count(*) AS n FROM k GROUP BY style""")
def d6_route_style(table):
    rows = table("pages").where("url IS NOT NULL").select(F.explode(_parts()).alias("part"))
    style = F.when(F.col("part").contains("-"), "-").when(F.col("part").contains("_"), "_").when(F.col("part").rlike("[0-9]"), "0").otherwise("")
    return rows.groupBy(style.alias("style")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT path, count(*) AS n, min(page_id) AS first_page FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) AS path FROM pages WHERE regexp_matches(url, '^[a-z]+://[^/]*/')) GROUP BY path HAVING count(*) > 1")
def d7_duplicate_route(table):
    rows = table("pages").select("page_id", extract(F.col("url"), "^[a-z]+://[^/]*(/[^?#]*)").alias("path")).where("path IS NOT NULL")
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page")).where("n > 1")


_SECRET = "(?i)(api[_-]?key|secret|token|password)[ \\t]*[:=][ \\t]*\"?[A-Za-z0-9_./+-]{8,}"


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{_SECRET}')) AS n FROM {_DOCS} WHERE regexp_matches(text, '{_SECRET}')")
def d8_secret_names(table):
    rows = _docs(table).where(F.col("text").rlike(_SECRET))
    return rows.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(_SECRET), F.lit(0))).cast("bigint").alias("n"))


@query(f"SELECT doc_id, regexp_matches(text, '(?i)(^|[^a-z0-9])(md5|sha1|sha-1)([^a-z0-9]|$)') AS weak FROM {_DOCS}")
def d9_weak_hash_words(table):
    return _docs(table).select("doc_id", F.col("text").rlike("(?i)(^|[^a-z0-9])(md5|sha1|sha-1)([^a-z0-9]|$)").alias("weak"))


@query(f"WITH l AS (SELECT doc_id, unnest(string_split(text, '\n')) AS line FROM {_DOCS}) SELECT doc_id, count(*) AS n FROM l WHERE regexp_matches(line, '^[^A-Za-z0-9_]*(TODO|FIXME|XXX|HACK|Copyright|The|De)([^A-Za-z0-9_]|$)') GROUP BY doc_id")
def d10_marker_lines(table):
    rows = _docs(table).select("doc_id", F.explode(literal_split(F.col("text"), "\n")).alias("line"))
    return rows.where(F.col("line").rlike("^[^A-Za-z0-9_]*(TODO|FIXME|XXX|HACK|Copyright|The|De)([^A-Za-z0-9_]|$)")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, '\n')) AS line, generate_subscripts(string_split(text, '\n'), 1) AS i FROM {_DOCS})
SELECT doc_id, CAST(i AS BIGINT) AS line_number, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS BIGINT) AS start, CAST(length(line) - length(ltrim(line, ' ')) AS INTEGER) AS indent FROM l""")
def d11_lines_with_offsets(table):
    """Offsets add up inside a row, so that lines need no window over a shuffle."""
    rows = _docs(table).select("doc_id", literal_split(F.col("text"), "\n").alias("lines"))
    step = F.aggregate(
        "lines",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all")),
        lambda a, x: F.struct((a["at"] + F.length(x) + 1).alias("at"), F.array_append(a["all"], a["at"]).alias("all")),
        lambda a: a["all"],
    )
    zipped = rows.select("doc_id", F.posexplode(F.arrays_zip(F.col("lines"), step.alias("starts"))).alias("i", "x"))
    named = zipped.select("doc_id", (F.col("i") + 1).cast("bigint").alias("line_number"), F.col("x.lines").alias("line"), F.col("x.starts").alias("start"))
    return named.select("doc_id", "line_number", "start", (F.length("line") - F.length(F.ltrim("line"))).alias("indent"))


@query("WITH w AS (SELECT conv_id, unnest(string_split(text, ' ')) AS value FROM conversations) SELECT value, count(*) AS n, count(DISTINCT conv_id) AS files FROM w WHERE length(value) >= 12 GROUP BY value HAVING count(*) >= 3 AND count(DISTINCT conv_id) >= 2")
def d12_repeated_literals(table):
    """Values are counted by file first: a common value is one row for each file and partition."""
    words = table("conversations").select("conv_id", F.explode(literal_split(F.col("text"), " ")).alias("value")).where(F.length("value") >= 12)
    by = words.groupBy("value", "conv_id").agg(F.count(F.lit(1)).alias("k"))
    return by.groupBy("value").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("files")).where("n >= 3 AND files >= 2")


@query(f"WITH l AS (SELECT doc_id, unnest(string_split(text, '\n')) AS line FROM {_DOCS}) SELECT doc_id, line, count(*) AS n FROM l WHERE length(line) >= 8 GROUP BY ALL HAVING count(*) >= 4")
def d13_repeated_within_one(table):
    rows = _docs(table).select("doc_id", F.explode(literal_split(F.col("text"), "\n")).alias("line")).where(F.length("line") >= 8)
    return rows.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")


@query(f"WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split(text, ' '), lambda x: x <> '')) AS a FROM {_DOCS}) SELECT doc_id, len(a) AS kinds, len(list_filter(a, lambda x: NOT list_contains(['the', 'de', 'of'], x))) AS rest, len(list_intersect(a, ['the', 'de', 'of'])) AS common FROM w")
def d14_list_sets(table):
    common = F.array(*[F.lit(x) for x in ("the", "de", "of")])
    rows = _docs(table).select("doc_id", F.array_distinct(F.filter(literal_split(F.col("text"), " "), lambda x: x != "")).alias("a"))
    return rows.select("doc_id", F.size("a").cast("bigint").alias("kinds"), F.size(F.array_except("a", common)).cast("bigint").alias("rest"), F.size(F.array_intersect("a", common)).cast("bigint").alias("common"))


@query("SELECT p_partkey, trim(regexp_replace(p_name, '^[a-z]+ ', '')) AS tail, lpad(CAST(p_size AS VARCHAR), CAST(greatest(4, length(CAST(p_size AS VARCHAR))) AS INTEGER), '0') AS code, CASE WHEN starts_with(p_type, 'ECO') THEN substr(p_type, 4) ELSE p_type END AS kind, CAST(len(range(p_size, 10)) AS INTEGER) AS steps FROM part")
def d15_text_helpers(table):
    name = strip(F.regexp_replace("p_name", "^[a-z]+ ", ""))
    size = F.col("p_size").cast("bigint")
    return table("part").select("p_partkey", name.alias("tail"), pad_start(F.col("p_size").cast("string"), 4, "0").alias("code"), strip_prefix(F.col("p_type"), "ECO").alias("kind"), F.size(range_of(size, F.lit(10).cast("bigint"))).alias("steps"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def d16_json_fields(table):
    return table("events").select("event_id", F.get_json_object("props", "$.k").alias("k")).where("k IS NOT NULL")


@query("SELECT n_name, count(*) AS n FROM nation JOIN pages ON regexp_matches(url, '(^|[^0-9])' || n_nationkey || '([^0-9]|$)') GROUP BY n_name")
def b10_dynamic_regex_mention(table):
    """Names are looked up by the words of a text: an equal join, not each text against each name."""
    words = table("pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("url", F.lit("[0-9]+"), F.lit(0)))).alias("word"))
    names = table("nation").select("n_name", F.col("n_nationkey").cast("string").alias("word"))
    return words.join(names, "word").groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))
