"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Everything is a DataFrame expression.  Offsets need no search function: the text is split at
a pattern's matches, and the lengths of gaps and matches add up to code-point offsets.  They
are summed in blocks, so that a text with very many matches takes far less than quadratic
time.  Patterns run possessively and start only where a run starts or the last match ended,
which finds the same matches in linear time on long runs of characters.

Kinds: ``email``, ``ip`` (parts up to 255), ``card`` (13 to 19 digits, Luhn) and ``phone``
(9 to 15 digits) stand on pattern and check alone.  ``iban`` needs its country's length and
mod-97, ``ssn`` (three, two and four digits) needs a telling word before it; a word like
"example" before either lowers the score.  Spans scoring ``LEAST`` or more count.

Cases: null and empty texts have no spans; texts of any length are searched whole;
overlapping spans of different kinds all count; repeated rows are treated alike; an empty
table gives an empty one; other columns pass, a column named ``pii`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import fresh, table

NAME = "op4_pii"
LEAST = 0.6
BLOCK = 64
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: A text without a match of this has no span of the kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "ssn": "[0-9]-[0-9]{2}-[0-9]"}
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24}
#: Code points before a span that are searched for context words.
BEFORE = 40
TELLING = {"iban": "iban|konto|account|bank|compte|cuenta|iban:", "ssn": "ssn|social security|social-security"}
DOUBTS = "example|sample|test|beispiel|exemple|ejemplo"
PLACEHOLDERS = {k: f"<{k.upper()}>" for k in KINDS}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right."""
    doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    marks = F.split(F.reverse(digits), "")
    values = F.transform(marks, lambda c, i: F.when(i % 2 == 1, F.get(doubled, c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _mod97(plain: Column) -> Column:
    """Whether an IBAN without spaces has the remainder 1."""
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    values = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97) == 1


def confirmed(kind: str, match: Column) -> Column:
    """Whether a match of the kind's pattern passes its check."""
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        plain = F.replace(match, F.lit(" "), F.lit(""))
        lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
        return F.when(F.length(plain) == F.try_element_at(lengths, F.substring(plain, 1, 2)), _mod97(plain)).otherwise(False)
    return F.lit(True)


def scored(kind: str, match: Column, gap: Column) -> Column:
    """Score of a match from its check and from the words in the gap before it; 0 if the check fails."""
    if kind in BASE:
        start = F.lit(1.0)
    else:
        words = F.lower(F.right(gap, F.lit(BEFORE)))
        told = F.when(words.rlike(TELLING[kind]), 0.3).otherwise(0.0) - F.when(words.rlike(DOUBTS), 0.3).otherwise(0.0)
        start = F.round(F.lit({"iban": 0.7, "ssn": 0.4}[kind]) + told, 1)
    return F.when(confirmed(kind, match), start).otherwise(0.0)


def _gaps(kind: str, text: Column) -> Column:
    return F.when(text.rlike(HINTS[kind]), F.split(text, PATTERNS[kind], -1))


def _matches(kind: str, text: Column) -> Column:
    return F.when(text.rlike(HINTS[kind]), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)))


def _spans(kind: str, gaps: Column, matches: Column) -> Column:
    """Spans (kind, start, end, score) of the matches; offsets are summed block by block."""
    steps = F.transform(matches, lambda m, i: F.struct(F.length(F.get(gaps, i)).cast("bigint").alias("gap"), F.length(m).cast("bigint").alias("size"), scored(kind, m, F.get(gaps, i)).alias("score")))
    none = F.array().cast("array<struct<start:bigint,end:bigint,score:double>>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))
    summed = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0).cast("bigint"), lambda a, x: a + x["gap"] + x["size"]))
    offsets = F.aggregate(
        summed,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all")),
        lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")),
    )["all"]
    within = F.zip_with(
        blocks,
        offsets,
        lambda block, at: F.aggregate(
            block,
            F.struct(at.alias("at"), none.alias("all")),
            lambda a, x: F.struct(
                (a["at"] + x["gap"] + x["size"]).alias("at"),
                F.concat(a["all"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["size"]).alias("end"), x["score"].alias("score")))).alias("all"),
            ),
        )["all"],
    )
    kept = F.filter(F.flatten(within), lambda s: s["score"] >= LEAST)
    named = F.transform(kept, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    return F.when(F.size(matches) > 0, named).otherwise(empty)


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``pii``: spans (kind, start, end, score), by kind as in ``KINDS``, then start."""
    passed = [c for c in df.columns if c != "pii"]
    # the rows stand in one struct, so that working columns never clash with theirs
    df = df.select(F.struct(*passed).alias("row"), F.col(text).alias("text"))
    df = df.select("*", *[f(k, F.col("text")).alias(f"{n}_{k}") for k in KINDS for n, f in (("gaps", _gaps), ("found", _matches))])
    df = df.select("*", *[_spans(k, F.col(f"gaps_{k}"), F.col(f"found_{k}")).alias(f"spans_{k}") for k in KINDS])
    return df.select("row.*", F.concat(*[F.coalesce(f"spans_{k}", F.array()) for k in KINDS]).alias("pii"))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Put a placeholder in the text for each span, kind after kind in the order of ``KINDS``."""
    gaps, found = fresh(df, "__gaps"), fresh(df, "__found")
    for kind in KINDS:
        df = df.withColumns({gaps: _gaps(kind, F.col(text)), found: _matches(kind, F.col(text))})
        df = df.withColumn(text, F.when(F.size(found) > 0, F.array_join(_pieces(kind, F.col(gaps), F.col(found)), "")).otherwise(F.col(text))).drop(gaps, found)
    return df


def _pieces(kind: str, gaps: Column, found: Column) -> Column:
    put = F.transform(found, lambda m, i: F.when(scored(kind, m, F.get(gaps, i)) >= LEAST, PLACEHOLDERS[kind]).otherwise(m))
    return F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(put, i), F.lit(""))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document, with digests."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    counts = [_count(kind).alias(f"n_{kind}") for kind in BASE]
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"))


def _count(kind: str) -> Column:
    return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("bigint")


def _sql() -> str:
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": PATTERNS["phone"],
        "iban": PATTERNS["iban"],
        "ssn": PATTERNS["ssn"],
    }
    lengths = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in IBAN_LENGTHS.items()) + "}"
    checks = {
        "email": "true",
        "ip": rf"regexp_full_match(m, '{_PART}(?:\.{_PART}){{3}}')",
        "card": "length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 0 THEN [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][1 + CAST(substr(reverse(d), i, 1) AS INT)] ELSE CAST(substr(reverse(d), i, 1) AS INT) END)) % 10 = 0",
        "phone": "length(d) BETWEEN 9 AND 15",
        "iban": f"length(p) = {lengths}[substr(p, 1, 2)] AND list_reduce(list_prepend(0, list_transform(string_split(substr(p, 5) || substr(p, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, x: (a * (CASE WHEN x > 9 THEN 100 ELSE 10 END) + x) % 97) = 1",
        "ssn": "true",
    }
    parts = []
    for n, kind in enumerate(KINDS):
        score = "1.0" if kind in BASE else f"round({({'iban': 0.7, 'ssn': 0.4}[kind])} + (CASE WHEN regexp_matches(w, '{TELLING[kind]}') THEN 0.3 ELSE 0 END) - (CASE WHEN regexp_matches(w, '{DOUBTS}') THEN 0.3 ELSE 0 END), 1)"
        parts.append(f"""
  SELECT doc_id, n, {n} AS k, '{kind}' AS kind, s, s + length(m) AS e FROM (
    SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d, replace(m, ' ', '') AS p, lower(right(g, {BEFORE})) AS w,
           sum(length(g) + length(m)) OVER (PARTITION BY n ORDER BY i) - length(m) AS s FROM (
      SELECT doc_id, n, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g FROM (
        SELECT doc_id, n, regexp_extract_all(text, '{plain[kind]}') AS ms, regexp_split_to_array(text, '{plain[kind]}') AS gs FROM docs)))
  WHERE CASE WHEN {checks[kind]} THEN {score} >= {LEAST} ELSE false END""")
    base = ", ".join(f"'{k}'" for k in BASE)
    counts = ", ".join(f"count(kind) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)
    item = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS n FROM documents),
spans AS ({' UNION ALL '.join(parts)})
SELECT docs.doc_id, {counts}, sha256(coalesce(string_agg({item}, ',' ORDER BY k, s) FILTER (WHERE kind IN ({base})), '')) AS base_sha256,
       coalesce(string_agg({item}, ',' ORDER BY k, s), '') AS spans
FROM docs LEFT JOIN spans USING (n) GROUP BY docs.n, docs.doc_id"""


ORACLE_SQL = _sql()
