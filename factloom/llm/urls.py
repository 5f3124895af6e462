"""URL filter: rules on host and path, and logistic regression on hashed character n-grams.

The regression is trained from ``LABELLED``, a small table of URLs, when the query is
built.  A URL's features are the shares of its n-grams of host and path in ``BUCKETS``
hash buckets.  Scoring runs in DataFrame functions alone.

Cases: a null URL or one without ``://`` has empty host and path, no rule, and scores by the
intercept; empty strings, ports, user names and long URLs are taken as they come; repeated
rows are judged alike; an empty table gives an empty one; columns named
``host``, ``path``, ``rule``, ``score`` or ``verdict`` are replaced, others pass.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import table

NAME = "op8_urls"
BUCKETS = 4096
SIZES = (3, 4, 5)
#: Probability of a blocked URL from which the method blocks.
THRESHOLD = 0.5
#: (verdict, rule).  At most this many rules become one expression; more belong in a table.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MOST_RULES = 1000

_BAD = """cheap-pills spam-farm free-casino online-poker buy-viagra payday-loans hot-singles adult-dating xxx-videos
lottery-winner miracle-diet replica-watches casino-bonus porn-tube sex-cams crypto-doubler fast-cash weight-loss-pills
discount-pharmacy free-bets ads-track ad-server track-clicks win-prizes click-farm link-farm seo-spam ad-clicks malware-download cracked-software torrent-warez keygen-serial
bet-now slot-machines escort-girls phishing-login prize-claim free-iphone work-from-home-rich make-money-fast""".split()
_GOOD = """university library museum newsroom weather recipes gardening history science physics travel-notes city-council
school-district orchestra cinema-review bookshop bicycle-club photography astronomy open-source documentation
statistics-office hospital-info public-transport parliament archive encyclopedia dictionary football-results
philosophy chess-club hiking-trails language-course mathematics marine-biology""".split()
#: Ordinary names are two of these words, any two that stand apart in the list by one of ``_APART``.
_WORDS = """river stone garden north market bridge lake valley house school music paper forest street harbor winter
summer bread coffee studio design build travel health energy water light green mountain village family kitchen
letter story window engine rail sport theater doctor farm island coast planet circle silver golden report
journal daily local world open central united first modern royal grand old new""".split()
_APART = (1, 3, 7, 12, 18)
_TLDS = ("com", "org", "net", "de", "fr", "es", "co.uk", "info", "io", "edu")
_PREFIXES = ("", "www.", "blog.", "m.", "news.", "shop.")
#: Paths of either kind of page, and paths that only pages to be blocked have.
_PLAIN = ("", "/", "/en/", "/about", "/news/2021/05", "/articles/17.html", "/wiki/main_page", "/products/list", "/de/12.html", "/blog/post-4", "/contact", "/fr/803", "/es/77/", "/docs/guide/intro", "/index.php", "/2019/story.htm")
_TELLING = ("/casino/bonus", "/win/prize-claim", "/xxx/videos", "/pills/cheap", "/adult/dating", "/download/crack-keygen", "/loans/payday", "/bet/slots")


def labelled() -> list[tuple[str, int]]:
    """The labelled URL table: (URL, 1 if it is to be blocked).  Ordinary names are in the majority, as on the web."""
    rows = []

    def add(name: str, n: int, path: str, label: int) -> None:
        rows.append((f"http{'s' * (n % 3 > 0)}://{_PREFIXES[n % len(_PREFIXES)]}{name}.{_TLDS[n // 2 % len(_TLDS)]}{path}", label))

    for n, name in enumerate(_BAD):
        for k in range(2):
            add(name, n + 5 * k, _PLAIN[(n + 7 * k) % len(_PLAIN)], 1)
    for n, name in enumerate(_GOOD):
        for k in range(2):
            add(name, n + 5 * k, _PLAIN[(n + 7 * k) % len(_PLAIN)], 0)
    for n, first in enumerate(_WORDS):
        for k, apart in enumerate(_APART):
            name = first + "-" * (k % 2) + _WORDS[(n + apart) % len(_WORDS)]
            add(name, n + k, _PLAIN[(n + 3 * k) % len(_PLAIN)], 0)
        add(first, n, _TELLING[n % len(_TELLING)], 1)
    return rows


def split_url(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path, of a URL."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, parts, n), F.lit("")) for n in (1, 2))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules; join a table of rules instead")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last one stands outermost
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def _bucket(gram: str) -> int:
    return int(hashlib.md5(gram.encode()).hexdigest()[:3], 16)


def _grams(host: str, path: str) -> list[str]:
    return [f"{kind}{part[i : i + n]}" for kind, part in (("h", host), ("p", path)) for n in SIZES for i in range(len(part) - n + 1)]


def fit(rows: list[tuple[str, int]]) -> tuple[tuple[float, ...], float]:
    """Weights of the buckets and the intercept, by gradient descent with a small ridge."""
    x, y = np.zeros((len(rows), BUCKETS)), np.array([label for _, label in rows], dtype=float)
    for k, (url, _) in enumerate(rows):
        host, _, path = url.partition("://")[2].partition("/")
        grams = _grams(host, f"/{path}")
        for g in grams:
            x[k, _bucket(g)] += 1 / len(grams)
    weights, base = np.zeros(BUCKETS), 0.0
    share = 1 / len(y)  # unweighted, so that a URL of unknown n-grams is taken for an ordinary one
    for _ in range(3000):
        miss = share * (1 / (1 + np.exp(-(x @ weights + base))) - y)
        weights -= 60.0 * (x.T @ miss + 1e-6 * weights)
        base -= 1.0 * miss.sum()
    return tuple(round(float(w), 4) for w in weights), round(float(base), 4)


@lru_cache(maxsize=1)
def model() -> tuple[tuple[float, ...], float]:
    """What is learned from the labelled table."""
    return fit(labelled())


def score(host: Column, path: Column) -> Column:
    """Probability that a URL is to be blocked."""
    weights, base = model()
    table_of = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<double>")

    def cut(kind: str, text: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        made = F.transform(starts, lambda i: F.concat(F.lit(kind), F.substring(text, i, F.lit(n))))
        return F.when(F.length(text) < n, F.array().cast("array<string>")).otherwise(made)

    def part(kind: str, text: Column) -> Column:
        return F.concat(*[cut(kind, text, n) for n in SIZES])

    grams = F.concat(part("h", host), part("p", path))
    hashes = F.transform(grams, lambda g: F.conv(F.substring(F.md5(g.cast("binary")), 1, 3), 16, 10).cast("int"))
    total = F.aggregate(hashes, F.lit(0.0), lambda acc, h: acc + F.get(table_of, h))
    return 1 / (1 + F.exp(-(total / F.greatest(F.size(grams), F.lit(1)) + F.lit(base))))


def judge(df: DataFrame, url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``score`` and ``verdict`` for each row."""
    host, path = split_url(F.col(url))
    df = df.withColumns({"host": host, "path": path})  # both read the URL as it came
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    df = df.withColumns({"rule": rule, "score": F.round(score(F.col("host"), F.col("path")), 6)})
    return df.withColumn("verdict", F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


def _sql() -> str:
    weights, base = model()
    rule = verdict = "NULL"
    for decision, text in sorted(RULES, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash + rest}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{decision}' ELSE {verdict} END"
    grams = ", ".join(f"CASE WHEN length({part}) < {n} THEN [] ELSE list_transform(range(1, length({part}) - {n - 2}), lambda i: '{kind}' || substr({part}, i, {n})) END" for kind, part in (("h", "host"), ("p", "path")) for n in SIZES)
    return f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
grams AS (SELECT *, flatten([{grams}]) AS g FROM parts),
scored AS (
  SELECT *, round(1 / (1 + exp(-(coalesce(list_sum(list_transform(g, lambda x: ([{",".join(map(str, weights))}])[1 + CAST('0x' || substr(md5(x), 1, 3) AS INTEGER)])), 0.0)
         / greatest(len(g), 1) + ({base})))), 6) AS score FROM grams)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN score >= {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict, score FROM scored"""


ORACLE_SQL = _sql()
