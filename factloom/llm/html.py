"""Main text of web pages: parser events, text-to-tag ratio, Gaussian smoothing, clustering.

The standard library's parser streams through a page.  Text between two borders of block
elements is a line; each line knows its tags, its linked characters and the landmarks around
it.  Lines inside menus, footers, sidebars, notices, adverts, forms, scripts and comments are
furniture, by element, role, or words in ``class`` and ``id``.  Of the others, the characters
per tag are smoothed by a Gaussian over neighbouring lines, and a threshold between two
clusters tells content from the rest.  Regions of content are closed over short gaps,
and within one container over all unlinked lines up to its end.  Where a page marks articles,
those that hold a region are taken whole, as nothing of an article may be dropped.

Cases: null and empty pages, and pages of furniture alone, give the empty text; unclosed
elements end with their container; long pages are read whole; repeated rows are treated
alike; an empty table gives an empty one; other columns pass, ``text`` and ``n_chars`` are
replaced.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import map_rows, table

NAME = "op9_html"
#: Standard deviation of the smoothing, in lines, and how far it reaches.
SIGMA, REACH = 1.0, 2
#: Lines that a gap between two content lines may have, and the share of linked text in a menu.
GAP, LINKED = 4, 0.5
#: A line has more characters per tag than this in any cluster of content.
LEAST_RATIO = 12.0

# Fixed values of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section "
    "select summary table tbody tfoot thead title tr ul".split()
)
_CONTAINERS = frozenset("body article main section div td center blockquote".split())
_SPACES = frozenset("br td th".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SILENT = frozenset("script style noscript template head title iframe object svg math canvas audio video select textarea button option datalist map".split())
_FURNITURE = frozenset("nav aside footer form menu dialog search".split())
_ROLES = frozenset("navigation complementary banner contentinfo search form dialog alertdialog alert menu menubar toolbar tablist status".split())
_SPECIAL = _SILENT | _FURNITURE | {"article", "main", "header"}
#: What a start tag closes, if it is open inside the nearest of the borders.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
_NAMES = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Words of class and id names that mark furniture wherever they stand.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox adblock sponsor sponsored sponsors promo promos promotion "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars aside rail footer foot colophon masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices banner popup modal overlay newsletter subscribe subscription signup login paywall alert "
    "comment comments commentlist disqus respond reply replies discussion share sharing social related recommended recommendations "
    "widget widgets skip search searchbox form copyright legal disclaimer teaser teasers trending popular".split()
)
#: Of these, the ones around elements that look like articles and aren't the page's.
_OTHERS = frozenset("comment comments commentlist disqus respond reply replies discussion related recommended recommendations teaser teasers trending popular sidebar sidebars aside rail widget widgets".split())
#: Elements that mark the article itself are furniture for these words alone.
_ARTICLE_MARKS = _OTHERS | frozenset("ad ads advert advertisement sponsored promo".split())
#: With one of these, a word above names what the element is laid out around.
_AROUND = frozenset("with has no without layout open free".split())


@dataclass(slots=True)
class Line:
    """Text between two borders, with what is needed to judge it."""

    parts: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0
    region: int = 0
    container: int = 0
    kind: str = "body"
    heading: bool = False
    text: str = ""
    size: int = 0

    def close(self) -> None:
        self.text = " ".join("".join(self.parts).split())
        self.size = len(self.text)


class _Page(HTMLParser):
    """Lines of a page; furniture and silent elements leave none."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, str, int, str, int]] = []  # element, state, region, kind, container
        self.container = self.containers = 0
        self.state, self.region, self.kind = "", 0, "body"
        self.regions, self.links = 0, 0
        self.now = Line()

    def border(self) -> None:
        """End the line."""
        line = self.now
        if line.parts:
            line.close()
            if line.size:
                self.lines.append(line)
            line = self.now = Line()
        line.tags = line.linked = 0
        line.container = self.container
        line.region, line.kind, line.heading = self.region, self.kind, bool(self.open) and self.open[-1][0] in _HEADINGS

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers aren't needed, nor counted."""
        return j

    def judged(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[str, bool]:
        """State within the element, and whether it marks an article."""
        state = self.state
        if not attrs and tag not in _SPECIAL:
            return state, False
        given = {k: v or "" for k, v in attrs}
        if tag in _SILENT or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower():
            return "silent", False
        role = given.get("role", "").lower()
        names = given.get("class", "") + " " + given.get("id", "")
        words: set[str] = set()
        for name in names.split():
            found = _NAMES.findall(_CAMEL.sub("-", name).lower())
            if _AROUND.isdisjoint(found):
                words.update(found)
        marks_article = tag in ("article", "main") or role in ("article", "main")
        if marks_article:
            if _ARTICLE_MARKS.isdisjoint(words) and state not in ("silent", "aside"):
                return "", True  # an article ends furniture that was left open
            return state or "aside", False
        if state:
            other = state == "furniture" and (tag == "aside" or role == "complementary" or not _OTHERS.isdisjoint(words))
            return "aside" if other else state, False
        if tag in ("html", "body"):
            return state, False
        if tag == "form" or role == "form":
            return "form", False
        if tag == "header":
            return ("heading" if self.kind != "body" else "furniture"), False
        if tag == "aside" or role == "complementary":
            return "aside", False
        if tag in _FURNITURE or role in _ROLES:
            return "furniture", False
        if not _MARKS.isdisjoint(words):
            return ("furniture" if _OTHERS.isdisjoint(words) else "aside"), False
        if "header" in words and tag not in _HEADINGS:
            return ("heading" if self.kind != "body" else "furniture"), False
        return state, False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _SPACES:
            self.now.parts.append(" ")
        if tag in _VOID:
            self.now.tags += 1
            if tag == "hr":
                self.border()
            return
        block = tag in _BLOCKS
        if block:
            self.pop_implied(tag)
            self.border()
        elif tag in _CLOSES:
            self.pop_implied(tag)
        self.now.tags += 1
        state, marks_article = self.judged(tag, attrs)
        kept = (tag, self.state, self.region, self.kind, self.container)
        if tag in _CONTAINERS:
            self.containers += 1
            self.container = self.now.container = self.containers
        if state != self.state or marks_article:
            if not block:
                self.border()
            if marks_article:
                self.regions += 1
                self.region, self.kind = self.regions, "article" if tag == "article" or self.kind == "article" else "main"
            self.state = state
            self.now.region, self.now.kind = self.region, self.kind
        self.open.append(kept)
        self.links += tag == "a"
        if tag in _HEADINGS:
            self.now.heading = True

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML reads <div/> as <div>

    def pop_implied(self, tag: str) -> None:
        """Close what a start tag ends without an end tag of its own."""
        if tag in _CLOSES:
            closed, borders = _CLOSES[tag]
        else:  # a block ends an open paragraph
            closed, borders = {"p"}, _BLOCKS - {"p"}
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in closed:
                self.leave(k)
                return
            if self.open[k][0] in borders:
                return

    def leave(self, k: int) -> None:
        """Close the element at place ``k`` and all within it."""
        tag, state, region, kind, container = self.open[k]
        inner = self.open[k:]
        if tag in _BLOCKS or state != self.state or len(inner) > 1 and any(e[0] in _BLOCKS for e in inner):
            self.border()
        if self.links:
            self.links -= sum(e[0] == "a" for e in inner)
        del self.open[k:]
        self.state, self.region, self.kind, self.container = state, region, kind, container
        if not self.now.parts:
            self.now.container = container
            self.now.region, self.now.kind, self.now.heading = region, kind, False

    def handle_endtag(self, tag: str) -> None:
        self.now.tags += 1
        if tag in _SPACES:
            self.now.parts.append(" ")
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.leave(k)
                return
        if tag in _BLOCKS and tag not in ("html", "body"):
            self.border()

    def handle_data(self, data: str) -> None:
        if not self.state or self.state == "heading" and any(e[0] in _HEADINGS for e in self.open):
            self.now.parts.append(data)
            if self.links:
                self.now.linked += len(data.strip())


def lines_of(html: str) -> list[Line]:
    """Lines of a page that aren't furniture."""
    page = _Page()
    page.feed(html)
    page.close()
    page.border()
    return page.lines


def smoothed(values: list[float]) -> list[float]:
    """Gaussian average over neighbouring lines."""
    weights = {k: math.exp(-k * k / (2 * SIGMA * SIGMA)) for k in range(-REACH, REACH + 1)}
    out = []
    for i in range(len(values)):
        near = [(values[i + k], w) for k, w in weights.items() if 0 <= i + k < len(values)]
        out.append(sum(v * w for v, w in near) / sum(w for _, w in near))
    return out


def threshold(values: list[float]) -> float:
    """Border between two clusters, by moving two means until they stay."""
    low, high = min(values), max(values)
    for _ in range(50):
        border = (low + high) / 2
        below, above = [v for v in values if v <= border], [v for v in values if v > border]
        if not above:
            break
        made = sum(below) / len(below), sum(above) / len(above)
        if made == (low, high):
            break
        low, high = made
    # clusters that lie close together are one: all content or none
    return (low + high) / 2 if high > 3 * low else 0.0


def chosen(lines: list[Line]) -> list[bool]:
    """Which lines are content."""
    if not lines:
        return []
    ratio = [max(0, x.size - x.linked) / max(1, x.tags) for x in lines]
    logs = [math.log1p(r) for r in smoothed(ratio)]
    least = max(math.log1p(LEAST_RATIO), threshold(logs))
    # a line that only its neighbours lift is no end of a region
    content = [v >= least and r >= LEAST_RATIO and x.linked <= LINKED * x.size for v, r, x in zip(logs, ratio, lines)]
    for kind in ("article", "main"):
        marked = {x.region for x in lines if x.kind == kind}
        if not marked:
            continue
        # articles with a content line, all of them if none has one; an article is taken whole
        found = {x.region for x, c in zip(lines, content) if c and x.region in marked} or marked
        return [x.region in found for x in lines]
    if not any(content):
        best = max(range(len(lines)), key=lambda i: (lines[i].size - lines[i].linked, -i))
        content[best] = lines[best].size > lines[best].linked
    places = [i for i, c in enumerate(content) if c]
    plain = lambda x: x.linked <= LINKED * x.size
    for a, b in zip(places, places[1:]):
        # within one container any number of unlinked lines belongs to the region
        if b - a - 1 <= GAP or lines[a].container == lines[b].container:
            for i in range(a + 1, b):
                content[i] = plain(lines[i])
    for i in places:  # a region reaches to the end of its container
        while i + 1 < len(lines) and not content[i + 1] and lines[i + 1].container == lines[i].container and plain(lines[i + 1]):
            i += 1
            content[i] = True
    for i in places:  # headings belong to what follows them
        while i and lines[i - 1].heading and not content[i - 1]:
            i -= 1
            content[i] = True
    return content


def main_text(html: str | None) -> str:
    """Blocks of the article, in page order, parted by an empty line."""
    if not html:
        return ""
    lines = lines_of(html)
    return "\n\n".join(x.text for x, c in zip(lines, chosen(lines)) if c)


def extract(df: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Add ``text`` and ``n_chars`` of each row's whole page."""
    kept = keep if keep is not None else [c for c in df.columns if c not in ("text", "n_chars")]

    def one(page: str | None) -> tuple[str, int]:
        text = main_text(page)
        return text, len(text)

    return map_rows(df, kept, "text string, n_chars bigint", [html], lambda: one)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html")), keep=["page_id", "url"])
