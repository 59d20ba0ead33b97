"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores by the innermost block it
stands in, a tag by its name; tags never score above ``TAG_MOST``. The weights
are log odds of being inside or outside of the content, counted over all
labelled pages: those that mark their content themselves (``LABELS`` elements).
One linear scan finds the contiguous region with the highest sum; a tie goes to
the earlier region. Elements that are never content (``ASIDE`` elements, or a
class, id or role that is one of ``ASIDE_WORDS``, or a compound that ends in one, as
``site-header``, or begins with one, as ``related-posts``; or hidden ones) score nothing
and are left out of the region's text, so an advert in the midst of an article does
not end it. Inside of content, elements are asides too whose class, id or role the
labelled pages have ``OUTSIDE`` times as often outside of the content as inside; a
``header`` there is the article's own. ``KEPT`` elements are no asides by their names,
but for an article inside of another that is called a comment. Nor are elements
around ``main`` or around an ``article``; if articles stand inside of several, as
comments do, those inside of the fewest count. On a page without either, an element
that is hidden or only begins with such a word is no aside if it holds over half of
the page's words.

Reading a page takes time in proportion to its length, whatever its markup.

Character references are decoded, white space inside a block becomes one blank,
blocks are trimmed and joined by line feeds, empty ones vanish. A null or empty
page, and one without a region that scores above zero, has an empty text.
Unclosed, crossing and truncated markup is read as far as it goes. Words of a
kind that no labelled page has score 1, such tags ``TAG_UNSEEN``. Repeated rows each get
their row; other columns than id, url and page are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

SLICE_BYTES = 4 << 20
TAG_MOST = -0.2
TAG_UNSEEN = -0.5
LIMIT = 6.0        # bound of a weight
OUTSIDE = 20       # learned names of asides: so often outside for once inside
# Only names that one labelled page in so many has are learned, so at most this
# many times the mean number of names of a page reach the driver.
NAME_PAGES = 1000

# Names of HTML elements and of what pages call their parts.
LABELS = {"article", "main"}
ASIDE = {"aside", "button", "dialog", "footer", "form", "head", "header", "iframe", "menu", "nav",
         "noscript", "object", "script", "select", "style", "svg", "template", "textarea", "title"}
RAW = {"iframe", "noembed", "noframes", "noscript", "script", "style", "template", "textarea",
       "title", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn",
          "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small",
          "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details",
         "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
         "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "menu",
         "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot",
         "th", "thead", "title", "tr", "ul"}
ASIDE_WORDS = {"ad", "ads", "adsbygoogle", "adsense", "advert", "advertisement", "advertising",
               "banner", "breadcrumb", "breadcrumbs",
               "comment", "comments", "complementary", "consent", "contentinfo", "cookie",
               "cookies", "disqus", "footer", "header", "masthead", "menu", "modal", "nav",
               "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo",
               "related", "reply", "replies", "search", "share", "sharing", "sidebar", "skip",
               "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
KEPT = {"html", "body", *LABELS}
# Compounds that begin so name a state of the element, not what it is.
STATES = {"can", "has", "hide", "in", "is", "no", "non", "not", "on", "show", "with", "without"}
SITE = {"global", "site", "top"}  # whose headers are never an article's
COMMENTS = {"comment", "comments", "replies", "reply"}

_PART = re.compile(
    r"<!--.*?(?:--!?>|$)"
    r"|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)"
    r"|([^<]+|<)", re.S)
# a tag whose quotes don't match ends at the next bracket
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)")
_NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.I)
_VALUES = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+)")
_STYLE = re.compile(r"(?<![\w-])style\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])", re.I)
_PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|$)", re.I) for name in RAW}

# How an element is an aside
NOT, WEAK, NAMED, ELEMENT = range(4)


def _tokens(attributes: str) -> list[str]:
    return [t for m in _NAMED.finditer(attributes) for t in m[1].strip("\"'").split()]


def _aside_kind(name: str, attributes: str, in_content: bool, names: set[str]) -> int:
    """Whether an element is an aside by what it is (``ELEMENT``), by its names
    (``NAMED``), or as hidden or by the begin of a compound (``WEAK``). ``names``:
    the learned ones, which count inside of content."""
    if name in ASIDE and not (name == "header" and in_content):
        return ELEMENT
    tokens = _tokens(attributes) if attributes else []
    if name in LABELS and in_content and any(t.lower() in COMMENTS for t in tokens):
        return NAMED
    if name in KEPT or not attributes:
        return NOT
    kind = NOT
    for token in tokens:
        if in_content and token.lower() in names:
            return NAMED
        pieces = [w.lower() for w in _PIECE.findall(token)]
        if not pieces or pieces[0] in STATES:
            continue
        if in_content and pieces[-1] == "header" and pieces[0] not in SITE:
            continue
        if pieces[-1] in ASIDE_WORDS:
            return NAMED
        if pieces == ["hidden"] or pieces[0] in ASIDE_WORDS - {"header"} and name not in INLINE:
            kind = WEAK
    style = _STYLE.search(attributes)
    if style and _UNSEEN.search(style[1]) or _HIDDEN.search(_VALUES.sub(" ", attributes)):
        kind = WEAK
    return kind


class Node:
    """A piece of a page: a tag (text is None) or text."""

    __slots__ = ("kind", "text", "breaks", "aside", "labelled")

    def __init__(self, kind: str, text: str | None, breaks: bool, aside: bool, labelled: bool):
        self.kind, self.text, self.breaks = kind, text, breaks
        self.aside, self.labelled = aside, labelled


def nodes(page: str, names: set[str] = frozenset(), seen: Counter | None = None) -> list[Node]:
    """Tags and texts of a page in order. ``seen`` counts the names of elements
    inside and outside of the content, without those around it."""
    out: list[Node] = []
    # open elements: their names, the aside around each, where their names stand in ``named``
    open_: list[tuple[str, int, int]] = []
    blocks_open: list[int] = []  # places of those that aren't inline
    opened: Counter = Counter()  # how many of a name are open
    asides: list[tuple[int, int]] = [(0, NOT)]  # the aside around each, its kind
    content: list[tuple[str, int]] = []  # labelled elements, with the aside around each
    named: list[tuple[list[str], bool]] = []  # names of elements, if inside of content
    around: set[int] = set()  # which of them stand around content
    marked = inner = labels = 0  # elements below ``marked`` are in ``around``
    block = ["page"]

    def close(upto: int):
        nonlocal inner, labels, marked
        while len(open_) > upto:
            name, inner, _ = open_.pop()
            opened[name] -= 1
            labels -= name in LABELS
            if name not in INLINE:
                block.pop()
                blocks_open.pop()
        marked = min(marked, upto)

    at = 0
    while m := _PART.match(page, at):
        loose = _LOOSE.match(page, at) if m[4] == "<" else None
        m = loose or m
        at = m.end()
        if not loose and m[4] is not None:
            out.append(Node("w:" + block[-1], m[4], False, inner, labels > 0))
            continue
        if m[2] is None:
            continue  # comment or declaration
        name = m[2].lower()
        known = name if name in BLOCK or name in INLINE or name in ASIDE else "other"
        breaks = name not in INLINE
        if m[1]:
            if opened[name]:
                place = len(open_) - 1
                while open_[place][0] != name:
                    place -= 1
                close(place)
            out.append(Node("t:/" + known, None, breaks, inner, labels > 0))
            continue
        # a block ends a paragraph that is open
        if name in BLOCK and blocks_open and open_[blocks_open[-1]][0] == "p":
            close(blocks_open[-1])
        kind = _aside_kind(name, m[3], labels > 0, names)
        number = inner
        if kind:
            asides.append((inner, NAMED if name == "form" else kind))
            number = len(asides) - 1
        if name in LABELS:
            content.append((name, inner))
            if seen is not None and not labels:
                around.update(place for _, _, place in open_[marked:])
                marked = len(open_)
        out.append(Node("t:" + known, None, breaks, number, labels > 0))
        if seen is not None and m[3] and name not in LABELS:
            named.append(([t.lower() for t in _tokens(m[3])], labels > 0))
        if name == "br":
            out.append(Node("w:" + block[-1], " ", False, inner, labels > 0))
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.start() if end else len(page)
        if name not in VOID and not m[3].endswith("/"):
            mine = seen is not None and m[3] and name not in LABELS
            open_.append((name, inner, len(named) - 1 if mine else -1))
            opened[name] += 1
            inner = number
            labels += name in LABELS
            if name not in INLINE:
                block.append(known)
                blocks_open.append(len(open_) - 1)
    left_out = _asides(asides, content, out)
    for n in out:
        n.aside = left_out[n.aside]
    if seen is not None and content:
        for i, (tokens, inside) in enumerate(named):
            if i not in around:
                seen.update(("n:" + t, inside) for t in set(tokens))
    return out


def _asides(asides: list[tuple[int, int]], content: list[tuple[str, int]],
            found: list[Node]) -> list[bool]:
    """Which asides hold: not those around main, or around the articles that
    stand inside of the fewest; on a page without either, no weak one that has
    over half of the words."""
    depth, soft = [0], [True]
    for around, kind in asides[1:]:
        depth.append(depth[around] + 1)
        soft.append(soft[around] and kind != ELEMENT)
    labelled = {(name, inner) for name, inner in content if soft[inner]}
    least = min((depth[inner] for _, inner in labelled), default=0)
    wraps = [False] * len(asides)
    for name, inner in labelled:
        if name == "main" or depth[inner] == least:
            while inner and not wraps[inner]:
                wraps[inner] = True
                inner = asides[inner][0]
    if not labelled and any(kind == WEAK for _, kind in asides):
        words = [0] * len(asides)
        for n in found:
            if n.text is not None:
                words[n.aside] += len(n.text.split())
        for number in range(len(asides) - 1, 0, -1):
            words[asides[number][0]] += words[number]
        for number in range(1, len(asides)):
            wraps[number] = asides[number][1] == WEAK and 2 * words[number] > words[0]
    holds = [False]
    for number in range(1, len(asides)):
        holds.append(holds[asides[number][0]] or not wraps[number])
    return holds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each kind and name stands inside and outside of labelled content;
    the row without a kind counts labelled pages."""
    for batch in batches:
        seen: Counter = Counter()
        names: Counter = Counter()
        for part in common.slices(batch, "html", SLICE_BYTES):
            for page in part.column("html"):
                found = nodes(page.as_py() or "", seen=names)
                if not any(n.labelled for n in found):
                    continue
                seen["", True] += 1
                for n in found:
                    if not n.aside:
                        seen[n.kind, n.labelled] += 1 if n.text is None else len(n.text.split())
        seen.update(names)
        keys = [k for k, n in seen.items() if n]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()),
             pa.array([k[1] for k in keys], pa.bool_()),
             pa.array([seen[k] for k in keys], pa.int64())], ["kind", "inside", "n"])


def fit(pages: DataFrame, page: str = "html") -> dict[str, float]:
    """Weights of all kinds (a few hundred at most) and of names of asides
    (``NAME_PAGES``), from every labelled page."""
    rows = pages.select(F.col(page).alias("html")).where("html is not null")
    counts = rows.mapInArrow(_count, "kind string, inside boolean, n long") \
        .groupBy("kind").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"),
                             F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("b"))
    counts = common.staged(counts)
    labelled = counts.where("kind = ''").agg(F.sum("a")).first()[0] or 0
    learned = (F.col("b") >= OUTSIDE * (F.col("a") + 1)) & (F.col("b") * NAME_PAGES >= labelled)
    found = counts.where("kind != ''") \
        .where(~F.col("kind").startswith("n:") | learned).collect()
    common.drop_staged(counts)
    names = [r.kind for r in found if r.kind[0] == "n"]
    found = [r for r in found if r.kind[0] != "n"]
    inside, outside = sum(r.a for r in found) + 1, sum(r.b for r in found) + 1
    weights = dict.fromkeys(names, -LIMIT)
    for r in found:
        odds = math.log((r.a + 1) / inside) - math.log((r.b + 1) / outside)
        odds = max(-LIMIT, min(LIMIT, odds))
        weights[r.kind] = min(TAG_MOST, odds) if r.kind[0] == "t" else odds
    return weights


def region(found: list[Node], weights: dict[str, float]) -> tuple[int, int]:
    """First and last + 1 node of the contiguous region with the highest score."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, n in enumerate(found):
        if n.aside:
            continue
        if n.text is None:
            total += weights.get(n.kind, TAG_UNSEEN)
        else:
            total += len(n.text.split()) * weights.get(n.kind, 1.0)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, span = total, (start, i + 1)
    return span


def learned_names(weights: dict[str, float]) -> set[str]:
    return {kind[2:] for kind in weights if kind.startswith("n:")}


def main_text(page: str | None, weights: dict[str, float], names: set[str] | None = None) -> str:
    names = learned_names(weights) if names is None else names
    found = nodes(page or "", names)
    first, last = region(found, weights)
    blocks: list[list[str]] = [[]]
    for n in found[first:last]:
        if n.text is None:
            if n.breaks and blocks[-1]:
                blocks.append([])
        elif not n.aside:
            blocks[-1].append(n.text)
    texts = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def extract(pages: DataFrame, weights: dict[str, float], page_id: str = "page_id",
            url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"),
                        F.col(page).alias("html"))
    schema = rows.drop("html").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = learned_names(weights)
        for batch in batches:
            for part in common.slices(batch, "html", SLICE_BYTES):
                texts = [main_text(h.as_py(), weights, names) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array(list(map(len, texts)), pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
