"""Main text of web pages by their line-block distribution.

1. Markup is stripped into lines, one per block element (white space inside a line becomes one space).
2. Each line gets a weight: its length plus ``LINE``, less twice the length of its links. Markup only scales it: lines
   in an element that is named for adverts, notices, comments and the like weigh ``NAMED`` of it, lines outside
   a marked article (``article``, ``main``) weigh ``OUTSIDE`` of it, lines inside weigh ``MARKED`` more. Copyright lines
   count as named. Lines in navigation, page headers and footers, sidebars, forms and hidden elements weigh nothing.
3. Weights are summed over sliding windows of ``WINDOW`` lines; where the page enters or leaves a container (an element
   that is no running text) stand as many empty lines. The text surges where the sum rises above nothing and
   dives where it falls back to it. A stretch between surge and dive counts as text if its greatest window
   reaches ``SURGE`` of the page's greatest one, and ``LEAST`` at least.
4. The stretch with most weight names the article: its marked element, else the innermost container around it,
   widened while all further lines of the next container are plain text. Lines of that container between its first
   surge and its last dive are kept, however short; stretches elsewhere, and named ones anywhere, are
   kept only if they count as text.

Defined cases: null and empty pages, and pages without text, give an empty string; truncated pages end all
open elements; ``br`` is white space; white space is what ``str.split`` splits on; repeated rows are kept;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import bound_batches

WINDOW = 3
SURGE, LEAST = 1 / 2, 8.0
LINE, MARKED = 8, 40
NAMED = OUTSIDE = 0.02

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs2>[^>]*+)(?:>|\Z)", re.S)
ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|\b(hidden)\b", re.S)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "picture", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
#: Blocks of running text: a line's container is the innermost open element that is none of these.
FLOW = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "ul", "ol", "li", "dl", "dt", "dd", "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "pre", "blockquote", "figure", "figcaption", "address", "center"}
ARTICLE = {"article", "main"}
BOILERPLATE = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "head"}
#: An element is named for noise if each part of one of its names is in NOISE_WORDS or, beside one, in GENERIC.
NOISE_WORDS = {
    "nav", "navbar", "navigation", "menu", "footer", "sidebar", "aside", "ad", "ads", "advert", "adverts", "advertisement", "advertising",
    "banner", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "breadcrumb",
    "breadcrumbs", "social", "share", "sharing", "related", "recommended", "comment", "comments", "disqus", "newsletter", "subscribe",
    "login", "signup", "search", "pagination", "pager", "copyright",
}
GENERIC = {
    "area", "bar", "block", "body", "bottom", "box", "btn", "buttons", "container", "content", "form", "group", "holder", "inner", "item", "items", "left", "link", "links",
    "list", "main", "outer", "page", "panel", "post", "posts", "right", "section", "site", "slot", "text", "the", "thread", "top", "unit", "widget", "wrap", "wrapper", "article", "articles",
}
COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form"}


class Element:
    """An open element that contains lines, with the one around it."""

    __slots__ = ("article", "depth", "parent", "top", "unlike")

    def __init__(self, parent: Element | None, top: bool = False, article: bool = False) -> None:
        self.parent, self.depth, self.top = parent, parent.depth + 1 if parent else 0, top
        #: the marked article that it lies in, or None
        self.article = self if article else parent.article if parent else None
        self.unlike = 0  # lines in it that are no plain text


class Line(NamedTuple):
    text: str
    link_chars: int
    dead: bool  # in navigation, header, footer, sidebar, form or hidden
    named: bool  # in an element named for adverts, notices, comments and the like
    container: Element


def _attributes(raw: str) -> dict[str, str]:
    return {(m[1] or m[3]).lower(): (m[2] or "").strip("\"'") for m in ATTR.finditer(raw)}


def _kind(name: str, raw: str, in_article: bool) -> str:
    """Whether an element's lines are ``dead``, ``named`` for noise or neither."""
    if name in BOILERPLATE or name == "header" and not in_article:
        return "dead"
    if not raw.strip():
        return ""
    attrs = _attributes(raw)
    if "hidden" in attrs or attrs.get("role", "").lower() in ROLES:
        return "dead"
    if name in ("html", "body") or name in ARTICLE:
        return ""
    names = [{x for x in re.split(r"[^a-z]+", one) if x} for one in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()]
    noise = [bool(parts & NOISE_WORDS) and parts <= NOISE_WORDS | GENERIC or "header" in parts and not in_article for parts in names]
    # running text of the article needs all its names to be of that kind
    told = any(noise) and (not (in_article and name in FLOW) or all(bad or parts <= GENERIC for bad, parts in zip(noise, names, strict=True)))
    return "named" if told else ""


def lines_of(page: str) -> list[Line]:
    """The page's lines in order; markup is gone, character references are decoded."""
    out: list[Line] = []
    pieces: list[str] = []
    linked = 0
    dead = named = links = 0  # open elements of each kind
    page_element = Element(None, top=True)
    stack: list[tuple[str, str, Element]] = []  # open elements: (name, kind, container of lines in it)

    def container() -> Element:
        return stack[-1][2] if stack else page_element

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            pieces.append(raw)
            if links:
                linked += len(raw.strip())

    def end_line() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                around = container()
                out.append(Line(text, linked, dead > 0, named > 0 or around.article is None and COPYRIGHT.match(text) is not None, around))
            pieces.clear()
        linked = 0

    def drop(kind: str) -> None:
        nonlocal dead, named, links
        dead -= kind == "dead"
        named -= kind == "named"
        links -= kind == "link"

    at = 0
    while m := TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if name in ("br", "hr"):
            pieces.append(" ")
        if name not in INLINE:
            end_line()
        if m["close"] or m["close2"]:
            if any(n == name for n, *_ in reversed(stack)):
                while stack:
                    n, kind, _ = stack.pop()
                    drop(kind)
                    if n == name:
                        break
            continue
        raw = m["attrs"] if m["attrs"] is not None else m["attrs2"] or ""
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID or raw.endswith("/"):
            continue
        if name == "p":  # a paragraph ends at the next one, with the inline elements left open in it
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    for _, kind, _ in stack[i:]:
                        drop(kind)
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
        around = container()
        kind = _kind(name, raw, around.article is not None) or ("link" if name == "a" else "")
        dead += kind == "dead"
        named += kind == "named"
        links += kind == "link"
        inline = name in INLINE or name in FLOW and not kind
        stack.append((name, kind, around if inline else Element(around, name in ("html", "body"), name in ARTICLE)))
    add(page[at:])
    end_line()
    return out


def weights_of(lines: list[Line]) -> list[float]:
    """Each line's weight; a line that is mostly links, or dead, has none."""
    marked = any(x.container.article for x in lines if not x.dead)
    out = []
    for x in lines:
        inside = x.container.article is not None
        w = 0.0 if x.dead else len(x.text) - 2 * x.link_chars * (not inside)
        if w > 0:
            w = (w + LINE + MARKED * inside) * (NAMED if x.named else 1.0) * (OUTSIDE if marked and not inside else 1.0)
        out.append(max(w, 0.0))
    return out


class Stretch(NamedTuple):
    start: int
    end: int
    peak: float  # the greatest window
    total: float


def stretches(lines: list[Line], weights: list[float]) -> list[Stretch]:
    """Ranges of lines from surge to dive: the windowed sum stays above nothing inside. Empty lines stand between containers."""
    places: list[int | None] = []
    for i, line in enumerate(lines):
        if i and (line.container is not lines[i - 1].container or line.named != lines[i - 1].named):
            places += [None] * WINDOW
        places.append(i)
    half = WINDOW // 2
    padded = [0.0] * half + [0.0 if i is None else weights[i] for i in places] + [0.0] * half
    out: list[Stretch] = []
    held: list[int] = []
    peak = 0.0
    for at, i in enumerate([*places, None]):
        total = sum(padded[at : at + WINDOW]) if at < len(places) else 0.0
        if total > 0:
            peak = max(peak, total)
            if i is not None and weights[i] > 0:
                held.append(i)
        elif held:
            out.append(Stretch(held[0], held[-1] + 1, peak, sum(weights[held[0] : held[-1] + 1])))
            held, peak = [], 0.0
    return out


def main_text(page: str | None) -> str:
    lines = lines_of(page or "")
    weights = weights_of(lines)
    found = stretches(lines, weights)
    least = max(LEAST, SURGE * max((s.peak for s in found), default=0.0))
    full = [s for s in found if s.peak >= least]
    if not full:
        return ""
    # a peak that counts need not belong to the stretch with most weight, which is the main one
    main = max(full, key=lambda s: (s.total, -s.start))
    around = article_around(lines, weights, lines[main.start].container)
    within: dict[Element, bool] = {around: True}
    inside = [not x.dead and not x.named and (w > 0 or x.link_chars > 0) and is_within(x.container, around.depth, within) for x, w in zip(lines, weights, strict=True)]
    own = [s for s in found if inside[s.start] and (not around.top or lines[s.start].container is around)]
    kept = {i for i in range(min(s.start for s in own), max(s.end for s in own)) if inside[i]} if own else set()
    kept |= {i for s in full for i in range(s.start, s.end) if not lines[i].dead}
    return "\n".join(lines[i].text for i in sorted(kept))


def is_within(element: Element, depth: int, known: dict[Element, bool]) -> bool:
    """Whether an element lies in the one of that depth that ``known`` starts with; answers are remembered in it."""
    path = []
    while element not in known and element.depth > depth:
        path.append(element)
        element = element.parent
    found = known.get(element, False)
    known.update(dict.fromkeys(path, found))
    return found


def article_around(lines: list[Line], weights: list[float], found: Element) -> Element:
    """The element whose lines a stretch in ``found`` stands for: see 4. above."""
    if found.article:
        return found.article
    around: set[Element] = set()
    for line, w in zip(lines, weights, strict=True):
        element: Element | None = line.container
        element.unlike += line.dead or line.named or line.link_chars > 0 or w <= 0
        while element and element not in around:
            around.add(element)
            element = element.parent
    for element in sorted(around, key=lambda e: -e.depth):
        if element.parent:
            element.parent.unlike += element.unlike
    while not found.top and found.parent and not found.parent.top and found.parent.unlike == found.unlike:
        found = found.parent
    return found


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [main_text(page) for page in part["html"]]
            yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    bound_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInPandas(run, "page_id bigint, url string, text string, n_chars bigint")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
