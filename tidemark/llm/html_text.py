"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events into lines (blocks of text); each line has a
ratio of text to tags, the ratios are smoothed with a Gaussian and clustered by a
threshold, and the lines of content so found say which part of the page is the article.
Tags and class words that name other parts are evidence against an element; it is set
aside where it would leave nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import scratch_name, without

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_REGION = frozenset("article main section div body td blockquote".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is never shown as such.
_SILENT = frozenset("script style template head title svg canvas iframe object audio video".split())
#: Elements that hold other parts of a page: for certain, or unless most of the page is in them.
_FIRM, _LOOSE = frozenset("nav footer".split()), frozenset("aside form header button select textarea option menu dialog datalist noscript".split())
#: Words of class, id and role that name parts other than the article.
_OTHER = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner banners"
    " nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer masthead topbar toolbar"
    " cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login paywall"
    " share sharing social related recommended recommendations trending popular widget widgets pagination pager"
    " comment comments commentlist reply replies respond disqus discussion complementary contentinfo search".split()
)
#: Words that may stand beside those in one name (``comment-list``); with any other word (``related-work``, ``no-sidebar``) the name says nothing.
_BESIDE = frozenset(
    "area article articles bar block blog body bottom box button buttons center col column container content entry footer form global group header icons inner"
    " item items left link links list main module outer page panel post posts primary reader right row secondary section site slot story text top unit user wrap wrapper zone".split()
)
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_COMMENTS = re.compile(r"(\d+ )?(reader )?(comments?|responses?|replies|kommentare?|commentaires?|comentarios?)( ?\(\d+\))?:?|(leave|post|add|write) a (comment|reply)", re.I)
_P_CLOSERS = _BLOCK - {"br", "head", "html", "body", "title", "option", "caption", "tbody", "td", "th", "tr", "tfoot", "thead", "legend", "summary"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_IN_HEAD = frozenset("title style script meta link base noscript template".split())

#: Marks of an element.
NONE, FIRM, LOOSE = 0, 1, 2


@dataclass
class Line:
    text: str
    tags: int
    linked: int
    element: int  # the innermost recorded element it is in, 0 for none
    heading: bool


@dataclass
class Element:
    parent: int
    tag: str
    mark: int
    articles: int  # articles and mains around it, itself included


def names_other_part(value: str) -> bool:
    """Does one of the names of a class, id or role name a part other than the article?"""
    for name in value.split():
        words = [w for w in _SPLIT.split(_CAMEL.sub("-", name).lower()) if w and not w.isdigit()]
        if not _OTHER.isdisjoint(words) and all(w in _OTHER or w in _BESIDE for w in words):
            return True
    return False


class LineParser(HTMLParser):
    """Turns parser events into lines and the elements that they are in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.elements = [Element(0, "", NONE, 0)]  # an element comes after its parent
        self._stack: list[tuple[str, int]] = []  # name and, if it is recorded, the element's number
        self._inside = 0  # the innermost recorded element
        self._open: Counter[str] = Counter()  # elements on the stack, so that none is searched for in vain
        self._text: list[str] = []
        self._tags = self._linked = self._silent = self._headings = 0

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.lines.append(Line(text, max(1, self._tags), self._linked, self._inside, self._headings > 0))
            self._tags = 0
        self._text.clear()
        self._linked = 0

    def _mark(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        articles = self.elements[self._inside].articles
        if tag in _FIRM:
            return FIRM
        if tag in _LOOSE and not (tag == "header" and articles):
            return LOOSE
        if tag in ("html", "body", "main"):
            return NONE
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and "display:none" in value.replace(" ", "").lower()):
                return FIRM
            if name not in ("class", "id", "role") or not value or (tag == "article" and not articles):
                continue
            if name == "id" and (tag not in ("div", "ul", "ol", "table", "section") or (tag == "section" and articles)):
                continue  # an anchor
            if names_other_part(value):
                return FIRM
        return NONE

    def _pop(self, by_its_own_end: bool) -> None:
        tag, element = self._stack.pop()
        self._open[tag] -= 1
        self._silent -= tag in _SILENT
        self._headings -= tag in _HEADING
        if element:
            own = self.elements[element]
            self._inside = own.parent
            if own.mark != NONE and not by_its_own_end and tag not in ("li", "p", "option", "td", "th", "tr", "dt", "dd"):
                own.mark = NONE  # never closed: where it ends isn't known

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if tag in _BLOCK:
            self._flush()
        if self._open["head"] and tag not in _IN_HEAD:
            self._close({"head"}, {"html"})
        if tag in _VOID:
            return
        if tag in _P_CLOSERS:
            self._close({"p"}, _REGION | {"li", "table", "nav", "aside", "footer", "form", "header"})
        if tag in _SIBLINGS:
            self._close(_SIBLINGS[tag], {"ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select", "menu"})
        mark = self._mark(tag, attrs)
        element = 0
        if mark != NONE or tag in _REGION:
            if tag not in _BLOCK:
                self._flush()
            element = len(self.elements)
            self.elements.append(Element(self._inside, tag, mark, self.elements[self._inside].articles + (tag in ("article", "main"))))
            self._inside = element
        self._stack.append((tag, element))
        self._open[tag] += 1
        self._silent += tag in _SILENT
        self._headings += tag in _HEADING

    def _close(self, names: set[str], fences: frozenset[str] | set[str]) -> None:
        """Close an open element of one of the names, if no fence stands between."""
        if not any(self._open[name] for name in names):
            return
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] in names:
                while len(self._stack) > k:
                    self._pop(False)
                return
            if self._stack[k][0] in fences:
                return

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in _BLOCK or (self._stack and self._stack[-1][0] == tag and self._stack[-1][1]):
            self._flush()
        if not self._open[tag]:
            return
        while self._stack[-1][0] != tag:
            self._pop(False)
        self._pop(True)

    def handle_data(self, data: str) -> None:
        if not self._silent:
            self._text.append(data)
            if self._open["a"]:
                self._linked += len(data)

    def close(self) -> None:
        super().close()
        self._flush()
        while self._stack:
            self._pop(False)


#: What opens a piece of markup that runs to its own end mark.
_PIECES = (("<!--", "-->"), ("<![", ">"), ("<?", ">"), ("<!", ">"), ("<", ">"))


def closed_markup(html: str) -> str:
    """The page with markup that nothing closes any more taken as text, so that no parser searches for its end in vain."""
    for begin, end in _PIECES:
        at = html.rfind(end) + 1
        if html.find(begin, at) >= 0:
            html = html[:at] + html[at:].replace(begin, "&lt;" if begin == "<" else " ")
    return html


def smooth(values: np.ndarray, radius: int = 2, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel is renormalised."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    whole = np.convolve(values, kernel)[radius : radius + len(values)]
    return whole / np.convolve(np.ones(len(values)), kernel)[radius : radius + len(values)]


def content_lines(lines: list[Line]) -> np.ndarray:
    """Which lines reach the threshold: a share of the deviation of the smoothed ratios."""
    ratios = np.array([max(0, len(x.text) - x.linked) / x.tags for x in lines], float)
    smoothed = smooth(ratios)
    return smoothed >= max(1.0, 0.5 * float(smoothed.std()))


def _below(elements: list[Element], own: list[bool]) -> list[bool]:
    """Whether an element is one of ``own`` or inside one."""
    out = [False] * len(elements)
    for k in range(1, len(elements)):
        out[k] = own[k] or out[elements[k].parent]
    return out


def live_lines(lines: list[Line], elements: list[Element]) -> list[Line]:
    """The lines outside elements that hold other parts of the page.

    Firm marks hold unless nothing else is on the page. A loose mark (form, aside, header)
    holds unless its element has more than half of the text outside firm ones.
    """
    firm = _below(elements, [e.mark == FIRM for e in elements])
    weight = [0] * len(elements)
    for x in lines:
        weight[x.element] += max(0, len(x.text) - x.linked) * (not firm[x.element])
    for k in range(len(elements) - 1, 0, -1):
        weight[elements[k].parent] += weight[k]
    loose = _below(elements, [e.mark == LOOSE and 2 * weight[k] <= weight[0] for k, e in enumerate(elements)])
    for dropped in ([f or d for f, d in zip(firm, loose, strict=True)], firm, loose):
        live = [x for x in lines if not dropped[x.element]]
        if any(len(x.text) > x.linked for x in live):
            return live
    return lines


def without_comments(lines: list[Line], elements: list[Element]) -> list[Line]:
    """Lines before a heading of reader comments, and those outside the element it is in."""
    ends: dict[int, int] = {}
    for i, x in enumerate(lines):
        if x.heading and x.element and elements[x.element].tag not in ("body", "main") and _COMMENTS.fullmatch(x.text):
            ends.setdefault(x.element, i)
    if not ends:
        return lines
    from_line = [len(lines)] * len(elements)
    for k in range(1, len(elements)):
        from_line[k] = min(from_line[elements[k].parent], ends.get(k, len(lines)))
    kept = [x for i, x in enumerate(lines) if i < from_line[x.element]]
    return kept or lines


def extract(html: str | None) -> str:
    """The main text of a page: the blocks of the article joined by one space."""
    if not html:
        return ""
    parser = LineParser()
    parser.feed(closed_markup(html))
    parser.close()
    elements = parser.elements
    lines = without_comments(live_lines(parser.lines, elements), elements)
    if not lines:
        return ""
    chosen = content_lines(lines).tolist()
    # Articles decide if they hold half of the content or more; else the ratios do, on the whole page.
    size = [len(x.text) * content for x, content in zip(lines, chosen, strict=True)]
    in_article = [elements[x.element].articles > 0 for x in lines]
    of_articles = 2 * sum(n for n, a in zip(size, in_article, strict=True) if a) >= sum(size) and any(in_article)
    held = [0] * len(elements)  # lines of content in each element; 0 is the whole page
    for x, content, a in zip(lines, chosen, in_article, strict=True):
        held[x.element] += content and (a or not of_articles)
    for k in range(len(elements) - 1, 0, -1):
        held[elements[k].parent] += held[k]
    # The innermost region that holds all of the content; an article isn't cut any smaller.
    regions = (k for k, e in enumerate(elements) if e.tag in _REGION and not (of_articles and e.articles and e.tag not in ("article", "main")))
    best = max((k for k in regions if held[k] and held[k] == held[0]), default=0)
    inside = _below(elements, [k == best for k in range(len(elements))]) if best else [True] * len(elements)
    return " ".join(x.text for x, a in zip(lines, in_article, strict=True) if inside[x.element] and (a or not of_articles))


def extract_pages(pages: DataFrame) -> DataFrame:
    """Add ``text`` (main text, empty if none) and ``n_chars`` (its code points) to ``pages``.

    Reads the whole ``html``, however long, in time linear in its length; null and empty pages
    give the empty text. White space inside a block becomes one space. Markup that is never
    closed (a comment, a tag) is taken as text. Repeated rows are extracted alike, columns of
    the result's names are replaced, an empty table stays empty.
    """

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([extract(h) for h in b], dtype=object)

    pages = without(pages, "text", "n_chars")
    found = scratch_name(pages, "main")
    out = pages.withColumn(found, main_text(F.col("html").cast("string")))
    return out.select(*[F.col(f"`{c}`") for c in pages.columns], F.col(found).alias("text"), F.length(found).cast("long").alias("n_chars"))
