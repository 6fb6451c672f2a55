"""HTML extraction: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams events. Block elements end a line; each line has its text, its number of
tags and the element it stands in. What the text must not have by definition (menus, page headers, footers, sidebars,
notices, adverts, forms, comments, scripts and hidden parts) makes no lines where element, role or a class
or id as a whole says so.

The ratio of characters to tags per line is smoothed with a Gaussian kernel and cut in two by the
one-dimensional two-means threshold. The characters of the lines above it count for the elements around
them, and these counts decide twice:

* A class or id that only ends in the name of an unwanted part, or a form, is a hint: a part that is so marked but holds ``MARKED_SHARE`` of the
  page's count or more is its content (as where a page lies in one form, or a wrapper is called ``no-sidebar``), and stays.
* The region is the innermost division with ``REGION_SHARE`` of the count that is left, or the article around that. All lines of the
  region are the text, short ones and lines of links too.

Parsing and counting take time in proportion to the page, whatever its nesting: open elements are found by tag, and
counts are added upwards once.

Defined cases: a null or empty page has the empty text; white space (no-break spaces too) becomes one
space and is trimmed; unclosed and stray tags are repaired as parsers do; several
articles stay if no division but one around them holds enough; rows are judged on their own, so repeated rows do not matter; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from profusion.llm.common import slices, task

SIGMA = 1.0
REGION_SHARE, MARKED_SHARE = 0.9, 0.5
#: Elements of HTML by their part here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
DROPPED = frozenset("head script style noscript template iframe object embed svg math canvas audio video map nav aside footer button select option textarea input dialog menu".split())
ENDS = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}
HOLDS = frozenset("ul ol dl table article main section div body blockquote td th nav aside footer header form".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer "
    "masthead cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond reply replies "
    "share sharing social related recommended widget toolbar pagination pager skip copyright".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words that end the name of a part after what it is about, as in comment-list.
PLACES = frozenset("area bar block body box container content form inner item items links list posts section slot text top unit wrap wrapper".split())
ARTICLES = frozenset(["article", "main"])
_PART = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


#: What is known of an element: it stays, it goes unless it holds much of the content, or it goes.
KEPT, MARKED, GONE = range(3)


def _named(value: str, marks: frozenset[str], whole: bool) -> int:
    """What a class or id says of a part: for certain if a whole name is a mark, as a hint by its last word, or by a word before a
    word for a place."""
    found = KEPT
    for token in value.split():
        if token in marks:
            return GONE
        parts = [] if whole else _PART.findall(token)
        if parts and (parts[-1] in marks or (parts[-1] in PLACES and not marks.isdisjoint(parts))):
            found = MARKED
    return found


def _judged(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> int:
    if tag in DROPPED or (tag == "header" and not inside):
        return GONE
    found = MARKED if tag == "form" else KEPT
    if tag in ("html", "body") or not attrs:
        return found
    for name, value in attrs:
        value = (value or "").lower()
        if name in ("class", "id"):
            found = max(found, _named(value, MARKS, tag in ARTICLES))
            if not inside and tag != "h1" and tag not in ARTICLES:
                found = max(found, _named(value, frozenset(["header"]), False))
        elif name == "hidden" or (name == "role" and value in ROLES and value != "form") or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
            return GONE
        elif name == "role" and value == "form":
            found = max(found, MARKED)
    return found


class Lines(HTMLParser):
    """Collects the lines of a page: text, tags, and the number of the element they stand in; parent holds its parent's."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []  # element, number, dropped
        self.where: dict[str, list[int]] = {}  # places of each element in open, rising
        self.holding: list[int] = []  # places of elements of HOLDS
        self.dropping: list[int] = []  # places of dropped elements
        self.around = 0  # open articles
        self.parent = [0]
        self.articles: set[int] = set()
        self.marked: set[int] = set()
        self.holders: set[int] = set()
        self.lines: list[tuple[str, int, int]] = []
        self.text: list[str] = []
        self.tags = 0

    def _end_line(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append((text, self.tags, self.open[-1][1] if self.open else 0))
            self.text = []
        self.tags = 0

    def _close(self, at: int) -> None:
        while len(self.open) > at:
            tag, number, dropped = self.open.pop()
            self.where[tag].pop()
            if tag in HOLDS:
                self.holding.pop()
            if dropped:
                self.dropping.pop()
            self.around -= number in self.articles

    def _last(self, tag: str) -> int:
        return self.where[tag][-1] if self.where.get(tag) else -1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self._end_line()
        self.tags += 1
        if tag in VOID:
            if tag == "br" and not self.dropping:
                self.text.append(" ")
            return
        if tag in ENDS:
            ended = max(map(self._last, ENDS[tag]))
            if ended >= 0 and ended >= (self.holding[-1] if self.holding else 0):
                self._close(ended)
        elif tag in ("body", "article", "main") and self.dropping and not self.articles:
            # An unclosed head, menu or advert before the article ends here.
            self._close(self.dropping[0])
        judged = _judged(tag, attrs, self.around > 0)
        drop = judged == GONE
        number = len(self.parent)
        self.parent.append(self.open[-1][1] if self.open else 0)
        at = len(self.open)
        self.open.append((tag, number, drop))
        self.where.setdefault(tag, []).append(at)
        if drop:
            self.dropping.append(at)
        if judged == MARKED:
            self.marked.add(number)
        if tag in HOLDS:
            self.holders.add(number)
            self.holding.append(at)
        if tag in ARTICLES and not self.dropping:
            self.articles.add(number)
            self.around += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._end_line()
        self.tags += 1
        at = self._last(tag)
        if at >= 0 and (tag not in INLINE or not self.holding or at > self.holding[-1]):
            self._close(at)

    def handle_data(self, data: str) -> None:
        if not self.dropping:
            self.text.append(data)


def content_lines(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Which lines are content: smoothed ratios above the two-means threshold."""
    if len(ratio) < 3:
        return np.ones(len(ratio), bool)
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    smooth = np.convolve(ratio, kernel, "full")[reach : reach + len(ratio)] / np.convolve(np.ones(len(ratio)), kernel, "full")[reach : reach + len(ratio)]
    low, high = float(smooth.min()), float(smooth.max())
    upper = smooth >= (low + high) / 2
    while high - low > 1e-9 * high:  # else all ratios are the same, but for rounding
        low, high = float(smooth[~upper].mean()), float(smooth[upper].mean())
        before, upper = upper, smooth >= (low + high) / 2
        if np.array_equal(before, upper):
            return upper
    return np.ones(len(ratio), bool)


def counted(page: Lines, content: list[bool]) -> list[int]:
    """For each element, the characters of content lines in it."""
    count = [0] * len(page.parent)
    for (text, _, e), good in zip(page.lines, content, strict=True):
        count[e] += len(text) * good
    for e in range(len(page.parent) - 1, 0, -1):
        count[page.parent[e]] += count[e]
    return count


def region(page: Lines, content: list[bool]) -> int:
    """The number of the element whose lines are the text; 0 for the page."""
    count = counted(page, content)
    best = max((e for e in page.holders if count[e] >= REGION_SHARE * count[0]), default=0)
    within = [0] * len(page.parent)
    for e in range(1, len(page.parent)):
        within[e] = e if e in page.articles else within[page.parent[e]]
    return within[best] or best


def inside_of(page: Lines, tops: set[int]) -> list[bool]:
    """Which elements are one of these, or in one."""
    held = [0 in tops] * len(page.parent)
    for e in range(1, len(held)):
        held[e] = e in tops or held[page.parent[e]]
    return held


def extract_text(html: str | None) -> str:
    """The main text of a page, one line per block."""
    page = Lines()
    page.feed(html or "")
    page.close()
    page._end_line()
    content = content_lines(np.array([len(t) / max(1, n) for t, n, _ in page.lines])).tolist()
    if page.marked:
        count = counted(page, content)
        gone = inside_of(page, {e for e in page.marked if count[e] < MARKED_SHARE * count[0] or not count[e]})
        page.lines, content = [x for x in page.lines if not gone[x[2]]], [good for x, good in zip(page.lines, content, strict=True) if not gone[x[2]]]
    if not page.lines:
        return ""
    held = inside_of(page, {region(page, content)})
    return "\n".join(t for t, _, e in page.lines if held[e])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (long) of each page."""

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                texts = [extract_text(h) for h in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
