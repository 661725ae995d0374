"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's HTML parser streams events; the page becomes lines (one per block
element) with their text, the tags they hold and the element they lie in. Lines inside menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments carry no
weight; where only the name of a block says so, the content cluster can overrule it. The
text-to-tag ratio of the lines (characters per tag) is smoothed with a Gaussian and clustered
into content and other by a threshold. If article (or main) elements hold half of the content
cluster's text, all those of prose are the content regions; else the smallest element that
holds nearly all of it is, and beside it the headings and paragraphs that stand next to it or
to what it lies in, and its neighbours' lines that are in the cluster. All lines of the regions
that are not of the other kinds form the text, however short. Of an article's own header the
headings stay.

Defined results: null or empty html and pages without content give an empty text; unclosed and
truncated markup is read as far as it goes, an unclosed comment hides all that follows; equal
ratios fall on the same side; repeated rows are extracted each; other columns are packed into
``row``, so that no name clashes; an empty table gives an empty result. One page is parsed at a
time, in time proportional to its length, and rows are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.tables import prepare

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(
    "head script style noscript template svg canvas iframe object nav header footer aside form "
    "button select textarea dialog menu audio video map".split())
#: Those of them that stand within a line of text.
INLINE = frozenset("button select textarea svg canvas iframe object audio video map script style "
                   "noscript template".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
LEAVES = ("p", "li", *HEADINGS, "pre", "blockquote", "dd", "dt")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu "
    "nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements a start tag closes when they are open and nothing but inline markup lies between.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Words of class, id and role that name parts of a page other than its article.
OTHER_PARTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs "
    "comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav "
    "navbar navigation newsletter notice notices notification overlay pager pagination popup "
    "promo promotion related replies reply respond share sharing sidebar sidebars skyscraper "
    "social sponsor sponsored subscribe subscription toolbar widget widgets alert alerts "
    "complementary contentinfo search login signup".split())
#: First and last words of class names that tell a state, such as has-sidebar, comments-open.
STATES = (frozenset("has is no with without".split()),
          frozenset("open opened closed enabled disabled active".split()))
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Share of the content cluster's text that the region must hold.
HELD = 0.9
#: Share of the cluster that makes a part count beside a block named as another part.
SOME = 0.1
SIGMA = 1.0


def _name_words(name: str) -> list[str]:
    """Words of one class, id or role; none of a state, widget only at its start."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if len(words) > 1 and (words[0] in STATES[0] or words[-1] in STATES[1]):
        return []
    return [w for i, w in enumerate(words) if i == 0 or w not in ("widget", "widgets")]


class PageLines(HTMLParser):
    """Collects lines: text, tags, element number; and per element its parent and name."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parents, self.names = [-1], ["#page"]
        #: Name, element, and 1 if it opened a skipped part, -1 if it leaves one for a while.
        self.open: list[tuple[str, int, int]] = []
        self.skipping = 0
        #: Text, tags, element, whether the line is a skipped part's, characters in links.
        self.lines: list[tuple[str, int, int, bool, int]] = []
        self.buffer: list[str] = []
        self.tags = self.linked = 0
        self.in_link = self.ending = False
        self.dropped = False
        self.named: set[int] = set()  # elements whose name says that they are another part

    def _line(self) -> None:
        """Ends a line; one of a skipped part only keeps its place among the ratios."""
        text = _SPACE.sub(" ", "".join(self.buffer)).strip()
        if text or self.dropped:
            element = next((e for _, e, _ in reversed(self.open) if e >= 0), 0)
            self.lines.append((text, self.tags, element, not text, self.linked))
            self.tags = 0
        self.buffer.clear()
        self.dropped, self.linked = False, 0

    def _close(self, at: int) -> None:
        for _, _, skipped in self.open[at:]:
            self.skipping -= skipped
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        block = (tag in BLOCKS or tag in SKIPPED) and tag not in INLINE
        if tag == "br":
            self.buffer.append(" ")
            return
        if block:
            self._line()
            self._implied(tag)
        if tag in VOID:
            return
        skipped, named = self._other_part(tag, attrs)
        skipped = int(skipped or named and not block)
        if tag in HEADINGS and not skipped and not named and self._own_header():
            skipped = -1
        if not block and not skipped and not self.skipping:
            # Inline markup neither ends a line nor is a region; within a skipped part it is
            # kept apart from the element that opened it.
            self.in_link = self.in_link or tag == "a"
            if tag in ("a", "b", "i", "em", "strong", "span", "font", "u", "s", "small"):
                return
        element = -1
        if block:
            parent = next((e for _, e, _ in reversed(self.open) if e >= 0), 0)
            self.parents.append(parent)
            self.names.append(tag)
            element = len(self.names) - 1
            if named:
                self.named.add(element)
        self.open.append((tag, element, skipped))
        self.skipping += skipped

    def _own_header(self) -> bool:
        """Whether all that is skipped here is the header of an article."""
        skips = [at for at, (_, _, skipped) in enumerate(self.open) if skipped > 0]
        return (self.skipping == 1 and len(skips) == 1 and self.open[skips[0]][0] == "header"
                and any(name in ("article", "main") for name, _, _ in self.open[:skips[0]]))

    def _implied(self, tag: str) -> None:
        """Ends an open paragraph at the next block, and list items and cells at the next."""
        ends = ("p", *CLOSES.get(tag, ()))
        for at in range(len(self.open) - 1, -1, -1):
            name = self.open[at][0]
            if name in ends:
                self._close(at)
            elif name in BLOCKS or name in SKIPPED:
                break

    def _other_part(self, tag: str, attrs) -> tuple[bool, bool]:
        """Whether the element is skipped, and whether it is named as another part."""
        if tag in SKIPPED:
            return True, False
        named = False
        for key, value in attrs:
            if key == "hidden" or key == "style" and value and _HIDDEN.search(value):
                return tag not in ("html", "body"), False
            if key == "aria-hidden" and value == "true":
                named = True
            if key in ("class", "id", "role") and value:
                words = {w for name in value.split() for w in _name_words(name)}
                if tag in ("article", "main", "h1", "h2", "h3", "p"):
                    words &= {"comment", "comments", "ad", "ads", "advert", "advertisement",
                              "reply", "cookie", "sponsored", "promo"}
                named = named or not words.isdisjoint(OTHER_PARTS)
        return False, named and tag not in ("html", "body")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        self.in_link = self.in_link and tag != "a"
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                if (tag in BLOCKS or tag in SKIPPED) and tag not in INLINE:
                    self._line()
                self._close(at)
                return
            if self.open[at][0] in ("article", "main", "body") and tag in ("p", "li", "b"):
                return

    def handle_data(self, data):
        if self.skipping:
            self.dropped = self.dropped or not data.isspace()
        else:
            self.buffer.append(data)
            self.linked += len(data) if self.in_link else 0

    def parse_comment(self, i, report=1):
        """An unclosed comment takes the rest of the page."""
        end = super().parse_comment(i, report)
        return len(self.rawdata) if end < 0 and self.ending else end

    def finish(self) -> None:
        self.ending = True
        self.close()
        self._line()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing with reflected ends."""
    if len(ratios) < 2:
        return ratios.astype(float)
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(ratios.astype(float), reach, mode="symmetric")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def content_cluster(ratios: np.ndarray) -> np.ndarray:
    """Lines above the threshold midway between the means of the two clusters."""
    threshold = ratios.std()
    for _ in range(20):
        high = ratios >= threshold
        if high.all() or not high.any():
            break
        moved = (ratios[high].mean() + ratios[~high].mean()) / 2
        if abs(moved - threshold) < 1e-9:
            break
        threshold = moved
    return ratios >= min(threshold, ratios.max(initial=0.0))


def main_text(html: str | None) -> str:
    """The article's blocks, joined by line feeds."""
    if not html:
        return ""
    page = PageLines()
    page.feed(html)
    page.finish()
    if not page.lines:
        return ""
    skipped = np.array([x[3] for x in page.lines]) | _other_parts(page)
    chars = np.where(skipped, 0, [len(x[0]) for x in page.lines])
    if not chars.any():
        return ""
    ratios = chars / np.maximum(1, [x[1] for x in page.lines])
    weight = np.where(content_cluster(smoothed(ratios)) & ~skipped, chars, 0)
    if not weight.any():
        weight = chars
    held = _sums(page, weight)
    inside = _content(page, skipped, weight, held)
    return "\n".join(x[0] for x, skip, own in zip(page.lines, skipped, inside, strict=True)
                     if own and not x[3] and not skip)


def _content(page: PageLines, skipped: np.ndarray, weight: np.ndarray,
             held: np.ndarray) -> np.ndarray:
    """Per line, whether it belongs to the content regions or their neighbours."""
    at = np.array([x[2] for x in page.lines])
    chars = np.where(skipped, 0, [len(x[0]) for x in page.lines])
    prose = _sums(page, chars) > 2 * _sums(page, np.where(skipped, 0, [x[4] for x in page.lines]))
    for kind in ("article", "main"):
        regions = {e for e, name in enumerate(page.names) if name == kind and prose[e]}
        within = _within(page, regions)[at]
        if regions and weight[within].sum() >= 0.5 * held[0]:
            return within
    region = _region(page, [e for e in range(len(held)) if held[e] >= HELD * held[0]])
    above, e = [], region
    while e > 0:
        e = page.parents[e]
        above.append(e)
    if not above:
        return np.ones(len(at), bool)
    beside = np.array([page.names[e] in LEAVES and page.parents[e] in above and bool(prose[e])
                       for e in range(len(held))])
    near = _within(page, {above[0]})[at] & (weight > 0)
    return _within(page, {region})[at] | beside[at] | near


def _within(page: PageLines, elements: set[int]) -> np.ndarray:
    """Per element, whether it is or lies in one of ``elements``."""
    inside = np.zeros(len(page.names), bool)
    for e in range(len(inside)):
        inside[e] = e in elements or e > 0 and inside[page.parents[e]]
    return inside


def _sums(page: PageLines, weights: np.ndarray) -> np.ndarray:
    """Per element, the weight of its lines and those of the elements in it."""
    held = np.zeros(len(page.names))
    np.add.at(held, [x[2] for x in page.lines], weights)
    for e in range(len(held) - 1, 0, -1):
        held[page.parents[e]] += held[e]
    return held


def _other_parts(page: PageLines) -> np.ndarray:
    """Lines of blocks named as parts other than the article. A name is overruled where the
    block holds the page's article or main element, its h1 with some of the content cluster, or
    half of the cluster, unless some of the cluster stands in such an element elsewhere. If
    nothing would be left, all names are overruled."""
    at = np.array([x[2] for x in page.lines])
    if not page.named:
        return np.zeros(len(at), bool)
    chars = np.array([0 if x[3] else len(x[0]) for x in page.lines])
    ratios = chars / np.maximum(1, [x[1] for x in page.lines])
    weight = np.where(content_cluster(smoothed(ratios)), chars, 0)
    below = _within(page, page.named)
    held, outside = _sums(page, weight), _sums(page, np.where(below[at], 0, weight))
    some = SOME * held[0]
    articles = {e for e, name in enumerate(page.names)
                if name in ("article", "main") and e not in page.named}
    heads = {e for e, name in enumerate(page.names) if name == "h1" and e not in page.named}
    named = set(page.named)
    if not any(outside[e] >= max(some, 1) for e in articles):
        over, top = _above(page, articles), _above(page, heads)
        rival = outside[0] >= some and any(not below[e] for e in heads)
        for e in page.named:
            if over[e] or top[e] and held[e] >= some or held[e] * 2 >= held[0] and not rival:
                named.discard(e)
    dropped = _within(page, named)[at]
    return dropped if chars[~dropped].any() else np.zeros(len(at), bool)


def _above(page: PageLines, elements: set[int]) -> np.ndarray:
    """Per element, whether one of ``elements`` is or lies in it."""
    above = np.zeros(len(page.names), bool)
    for e in range(len(above) - 1, -1, -1):
        above[e] |= e in elements
        if e:
            above[page.parents[e]] |= above[e]
    return above


def _region(page: PageLines, enough: list[int]) -> int:
    """The deepest element that holds enough and isn't a mere block of text."""
    return max((e for e in enough if page.names[e] not in LEAVES), default=0)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without the html column, with text: one page at a time, no shuffle."""
    prepare(pages.sparkSession)
    others = [c for c in pages.columns if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(x.as_py()) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    rows = pages.select(
        F.struct(*[pages[f"`{c}`"] for c in others]).alias("row"), pages[html].alias("html"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, text STRING")
