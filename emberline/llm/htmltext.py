"""Main text of HTML pages from streaming parser events.

The standard library's parser feeds a page's events to a state that holds open elements and the current block. Each block
is a line with its ratio of text to tags; the ratios are smoothed by a Gaussian and split in two clusters by a threshold
(two-means). Lines above it are content. They choose the region: the articles of the page where these hold most of the
content, otherwise the deepest element that holds nearly all of it, widened over headings right above. Every block of the
region stays, short ones too, but for links alone, under the threshold, at its edges.

Elements that are menus, headers, footers, sidebars, forms, scripts or styles by their tag or role never count. A class or
id that is one of `NAMES` is a weak sign: such an element goes only if most of the content lies elsewhere.

Defined results: null, empty or text-less html gives an empty text; broken markup is read as the parser reads it; very
long pages are read whole; of elements that hold as much, the deepest is the region; repeated rows, and rows of one key,
are extracted each; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emberline.llm.common import slices
from emberline.llm.tokencount import decoded

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_DROP = frozenset("nav header footer aside form script style noscript template iframe object svg math button select option textarea dialog menu head title canvas audio video map datalist".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form menu menubar toolbar alert".split())
_ITEMS = frozenset(("li", "dt", "dd", "tr", "td", "th"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Class and id names, whole, of what is seldom an article.
NAMES = frozenset(
    """ad ads advert adverts advertisement advertising ad-banner ad-slot ad-container adsbygoogle sponsor sponsored sponsored-content promo promotion banner
    cookie cookies cookie-banner cookie-notice cookie-bar cookie-consent consent gdpr notice notices notification site-notice newsletter subscribe newsletter-signup popup modal overlay
    sidebar side-bar left-sidebar right-sidebar widget widgets related related-posts related-articles related-links recommended share share-buttons sharing social social-links social-share
    comment comments comment-list commentlist comments-area comments-section comment-section user-comments reader-comments disqus disqus_thread replies
    breadcrumb breadcrumbs menu main-menu site-menu nav navbar navigation topnav main-nav site-nav header site-header page-header masthead topbar toolbar
    footer site-footer page-footer pagination pager paywall""".split()
)


class _Block(NamedTuple):
    text: str
    tags: int
    path: tuple[int, ...]
    heading: bool
    linked: int  # characters in links


class _Blocks(HTMLParser):
    """Blocks of a page outside of dropped elements; containers are numbered inwards."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []  # tag, container's number, whether it starts a dropped part
        self.drops = self.links = 0
        self.names: list[str] = []
        self.weak: set[int] = set()
        self.blocks: list[_Block] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                heading = any(t in _HEADINGS for t, _, _ in self.open)
                self.blocks.append(_Block(text, self.tags, tuple(n for _, n, _ in self.open if n >= 0), heading, self.linked))
                self.tags = 0
            self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        drop = tag in _DROP
        named = False
        for name, value in attrs:
            value = value or ""
            drop |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.strip().lower() in _ROLES
            named |= name in ("class", "id") and any(x in NAMES for x in value.lower().split())
        if tag in _VOID:
            if tag == "br":
                self.handle_data(" ")
            elif tag not in _INLINE:
                self.flush()
            return
        if tag in _INLINE and not drop and not named:
            self.open.append((tag, -1, False))
            self.links += tag == "a"
            return
        self.flush()
        self.imply_end(tag)
        drop &= tag not in ("html", "body", "main")
        number = -1
        if not drop and not self.drops:
            number = len(self.names)
            self.names.append("main" if ("role", "main") in attrs else tag)
            if named and tag not in ("html", "body", "main"):
                self.weak.add(number)
        self.open.append((tag, number, drop))
        self.drops += drop
        self.links += tag == "a"

    def imply_end(self, tag):
        """A block ends an open paragraph, an item the item before it."""
        for i in range(len(self.open) - 1, -1, -1):
            t, number, drop = self.open[i]
            if t in _INLINE and number < 0 and not drop:
                continue
            if t == "p" or t == tag and tag in _ITEMS:
                self.end_at(i)
                if t == "p":
                    self.imply_end(tag)
            return

    def end_at(self, i):
        self.drops -= sum(d for _, _, d in self.open[i:])
        self.links -= sum(t == "a" for t, _, _ in self.open[i:])
        del self.open[i:]

    def handle_startendtag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.handle_data(" ")
        elif tag not in _INLINE:
            self.flush()

    def handle_endtag(self, tag):
        self.tags += 1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                break
        else:
            if tag not in _INLINE:
                self.flush()
            return
        inline = self.open[i][1] < 0 and not self.open[i][2] and tag in _INLINE
        if inline and any(t not in _INLINE for t, _, _ in self.open[i + 1 :]):
            return  # an inline end does not close blocks
        if not inline:
            self.flush()
        self.end_at(i)

    def handle_data(self, data):
        if not self.drops:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def smoothed(ratios: list[float], sigma: float = 1.0) -> np.ndarray:
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    x = np.asarray(ratios)
    weight = np.convolve(np.ones(len(x)), kernel)[reach:-reach]
    return np.convolve(x, kernel)[reach:-reach] / weight


def threshold(x: np.ndarray) -> float:
    """Midway between the means of two clusters; the least value if there is one."""
    low, high = float(x.min()), float(x.max())
    for _ in range(20):
        middle = (low + high) / 2
        above = x >= middle
        if above.all():
            return float(x.min())
        low, high = float(x[~above].mean()), float(x[above].mean())
    return min((low + high) / 2, float(x.max()))


def content_lines(blocks: list[_Block]) -> np.ndarray:
    """Whether each line's smoothed text-to-tag ratio reaches the threshold of the page."""
    x = smoothed([len(b.text) / max(1, b.tags) for b in blocks])
    return x >= threshold(x)


def _held(blocks: list[_Block], content: np.ndarray) -> tuple[dict[int, int], int]:
    """Characters of content in each container, and in all."""
    held: dict[int, int] = {}
    for b, c in zip(blocks, content, strict=True):
        for node in b.path:
            held[node] = held.get(node, 0) + len(b.text) * bool(c)
    return held, sum(len(b.text) for b, c in zip(blocks, content, strict=True) if c)


def _region(blocks: list[_Block], content: np.ndarray, names: list[str]) -> set[int]:
    """Containers whose blocks are the main text; none stands for the whole page."""
    held, total = _held(blocks, content)
    for kind in ("article", "main"):
        found = {n for n in held if names[n] == kind}
        inside = sum(len(b.text) for b, c in zip(blocks, content, strict=True) if c and not found.isdisjoint(b.path))
        if found and 2 * inside >= total:
            return found
    if not (deep := [n for n, v in held.items() if 10 * v >= 9 * total]):
        return set()
    path = next(b.path for b in blocks if max(deep) in b.path)
    at = path.index(max(deep))
    while at:  # up over headings that stand before it
        added = [b for b in blocks if path[at - 1] in b.path and path[at] not in b.path]
        if any(not b.heading for b in added) or at == 1 and not added:
            break
        at -= 1
    return {path[at]}


def main_text(html: str) -> str:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    blocks, names = parser.blocks, parser.names
    if not blocks:
        return ""
    content = content_lines(blocks)
    if parser.weak:
        held, total = _held(blocks, content)
        proper: set[int] = set()  # articles outside of weak elements, and all that holds one
        for b in blocks:
            for i, n in enumerate(b.path):
                if names[n] in ("article", "main") and parser.weak.isdisjoint(b.path[: i + 1]):
                    proper.update(b.path[: i + 1])
        weak = {n for n in parser.weak if 2 * held.get(n, 0) < total or proper and n not in proper}
        stay = np.array([weak.isdisjoint(b.path) for b in blocks])
        if stay.any():
            blocks = [b for b, s in zip(blocks, stay, strict=True) if s]
            content = content_lines(blocks)
    region = _region(blocks, content, names)
    rows = [(b, c) for b, c in zip(blocks, content, strict=True) if not region or not region.isdisjoint(b.path)]
    first, last = 0, len(rows)
    edge = lambda r: not r[1] and 2 * r[0].linked > len(r[0].text)
    while first + 1 < last and edge(rows[first]):
        first += 1
    while first + 1 < last and edge(rows[last - 1]):
        last -= 1
    return "\n\n".join(b.text for b, _ in rows[first:last])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: key, url, text and its code points."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "c2"):
                texts = [main_text(x) for x in decoded(part.column("c2"))]
                yield pa.RecordBatch.from_arrays([part.column("c0"), part.column("c1"), pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["c0", "c1", "text", "n_chars"])

    kinds = ", ".join(f"c{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate((key, url)))
    rows = pages.select(*(pages[c].alias(f"c{i}") for i, c in enumerate((key, url, html)))).mapInArrow(run, f"{kinds}, text string, n_chars bigint")
    return rows.withColumnsRenamed({"c0": key, "c1": url})
