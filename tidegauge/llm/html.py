"""Main text of web pages by the ratio of text to tags.

The standard library's parser streams a page as events. They become lines, one per block of text, each with its
number of tags. The ratios of text to tags are smoothed by a Gaussian; lines that reach their standard deviation are
content. The page's region is the container that holds the content lines: an article or main element, a container
named like one, or the deepest one with nearly all of them. Elements and class names that stand for menus, notices and
the like are left out on the way; inside a region nothing else is dropped, however short.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidegauge.llm.common import prepare, tables

RADIUS = 2  # lines on each side of the Gaussian
SIGMA = 1.0
REGION = 0.8  # share of the content that a plain container must hold
NAMED = 0.5  # ... and one that is named as the article

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base head link meta noscript script style template title".split())
# Elements that never hold the article's text.
NEVER = frozenset(
    "aside audio button canvas dialog footer head iframe menu nav noscript object option search select script style svg "
    "template textarea title video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tooltip".split())
# Parts of class names and ids of what surrounds an article, and beginnings of such parts.
NAMES = frozenset(
    "ad ads adsbygoogle adslot banner consent copyright footer gdpr header hidden login masthead menu modal nav notice "
    "notices notification outbrain overlay pager pagination popup promo promos promotion reply replies respond "
    "recommended related share sharing signup social subscribe subscription taboola teaser toast toolbar widget "
    "widgets".split())
BEGINNINGS = ("advert", "breadcrumb", "comment", "cookie", "disqus", "navbar", "navigation", "newsletter", "sidebar", "sponsor")
OF_ARTICLES = frozenset("ad ads promo promotion related reply teaser".split())  # an article element with such a name is none
CONTENT = frozenset("article articlebody content entry main post story".split())
CLOSES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "td": ("tr",), "th": ("tr",), "tr": ("table",), "option": ("select",)}
SENTENCE = tuple(".!?…:\"”»)")


@lru_cache(100_000)
def _parts(name: str) -> tuple[str, ...]:
    return tuple(x for x in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if x)


def _noisy(tag: str, own: dict[str, str | None]) -> bool:
    if "hidden" in own or own.get("aria-hidden") == "true" or (own.get("role") or "").lower() in ROLES:
        return True
    if "display:none" in (own.get("style") or "").replace(" ", "").lower():
        return True
    parts = _parts(f"{own.get('class') or ''} {own.get('id') or ''}")
    begins = any(p.startswith(BEGINNINGS) and p != "commentary" for p in parts)
    if tag in ("html", "body", "main"):
        return False
    if tag == "article":
        return not OF_ARTICLES.isdisjoint(parts) or any(p.startswith(("advert", "comment", "sponsor")) for p in parts)
    return begins or not NAMES.isdisjoint(parts)


@dataclass
class Line:
    text: str
    tags: int
    linked: int  # characters inside links
    inside: tuple[int, ...]  # numbers of the open elements
    heading: bool


class Lines(HTMLParser):
    """Events of one page to lines; `noise` has the elements whose names stand for something beside the article."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.noise: set[int] = set()
        self.parents: dict[int, tuple[int, ...]] = {}
        self.named: dict[int, str] = {}  # article, main, or content by name
        self.stack: list[tuple[str, int, bool]] = []  # tag, number, never text
        self.numbers = 0
        self.never = self.links = self.tags = self.linked = 0
        self.text: list[str] = []

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                open_tags = {tag for tag, _, _ in self.stack}
                heading = not HEADINGS.isdisjoint(open_tags)
                if heading or "header" not in open_tags:
                    self.lines.append(Line(text, self.tags, self.linked, tuple(n for _, n, _ in self.stack), heading))
                self.tags = self.linked = 0
            self.text = []
        self.links = 0

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            self.never -= self.stack.pop()[2]

    def close_open(self, tag: str) -> None:
        """Elements whose end this start tag implies."""
        if self.stack and self.stack[0][0] == "head" and tag not in IN_HEAD:
            self.pop(0)
        for at in range(len(self.stack) - 1, -1, -1):
            name = self.stack[at][0]
            if name == "head" and tag not in IN_HEAD or name == "p" or tag in ("article", "main") and name in ("nav", "button", "select"):
                self.pop(at)
            elif name == tag and tag in CLOSES:
                self.pop(at)
                break
            elif tag in CLOSES and name in CLOSES[tag]:
                break

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
            self.close_open(tag)
        elif tag == "br":
            self.text.append(" ")
        elif tag == "a":
            self.links += 1
        if tag in VOID:
            return
        own = dict(attrs)
        never = tag in NEVER or tag == "header" and not any(t == "article" for t, _, _ in self.stack)
        noisy = tag == "form" or bool(own) and _noisy(tag, own)
        if not (tag in BLOCKS or never or noisy):
            return
        self.numbers += 1
        number = self.numbers
        if noisy:
            self.noise.add(number)
        if tag in ("article", "main"):
            self.named[number] = tag
        elif own and not CONTENT.isdisjoint(_parts(f"{own.get('class') or ''} {own.get('id') or ''} {own.get('itemprop') or ''}")):
            self.named[number] = "content"
        self.parents[number] = tuple(n for _, n, _ in self.stack)
        self.stack.append((tag, number, never))
        self.never += never

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        elif tag == "a":
            self.links = max(0, self.links - 1)
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                self.pop(at)
                break

    def handle_data(self, data: str) -> None:
        if not self.never:
            self.text.append(data)
            if self.links:
                self.linked += len(data)

    def unknown_decl(self, data: str) -> None:
        pass


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian mean of every line and its neighbours; beyond the ends the page is mirrored."""
    weights = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    padded = np.pad(ratios, RADIUS, mode="symmetric")
    return np.convolve(padded, weights / weights.sum(), "valid")


def content(lines: list[Line]) -> np.ndarray:
    """Whether a line belongs to the cluster of high ratios."""
    ratios = smoothed(np.array([len(x.text) / max(1, x.tags) for x in lines]))
    return ratios >= ratios.std()


def _region(page: Lines, lines: list[Line], chosen: np.ndarray) -> int | None:
    """Number of the element that holds the article; None is the whole page."""
    held: dict[int, int] = defaultdict(int)
    for line, wanted in zip(lines, chosen):
        if wanted:
            for number in line.inside:
                held[number] += len(line.text)
    total = sum(len(x.text) for x, wanted in zip(lines, chosen) if wanted)
    for kind in ("article", "main", "content"):
        found = [n for n, k in page.named.items() if k == kind and held[n] > 0 and held[n] >= NAMED * total]
        if found:
            most = max(held[n] for n in found)
            return max(n for n in found if held[n] == most)
    return max((n for n in held if held[n] >= REGION * total), key=lambda n: (len(page.parents[n]), n), default=None)


def extract(html: str) -> str:
    """The page's main text: its blocks in order, one space between them; empty if it has none."""
    if "<![" in html:  # marked sections, bogus comments to a browser
        html = re.sub(r"<!\[[^>]*>?", "", html)
    page = Lines()
    page.feed(html)
    page.close()
    page.flush()
    if not page.lines:
        return ""
    # A container with the name of a sidebar or form that holds the article or main element is no such thing.
    size: dict[int, int] = defaultdict(int)
    for line in page.lines:
        for number in line.inside:
            size[number] += len(line.text)
    whole = [n for n, k in page.named.items() if k != "content" and n not in page.noise and size[n]]
    clean = [n for n in whole if page.noise.isdisjoint(page.parents[n])]
    if whole and not clean:
        page.noise -= set(page.parents[max(whole, key=lambda n: size[n])])
    lines = [x for x in page.lines if page.noise.isdisjoint(x.inside)]
    if not lines:
        return ""
    chosen = content(lines)
    region = _region(page, lines, chosen)
    inside = [i for i, x in enumerate(lines) if region is None or region in x.inside]
    if region is None or region not in page.named:
        # No element is named as the article: from the first content line to the last, and what joins them.
        def links(i: int) -> bool:
            return 2 * lines[i].linked >= len(lines[i].text)

        def joins(i: int) -> bool:
            return not links(i) and (lines[i].heading or lines[i].text.endswith(SENTENCE))

        # Smoothing lifts the lines beside a long one: links at the ends are none of the article's.
        some = [i for i in inside if chosen[i] and not links(i)]
        if not some:
            return ""
        low, high = some[0], some[-1]
        while low - 1 in inside and joins(low - 1):
            low -= 1
        while high + 1 in inside and joins(high + 1):
            high += 1
        inside = [i for i in inside if low <= i <= high]
    return " ".join(lines[i].text for i in inside)


def main_text(pages: DataFrame) -> DataFrame:
    """`page_id, url, text, n_chars` of every row.

    Null or empty html gives an empty text; null ids and urls stay; repeated rows and ties each give their row; very
    long pages are read whole, one at a time; other columns are ignored; an empty table gives no row.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables(batches):
            texts = [extract(x.as_py() or "") for x in batch.column("html")]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                   pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
