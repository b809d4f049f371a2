"""Main text of web pages.

The standard library's streaming parser turns a page into lines (one for each block) with the number of tags
met in each. The text-to-tag ratio of the lines is smoothed with a Gaussian and split into two clusters. Boxes (the page,
body, divisions, sections, articles) are weighed by the characters of their lines, those of the upper cluster for and
those of the lower one against; the heaviest box is the content region. Elements only settle close calls: articles of
positive weight that together have over half of the heaviest box's weight are taken instead of it, and an article goes
before another box of the same weight. Page furniture (menus, headers, footers, side bars, notices, adverts, forms,
scripts, styles, reader comments) counts against a box and is left out of the region.

Defined results: null or empty html gives empty text; markup that the parser rejects is read as text; of a header in an
article the headings stay (the title), the rest (names, dates) goes. Equal pages give equal texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Elements by their role, and words of class or id that mark page furniture.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
BOXES = set("article aside body blockquote details dialog div dl fieldset figure footer form header html main menu nav ol section table ul".split())
FURNITURE = set("aside dialog footer form header menu nav".split())
SILENT = set("audio button canvas datalist iframe map math noscript object script select style svg template textarea title video".split())
#: Boxes that can be a region; lists, tables, quotes and the like are parts of one.
REGIONS = set("article body div html main section".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: How far a box hides its lines: not at all, all but headings (a header in an article), all.
SHOWN, TITLED, HIDDEN = 0, 1, 2
MARKS = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies discussion disqus footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split())
WORDS = re.compile(r"[A-Za-z]+")
SPACE = re.compile(r"\s+")


class Lines(HTMLParser):
    """rows: (text, tags, furniture, innermost box or -1); boxes: (tag, box around it or -1, furniture), in the order of their start tags.

    The end tags of head and option may be left out, so neither silences by itself: what head may hold is silent of its
    own, and options stand in a select or datalist.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, int, bool, int]] = []
        self.open: list[tuple[str, int, bool, int]] = []
        self.boxes: list[tuple[str, int, bool]] = []
        self.parts: list[str] = []
        self.tags = self.silent = 0
        self.heading = False

    def _state(self) -> tuple[int, bool, int]:
        """How far lines are hidden here, whether in an article, innermost box."""
        return self.open[-1][1:] if self.open else (SHOWN, False, -1)

    def line(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                hides, _, box = self._state()
                self.rows.append((text, self.tags, hides == HIDDEN or (hides == TITLED and not self.heading), box))
            self.parts = []
        self.tags = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            self.silent += 1
            return
        if tag == "option":
            return
        if tag in BLOCKS:
            self.line()
            self.heading = tag in HEADINGS
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in BOXES:
            hides, article, box = self._state()
            said = dict(attrs)
            names = {x.lower() for k in ("class", "id", "role") for x in WORDS.findall(said.get(k) or "")}
            marks = names & MARKS if tag not in ("body", "html") else set()
            if "hidden" in said or (tag in FURNITURE and tag != "header") or marks - {"header"}:
                hides = HIDDEN
            elif tag == "header" or marks:
                hides = max(hides, TITLED if article else HIDDEN)
            article = article or (tag in ("article", "main") and hides == SHOWN and not any("comment" in x for x in names))
            self.boxes.append((tag if article or tag not in ("article", "main") else "div", box, hides != SHOWN))
            self.open.append((tag, hides, article, len(self.boxes) - 1))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in SILENT:
            self.handle_starttag(tag, attrs)
            if tag in BOXES:
                self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
            return
        if tag == "option":
            return
        if tag in BLOCKS:
            self.line()
            self.heading = False
        self.tags += 1
        if tag in BOXES:
            at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
            if at is not None:
                del self.open[at:]

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)


def lines(html: str) -> Lines:
    parser = Lines()
    try:
        parser.feed(html)
        parser.close()
    except AssertionError:  # the parser's word for a broken declaration
        parser = Lines()
        parser.feed(html.replace("<![", "&lt;!["))
        parser.close()
    parser.line()
    return parser


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian mean; weights outside the page are left out."""
    reach = max(1, math.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, kernel)[reach : reach + len(x)]
    return full(values) / full(np.ones(len(values)))


def upper_cluster(values: np.ndarray) -> np.ndarray:
    """Two means on a line, from the extremes; all are in it if they are equal."""
    low, high = values.min(), values.max()
    while high > low:
        upper = values >= (low + high) / 2
        new = values[~upper].mean(), values[upper].mean()
        if new == (low, high):
            return upper
        low, high = new
    return np.ones(len(values), bool)


def weights(boxes: list[tuple[str, int, bool]], rows: list[tuple[str, int, bool, int]], chosen: np.ndarray) -> list[int]:
    """Characters of each box's lines, with those in the boxes inside it: chosen ones for it, the others against it. The last one is the page."""
    own = [0] * (len(boxes) + 1)
    for (text, _, furniture, box), c in zip(rows, chosen, strict=True):
        own[box] += len(text) if c and not furniture else -len(text)
    for b in range(len(boxes) - 1, -1, -1):  # inner boxes start after those around them
        own[boxes[b][1]] += own[b]
    return own


def regions(boxes: list[tuple[str, int, bool]], weight: list[int]) -> set[int]:
    """The boxes of the content; -1 is the page."""
    able = [b for b, (tag, _, furniture) in enumerate(boxes) if tag in REGIONS and not furniture]
    best = max([-1, *able], key=lambda b: (weight[b], b >= 0 and boxes[b][0] in ("article", "main"), b))
    articles: list[int] = []
    for b in able:  # outermost ones
        if boxes[b][0] in ("article", "main") and weight[b] > 0 and not inside(boxes, b, articles):
            articles.append(b)
    return set(articles) if articles and 2 * sum(weight[b] for b in articles) > weight[best] else {best}


def inside(boxes: list[tuple[str, int, bool]], box: int, outer: Iterable[int]) -> bool:
    """Whether a box is one of some or stands in one."""
    while box not in outer:
        if box < 0:
            return False
        box = boxes[box][1]
    return True


def main_text(html: str | None, sigma: float = 1.0) -> str:
    page = lines(html or "")
    if all(furniture for *_, furniture, _ in page.rows):
        return ""
    ratio = np.array([len(t) / max(1, tags) for t, tags, *_ in page.rows])
    chosen = upper_cluster(smoothed(ratio, sigma))
    kept = regions(page.boxes, weights(page.boxes, page.rows, chosen))
    held = {b: inside(page.boxes, b, kept) for b in {r[3] for r in page.rows}}
    return "\n".join(text for text, _, furniture, box in page.rows if held[box] and not furniture)


def extract_text(pages: DataFrame, sigma: float = 1.0) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages; one row for each, repeated rows included."""

    def make():
        def f(ids: list, urls: list, htmls: list) -> Iterable[tuple]:
            for i, u, h in zip(ids, urls, htmls, strict=True):
                text = main_text(h, sigma)
                yield i, u, text, len(text)

        return f

    return map_rows(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), make, "page_id long, url string, text string, n_chars long")
