"""Main text of web pages from parser events, text-to-tag ratios and threshold clustering.

The standard library's parser streams events into lines, one for each block of a page, and
groups neighbouring lines of one container into regions. A line's ratio is its text outside
links against its tags, on a logarithmic scale; what the markup says of a line moves its ratio up
(an article) or down (menus, adverts, footers, comments). A Gaussian smooths the ratios over
neighbouring lines, and two-means clustering of the smoothed ratios gives the threshold: the
regions above it are the main text, short blocks in them included. No tag decides by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, elements that break a line, elements that never hold main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
APART = frozenset("head title script style noscript template nav footer aside form button select option textarea iframe svg canvas object audio video dialog menu label input".split())
#: Words of class, id and role attributes that mark what isn't main text.
MARKS = frozenset("ad ads adv advert advertisement adsbygoogle banner sponsor sponsored promo promotion sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer foot masthead cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendation comment comments disqus reply replies discussion widget pagination pager toolbar skip complementary contentinfo search".split())
ARTICLE_MARKS = frozenset("articlebody".split())
#: Those that count on an article or main element too, and words that turn the next one round (has-sidebar).
OTHER_ARTICLES = frozenset("ad advert comment comments promo recommended related replies reply sponsored".split())
TURNS = frozenset("has no with without".split())
#: Containers whose lines make one region where nothing is marked.
CONTAINERS = frozenset("address article aside blockquote body center dialog div fieldset footer form header html main nav section table".split())
#: What an article adds to the logarithm of a line's ratio, and what other marks take away.
ARTICLE_GAIN, APART_LOSS = 2.0, 8.0


@dataclass
class Line:
    text: str
    tags: int
    linked: int
    article: int
    apart: int
    region: int


class Lines(HTMLParser):
    """The lines of a page.

    ``article`` and ``apart`` number the outermost article and the outermost element of marked
    markup around a line, 0 outside of any; ``region`` numbers the marked element or else the article or else the nearest container.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, int, int, int]] = []  # name, apart, article, container
        self.parts: list[str] = []
        self.tags = self.linked = self.links = self.numbers = 0

    def parse_marked_section(self, i, report=1):
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def unknown_decl(self, data):
        pass

    def _state(self) -> tuple[int, int, int]:
        return self.open[-1][1:] if self.open else (0, 0, 0)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        apart, article, container = self._state()
        if text:
            self.lines.append(Line(text, self.tags, self.linked, article, apart, apart or article or container))
        self.parts, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag, attrs):
        block = tag in BLOCK
        apart, article, container = self._state()
        marked = tag in APART or self._marked(tag, attrs, article)
        if block or marked and not apart:
            self.flush()
        if tag in ("p", "li", "dt", "dd", "tr"):
            self._close_open(tag)
            apart, article, container = self._state()
        self.tags += 1
        if tag in VOID:
            self.parts.append(" " if tag in ("br", "hr") else "")
            return
        if tag in ("td", "th"):
            self.parts.append(" ")
        self.links += tag == "a"
        self.numbers += 1
        if marked:
            apart = apart or self.numbers
        elif not article and (tag in ("article", "main") or any(k == "role" and v == "main" or k == "itemprop" and (v or "").lower() in ARTICLE_MARKS for k, v in attrs)):
            article = self.numbers
        self.open.append((tag, apart, article, self.numbers if tag in CONTAINERS else container))

    def _marked(self, tag, attrs, article) -> bool:
        if tag in ("html", "body"):
            return False
        if tag == "header" and not article:
            return True
        marks = OTHER_ARTICLES if tag in ("article", "main") else MARKS
        for k, v in attrs:
            if k in ("class", "id", "role") and v:
                words = re.split(r"[^a-z]+", v.lower())
                if any(w in marks and before not in TURNS for before, w in zip(["", *words], words, strict=False)):
                    return True
            if k == "hidden" or k == "aria-hidden" and v == "true":
                return True
        return False

    def _close_open(self, tag) -> None:
        """An open paragraph ends at the next one, a list item at the next of its list."""
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name == tag:
                self._pop(i)
                return
            if name in BLOCK or name in ("td", "th"):
                return

    def _pop(self, i: int) -> None:
        self.links -= sum(x[0] == "a" for x in self.open[i:])
        del self.open[i:]

    def handle_endtag(self, tag):
        self.tags += 1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                state = self._state()
                if any(x[0] in BLOCK for x in self.open[i:]):
                    self.flush()
                elif (self.open[i - 1][1:] if i else (0, 0, 0)) != state:
                    self.flush()
                self._pop(i)
                return
        if tag in BLOCK:
            self.flush()

    def handle_data(self, data):
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())


def ratios(lines: list[Line]) -> np.ndarray:
    """The logarithm of each line's text outside links against its tags, moved by its marks; 0 at least."""
    free = np.array([max(0, len(x.text) - 2 * x.linked) / max(1, x.tags) for x in lines])
    marks = np.array([-APART_LOSS if x.apart else ARTICLE_GAIN if x.article else 0.0 for x in lines])
    return np.maximum(np.log1p(free) + np.where(free > 0, marks, 0.0), 0.0)


def smoothed(values: np.ndarray, apart: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines that are marked alike (``apart``), with weights renewed at the ends."""
    if sigma <= 0:
        return values.copy()
    total, weight = values.copy(), np.ones(len(values))
    for d in range(1, min(int(3 * sigma), len(values) - 1) + 1):
        w = np.exp(-0.5 * (d / sigma) ** 2) * (apart[d:] == apart[:-d])
        total[d:] += w * values[:-d]
        total[:-d] += w * values[d:]
        weight[d:] += w
        weight[:-d] += w
    return total / weight


def threshold(values: np.ndarray) -> float:
    """The midpoint of the two clusters of the values (two-means), one of them held by the 0 of a page without text."""
    values = np.append(values, 0.0)
    low, high = 0.0, float(values.max())
    for _ in range(50):
        mid = (low + high) / 2
        below, above = values[values <= mid], values[values > mid]
        if not len(above):
            return mid
        new = float(below.mean()), float(above.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(html: str | None, *, sigma: float = 1.0, least: float | None = None) -> str:
    """The blocks of the main text, joined by two line ends; empty if there are none.

    A region, the lines of one marked element, article or container, is main text if the mean of its lines' smoothed ratios, by their
    lengths, is above the threshold of the page (or ``least``). In such a region only lines that are links for the most
    part and below the threshold themselves go. ``sigma`` 0 switches the smoothing off. Null or empty html gives an empty text.
    """
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    ratio = smoothed(ratios(lines), np.array([x.apart for x in lines]), sigma)
    least = threshold(ratio) if least is None else least
    _, region = np.unique([x.region for x in lines], return_inverse=True)
    sizes = np.array([len(x.text) for x in lines], float)
    content = (np.bincount(region, sizes * ratio) / np.bincount(region, sizes) > least)[region]
    return "\n\n".join(x.text for x, c, r in zip(lines, content, ratio, strict=True) if c and (r > least or 2 * x.linked <= len(x.text)))


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every input row, from the whole html.

    Null or empty html, or a page without main text, gives an empty text. Null ids and urls stay;
    repeated rows give repeated rows; an empty table gives none. Unclosed, misplaced and
    unknown markup is read as far as it goes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kept = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return kept.mapInArrow(run, "page_id long, url string, text string, n_chars long")
