"""The main text of web pages: text-to-tag ratios of lines, smoothed, clustered by a threshold.

The standard library's parser gives events; block elements end lines. A line's ratio is its
characters over its tags, 0 inside elements that never hold an article (menus, headers, footers,
forms, adverts, notices, comments). The ratios are smoothed by a Gaussian; lines above one standard
deviation are cores, and the regions that hold cores (an article or main element, else the cores'
own containers) are kept whole, so that short paragraphs of an article stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, bound_batches, pick

#: Elements that end a line.
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6
    head header hgroup hr html legend li main menu nav noscript ol p pre search section summary table tbody td template tfoot th thead title tr ul""".split()
)
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no article's.
OUTSIDE = frozenset("aside audio button canvas datalist dialog footer form frameset iframe map menu nav noframes noscript object script search select style svg template textarea title video".split())
#: Roles of such elements.
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words that begin or end a class or id of such elements.
OUTSIDE_NAMES = frozenset(
    """ad ads adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus discussion footer gdpr
    masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion related replies reply respond
    share sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar topbar widget widgets""".split()
)
#: Of these an article's own parts may be called.
HEADS = frozenset(["header", "heading"])
#: Before such a word another one turns its meaning: a page that has or lacks a sidebar.
TURNS = frozenset(["has", "no", "non", "with", "without"])
#: Elements that can hold a region.
CONTAINERS = frozenset("article blockquote body center div main section table td".split())
ROOTS = frozenset(["article", "main"])
#: A new one ends an open one of these.
IMPLIED = frozenset("dd dt li p td th tr".split())
#: Standard deviation of the smoothing in lines, and how many lines to each side it reaches.
SIGMA, REACH = 1.0, 2


def named_outside(names: str) -> bool:
    """Whether a class or id attribute names a part that is no article's."""
    for name in names.lower().split():
        words = name.replace("_", "-").split("-")
        if (words[0] in OUTSIDE_NAMES or words[-1] in OUTSIDE_NAMES) and words[0] not in TURNS:
            return True
    return False


class Lines(HTMLParser):
    """Lines of a page as (text, tags, inside, root, container): inside tells that the line can be an article's, root and container number the article or main element and the container that hold it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, int, int]] = []
        self.open: list[tuple[str, bool, int, int, bool]] = []  # tag, inside, root, container, muted: in a script or the like amid a line
        self.depth: Counter[str] = Counter()  # of each tag in open
        self.number = count(1)
        self.said: list[str] = []
        self.place = (True, 0, 0)  # where the line began
        self.tags = 0

    def _now(self) -> tuple[bool, int, int]:
        return self.open[-1][1:4] if self.open else (True, 0, 0)

    def _muted(self) -> bool:
        return bool(self.open) and self.open[-1][4]

    def _end_line(self) -> None:
        if self._muted():
            return
        text = " ".join("".join(self.said).split())
        if text:
            self.lines.append((text, self.tags, *self.place))
            self.tags = 0
        self.said.clear()

    def _pop(self, k: int) -> None:
        self.depth.subtract(x[0] for x in self.open[k:])
        del self.open[k:]

    def _outside(self, tag: str, attrs: list[tuple[str, str | None]], root: int) -> bool:
        if tag in OUTSIDE:
            return True
        if tag in ("html", "body", "main"):
            return False
        values = {k: v or "" for k, v in reversed(attrs)}
        names = f"{values.get('class', '')} {values.get('id', '')}"
        if not root and (tag == "header" or any(n.replace("_", "-").split("-")[-1] in HEADS for n in names.lower().split())):
            return True
        return named_outside(names) or values.get("role", "").lower() in OUTSIDE_ROLES or "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in values.get("style", "").lower().replace(" ", "")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._end_line()
            if self.open and (self.open[-1][0] == "p" or tag in IMPLIED and self.open[-1][0] == tag):
                self._pop(len(self.open) - 1)
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        inside, root, container = self._now()
        outside = inside and self._outside(tag, attrs, root)
        if tag in CONTAINERS or outside or tag in OUTSIDE:
            number = next(self.number)
            muted = self._muted() or outside and tag not in BLOCKS
            self.open.append((tag, inside and not outside, number if tag in ROOTS else root, number if tag in CONTAINERS else container, muted))
            self.depth[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as in browsers, the slash of <div/> means nothing

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._end_line()
        if tag == "br":
            self.handle_data(" ")
        k = len(self.open) - 1 if self.depth[tag] else -1
        while k >= 0 and self.open[k][0] != tag:
            if self.open[k][0] in ROOTS and tag not in ("html", "body"):  # a stray end tag leaves an article open
                return
            k -= 1
        if k >= 0:
            self._pop(k)

    def handle_data(self, data: str) -> None:
        if self._muted():
            return
        if not self.said:
            self.place = self._now()
        self.said.append(data)

    def close(self) -> None:
        super().close()
        self.open.clear()
        self._end_line()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA, reach: int = REACH) -> np.ndarray:
    """Each ratio as the Gaussian mean of its neighbours; at the ends of those there are."""
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    middle = slice(reach, reach + len(ratios))
    return np.convolve(ratios, kernel)[middle] / np.convolve(np.ones(len(ratios)), kernel)[middle]


def text_of(html: str) -> str:
    """The main text of a page: its blocks in page order, one a line."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = parser.lines
    if not any(x[2] for x in lines):
        return ""
    ratios = smoothed(np.array([len(t) / max(1, tags) if inside else 0.0 for t, tags, inside, _, _ in lines]))
    inside = np.array([x[2] for x in lines])
    ratios = np.where(inside, ratios, 0.0)
    cores = inside & (ratios >= min(ratios.std(), ratios.max()))
    root, container = (np.array([x[k] for x in lines]) for k in (3, 4))
    if root[cores].any():
        kept = inside & np.isin(root, np.unique(root[cores & (root > 0)]))
    else:
        kept = cores | inside & np.isin(container, np.unique(container[cores]))
    return "\n".join(lines[k][0] for k in np.flatnonzero(kept).tolist())


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages: the article's blocks, one a line, and the code points of that text.

    Character references are decoded, white space inside a block is one space, br counts as white
    space, an article's own header and headings belong to it. All blocks of a region that is kept
    stay, whatever their own ratio.

    Each row stands alone, so nothing is shuffled and a lost task is only run again. A page is
    worked on whole, at any length. Null or empty html, and a page without text outside menus and the like, gives an
    empty text; null ids and addresses stay null. Rows that repeat give equal rows, an empty table an empty
    result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "html"):
                texts = [text_of(h or "") for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    bound_batches(pages.sparkSession)
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col)
    rows = rows.select("page_id", rows.url.cast("string").alias("url"), rows.html.cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
