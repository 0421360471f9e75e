"""Main text of web pages by the distribution of text over lines.

Markup is stripped into lines, one per block.  Scripts, styles, forms and what is
marked as menu, header, footer, sidebar, notice, advert or reader comments give no
lines, so what stands around them is adjacent.  A class or id marks an element if one
whole name in it is made of marking words: ``cookie-notice`` does, ``has-sidebar`` does
not.  A ``main`` that is not marked itself is never dropped with the elements around it,
nor is an ``article`` so placed if the page has no other and its text is longer than the
rest (of ``main``, or of the page without one).  Articles among comments and teasers
stay out.

If the page has an ``article`` or ``main`` element, its lines are the text.  Without one,
line lengths are summed over a sliding window, in which lines that are mostly links count
as empty; a surge is where the sum rises from nothing to ``SURGE_SHARE`` of its peak, a
dive is where it falls to nothing.  The lines from a surge to its dive are the text, and
with them, however short: other lines between the first surge and the last dive, and
those in the same container as a line of the text.  Lines that are mostly links stay if they
are in such a stretch or, unless it is the body, in such a container.

A null or empty page has the empty text.  Broken markup, unknown references and texts
of any length are read as browsers do: an unclosed element ends with the one around
it.  Repeated pages give equal rows; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandkit.llm.common import column_of, prepare, texts

WINDOW_LINES = 3
SURGE_SHARE = 0.25

# -- fixed values: element names
BLOCKS = set(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes".split())
DROPPED = set("nav footer aside form button select datalist dialog menu head object svg canvas audio video map math search".split())
MAIN = {"article", "main"}
# What holds paragraphs, lists and headings; the body is the container PAGE.
CONTAINERS = set("article aside dialog div fieldset footer form header main section td th".split())
PAGE = 0
# Where a line is: outside, in main alone, in an article, in an article that stands in a dropped element.
OUTSIDE, IN_MAIN, IN_ARTICLE, IN_DROPPED_ARTICLE = range(4)
KEPT, DROPPED_TEXT, DROPPED_OTHERS = range(3)
ENDS_PARAGRAPH = BLOCKS - {"caption", "legend", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html", "head"}
CLOSED_BY_SIBLING = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "option": {"select"}}
SIBLINGS = {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}}

# -- fixed values: words of class and id attributes, and roles, of what is not the article
NOT_TEXT = set(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disclaimer disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay paywall pager pagination "
    "popup promo promotion related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget".split()
)
NOT_TEXT_OUTSIDE_ARTICLE = {"header", "alert"}
# Words that leave the meaning of a name to its others.
NEUTRAL = {"site"}
# An article in one of these is never that of the page.
OF_OTHERS = set("comment comments commentlist disqus related replies respond teaser".split())
NOT_TEXT_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar note feed".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.S)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def _marked(attrs: str, in_main: bool) -> int:
    """Whether the attributes of an element mark it as something beside the article: DROPPED_TEXT or,
    where articles in it are others, DROPPED_OTHERS."""
    for name, *values in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            marks = NOT_TEXT if in_main else NOT_TEXT | NOT_TEXT_OUTSIDE_ARTICLE
            for whole in value.split():
                words = {w.lower() for w in _NAME_PARTS.findall(whole) if not w.isdigit()} - NEUTRAL
                if words and words <= marks:
                    return DROPPED_OTHERS if words & OF_OTHERS else DROPPED_TEXT
        elif name == "role" and value.lower() in NOT_TEXT_ROLES:
            return DROPPED_TEXT
        elif name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return DROPPED_TEXT
    return DROPPED_TEXT if _HIDDEN.search(_ATTRIBUTE.sub(" ", attrs)) else KEPT


class Lines:
    """The lines of a page that may belong to the article: text, where, and its characters in links."""

    def __init__(self, page: str):
        self.text: list[str] = []
        self.main: list[int] = []
        self.container: list[int] = []
        self.link_chars: list[int] = []
        self._parts: list[str] = []
        self._links: list[str] = []
        # open elements: (name, dropped, inside the main element and how, inside a link, number of the container)
        self._open: list[tuple[str, int, int, bool, int]] = [("", KEPT, OUTSIDE, False, PAGE)]
        self._containers = PAGE
        self._read(page)

    def _end_line(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                _, dropped, main, _, container = self._open[-1]
                if not dropped:
                    self.text.append(text)
                    self.main.append(main)
                    self.container.append(container)
                    self.link_chars.append(len("".join("".join(self._links).split())))
            self._parts, self._links = [], []

    def _pop(self, depth: int) -> None:
        """Closes the elements from ``depth`` on."""
        for entry in self._open[depth:]:
            if entry[0] in BLOCKS or entry[1] != self._open[depth - 1][1]:
                self._end_line()
                break
        del self._open[depth:]

    def _close(self, names: set[str], stop: set[str]) -> None:
        for depth in range(len(self._open) - 1, 0, -1):
            if self._open[depth][0] in names:
                return self._pop(depth)
            if self._open[depth][0] in stop:
                return None
        return None

    def _start(self, name: str, attrs: str) -> None:
        if name in VOID:
            if name == "hr":
                self._end_line()
            elif not self._open[-1][1]:
                self._parts.append(" ")
            return
        if name in ENDS_PARAGRAPH:
            self._close({"p"}, {"td", "th", "button", "caption", "table", "object"})
        if name in CLOSED_BY_SIBLING:
            self._close(SIBLINGS.get(name, {name}), CLOSED_BY_SIBLING[name])
        _, dropped, main, link, container = self._open[-1]
        now_main, out = main, dropped
        if name in MAIN and main in (OUTSIDE, IN_MAIN) and not (name == "article" and dropped == DROPPED_OTHERS):
            # a comment inside the main element, or one of those in a dropped element, is marked itself
            out = _marked(attrs, True) if attrs and (dropped or main) else KEPT
            if not out:
                now_main = IN_MAIN if name == "main" else IN_DROPPED_ARTICLE if dropped else IN_ARTICLE
        elif dropped != DROPPED_OTHERS:
            if attrs and name not in ("html", "body"):
                out = max(out, _marked(attrs, bool(main)))  # also a comment inside the article
            if name in DROPPED or name == "header" and not main:
                out = out or DROPPED_TEXT
        if name in BLOCKS or bool(out) != bool(dropped):
            self._end_line()
        if name in CONTAINERS:
            self._containers += 1
            container = self._containers
        self._open.append((name, out, now_main, link or name == "a", container))

    def _read(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            m = _TOKEN.search(page, at)
            if m is None:
                self._add(page[at:])
                break
            if m.start() > at:
                self._add(page[at : m.start()])
            at = m.end()
            name = m["name"] or m["name2"]
            if not name:
                continue
            name = name.lower()
            if m["end"] or m["end2"]:
                self._close({name}, MAIN if name in ("p", "span", "a", "b", "i") else set())
            elif name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                if end is None:
                    at = n
                else:
                    close = page.find(">", end.end())
                    at = n if close < 0 else close + 1
            else:
                self._start(name, m["attrs"] or m["attrs2"] or "")
        self._pop(1)
        self._end_line()

    def _add(self, text: str) -> None:
        decoded = html.unescape(text)
        self._parts.append(decoded)
        if self._open[-1][3]:
            self._links.append(decoded)


def between_surge_and_dive(weights: np.ndarray, share: float, window: int = WINDOW_LINES) -> np.ndarray:
    """Marks the lines of each stretch of text whose window sums reach the share of the peak."""
    kept = np.zeros(len(weights), bool)
    if not len(weights) or not weights.any():
        return kept
    sums = np.convolve(weights, np.ones(window, np.int64))[window - 1 :]  # from each line on
    padded = np.concatenate([np.convolve(weights, np.ones(window, np.int64)), [0]])  # every window, also those over the ends
    live = padded > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], live, [False]]).astype(np.int8)))
    peak = sums.max()
    for surge, dive in zip(edges[::2], edges[1::2]):
        if padded[surge:dive].max() >= share * peak:
            kept[max(0, surge) : min(len(weights), dive - window + 1)] = True
    return kept


def main_text(page: str) -> str:
    lines = Lines(page)
    sizes = np.array([len(t) for t in lines.text], np.int64)
    place = np.array(lines.main, np.int8)
    inside, placed = (place == IN_MAIN) | (place == IN_ARTICLE), place == IN_DROPPED_ARTICLE
    rest = inside if inside.any() else place == OUTSIDE
    if not (place == IN_ARTICLE).any() and sizes[placed].sum() > sizes[rest].sum():
        inside |= placed
    if not inside.any():
        inside = ~placed
        inside[inside] = _text_block(sizes[inside], np.array(lines.link_chars, np.int64)[inside], np.array(lines.container, np.int64)[inside])
    return "\n".join(t for t, kept in zip(lines.text, inside) if kept)


def _text_block(sizes: np.ndarray, link_chars: np.ndarray, container: np.ndarray) -> np.ndarray:
    """Marks the lines of the text on a page that does not say where it is."""
    links = 2 * link_chars > sizes
    kept = between_surge_and_dive(np.where(links, 0, sizes), SURGE_SHARE)
    if not kept.any():
        return kept
    at = np.flatnonzero(kept)
    between = np.zeros(len(sizes), bool)
    between[at[0] : at[-1] + 1] = True
    beside = np.isin(container, container[kept & ~links])
    return kept | ~links & (between | beside) | links & beside & (container != PAGE)


def extract(pages: DataFrame, ident: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.  Nothing is shuffled."""
    prepare(pages.sparkSession)
    slim = pages.select(F.col(ident).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(t) for t in texts(batch, "html")]
            yield pa.RecordBatch.from_arrays(
                [column_of(batch, "page_id"), column_of(batch, "url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    fields = [slim.schema["page_id"], slim.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return slim.mapInArrow(rows, T.StructType(fields))
