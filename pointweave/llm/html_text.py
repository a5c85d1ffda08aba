"""Main text of web pages by the text-to-tag ratio of their lines.

The standard library's parser streams a page as events, which make lines: inline content between two block borders, with
the number of tags up to it. The text-to-tag ratio of a line is its text outside of links over its tags. The ratios along a
page are smoothed with a Gaussian and split by a threshold into two clusters; lines of the upper one are the core of the
content. Menus, headers, footers, sidebars, forms, notices, adverts and comments, told by their elements, roles and class
words, have ratio 0. The content region is the article element (or ``main``) around core lines; a page without one gives
the deepest container that holds most of the core, from its first to its last core line, with headings before it. Every
line of the region counts, however short.

A page is one row and one call; nothing is shared between pages, so there is no shuffle and no skew but a page's length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article aside body center details dialog div fieldset figure footer form header html main nav section "
                       "table tbody td tfoot th thead tr ul ol li dl dd dt blockquote".split())
BLOCKS = CONTAINERS | HEADINGS | frozenset("address caption figcaption head hr legend menu option p pre summary title".split())
#: Elements whose content is no running text anywhere.
NO_TEXT = frozenset("script style template noscript iframe object svg canvas select textarea button title head audio video".split())
#: Elements beside the content.
ASIDE = frozenset("nav header footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words in a class or id that name something beside the content.
NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
                  "cookies copyright discussion disqus footer header login masthead menu modal nav navbar navigation newsletter "
                  "notice notices notification pager pagination popup promo promoted promotion related replies respond share "
                  "sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar widget".split())
#: Attributes that can tell of it.
TELLING = frozenset("hidden aria-hidden style role class id".split())
#: Words before which a name tells what an element has or lacks, not what it is.
ABOUT = frozenset("has no not with without".split())
#: Open elements that a new one of the same kind ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}}
HOLDS_ITEMS = frozenset("ul ol menu dl table select".split())

SIGMA = 1.0
APART = 3
#: The share of a container's core that one inside it must hold to be the region in its place.
MOST = 0.6
_WORDS = re.compile(r"[a-z0-9]+")
_BROKEN_OFF = re.compile("<[a-zA-Z/!?]")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def names_an_aside(attributes: dict[str, str | None]) -> bool:
    """Whether the element says, by role, class, id or being hidden, that it is no part of the content."""
    if not TELLING & attributes.keys():
        return False
    if "hidden" in attributes or (attributes.get("aria-hidden") or "").lower() == "true":
        return True
    if "display:none" in (attributes.get("style") or "").replace(" ", "").lower():
        return True
    if (attributes.get("role") or "").strip().lower() in ROLES:
        return True
    for name in f"{attributes.get('class') or ''} {attributes.get('id') or ''}".split():
        for word in _WORDS.findall(_CAMEL.sub("-", name).lower()):
            if word in ABOUT:
                break
            if word in NAMES:
                return True
    return False


class Lines(HTMLParser):
    """Lines of a page, and the tree of its elements as parallel lists."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.named = ["#page"], [-1], [False]
        self.open = [0]
        self.opened: Counter[str] = Counter()
        #: Per line: its chunks as (element, text, whether linked), and the tags since the line before.
        self.lines: list[tuple[list[tuple[int, str, bool]], int]] = []
        self.chunks: list[tuple[int, str, bool]] = []
        self.tags = 0
        self.breaks = 0

    def updatepos(self, i: int, j: int) -> int:
        """Line and column numbers are not asked for, so newlines need no counting."""
        return j

    def close(self) -> None:
        """A comment or tag that the page breaks off in is no text."""
        if _BROKEN_OFF.match(self.rawdata):
            self.rawdata = ""
        super().close()

    def border(self) -> None:
        if any(text.strip() for _, text, _ in self.chunks):
            self.lines.append((self.chunks, self.tags))
            self.tags = 0
        self.chunks, self.breaks = [], 0

    def close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            self.opened[self.tag[self.open.pop()]] -= 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            # One line break is white space, more of them are a border.
            self.chunks.append((self.open[-1], " ", False))
            self.breaks += 1
            if self.breaks > 1:
                self.border()
            return
        if tag in BLOCKS:
            self.border()
            if tag == "body" and self.opened["head"]:
                self.handle_endtag("head")
            for depth in range(len(self.open) - 1, 0, -1):
                inner = self.tag[self.open[depth]]
                if inner == "p" or inner in ENDS.get(tag, ()):
                    self.close_to(depth)
                elif inner in HOLDS_ITEMS or inner in CONTAINERS and tag not in ENDS:
                    break
        if tag in VOID:
            return
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.named.append(bool(attrs) and tag not in ("html", "body", "main") and names_an_aside(dict(attrs)))
        self.open.append(len(self.tag) - 1)
        self.opened[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.border()
        if self.opened[tag]:
            depth = len(self.open) - 1
            while self.tag[self.open[depth]] != tag:
                depth -= 1
            self.close_to(depth)

    def handle_data(self, data: str) -> None:
        self.chunks.append((self.open[-1], data, self.opened["a"] > 0))
        if not data.isspace():
            self.breaks = 0


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian means along a page; beyond its ends there is nothing to take in."""
    reach = max(1, math.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(ratios, kernel)[reach:reach + len(ratios)]
    return total / np.convolve(np.ones(len(ratios)), kernel)[reach:reach + len(ratios)]


def threshold(values: np.ndarray) -> float:
    """The value between two clusters: halfway between the means of what lies below and above it, from the mean on.

    Values that lie closer together than one to ``APART`` are a single cluster, which all lies above.
    """
    at = float(values.mean())
    for _ in range(50):
        above = values >= at
        if above.all() or not above.any():
            break
        moved = (values[above].mean() + values[~above].mean()) / 2
        if abs(moved - at) < 1e-9:
            break
        at = float(moved)
    above = values >= at
    return at if above.all() or APART * values[~above].mean() < values[above].mean() else float(values.min())


class Page:
    """The lines of one page and which of them are content."""

    def __init__(self, html: str):
        self.events = events = Lines()
        events.feed(html)
        events.close()
        events.border()
        self.lines = events.lines
        self.sizes = [sum(len(t.strip()) for _, t, _ in chunks) for chunks, _ in self.lines]
        self.judge(events.named)

    def judge(self, named: list[bool]) -> None:
        """Which elements are beside the content: their own kind, their names, and all they hold."""
        events = self.events
        self.beside = beside = [False] * len(events.tag)
        within = [False] * len(events.tag)
        in_header = [False] * len(events.tag)
        for i in range(1, len(events.tag)):
            tag, up = events.tag[i], events.parent[i]
            # An article's own header holds its title.
            title = within[up] and tag == "header"
            beside[i] = beside[up] or tag in NO_TEXT or named[i] or tag in ASIDE and not title
            in_header[i] = in_header[up] and tag not in HEADINGS or title
            within[i] = within[up] or tag in ("article", "main") and not beside[i]
        for i, only_title in enumerate(in_header):
            beside[i] = beside[i] or only_title

    def live(self, line: int) -> list[tuple[int, str, bool]]:
        return [c for c in self.lines[line][0] if not self.beside[c[0]]]

    def held(self, weights: list[float]) -> list[float]:
        """The weight of all lines below each element. A line belongs to the element of its first chunk with text."""
        total = [0.0] * len(self.events.tag)
        for place, weight in zip(self.places, weights):
            total[place] += weight
        for i in range(len(total) - 1, 0, -1):
            total[self.events.parent[i]] += total[i]
        return total

    def below(self, roots: set[int]) -> list[bool]:
        inside = [False] * len(self.events.tag)
        for i in range(len(inside)):
            inside[i] = i in roots or i > 0 and inside[self.events.parent[i]]
        return inside

    def text(self) -> str:
        if not self.lines:
            return ""
        self.places = [next((e for e, t, _ in chunks if t.strip()), 0) for chunks, _ in self.lines]
        self.rescue()
        events, n = self.events, len(self.lines)
        kept = [self.live(i) for i in range(n)]
        self.places = [next((e for e, t, _ in chunks if t.strip()), place) for chunks, place in zip(kept, self.places)]
        free = [sum(len(t.strip()) for _, t, linked in c if not linked) for c in kept]
        size = [sum(len(t.strip()) for _, t, _ in c) for c in kept]
        ratio = smoothed(np.array(free, float) / np.maximum(1, [tags for _, tags in self.lines]))
        cut = threshold(ratio)
        core = [size[i] > 0 and free[i] > 0 and ratio[i] >= cut for i in range(n)]
        if not any(core):
            core = [f > 0 for f in free]
        if not any(size):
            return ""
        core_of, all_of = self.held([f * c for f, c in zip(free, core)]), self.held(size)
        for kind in ("article", "main"):
            found = [i for i, tag in enumerate(events.tag) if tag == kind and not self.beside[i] and all_of[i]]
            if found:
                region = {i for i in found if core_of[i]} or set(found)
                inside = self.below(region)
                chosen = [inside[self.places[i]] for i in range(n)]
                break
        else:
            chosen = self.container(core, core_of, free, size)
        menus = self.below(self.menus(size, free))
        out = (" ".join("".join(t for _, t, _ in kept[i]).split()) for i in range(n) if chosen[i] and not menus[self.places[i]])
        return "\n".join(line for line in out if line)

    def rescue(self) -> None:
        """An article that holds most of the page is content, whatever the elements around it are called.

        The same goes for a page whose every line is beside the content by name.
        """
        events, total = self.events, sum(self.sizes)
        articles = [i for i, tag in enumerate(events.tag) if tag in ("article", "main")]
        named = list(events.named)
        if articles and all(self.beside[i] for i in articles):
            all_of = self.held(self.sizes)
            best = max(articles, key=lambda i: all_of[i])
            if 2 * all_of[best] > total:
                while best > 0:
                    named[best] = False
                    if events.tag[best] in ASIDE:
                        events.tag[best] = "div"
                    best = events.parent[best]
                self.judge(named)
        elif not articles and not any(t.strip() for i in range(len(self.lines)) for _, t, _ in self.live(i)):
            self.judge([False] * len(named))

    def container(self, core: list[bool], core_of: list[float], free: list[int], size: list[int]) -> list[bool]:
        """Lines of the deepest container with most of the core, from its first to its last core line."""
        events, at = self.events, 0
        below = [[] for _ in events.tag]
        for i in range(1, len(events.tag)):
            below[events.parent[i]].append(i)
        while True:
            inner = [i for i in below[at] if events.tag[i] in CONTAINERS and events.tag[i] not in ("li", "dd", "dt", "tr", "td", "th", "blockquote")
                     and core_of[i] > MOST * core_of[at]]
            if not inner:
                break
            at = inner[0]
        inside = self.below({at})
        own = [i for i in range(len(core)) if inside[self.places[i]]]
        marked = [i for i in own if core[i]]
        if not marked:
            # Links and nothing else.
            return [False] * len(core)
        first, last = marked[0], marked[-1]
        heading = lambda i: events.tag[self.places[i]] in HEADINGS
        while first > 0 and inside[self.places[first - 1]] and heading(first - 1):
            first -= 1
        return [first <= i <= last and inside[self.places[i]] and (core[i] or 2 * free[i] >= size[i]) for i in range(len(core))]

    def menus(self, size: list[int], free: list[int]) -> set[int]:
        """Lists of two or more items that hold nothing but links."""
        events = self.events
        all_of, free_of = self.held(size), self.held(free)
        items = Counter(events.parent[i] for i, tag in enumerate(events.tag) if tag == "li" and all_of[i])
        return {i for i, k in items.items() if k > 1 and events.tag[i] in ("ul", "ol") and not free_of[i]}


def main_text(html: str | None) -> str:
    return Page(html).text() if html else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            some = batch.slice(at, 64)
            texts = pa.array([main_text(h.as_py()) for h in some.column(0)], pa.string())
            yield pa.RecordBatch.from_arrays([*some.columns[1:], texts], [*some.schema.names[1:], "text"])


def extracted(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep``, then ``text`` (lines joined by ``\\n``) and its length ``n_chars``, for every row.

    Whole pages are parsed, of any length. Null or empty html, and pages without content, have an empty text. Rows stand
    for themselves: nulls in ``keep`` stay, repeated rows come out as often, an empty table gives none. Other columns are
    left out, whatever their names.
    """
    schema = T.StructType([*[pages.schema[c] for c in keep], T.StructField("text", T.StringType())])
    rows = pages.select(F.col(html).cast("string").alias("__html"), *[F.col(f"`{c}`") for c in keep])
    return rows.mapInArrow(_extract, schema).withColumn("n_chars", F.length("text").cast("bigint"))
