"""Main text of web pages by text-to-tag ratios of streamed parser events.

The standard library's parser is fed a page and hands over its events; they are folded into
lines, one a block (paragraph, heading, list item, cell, bare text between blocks).  Each line
carries the number of its characters and of the tags met with it.  The ratio of the two is high
in running text and low in menus, forms and footers.  The row of ratios is smoothed with a
Gaussian, so that a short line among long ones counts as text and a long line among links does
not, and lines at or above a threshold (a share of the ratios' spread) form clusters.  The region
of the page is the element that holds the clusters: an ``article`` or ``main`` element with most
of their text, else the lowest element that still holds nearly all of it.

Lines in elements that are never running text (``nav``, ``aside``, ``form``, ``script`` ...) or are
named so by their role, class or id (adverts, notices, comments of readers ...) take no part in the
ratios.  All other lines of the region are kept, short ones included, unless they are lists of
links.  If the region is the whole body, lines between blocks (bare text) must lie in a cluster.

Defined results: null and empty pages give an empty text; pages without markup are one block;
unclosed and misnested elements are closed as browsers do for the common cases; ``br`` is white
space.  A page is worked on in one pass; memory grows with the page, not with the table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Width of the smoothing in lines.
SIGMA = 1.0
RADIUS = 2
#: Lines at this share of the ratios' standard deviation or above form clusters.
THRESHOLD = 0.5
#: Share of the clusters' text that the region must hold.
SHARE, NAMED_SHARE = 0.9, 0.5
#: A line with this share of its characters inside links is a link.
LINKED = 0.8

# Elements of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr".split()
)
#: Without text of the page, and no break in a line.
SILENT = frozenset(
    "script style noscript template button select textarea option iframe object svg math canvas audio video map"
    " datalist".split()
)
DROPPED = SILENT | frozenset("head title nav header footer aside form dialog menu".split())
FLOWING = INLINE | SILENT
#: Elements that hold one piece of text and end where the next block begins.
PIECES = frozenset("p h1 h2 h3 h4 h5 h6 dt dd li pre address figcaption caption td th summary legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: An opening element closes an open one of these, up to the nearest element that confines it.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
    "body": (("head",), ()),
}
CONFINES = frozenset("table td th caption object template button svg".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tooltip".split()
)
NAMED = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored promo promos promotion"
    " banner sidebar nav navbar navigation navigator menu menubar breadcrumb breadcrumbs header masthead topbar footer foot"
    " cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share"
    " sharing social comment comments commentlist reply replies respond disqus related recommended recommendations widget"
    " widgets toolbar pagination pager skip search copyright disclaimer".split()
)
KEPT = frozenset("html body main article".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def named_boilerplate(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Does the element's role, class or id say that it is no running text?"""
    if tag in KEPT:
        return False
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if not value:
            continue
        if name == "role" and value.lower() in ROLES:
            return True
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        if name in ("class", "id"):
            for one in value.split():
                words = [w.lower() for w in WORDS.findall(one)]
                if words and words[0] not in ("has", "with", "no", "without", "is") and not NAMED.isdisjoint(words):
                    return True
    return False


class Lines(HTMLParser):
    """Folds parser events into lines with their tags, characters and place in the tree."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        #: Open elements: tag and node; nodes know their parent, tag and whether they are dropped.
        self.open: list[tuple[str, int]] = [("", 0)]
        self.parent, self.tags, self.dropped, self.block = [-1], [""], [False], [0]
        self.count: dict[str, int] = {}
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.text: list[str] = []
        self.node = 0
        self.n_tags = self.linked = 0

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers of the source are not needed."""
        return j

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.node, max(self.n_tags, 1), self.linked, len(text)))
            self.n_tags = 0
        self.text, self.linked = [], 0

    def _close_to(self, depth: int) -> None:
        """Close the open elements from ``depth`` on."""
        for tag, _ in self.open[depth:]:
            self.count[tag] -= 1
        del self.open[depth:]

    def _innermost(self, tags, confines) -> int | None:
        if not any(map(self.count.get, tags)):
            return None
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.open[depth][0]
            if tag in tags:
                return depth
            if tag in confines:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        if tag not in FLOWING:
            self.end_line()
        if not self.dropped[self.open[-1][1]]:
            self.n_tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        if tag in ENDS_P and (depth := self._innermost(("p",), CONFINES)) is not None:
            self._close_to(depth)
        if tag in CLOSES and (depth := self._innermost(*CLOSES[tag])) is not None:
            self._close_to(depth)
        above = self.open[-1][1]
        dropped = self.dropped[above] or tag in DROPPED or named_boilerplate(tag, attrs)
        if dropped and tag in HEADINGS and self._in_article_header(above):
            dropped = False  # the title of an article stands in its own header
        self.parent.append(above)
        self.tags.append(tag)
        self.dropped.append(dropped)
        node = len(self.tags) - 1
        self.block.append(self.block[above] if tag in INLINE else node)
        self.open.append((tag, node))
        self.count[tag] = self.count.get(tag, 0) + 1

    def _in_article_header(self, node: int) -> bool:
        if self.tags[node] != "header":
            return False
        above = self.parent[node]
        while above > 0 and not self.dropped[above]:
            if self.tags[above] in ("article", "main"):
                return True
            above = self.parent[above]
        return False

    def handle_endtag(self, tag):
        if tag not in FLOWING:
            self.end_line()
        if not self.dropped[self.open[-1][1]]:
            self.n_tags += 1
        if tag == "br":
            self.text.append(" ")
            return
        confines = CONFINES - {tag} if tag not in ("table", "html", "body") else ()
        depth = self._innermost((tag,), confines)
        if depth is not None:
            self._close_to(depth)

    def handle_data(self, data):
        node = self.open[-1][1]
        if self.dropped[node]:
            return
        if not self.text:
            if data.isspace():
                return
            self.node = self.block[node]
        self.text.append(data)
        if self.count.get("a"):
            self.linked += len(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    """Gaussian means of neighbouring lines; at the ends the weights of missing lines are left out."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    total = np.convolve(ratios, kernel)[radius : radius + len(ratios)]
    weight = np.convolve(np.ones(len(ratios)), kernel)[radius : radius + len(ratios)]
    return total / weight


def clustered(ratios: np.ndarray) -> np.ndarray:
    """Which lines are in clusters of running text; the highest line always is."""
    level = smoothed(ratios)
    return level >= min(THRESHOLD * ratios.std(), level.max())


def _region(page: Lines, sizes: np.ndarray, nodes: np.ndarray, hit: np.ndarray) -> int:
    """The element that holds the clusters."""
    inside = np.zeros(len(page.tags))
    np.add.at(inside, nodes[hit], sizes[hit])
    for node in range(len(page.tags) - 1, 0, -1):  # parents come before their children
        inside[page.parent[node]] += inside[node]
    whole = inside[0]
    named = [n for n, tag in enumerate(page.tags) if tag in ("article", "main") and inside[n] >= NAMED_SHARE * whole]
    if named:
        return max(named, key=lambda n: (page.tags[n] == "article", n))
    held = [n for n in range(len(page.tags)) if inside[n] >= SHARE * whole and page.tags[n] not in PIECES | INLINE]
    return max(held)  # numbers grow downwards, and only one branch can hold this share


def _below(page: Lines, marked) -> list[int]:
    """For each element the nearest one at or above it that is marked, or -1."""
    out: list[int] = []
    for node, above in enumerate(page.parent):
        out.append(node if marked(node) else out[above] if above >= 0 else -1)
    return out


def _link_lists(page: Lines, nodes: list[int], linked: list[bool]) -> set[int]:
    """Lists of two items or more all of whose lines are links."""
    lists = _below(page, lambda n: page.tags[n] in ("ul", "ol"))
    lines: dict[int, list[bool]] = {}
    for node, link in zip(nodes, linked):
        if lists[node] >= 0:
            lines.setdefault(lists[node], []).append(link)
    return {n for n, links in lines.items() if len(links) > 1 and all(links)}


def main_text(html: str | None) -> str:
    """The blocks of a page's article, one a line."""
    page = Lines()
    page.feed(html or "")
    page.close()
    page.end_line()
    if not page.lines:
        return ""
    texts, nodes, tags, links, lengths = (list(c) for c in zip(*page.lines))
    sizes = np.array(lengths, dtype=float)
    linked = np.array(links) >= LINKED * sizes
    hit = clustered(np.where(linked, 0.0, sizes) / np.array(tags))
    region = _region(page, sizes, np.array(nodes), hit)
    menus = _link_lists(page, nodes, linked.tolist())
    inside = _below(page, lambda n: n == region)
    menu = _below(page, lambda n: n in menus) if menus else [-1] * len(page.tags)
    loose = page.tags[region] in ("", "html", "body")
    out = []
    for text, node, link, high in zip(texts, nodes, linked.tolist(), hit.tolist()):
        if inside[node] < 0 or menu[node] >= 0:
            continue
        bare = page.tags[node] not in PIECES and page.tags[node] != "blockquote"
        if loose and (link or (bare and not high)):
            continue
        out.append(text)
    if page.tags[region] not in ("article", "main") and not loose:
        out = _title_before(page, texts, nodes, region, inside) + out
    return "\n".join(out)


def _title_before(page: Lines, texts: list[str], nodes: list[int], region: int, inside: list[int]) -> list[str]:
    """A page's first heading, where it stands before the region and outside of it."""
    for text, node in zip(texts, nodes):
        if inside[node] >= 0 or node > region:
            return []
        if page.tags[node] == "h1":
            return [text]
    return []


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.column("html")
        texts = [main_text(pages[i].as_py()) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    return rows.mapInArrow(_extracted, schema)
