"""Main-text extraction from web pages by tree scoring.

Paragraphs give points for length and commas to their ancestors, halved at each level up; a container's points are discounted by the share of
its text that is links. The best container, or the article around it, and its siblings of less than a quarter links hold the main text. What is
page furniture by its element, or hidden, or reader comments by its name, never counts; what is only named like furniture counts where it
holds most of the points of its article or page. Other articles, or on a page without one other containers, with at least a fifth of the best one's
discounted points are main text too, wherever they stand. All passes are linear in the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Elements and names of HTML, and words that sites use in class and id names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math xmp noembed noframes".split())
FURNITURE = frozenset("nav footer aside form button select dialog menu object canvas audio video head".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body div main section td table blockquote html ul ol li dl figure tr tbody fieldset details center".split())
SCORED = frozenset("article body center div main section table td blockquote".split())
CLOSES_P = BLOCKS - {"body", "html", "head", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary", "figcaption"}
COMMENTS = frozenset("comment comments disqus replies respond".split())
AVOIDED = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe nav navbar navigation menu breadcrumb "
    "breadcrumbs header masthead footer sidebar aside complementary contentinfo share sharing social related recommended widget toolbar pagination pager login signup form search copyright".split()
)
#: Words that say nothing of a block's matter: before them the first word of a name counts, as in comment-list.
GENERIC = frozenset("list box bar wrap wrapper container inner outer area section block link links item items panel button buttons icon icons group row column col top bottom left right content body text thread slot unit".split())
#: Words that say so anywhere in a name, outside of articles only: inside of one they may be its matter.
OUTSIDE = frozenset("responses discussion feedback outbrain taboola breadcrumb sitemap related popular recommended trending".split())
NEVER_NAMED = frozenset("article main body html p h1 h2 h3 h4 h5 h6 pre b i em strong a".split())

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*>|[^>]*(?:>|\Z))|[!?/][^>]*(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}
KEPT, NAMED, CUT = 0, 1, 2


def _named(names: str, inside: bool) -> frozenset[str]:
    """Words of AVOIDED that a class, id or role says the block is: its last word, or the first before a generic last one; outside of articles also
    any of OUTSIDE."""
    found, outside = set(), set()
    for name in names.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if words:
            found.add(words[0] if words[-1] in GENERIC else words[-1])
            outside.update(words)
    return frozenset(found & AVOIDED | (frozenset() if inside else outside & OUTSIDE))


def _state(tag: str, attributes: str, inside: bool) -> int:
    """CUT: never part of the text. NAMED: furniture by its name, unless it holds most of its article or page."""
    if tag in FURNITURE:
        return CUT
    if not attributes.strip(" >/"):
        return KEPT
    names = []
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _UNSEEN.search(value):
            return CUT
        if name in ("class", "id", "role"):
            names.append(value)
    if tag in NEVER_NAMED:
        return KEPT
    found = _named(" ".join(names), inside)
    return CUT if found & COMMENTS else NAMED if found else KEPT


class _Page:
    """Nodes as parallel lists, and the blocks of text found under them."""

    def __init__(self, html: str):
        self.tag, self.parent, self.state = ["#page"], [-1], [KEPT]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters of it in links
        self._open, self._parts, self._linked = [0], [], 0
        self._at: dict[str, list[int]] = {}  # where in _open each tag is
        self._block_at, self._container_at = [], []
        self._cut = self._article = 0  # how many open nodes are
        at = 0
        while True:
            found = _TAG.search(html, at)
            self._add(html[at : found.start() if found else len(html)])
            if not found:
                break
            at = found.end()
            name = (found[2] or "").lower()
            if not name:
                continue
            if found[1]:
                self._end(name)
            elif name in RAW:
                if not found[3].endswith("/>"):
                    close = _RAW_END[name].search(html, at)
                    at = close.end() if close else len(html)
            else:
                self._start(name, found[3])
        self._flush()

    def _add(self, text: str) -> None:
        if text and not self._cut:
            self._parts.append(text)
            if self._at.get("a"):
                self._linked += len(text)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join(unescape("".join(self._parts)).split())
            if text:
                self.blocks.append((self._open[-1], text, min(self._linked, len(text))))
            self._parts, self._linked = [], 0

    def _start(self, name: str, attributes: str) -> None:
        if name == "br" or name == "wbr":
            if name == "br":
                self._add(" ")
            return
        if name in BLOCKS:
            self._flush()
            if name in CLOSES_P:
                self._close("p", CONTAINERS)
            elif name in ("li", "dd", "dt", "tr", "td", "th"):
                for same in {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,)):
                    self._close(same, frozenset(("ul", "ol", "dl", "table")) if name != "tr" else frozenset(("table",)))
        if name in VOID or attributes.endswith("/>") and name not in BLOCKS:
            return
        state = _state(name, attributes, self._article > 0)
        if name == "header" and state == KEPT and not self._article and self.tag[self._open[-1]] in ("body", "html", "#page"):
            state = NAMED
        self.tag.append(name)
        self.parent.append(self._open[-1])
        self.state.append(state)
        self._at.setdefault(name, []).append(len(self._open))
        if name in BLOCKS:
            self._block_at.append(len(self._open))
        if name in CONTAINERS:
            self._container_at.append(len(self._open))
        self._cut += state == CUT
        self._article += name in ("article", "main")
        self._open.append(len(self.tag) - 1)

    def _last(self, names: frozenset[str] | tuple[str, ...]) -> int:
        return max((self._at[n][-1] for n in names if self._at.get(n)), default=0)

    def _close(self, name: str, until: frozenset[str]) -> None:
        at = self._last((name,))
        if at and at >= self._last(until):
            self._pop(at)

    def _pop(self, to: int) -> None:
        while len(self._open) > to:
            node = self._open.pop()
            name = self.tag[node]
            self._at[name].pop()
            if name in BLOCKS:
                self._block_at.pop()
            if name in CONTAINERS:
                self._container_at.pop()
            self._cut -= self.state[node] == CUT
            self._article -= name in ("article", "main")

    def _end(self, name: str) -> None:
        if name in BLOCKS:
            self._flush()
        at = self._last((name,))
        barrier = self._container_at if name == "p" else [] if name in BLOCKS else self._block_at
        if at and (not barrier or at >= barrier[-1]):
            self._pop(at)

    def _whole(self, node: int) -> int:
        """The nearest article or main that holds the node, else the node."""
        level = node
        while level > 0 and self.tag[level] not in ("article", "main"):
            level = self.parent[level]
        return level if level > 0 else node

    def _without_named(self) -> tuple[list[tuple[int, str, int]], list[bool]]:
        """The blocks outside of named furniture, and which nodes are inside of it. A named node counts as text if it holds more than half of the points
        of the article around it, or, outside of any article, of the page and every article of it."""
        n = len(self.tag)
        mass, articles, around = [0.0] * n, [0] * n, [0] * n
        for node, text, linked in self.blocks:
            mass[node] += _points(text, linked)
        for i in range(n - 1, 0, -1):
            articles[i] += self.tag[i] in ("article", "main") and mass[i] > 0
            mass[self.parent[i]] += mass[i]
            articles[self.parent[i]] += articles[i]
        gone = [False] * n
        for i in range(1, n):
            up = self.parent[i]
            around[i] = up if self.tag[up] in ("article", "main") else around[up]
            few = 2 * mass[i] <= mass[around[i]] or not around[i] and articles[i] < articles[0]
            gone[i] = gone[up] or self.state[i] == CUT or (self.state[i] == NAMED and few)
        return [x for x in self.blocks if not gone[x[0]]], gone

    def main_blocks(self) -> list[str]:
        n = len(self.tag)
        blocks, gone = self._without_named()
        points, size, linked = [0.0] * n, [0] * n, [0] * n
        for node, text, in_links in blocks:
            points[node] += _points(text, in_links)
            size[node] += len(text)
            linked[node] += in_links
        for i in range(n - 1, 0, -1):  # children come after their parents
            up = self.parent[i]
            points[up] += points[i] / 2 if self.tag[i] in SCORED else points[i]
            size[up] += size[i]
            linked[up] += linked[i]
        score = [p * (1 - k / s) + (25 if t in ("article", "main") else 0) if s else -1e9 for p, s, k, t in zip(points, size, linked, self.tag, strict=True)]
        candidates = [i for i in range(n) if size[i] and (self.tag[i] in SCORED or i == 0)]
        if not candidates:
            return []
        best = self._whole(max(candidates, key=lambda i: (score[i], -i)))
        chosen = {best}
        if best:
            chosen.update(i for i in range(n) if self.parent[i] == self.parent[best] and size[i] and not gone[i] and linked[i] < 0.25 * size[i])
        above, level = {0}, best
        while level > 0:
            level = self.parent[level]
            above.add(level)
        plain = [p * (1 - k / s) if s else 0.0 for p, s, k in zip(points, size, linked, strict=True)]
        wanted = ("article", "main") if any(t in ("article", "main") and s for t, s in zip(self.tag, size, strict=True)) else SCORED
        inside = [False] * n
        for i in range(n):
            up = self.parent[i] >= 0 and inside[self.parent[i]]
            more = best and self.tag[i] in wanted and i not in above and not gone[i] and linked[i] < 0.25 * size[i] and plain[i] >= 0.2 * plain[best]
            inside[i] = up or i in chosen or bool(more)
        return [text for node, text, _ in blocks if inside[node]]


def _points(text: str, linked: int) -> float:
    return 1 + text.count(",") + min(len(text) / 100, 3.0) - (linked / len(text)) * 4


def main_text(html: str | None) -> str:
    """Blocks of the page's main text in page order, white space inside each as one space, joined by line breaks."""
    return "\n".join(_Page(html).main_blocks()) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    A null or empty page, or one without text, gives the empty text. Null ids and urls and repeated rows are kept as they are. Other columns are
    ignored.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                texts = [main_text(x) for x in rows.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(x) for x in texts], np.int64))], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(part, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
