"""Main-text extraction with a tree-structured graphical model over the page.

Every element is a binary node: does it hold main text? A node's potential is
linear in features of the element; parent-child potentials depend on the kind
of the child. Sum-product messages up and down the tree give each node's
marginal exactly. The weights maximise the exact likelihood of labelled pages,
which are made here from a grammar of page layouts.
"""

from __future__ import annotations

import bisect
import functools
import html
import math
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_column

# Fixed values of HTML: elements without content, with raw text, that stand as blocks, that run in a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes noembed".split())
UNSEEN = frozenset("script style noscript template iframe noframes noembed head title object svg math select option button input textarea canvas video audio map".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "head", "body", "html", "title", "legend"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
P_SCOPE = frozenset("html body article section main div aside nav header footer form td th li blockquote table figure dd dt fieldset button caption details".split())

TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</?([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|</?([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*>", re.S)
NAMES = re.compile(r"(?:^|[\s\"'])(class|id|role|itemprop|aria-label|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

DIMENSIONS = 1 << 12
KINDS = 3  # of a child: block that structures, block of text, inline
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt blockquote pre figcaption caption summary address tr table tbody thead ul ol dl figure hr".split())
TOP = 12.0  # node scores and messages stay within this many nats


CELL_SCOPE = frozenset(("td", "th", "table"))


class Open:
    """The open elements of a page being read. Where a name or a scope stands last is known without a walk."""

    def __init__(self):
        self.nodes, self.names = [0], ["#page"]
        self.places: dict[str, list[int]] = {"#page": [0]}
        self.scopes: list[int] = []  # places of P_SCOPE elements
        self.cells: list[int] = []  # places of CELL_SCOPE elements

    def push(self, node: int, name: str) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.names.append(name)
        self.places.setdefault(name, []).append(at)
        if name in P_SCOPE:
            self.scopes.append(at)
        if name in CELL_SCOPE:
            self.cells.append(at)

    def close(self, at: int) -> bool:
        """Closes the elements from a place on; whether a block was among them."""
        block = False
        while len(self.nodes) > at:
            self.nodes.pop()
            name = self.names.pop()
            self.places[name].pop()
            if name in P_SCOPE:
                self.scopes.pop()
            if name in CELL_SCOPE:
                self.cells.pop()
            block = block or name in BLOCK
        return block

    def last(self, name: str) -> int:
        """The place of the innermost element of that name; 0 where none is open."""
        found = self.places.get(name)
        return found[-1] if found else 0

    def scope(self) -> int:
        return self.scopes[-1] if self.scopes else 0

    def cell(self) -> int:
        return self.cells[-1] if self.cells else 0

    def outermost(self, names: set[str], scopes: set[str]) -> int:
        """The outermost element of one of the names that no scope stands within or around before; 0 where none is open."""
        bound = max(map(self.last, scopes))
        found = 0
        for name in names:
            own = self.places.get(name, ())
            k = bisect.bisect_left(own, bound) if own else 0
            if k < len(own) and own[k] and (not found or own[k] < found):
                found = own[k]
        return found


class Page:
    """The element tree in document order; node 0 is the page itself."""

    __slots__ = ("attrs", "links", "own", "parent", "pieces", "size", "tags")

    def __init__(self, source: str):
        self.tags, self.parent, self.attrs = ["#page"], [-1], [""]
        self.own, self.size, self.links = [0], [0], [0]  # text of its own, in its subtree, of that inside links
        self.pieces: list[tuple[int, str]] = []  # (node, text with references decoded), node -1: a block's edge
        self._build(source)

    def _build(self, source: str) -> None:
        tags, parent, attrs, pieces, own = self.tags, self.parent, self.attrs, self.pieces, self.own
        stack, at, end = Open(), 0, len(source)
        lower = None
        for_scan = TOKEN.search
        while at < end:
            m = for_scan(source, at)
            begin = m.start() if m else end
            if begin > at:
                text = source[at:begin]
                if "&" in text:
                    text = html.unescape(text)
                pieces.append((stack.nodes[-1], text))
                own[stack.nodes[-1]] += len(text.strip())
            if not m:
                break
            at = m.end()
            tag = m[1] or m[3]
            if not tag:
                continue
            tag = tag.lower()
            if source[begin + 1] == "/":
                if tag == "br":
                    pieces.append((stack.nodes[-1], " "))
                elif tag == "p" or tag not in VOID:
                    k = stack.last(tag)
                    # an inline element isn't closed through a scope, nor text in a cell through the cell
                    within = stack.scope() if tag not in BLOCK else 0
                    if tag in ("p", "div", "span", "li"):
                        within = max(within, stack.cell())
                    if k and k >= within and stack.close(k):
                        pieces.append((-1, ""))
                continue
            rest = m[2] if m[1] else m[4]
            if tag in CLOSES_P and (k := stack.last("p")) > stack.scope():
                stack.close(k)
            if tag in SIBLINGS and (k := stack.outermost(SIBLINGS[tag], SCOPES[tag])):
                stack.close(k)
            if tag in ("body", "nav", "div", "article", "p", "header", "main") and stack.names[-1] == "head":
                stack.close(len(stack.nodes) - 1)
            node = len(tags)
            tags.append(tag)
            parent.append(stack.nodes[-1])
            attrs.append(rest)
            own.append(0)
            if tag in BLOCK:
                pieces.append((-1, ""))
            elif tag == "br":
                pieces.append((stack.nodes[-1], " "))
            if tag in VOID or rest.endswith("/") and tag not in BLOCK and tag not in RAW and tag not in ("a", "span", "b", "i", "em", "strong"):
                continue
            if tag in RAW:
                lower = source.lower() if lower is None else lower
                close = lower.find(f"</{tag}", at)
                if len(lower) != end:  # a few letters change length in lower case
                    found = re.compile(f"</{tag}", re.I).search(source, at)
                    close = found.start() if found else -1
                close = end if close < 0 else close
                if tag in ("title", "textarea"):
                    pieces.append((node, html.unescape(source[at:close])))
                stop = source.find(">", close)
                at = end if close == end or stop < 0 else stop + 1
                if tag in BLOCK:
                    pieces.append((-1, ""))
                continue
            stack.push(node, tag)
        size, links = own[:], [n if t == "a" else 0 for n, t in zip(own, tags)]
        for k in range(len(tags) - 1, 0, -1):
            if tags[k] == "a":
                links[k] = size[k]
            size[parent[k]] += size[k]
            links[parent[k]] += links[k]
        self.size, self.links = size, links

    def text(self, keep: list[bool]) -> str:
        """The kept nodes' text: white space inside a block one space, blocks joined by a line feed."""
        out, block = [], []
        for node, text in self.pieces:
            if node < 0:
                if block:
                    if line := " ".join("".join(block).split()):
                        out.append(line)
                    block = []
            elif keep[node]:
                block.append(text)
        if line := " ".join("".join(block).split()):
            out.append(line)
        return "\n".join(out)


@functools.lru_cache(maxsize=50_000)
def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % DIMENSIONS


@functools.lru_cache(maxsize=20_000)
def _attribute_slots(attrs: str) -> tuple[int, ...]:
    """Features of the parts of class, id and role names."""
    found = set()
    for name, value in NAMES.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            found.add("unseen")
        elif name in ("class", "id", "role", "itemprop", "aria-label"):
            found |= {"n:" + p.lower().rstrip("s") for p in PART.findall(value)}
    return tuple(sorted({_slot(f) for f in found}))


def features(page: Page) -> list[tuple[int, ...]]:
    """Indices of the active binary features of each node."""
    total = max(1, page.size[0])
    out = []
    for tag, attrs, own, size, links, parent in zip(page.tags, page.attrs, page.own, page.size, page.links, page.parent):
        density = 0 if not size else links * 4 // size
        slots = [_slot("bias"), _slot("t:" + tag), _slot(f"p:{page.tags[parent]}>{tag}" if parent >= 0 else "top"), _slot(f"d:{density}"), _slot(f"o:{own.bit_length()}"), _slot(f"s:{min(size.bit_length(), 12)}"), _slot(f"r:{size * 8 // total}:{density}")]
        if tag in UNSEEN:
            slots.append(_slot("no text"))
        if attrs:
            # long attributes, data in them say, aren't held in the cache
            slots += _attribute_slots(attrs) if len(attrs) < 2000 else _attribute_slots.__wrapped__(attrs)
        out.append(tuple(slots))
    return out


def kind(tag: str) -> int:
    return 1 if tag in TEXT_BLOCKS else 0 if tag in BLOCK or tag in UNSEEN else 2


class Model:
    """``weights`` of features for the state 1; ``edges[kind][parent state][child state]`` in nats."""

    def __init__(self, weights: np.ndarray, edges: np.ndarray):
        self.weights = weights
        self.edges = edges
        self._w = weights.tolist()
        self._e = [[[math.exp(v) for v in row] for row in table] for table in edges]

    def marginals(self, page: Page) -> list[float]:
        """P(node holds main text) by messages from the leaves to the top and back."""
        w, e, tags, parent, exp, log = self._w, self._e, page.tags, page.parent, math.exp, math.log
        up = [max(-TOP, min(TOP, sum(map(w.__getitem__, f)))) for f in features(page)]  # log odds without the parent
        sent = [0.0] * len(up)
        for k in range(len(up) - 1, 0, -1):
            t, odds = e[kind(tags[k])], exp(max(-2 * TOP, min(2 * TOP, up[k])))
            sent[k] = log((t[1][0] + t[1][1] * odds) / (t[0][0] + t[0][1] * odds))
            up[parent[k]] += sent[k]
        both = up
        for k in range(1, len(up)):
            t, odds = e[kind(tags[k])], exp(max(-2 * TOP, min(2 * TOP, both[parent[k]] - sent[k])))
            both[k] += log((t[0][1] + t[1][1] * odds) / (t[0][0] + t[1][0] * odds))
        return [1 / (1 + exp(-max(-50.0, min(50.0, x)))) for x in both]

    def extract(self, source: str) -> str:
        page = Page(source)
        return page.text([p >= 0.5 and t not in UNSEEN for p, t in zip(self.marginals(page), page.tags)])


# ---------------------------------------------------------------- labelled pages

# Names that page authors give to parts of a page.
CONTENT_NAMES = "content main article post entry story body text page-content article-body post-content entry-content main-content story-body prose markdown".split()
MENU_NAMES = "nav menu navbar navigation topnav breadcrumbs breadcrumb site-nav main-menu tabs pagination pager toc links".split()
HEAD_NAMES = "header site-header masthead banner top topbar logo brand page-header".split()
FOOT_NAMES = "footer site-footer foot bottom copyright legal colophon credits imprint page-footer".split()
SIDE_NAMES = "sidebar side aside widget related rail secondary recommended popular trending more-stories see-also tags share social share-bar".split()
NOTICE_NAMES = "notice cookie cookie-banner consent gdpr alert warning popup modal overlay newsletter subscribe signup paywall banner-notice disclaimer announcement toast".split()
AD_NAMES = "ad ads advert advertisement sponsored sponsor promo promotion ad-slot banner-ad adsense commercial".split()
COMMENT_NAMES = "comments comment comment-list discussion replies reply responses disqus reader-comments respond comment-body feedback".split()
FORM_NAMES = "form search login search-form contact-form poll survey".split()
PLAIN_NAMES = "container wrapper row col inner outer section block box group layout grid site page wrap".split()


class _Maker:
    """Writes one random page with the label of every element, in document order."""

    def __init__(self, rng: random.Random):
        self.rng, self.out, self.labels = rng, [], []

    def words(self, low: int, high: int) -> str:
        rng = self.rng
        return " ".join("".join(rng.choice("aeiou") + rng.choice("bcdfglmnprst") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, max(low, high)))).capitalize() + "."

    def element(self, tag: str, label: int, inside, name: str = "") -> None:
        attr = f' {self.rng.choice(["class", "class", "id"])}="{name}"' if name else ""
        self.out.append(f"<{tag}{attr}>")
        self.labels.append(label)
        inside() if callable(inside) else self.out.append(inside)
        self.out.append(f"</{tag}>")

    def name(self, names: list[str], often: float = 0.85) -> str:
        rng = self.rng
        return "" if rng.random() > often else " ".join(rng.sample(names, 1) + rng.sample(PLAIN_NAMES, rng.random() < 0.3))

    def link_list(self) -> None:
        rng = self.rng

        def items() -> None:
            for _ in range(rng.randint(2, 9)):
                if listed:
                    self.element("li", 0, lambda: self.element("a", 0, self.words(1, 3)))
                else:
                    self.element("a", 0, self.words(1, 3))

        listed = rng.random() < 0.7
        self.element("ul" if listed else "div", 0, items)

    def sentence(self, label: int, low: int = 3, high: int = 60) -> None:
        """Text that at times has links or stressed words in it, or a tag left open."""
        rng = self.rng
        self.out.append(self.words(low, high))
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            self.out.append(" ")
            self.element(rng.choice(["a", "b", "em", "strong", "i", "span", "code"]), label, self.words(1, 5 if rng.random() < 0.8 else 40))
            self.out.append(" " + self.words(2, 30))

    def paragraphs(self, label: int, low: int, high: int) -> None:
        rng = self.rng
        for _ in range(rng.randint(low, high)):
            self.element("p", label, lambda: self.sentence(label, rng.choice([1, 3, 8]), rng.choice([2, 10, 40, 90])))

    def bold_all(self) -> None:
        """A paragraph that is stressed as a whole, followed by a break."""

        def inside() -> None:
            self.element("b", 1, lambda: (self.out.append(self.words(1, 40)), self.labels.append(1), self.out.append("<br>")))

        self.element("p", 1, inside)

    def clutter(self, where: str = "") -> None:
        rng = self.rng
        which = where or rng.choice(["menu", "side", "notice", "ad", "form", "share", "comments", "code"])
        if which == "menu":
            self.element(rng.choice(["nav", "nav", "div", "ul"]), 0, self.link_list, self.name(MENU_NAMES))
        elif which == "head":
            self.element(rng.choice(["header", "header", "div"]), 0, lambda: (self.element(rng.choice(["h1", "div", "p", "span", "a"]), 0, self.words(1, 5)), self.link_list() if rng.random() < 0.5 else None), self.name(HEAD_NAMES, 0.9))
        elif which == "foot":
            self.element(rng.choice(["footer", "footer", "div"]), 0, lambda: (self.out.append(rng.choice(["&copy; ", ""]) + self.words(2, 12)), self.link_list() if rng.random() < 0.5 else None, self.paragraphs(0, 0, 2)), self.name(FOOT_NAMES, 0.9))
        elif which == "side":
            self.element(rng.choice(["aside", "aside", "div", "section"]), 0, lambda: (self.element(rng.choice(["h2", "h3", "h4"]), 0, self.words(1, 4)), self.paragraphs(0, 0, 3), self.link_list() if rng.random() < 0.8 else None), self.name(SIDE_NAMES, 1.0))
        elif which == "notice":
            self.element(rng.choice(["div", "div", "section", "p", "aside", "dialog"]), 0, lambda: (self.out.append(self.words(3, 40)), self.element("button", 0, self.words(1, 2)) if rng.random() < 0.4 else None), self.name(NOTICE_NAMES, 1.0))
        elif which == "ad":
            self.element(rng.choice(["div", "div", "div", "section", "aside", "p", "ins"]), 0, lambda: self.sentence(0, 2, 40) if rng.random() < 0.7 else self.paragraphs(0, 1, 2), self.name(AD_NAMES, 1.0))
        elif which == "form":
            self.element("form", 0, lambda: (self.element("label", 0, self.words(1, 3)), self.element(rng.choice(["button", "p", "span", "div"]), 0, self.words(1, 8))), self.name(FORM_NAMES, 0.6))
        elif which == "share":
            self.element(rng.choice(["div", "ul", "p"]), 0, lambda: [self.element("a", 0, self.words(1, 2)) for _ in range(rng.randint(1, 4))], self.name(SIDE_NAMES, 1.0))
        elif which == "comments":

            def one() -> None:
                self.element(rng.choice(["div", "li", "article"]), 0, lambda: (self.element(rng.choice(["b", "span", "h4", "a", "cite"]), 0, self.words(1, 2)), self.paragraphs(0, 1, 2)), self.name(COMMENT_NAMES, 0.8))

            self.element(rng.choice(["section", "div", "ol", "ul"]), 0, lambda: (self.element("h3", 0, self.words(1, 2)) if rng.random() < 0.6 else None, [one() for _ in range(rng.randint(1, 4))]), self.name(COMMENT_NAMES, 1.0))
        else:
            self.element("script" if rng.random() < 0.6 else "style", 0, "var x=1;")

    def article(self) -> None:
        rng = self.rng
        if rng.random() < 0.85:
            title = lambda: self.element(rng.choice(["h1", "h1", "h2"]), 1, self.words(1, 14))
            self.element("header", 1, title) if rng.random() < 0.12 else title()
        if rng.random() < 0.3:
            self.bold_all()
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            what = rng.random()
            if what < 0.55:
                self.paragraphs(1, 1, 6)
            elif what < 0.62:
                self.element(rng.choice(["h2", "h3"]), 1, self.words(1, 8))
            elif what < 0.72:
                self.element(rng.choice(["ul", "ol"]), 1, lambda: [self.element("li", 1, lambda: self.sentence(1, 1, 20)) for _ in range(rng.randint(1, 5))])
            elif what < 0.78:
                self.element("blockquote", 1, lambda: self.paragraphs(1, 1, 2))
            elif what < 0.83:
                row = lambda cell: self.element("tr", 1, lambda: [self.element(cell, 1, self.words(1, 4)) for _ in range(3)])
                self.element("table", 1, lambda: (row("th"), [row("td") for _ in range(rng.randint(1, 4))]))
            elif what < 0.87:
                self.element(rng.choice(["pre", "figure"]), 1, lambda: self.element(rng.choice(["figcaption", "code", "span"]), 1, self.words(2, 20)))
            elif what < 0.92:
                self.element(rng.choice(["section", "div"]), 1, lambda: self.paragraphs(1, 1, 3))
            else:
                self.clutter(rng.choice(["ad", "share", "side", "notice", "comments", "menu", "form", "code"]))
        if rng.random() < 0.5:
            self.paragraphs(1, 1, 8)

    def page(self) -> tuple[str, list[int]]:
        rng = self.rng
        if rng.random() < 0.03:
            self.paragraphs(1, 1, 5)
            return "".join(self.out), [1, *self.labels]

        def middle() -> None:
            tag = rng.choice(["article", "article", "article", "main", "div", "section"])
            inside = self.article if rng.random() < 0.8 else lambda: self.element(rng.choice(["article", "div"]), 1, self.article, self.name(CONTENT_NAMES, 0.6))
            self.element(tag, 1, inside, self.name(CONTENT_NAMES, 0.3 if tag in ("article", "main") else 1.0))

        def body() -> None:
            for kind_, often in (("menu", 0.7), ("head", 0.45), ("ad", 0.35), ("notice", 0.25), ("form", 0.15)):
                if rng.random() < often:
                    self.clutter(kind_)
            where = rng.random()
            if where < 0.06:  # an old page: its text stands in the body itself
                self.article()
            elif where < 0.4:
                self.element("div", 1, lambda: ([self.clutter() for _ in range(rng.randint(0, 1))], middle(), [self.clutter() for _ in range(rng.randint(0, 2))]), self.name(PLAIN_NAMES, 0.8))
            else:
                middle()
            for kind_, often in (("side", 0.35), ("comments", 0.3), ("notice", 0.15), ("ad", 0.2), ("foot", 0.8), ("code", 0.3)):
                if rng.random() < often:
                    self.clutter(kind_)

        def head() -> None:
            self.element("title", 0, self.words(1, 9))
            self.element("style", 0, "p{margin:0}")

        def whole() -> None:
            if rng.random() < 0.9:
                self.element("head", 0, head)
            self.element("body", 1, body)

        self.element("html", 1, whole)
        return "".join(self.out), [1, *self.labels]


def labelled_pages(n: int, seed: int) -> list[tuple[str, list[int]]]:
    """(html, label of each element in document order, the page itself first)."""
    rng = random.Random(seed)
    return [_Maker(rng).page() for _ in range(n)]


# ---------------------------------------------------------------- training


def fit(pages: list[tuple[str, list[int]]], rounds: int = 120, rate: float = 0.15, shrink: float = 1e-4) -> Model:
    """Maximum likelihood by gradient ascent (Adam); messages go through all pages at once, level by level."""
    slots, owner, label, parent, level, kinds = [], [], [], [], [], []
    for source, labels in pages:
        page = Page(source)
        if len(page.tags) != len(labels):
            raise ValueError("a page's labels don't match its elements")
        base = len(label)
        for k, f in enumerate(features(page)):
            slots += f
            owner += [base + k] * len(f)
            label.append(labels[k])
            p = page.parent[k]
            parent.append(base + p if p >= 0 else -1)
            level.append(0 if p < 0 else level[base + p] + 1)
            kinds.append(kind(page.tags[k]))
    slots, owner, y, parent, level, kinds = map(np.array, (slots, owner, label, parent, level, kinds))
    levels = [np.flatnonzero(level == d) for d in range(level.max() + 1)]
    child = np.flatnonzero(parent >= 0)
    seen = np.zeros((KINDS, 2, 2))
    np.add.at(seen, (kinds[child], y[parent[child]], y[child]), 1)
    x, n = np.zeros(DIMENSIONS + KINDS * 4), len(y)
    first, second = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        w, e = x[:DIMENSIONS], x[DIMENSIONS:].reshape(KINDS, 2, 2)
        up = np.clip(np.bincount(owner, w[slots], n), -TOP, TOP)
        sent, t = np.zeros(n), np.exp(e)
        for nodes in levels[:0:-1]:
            k, odds = kinds[nodes], np.exp(np.clip(up[nodes], -2 * TOP, 2 * TOP))
            sent[nodes] = np.log((t[k, 1, 0] + t[k, 1, 1] * odds) / (t[k, 0, 0] + t[k, 0, 1] * odds))
            up += np.bincount(parent[nodes], sent[nodes], n)
        both, pair = up.copy(), np.zeros((KINDS, 2, 2))
        for nodes in levels[1:]:
            k = kinds[nodes]
            above = np.exp(np.clip(both[parent[nodes]] - sent[nodes], -2 * TOP, 2 * TOP))
            below = np.exp(np.clip(up[nodes], -2 * TOP, 2 * TOP))
            joint = t[k] * np.stack([np.ones_like(above), above], 1)[:, :, None] * np.stack([np.ones_like(below), below], 1)[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            np.add.at(pair, k, joint)
            both[nodes] += np.log((t[k, 0, 1] + t[k, 1, 1] * above) / (t[k, 0, 0] + t[k, 1, 0] * above))
        p = 1 / (1 + np.exp(-np.clip(both, -50, 50)))
        slope = np.concatenate([np.bincount(slots, (y - p)[owner], DIMENSIONS), (seen - pair).ravel()]) / n - shrink * x
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        x = x + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(x[:DIMENSIONS], x[DIMENSIONS:].reshape(KINDS, 2, 2))


@functools.lru_cache(maxsize=2)
def trained(n: int = 500, seed: int = 11) -> Model:
    return fit(labelled_pages(n, seed))


def extract_main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """The main text of every page, one row per input row: page_id, url, text, n_chars.

    ``model``: fitted weights; by default those of ``trained()``, fitted on the
    driver on 500 pages from the layout grammar (some 100 kB, sent with the
    function). A null or empty html gives an empty text; null ids and addresses
    stay null; repeated rows give repeated results; an empty table gives none;
    other columns are ignored; long pages are read whole. No shuffle.
    """
    fitted = model or trained()
    weights, edges = fitted.weights, fitted.edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights, edges)
        for batch in (s for b in batches for s in slices(b, 2)):
            texts = list(map(own.extract, batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    some = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_column(pages, "html").alias("html"))
    return some.mapInArrow(run, "page_id long, url string, text string, n_chars long")
