"""Main-text extraction by wrapper induction.

Pages of one host are DOM trees of block elements (inline elements belong to
the text of their block; furniture and elements without text are left out).
Trees are aligned by simple tree matching: nodes of equal label (element and
first class) match, siblings stay separate nodes, and the children of matched
nodes are matched in order so that most nodes match, equal texts counting
more. Siblings of one label match only if their own texts are equal; those
that find no partner fold into one starred node of their label, which takes
any number of nodes. Folding every page of a host
into one tree this way leaves, for each aligned node, whether its text is the
same on all pages (template) or varies (a slot), and how much text it holds; a
starred node also counts its texts, so a line that most pages repeat among
varying ones is template. The content of the host's pages is the region of
varying slots: the article or main element where there is one, else the
container that holds most varying text. A page is read by aligning it to its
host's tree. Furniture is known by element (nav, form, ...) or by class and
id words (menu, cookie, comments, ...).

Copies of a page are left out by a hash of its content.
Trees are folded per partition first, then per host and a salt, then per
host, as streams that hold one tree at a time: a host of any size is no
group. Every different page takes part. A repeated label has as many nodes of
its own as every page has, or two pages share word for word, and one starred
node, so trees do not grow with the pages. Wrappers join the pages by host;
they are broadcast only if they measure ``BROADCAST_BYTES`` at most.

Defined results: null and empty html give no text. A page that does not parse
cleanly is read as browsers do, roughly: unknown end tags are ignored, open
elements end with their parent. Parsing takes time in proportion to the page:
elements deeper than ``MAX_DEPTH`` hang on their ancestor at that depth, and
after ``BROKEN_TAGS`` tags with quotes left open, quotes no longer hide a
``>``. Trees of any size are matched by the one rule above: small ones pair by
pair, large ones by rows of comparisons in arrays, with the same pairs. A starred node counts ``STAR_TEXTS`` texts;
a line that is more than that fraction of its repeats is always counted.
Pages of a host whose text outside furniture is equal count as one. A constant
node is template, whatever its element, if it stands on most of the host's
different pages, from two on (four, if it stands among siblings of its label),
and something else varies; on a host whose pages
are all alike, everything outside furniture is content. An item of a list or
table that varies is content, constant or not. A null or odd url
belongs to the host with the empty name. Repeated pages give equal rows. An
empty table gives an empty result. Columns are taken by name."""

from __future__ import annotations

import html as html_module
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lagscope.llm.common import settle

#: Different pages that a template node stands on, at least.
MIN_PAGES = 2
#: The same for a text that stands among siblings of its label: two of three
#: pages easily share a line by chance.
MIN_PAGES_AMONG = 4
#: Share of the varying text that a container must hold to be gone into.
DENSE = 0.7
SALTS = 32
HOSTS_AT_ONCE = 1000
MAX_DEPTH = 64
BROKEN_TAGS = 100
#: Pairs of nodes up to which two trees are matched pair by pair; beyond it a
#: node meets all its partners in one array. The pairs found are the same.
SMALL = 1 << 12
#: What an equal text adds to the nodes that a pair matches.
SAME_TEXT = 3
STAR_TEXTS = 256
BROADCAST_BYTES = 8 << 20

# ---------------------------------------------------------------------------
# HTML elements by role, and words of class and id attributes
# that mark page furniture.
# ---------------------------------------------------------------------------
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q "
                   "s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
FURNITURE = frozenset("head title nav footer aside form script style noscript template iframe button select "
                      "textarea input dialog menu svg canvas object audio video figure-caption".split())
TEXT_BLOCKS = frozenset("p li h1 h2 h3 h4 h5 h6 pre blockquote dt dd figcaption".split())
ITEMS = frozenset("li dt dd thead tbody tfoot tr td th".split())
MAIN = ("article", "main")
CLOSED_BY = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr "
                   "main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option", "optgroup"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "head": frozenset(["head", "body"]),
}
SCOPES = frozenset("article aside body button div form li main nav section table td th ul ol".split())
HINTS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent "
                  "cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation "
                  "newsletter notice notices pager pagination popup promo promoted promotion related reply "
                  "replies respond share sharing sidebar signup skip social sponsor sponsored subscribe "
                  "subscription toolbar widget".split())
# ---------------------------------------------------------------------------
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
                    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>", re.S)
_PLAIN_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|(?!)()()()|<[!?][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HINT_WORD = re.compile(r"[a-z]+")


@lru_cache(4096)
def _label(tag: str, attributes: str) -> tuple[str, bool]:
    """(label, whether it is furniture) of an element. The label has the words
    of its first class, without digits, and no id: those often name the page."""
    words: list[str] = []
    label = tag
    for m in _ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        words += _hint_words(value)
        if m[1].lower() == "class" and label == tag:
            label = ".".join([tag, *_hint_words(value.split(None, 1)[0] if value.strip() else "")])
    return label, tag in FURNITURE or not HINTS.isdisjoint(words)


def _hint_words(value: str) -> list[str]:
    return _HINT_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())


class _Open(NamedTuple):
    """An open element: its block node (or that of the nearest block around an
    inline one), and what holds for all inside it."""
    tag: str
    block: bool
    node: int
    out: bool       # in furniture
    main: bool      # in an article or main element
    scope: int      # place of the nearest element that end tags do not cross
    stop: int       # place of the nearest element that a start tag may end


class Page:
    """Block nodes in document order: parents, labels, furniture marks and
    the pieces of text (node, text) in page order; a piece with node -1 is a
    block boundary."""

    def __init__(self, source: str | None):
        self.parent, self.label, self.out = [-1], ["#"], [False]
        self.pieces: list[tuple[int, str]] = []
        self._stack = [_Open("#", True, 0, False, False, 0, 0)]
        self._places: dict[str, list[int]] = {}   # of the open elements by tag
        if source:
            self._read(source)

    def _read(self, source: str) -> None:
        stack, at, n, broken, token = self._stack, 0, len(source), 0, _TOKEN
        last = source.rfind(">")   # behind it only a comment can begin
        while at < n:
            if at > last:
                end = source.find("<!--", at)
                self._text(source[at:end if end >= 0 else n])
                return
            m = token.search(source, at)
            if m is None:
                self._text(source[at:])
                return
            if m.start() > at:
                self._text(source[at:m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[5] and token is _TOKEN:
                broken += 1
                if broken > BROKEN_TAGS:
                    token = _PLAIN_TOKEN
            if m[1] or m[4]:
                self._close(tag)
            else:
                self._start(tag, m[3] or m[6] or "")
                if tag in RAW:
                    end = re.compile(rf"</{tag}\b", re.I).search(source, at)
                    if tag in ("title", "textarea"):
                        self._text(source[at:end.start() if end else n])
                    self._close(tag)
                    after = source.find(">", end.end()) if end else -1
                    at = after + 1 if after >= 0 else n

    def _text(self, text: str) -> None:
        self.pieces.append((self._stack[-1].node, text))

    def _break(self) -> None:
        self.pieces.append((-1, " "))

    def _cut(self, k: int) -> None:
        """End the open elements from place k on."""
        for e in self._stack[k:]:
            self._places[e.tag].pop()
        del self._stack[k:]

    def _start(self, tag: str, attributes: str) -> None:
        stack = self._stack
        k = stack[-1].stop
        while k > 0:
            if tag in CLOSED_BY.get(stack[k].tag, ()):
                self._cut(k)
                break
            if stack[k].tag in SCOPES:
                break
            k = stack[k - 1].stop
        if tag == "br":
            self._break()
        label, furniture = _label(tag, attributes)
        # an inline element that is furniture is a block of its own
        block = tag not in INLINE or furniture
        if tag not in INLINE:
            self._break()
        if tag in VOID:
            return
        top, place = stack[-1], len(stack)
        node, out = top.node, top.out
        if block:
            out = out or furniture or (tag == "header" and not top.main)
            node = len(self.parent)
            self.parent.append(top.node if place <= MAX_DEPTH else stack[MAX_DEPTH - 1].node)
            self.label.append(label)
            self.out.append(out)
        stack.append(_Open(tag, block, node, out, top.main or tag in MAIN,
                           place if tag in SCOPES else top.scope,
                           place if tag in SCOPES or tag in CLOSED_BY else top.stop))
        self._places.setdefault(tag, []).append(place)

    def _close(self, tag: str) -> None:
        places = self._places.get(tag)
        if not places or (tag in INLINE and self._stack[-1].scope > places[-1]):
            return
        k = places[-1]
        if any(e.tag not in INLINE for e in self._stack[k:]):
            self._break()
        self._cut(k)


# A tree node is [label, mark, pages, text hash or None (varies), characters, children];
# a starred node has a seventh entry, the pages of its commonest texts. Marks are set in
# wrappers only.
Tree = list
TEMPLATE, REGION = 1, 2


def tree_of(page: Page, numbered: bool = False) -> Tree:
    """The page's tree, without furniture and elements that hold no text; with
    ``numbered`` the third entry is the page's node."""
    texts: list[list[str]] = [[] for _ in page.parent]
    for node, text in page.pieces:
        if node >= 0 and not text.isspace():
            texts[node].append(text.strip())
    nodes: list[Tree] = []
    for k, found in enumerate(texts):
        text = "" if page.out[k] else " ".join(found)
        nodes.append([page.label[k], 0, k if numbered else 1,
                      xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) if text else 0, len(text), []])
    for k in range(len(nodes) - 1, 0, -1):   # children come after their parent
        if not page.out[k] and (nodes[k][4] or nodes[k][5]):
            nodes[k][5].reverse()
            nodes[page.parent[k]][5].append(nodes[k])
    nodes[0][5].reverse()
    return nodes[0]


class _Shape:
    """What matching sees of a node; equal shapes of a work are one object.
    ``text`` numbers the texts, 0 for none and -1 if it varies; ``own`` is the
    weight of the node with itself, which no other partner passes."""
    __slots__ = ("label", "text", "kids", "repeated", "own")

    def __init__(self, label: str, text: int, kids: tuple[_Shape, ...], repeated: frozenset[str]):
        self.label, self.text, self.kids, self.repeated = label, text, kids, repeated
        self.own = 1 + (SAME_TEXT if text > 0 else 0) + sum(c.own for c in kids if self.pairs_with_itself(c))

    def pairs_with_itself(self, c: _Shape) -> bool:
        return c.text >= 0 or c.label not in self.repeated

    def behind(self, k: int) -> _Shape:
        return _Shape(self.label, self.text, self.kids[k:], self.repeated)


class _Work:
    """What is known of the nodes of two trees and of their pairs."""

    def __init__(self):
        self.pairs: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
        self.sizes: dict[int, int] = {}
        self.shapes: dict[int, _Shape] = {}
        self._texts: dict[int, int] = {0: 0}
        self._known: dict[tuple, _Shape] = {}

    def size(self, node: Tree) -> int:
        n = self.sizes.get(id(node))
        if n is None:
            self.sizes[id(node)] = n = 1 + sum([self.size(x) for x in node[5]])
        return n

    def shape(self, node: Tree) -> _Shape:
        shape = self.shapes.get(id(node))
        if shape is None:
            kids, stars = tuple([self.shape(x) for x in node[5] if len(x) == 6]), frozenset(_stars(node))
            text = -1 if node[3] is None else self._texts.setdefault(node[3], len(self._texts))
            key = node[0], text, kids, stars
            shape = self._known.get(key)
            if shape is None:
                again = {k for k, n in Counter(c.label for c in kids).items() if n > 1}
                shape = self._known[key] = _Shape(node[0], text, kids, stars | again)
            self.shapes[id(node)] = shape
        return shape


class _Many:
    """Nodes that one node meets at once. Their children lie in one row of
    cells: each node's backwards, behind a cell that stands for none of them."""

    def __init__(self, nodes: list[_Shape]):
        lengths = np.array([1 + len(s.kids) for s in nodes])
        self.text = np.array([s.text for s in nodes])
        self.first = np.cumsum(lengths) - 1      # a node's first child
        self.node = np.repeat(np.arange(len(nodes)), lengths)
        self._places: dict[str, list[tuple[int, bool, _Shape]]] = {}
        for s, last in zip(nodes, (self.first - lengths + 2).tolist()):
            for k, c in enumerate(reversed(s.kids), last):
                self._places.setdefault(c.label, []).append((k, c.label in s.repeated, c))
        self._labels: dict[str, tuple] = {}
        self._last: tuple | None = None

    def _of(self, label: str) -> tuple:
        """Cells of a label, whether the label is repeated there, the texts,
        and the different nodes with the place of each cell's among them."""
        if label not in self._labels:
            cells, again, nodes = zip(*self._places[label])
            kinds = {c: i for i, c in enumerate(dict.fromkeys(nodes))}
            self._labels[label] = (np.array(cells), np.array(again), np.array([c.text for c in nodes]),
                                   _Many(list(kinds)), np.array([kinds[c] for c in nodes]))
        return self._labels[label]

    def partners(self, c: _Shape, repeated: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """Cells that a child may pair with, and what each pair weighs."""
        if c.label not in self._places:
            return None
        if self._last and self._last[0] is c and self._last[1] == repeated:
            return self._last[2]
        cells, again, texts, kinds, kind = self._of(c.label)
        may = (texts == c.text) & (c.text >= 0)
        if not repeated:
            may |= ~again
        found = (cells[may], _weights(c, kinds)[kind[may]]) if may.any() else None
        self._last = c, repeated, found
        return found


def _row(below: np.ndarray, found: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """The heaviest pairs from each cell on, one more child taken in."""
    if found is None:
        return below
    cells, weights = found
    row = below.copy()
    row[cells] = np.maximum(row[cells], below[cells - 1] + weights)
    return np.maximum.accumulate(row, out=row)


def _weights(x: _Shape, many: _Many) -> np.ndarray:
    """The weight of a node with each of many of its label."""
    start = many.node * (x.own + 1)   # no node's weights reach the next one's
    row = start
    for c in reversed(x.kids):
        row = _row(row, many.partners(c, c.label in x.repeated))
    return 1 + SAME_TEXT * ((many.text == x.text) & (x.text > 0)) + (row - start)[many.first]


def _match_large(x: _Shape, y: _Shape) -> tuple[int, list[tuple[int, int]]]:
    """As ``_match``, in memory for the square root of the comparisons' rows."""
    own = 1 + (SAME_TEXT if x.text > 0 and x.text == y.text else 0)
    k, repeated = 0, x.repeated | y.repeated
    for c, d in zip(x.kids, y.kids):   # equal first children weigh most together
        if c is not d or (c.text < 0 and c.label in repeated):
            break
        own, k = own + c.own, k + 1
    pairs = [(i, i) for i in range(k)]
    x, many, n, m = x.behind(k), _Many([y.behind(k)]), len(x.kids) - k, len(y.kids) - k
    step = isqrt(n) + 1

    def found(i: int) -> tuple[np.ndarray, np.ndarray] | None:
        return many.partners(x.kids[i], x.kids[i].label in x.repeated)

    nothing = np.zeros(m + 1, np.int64)
    row, stored = nothing, {}
    for i in range(n - 1, -1, -1) if m else ():
        row = _row(row, found(i))
        if i % step == 0:
            stored[i] = row
    rows: dict[int, np.ndarray] = {}
    i = j = 0
    while i < n and j < m:
        if i not in rows or i + 1 not in rows:
            low, top = i - i % step, min(n, i - i % step + step)
            rows, partners = {top: stored.get(top, nothing)}, {}
            for r in range(top - 1, low - 1, -1):
                partners[r] = found(r)
                rows[r] = _row(rows[r + 1], partners[r])
        here, below, cell = rows[i], rows[i + 1], m - j
        if partners[i] is not None:
            cells, weights = partners[i]
            at = np.searchsorted(cells, cell)
            if at < len(cells) and cells[at] == cell and here[cell] == below[cell - 1] + weights[at]:
                pairs.append((k + i, k + j))
                i, j = i + 1, j + 1
                continue
        if here[cell] == below[cell]:
            i += 1
        else:
            j += 1
    return own + int(row[m]), pairs


def _fixed(node: Tree) -> list[Tree]:
    return [x for x in node[5] if len(x) == 6]


def _stars(node: Tree) -> dict[str, Tree]:
    return {x[0]: x for x in node[5] if len(x) == 7}


def _match(x: Tree, y: Tree, work: _Work) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two nodes of equal label: the weight of the
    pair, and the pairs of their children, in order, that weigh most. Children
    of a label that is repeated or starred pair with equal texts only."""
    if (id(x), id(y)) in work.pairs:
        return work.pairs[id(x), id(y)]
    a, b = _fixed(x), _fixed(y)
    stars = _stars(x).keys() | _stars(y).keys()
    times, others = Counter(c[0] for c in a), Counter(c[0] for c in b)
    repeated = stars | {k for c in (times, others) for k, n in c.items() if n > 1}
    left, right = ([(c[0], c[3]) if c[0] in repeated else (c[0],) for c in side] for side in (a, b))
    pairs: list[tuple[int, int]] = []
    if left == right and not repeated:
        pairs = [(i, i) for i in range(len(a))]
    elif not a or not b:
        pass
    elif work.size(x) * work.size(y) > SMALL:
        found = work.pairs[id(x), id(y)] = _match_large(work.shape(x), work.shape(y))
        return found
    else:
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        gain = {}
        for i in range(len(a) - 1, -1, -1):
            row, below = best[i], best[i + 1]
            for j in range(len(b) - 1, -1, -1):
                most = max(below[j], row[j + 1])
                if left[i] == right[j] and left[i][-1] is not None:
                    gain[i, j] = _match(a[i], b[j], work)[0]
                    most = max(most, below[j + 1] + gain[i, j])
                row[j] = most
        i = j = 0
        while i < len(a) and j < len(b):
            if (i, j) in gain and best[i][j] == best[i + 1][j + 1] + gain[i, j]:
                pairs.append((i, j))
                i, j = i + 1, j + 1
            elif best[i][j] == best[i + 1][j]:
                i += 1
            else:
                j += 1
    weight = 1 + (SAME_TEXT if x[3] and x[3] == y[3] else 0) + sum(_match(a[i], b[j], work)[0] for i, j in pairs)
    work.pairs[id(x), id(y)] = weight, pairs
    return weight, pairs


def matching(a: Tree, b: Tree) -> int:
    """The weight of two trees: matching nodes, and more for equal texts."""
    return _match(a, b, _Work())[0] if a[0] == b[0] else 0


def _counted(a: dict[str, int], b: dict[str, int]) -> dict[str, int]:
    """Sums of two counts, kept to the commonest texts as Misra and Gries do."""
    both = dict(a)
    for text, n in b.items():
        both[text] = both.get(text, 0) + n
    if len(both) > STAR_TEXTS:
        less = sorted(both.values())[-STAR_TEXTS - 1]
        both = {text: n - less for text, n in both.items() if n > less}
    return both


def _texts(node: Tree) -> dict[str, int]:
    return node[6] if len(node) == 7 else {str(node[3]): node[2]} if node[3] else {}


def align(a: Tree, b: Tree, work: _Work | None = None) -> Tree:
    """The tree of all nodes of two trees of equal label, matched ones once. A
    label that is left once on either side is matched all the same; one that
    stands repeatedly goes into the starred node of its label, but for texts
    that two pages share."""
    if not a[5] and not b[5]:
        return [a[0], 0, a[2] + b[2], a[3] if a[3] == b[3] else None, a[4] + b[4], []]
    work = work or _Work()
    left, right, stars, more = _fixed(a), _fixed(b), _stars(a), _stars(b)
    pairs = dict(_match(a, b, work)[1])
    taken = set(pairs.values())
    single = [x for i, x in enumerate(left) if i not in pairs]
    other = [x for j, x in enumerate(right) if j not in taken]
    times, others = Counter(x[0] for x in left), Counter(x[0] for x in right)
    starred = {x[0] for x in single + other if max(times[x[0]], others[x[0]]) > 1} | stars.keys() | more.keys()

    def stays(x: Tree, pages: int) -> bool:
        return x[0] not in starred or bool(x[3] and x[2] > 1 and 2 * x[2] > pages)

    late = {x[0] for x in single} - starred   # these meet their partners out of order
    rest = {x[0]: x for x in other if x[0] in late}
    children, after = [], 0
    for i, x in enumerate([*left, None]):
        upto = len(right) if x is None else pairs.get(i, after)
        children += [y for j, y in enumerate(right[after:upto], after)
                     if j not in taken and y[0] not in late and stays(y, b[2])]
        after = max(after, upto)
        if i in pairs:
            children.append(align(x, right[pairs[i]], work))
            after += 1
        elif x is not None and x[0] in rest:
            children.append(align(x, rest.pop(x[0]), work))
        elif x is not None and stays(x, a[2]):
            children.append(x)
    for loose in ([x for x in single if not stays(x, a[2])],
                  [y for y in other if not stays(y, b[2])] + list(more.values())):
        texts: dict[str, dict[str, int]] = {}
        for x in loose:
            # a text that one side repeats is counted once
            most = texts.setdefault(x[0], {})
            for text, n in _texts(x).items():
                most[text] = max(n, most.get(text, 0))
            star = stars.get(x[0])
            stars[x[0]] = ([*x[:6], {}] if star is None
                           else [*align(star[:6], x[:6], _Work()), star[6]])
        for label, found in texts.items():
            stars[label][6] = _counted(stars[label][6], found)
    children += [stars[k] for k in sorted(stars)]
    return [a[0], 0, a[2] + b[2], a[3] if a[3] == b[3] else None, a[4] + b[4], children]


def content_hash(page: Page) -> str:
    """Hash of the page's text outside furniture."""
    text = "".join(t if node < 0 or not page.out[node] else " " for node, t in page.pieces)
    return xxhash.xxh3_128_hexdigest(" ".join(text.split()).encode("utf-8", "surrogatepass"))


def _slots(node: Tree) -> int:
    """Characters of content in the tree."""
    return (0 if node[1] & TEMPLATE else node[4]) + sum(map(_slots, node[5]))


def _varies(node: Tree) -> bool:
    return node[3] is None or any(map(_varies, node[5]))


def _marked(node: Tree, pages: float, within: bool = False, among: bool = False) -> Tree:
    """The tree with template nodes marked: constant, and on most of the pages
    (a starred node keeps only such texts). An item ``within`` a list or table
    that varies is part of it, constant or not."""
    varies = _varies(node)
    least = max(MIN_PAGES_AMONG if among else MIN_PAGES, pages / 2 + 0.5)
    item = within and node[0].split(".")[0] in ITEMS
    labels = Counter(x[0] for x in node[5])
    out = [node[0], TEMPLATE if node[3] and node[2] >= least and not item and len(node) == 6 else 0, *node[2:5],
           [_marked(x, pages, varies, labels[x[0]] > 1 or len(x) == 7) for x in node[5]]]
    if len(node) == 7:
        out.append({} if item else {t: n for t, n in node[6].items() if n >= least})
    return out


def wrapper_of(tree: Tree) -> Tree:
    """The tree with marks: ``REGION`` for the roots of the content,
    ``TEMPLATE`` for constant nodes; a starred node lists its template texts."""
    tree = _marked(tree, tree[2] if _varies(tree) else float("inf"))

    def mains(node: Tree) -> list[Tree]:
        inner = [p for x in node[5] for p in mains(x)]
        tag = node[0].split(".")[0]
        if tag in MAIN and _slots(node):
            return inner if tag == "main" and inner else [node]
        return inner

    regions = mains(tree)
    if not regions:
        node = tree
        while True:
            total, labels = _slots(node), [x[0] for x in node[5]]
            dense = [x for x in node[5] if total and labels.count(x[0]) == 1 and len(x) == 6
                     and x[0].split(".")[0] not in TEXT_BLOCKS and _slots(x) >= DENSE * total]
            if not dense:
                break
            node = dense[0]
        regions = [node]
    for node in regions:
        node[1] |= REGION
    return tree


@lru_cache(256)
def _read(wrapper: str) -> Tree:
    return json.loads(wrapper)


def main_text(source: str | None, wrapper: str) -> str:
    """The page's text in the wrapper's slots."""
    page = Page(source)
    inside, keep = [False] * len(page.parent), [False] * len(page.parent)
    work = _Work()

    def read(node: Tree, slot: Tree | None, within: bool) -> None:
        k = node[2]
        inside[k] = within = within or bool(slot and slot[1] & REGION)
        known = slot is not None and ((slot[1] & TEMPLATE and slot[3] == node[3])
                                      or (len(slot) == 7 and str(node[3]) in slot[6]))
        keep[k] = within and not known
        if slot is None:
            for x in node[5]:
                read(x, None, within)
            return
        fixed, stars = _fixed(slot), _stars(slot)
        pairs = {j: i for i, j in _match(slot, node, work)[1]}
        used = set(pairs.values())
        spare = {x[0]: x for i, x in enumerate(fixed) if i not in used}
        for j, x in enumerate(node[5]):
            read(x, fixed[pairs[j]] if j in pairs else stars.get(x[0]) or spare.get(x[0]), within)

    read(tree_of(page, True), _read(wrapper), False)
    if not any(inside):   # a page unlike its host's others
        keep = [not out for out in page.out]
    text = "".join(t if node < 0 or keep[node] else " " for node, t in page.pieces)
    return " ".join(html_module.unescape(text).split())


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1),
                      F.lit(""))


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(host, wrapper)``: a wrapper, as JSON, from all pages of each host."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            read = [Page(source) for source in b["html"]]
            yield pd.DataFrame({"host": b["host"], "page": [content_hash(p) for p in read],
                                "tree": [json.dumps(tree_of(p)) for p in read]})

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees: dict[str, Tree] = {}
        for b in batches:
            for host, tree in zip(b["host"], map(json.loads, b["tree"])):
                trees[host] = align(trees[host], tree) if host in trees else tree
                if len(trees) > HOSTS_AT_ONCE:
                    yield out(trees)
                    trees = {}
        yield out(trees)

    def out(trees: dict[str, Tree]) -> pd.DataFrame:
        return pd.DataFrame([(h, json.dumps(t)) for h, t in trees.items()], columns=["host", "tree"])

    def merge(final: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, tree = None, None
            for b in batches:
                done = []
                for host, part in zip(b["host"], b["tree"]):
                    part = json.loads(part)
                    if host == now:
                        tree = align(tree, part)
                        continue
                    if tree is not None:
                        done.append((now, json.dumps(wrapper_of(tree) if final else tree)))
                    now, tree = host, part
                yield pd.DataFrame(done, columns=["host", "tree"])
            if tree is not None:
                yield pd.DataFrame([(now, json.dumps(wrapper_of(tree) if final else tree))],
                                   columns=["host", "tree"])
        return run

    schema = "host string, tree string"
    grown = (pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
             .where(F.length("html") > 0).mapInPandas(parse, "host string, page string, tree string")
             .groupBy("host", "page").agg(F.min("tree").alias("tree")).select("host", "tree")
             .mapInPandas(grow, schema))
    salted = (grown.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).repartition("host", "salt")
              .sortWithinPartitions("host", "tree").select("host", "tree").mapInPandas(merge(False), schema))
    return (salted.repartition("host").sortWithinPartitions("host", "tree").mapInPandas(merge(True), schema)
            .withColumnRenamed("tree", "wrapper"))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(id, url, text)`` of every page."""
    found = settle(wrappers(pages, url, html).select(F.col("host").alias("of"), "wrapper"))
    size = found.agg(F.sum(F.length("of") + F.length("wrapper") + 32)).first()[0] or 0
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url).alias("url"), F.col(html).alias("html"),
                        host_of(F.col(url)).alias("host"))
    joined = rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, F.col("host") == F.col("of"), "left")

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "url": b["url"], "text": [
                main_text(h, w) if h and w else "" for h, w in zip(b["html"], b["wrapper"])]})

    return (joined.select("id", "url", "html", "wrapper").mapInPandas(texts, "id string, url string, text string")
            .withColumn("id", F.col("id").cast(dict(pages.dtypes)[id_col])))


def op3(pages: DataFrame) -> DataFrame:
    return extract(pages).select(F.col("id").alias("page_id"), "url", "text",
                                 F.length("text").cast("bigint").alias("n_chars"))
