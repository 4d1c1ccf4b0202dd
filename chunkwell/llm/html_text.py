"""Main text of web pages by composite text density.

A tolerant parser builds the element tree in one pass over the page.  Each node has its characters C, tags T, link characters
LC and link tags LT; its composite density is ``C/T * log(C/LC * T/LT)`` to the base
``ln(C/nonLC * LC + LCb/Cb * C + e)``, where b is the body.  The density sum of a node adds up the
densities of its children; a run of text that stands in the node itself is a child without tags.  The node with the largest sum is selected; the smallest
density on its path to the body is the threshold.  An article or main element that holds the node is taken whole.  Elsewhere the body's
subtrees are walked as far as their density reaches the threshold (or they hold a good share of plain text), and the node with the largest sum in each is
taken, with the container of its paragraph.  Of what is taken, a block that is mostly links and below the threshold goes.

Elements that can't be article text (scripts, forms, menus, headers, footers, asides) are cut before the densities are
taken.  So are blocks whose class, id or role names an advert, a notice, a sidebar or comments; but where such words leave next to nothing
of a page's text, they are taken back.

Defined cases: null or empty html gives an empty text; unclosed, misnested and unknown tags are
taken as browsers do for paragraphs, list items and table parts; a quote without an end ends the reading of quotes on
that page, and a tag without an end is text, so a broken page of any length takes time in proportion to it; without a body the whole tree counts;
repeated rows give one row each; ids and urls may be null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

SCHEMA = "page_id long, url string, text string, n_chars long"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
CUT = frozenset("head script style noscript template iframe svg math canvas object audio video map nav header footer aside form button select option textarea input label fieldset dialog menu menuitem title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag on the left ends an open element on the right.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "option": {"option"}}
HOLDS = frozenset("ul ol dl table div section article main body td th blockquote aside header footer nav form figure details".split())
#: Elements inside which an end tag, a paragraph's end and an item's end look for their start.
WALLS = HOLDS - {"div", "section"}
STOPS = {k: HOLDS - v for k, v in ENDS.items()}
NOT_TEXT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notice\w*|popup|modal|overlay|newsletter|subscri\w*|paywall|alert|toast|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|aside|widget\w*|related|recommend\w*|share\w*|social\w*|comments?|commentlist|disqus|respond|replies|reply|discussion|footer\w*|foot|header|masthead|topbar|toolbar|pagination|pager|login|signup|search\w*|skip\w*)(?=$|[\s_-])",
    re.I,
)
#: Says what an element goes with or goes without, not what it is.
BESIDE = re.compile(r"\b(?:has|with|no|without|hide|show|is)[-_][\w-]*", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Share of link text that makes a block a list of links.
LINKED = 0.6
#: Blocks that are part of a container's text, not the container.
PARTS = frozenset("p li td span b i em strong blockquote pre h1 h2 h3 h4 h5 h6 tr tbody br a u small code #text".split())
CONTAINERS = frozenset("div section body td #root".split())
#: Share of the selected node's plain text that keeps a block whatever its density, and of a cut block's that kept text must have.
PLAIN, LEAST = 0.05, 0.1
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_BARE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("attrs", "best", "c", "cut", "density", "holds", "in_article", "items", "lc", "lt", "parent", "sum", "t", "tag")

    def __init__(self, tag: str, parent=None, attrs: str = ""):
        self.tag, self.parent, self.attrs, self.items = tag, parent, attrs, []
        self.c = self.t = self.lc = self.lt = 0
        self.density = self.sum = 0.0
        self.best = self  # the node with the largest sum in the subtree
        self.cut = self.holds = False  # holds: an article or main element lies below
        self.in_article = parent is not None and (parent.in_article or parent.tag == "article")


class Open:
    """The elements that are open, and where those of each tag stand."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], {}

    def push(self, n: Node) -> None:
        self.at.setdefault(n.tag, []).append(len(self.stack))
        self.stack.append(n)

    def close(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.at[self.stack.pop().tag].pop()

    def last(self, tags) -> int:
        """Depth of the innermost open element with one of the tags; 0 if there is none."""
        return max((d[-1] for t in tags if (d := self.at.get(t))), default=0)


def parse(page: str) -> Node:
    root = Node("#root")
    opened = Open(root)
    stack = opened.stack
    at, size, pattern = 0, len(page), _TAG
    while at < size:
        start = page.find("<", at)
        if start != at:
            stack[-1].items.append(page[at : start if start >= 0 else size])
        if start < 0:
            break
        mark = page[start + 1 : start + 2]
        if mark in ("!", "?") or mark == "/" and not page[start + 2 : start + 3].isalpha():  # comments, declarations
            if page.startswith("<!--", start) and not page.startswith(("<!-->", "<!--->"), start):
                end = page.find("-->", start + 4)
                at = end + 3 if end >= 0 else size
            else:
                end = page.find(">", start)
                at = end + 1 if end >= 0 else size
            continue
        if not mark.isalpha() and mark != "/":
            stack[-1].items.append("<")
            at = start + 1
            continue
        m = pattern.match(page, start)
        if not m and pattern is _TAG:  # a quote has no end: from here on quotes are plain characters
            pattern = _BARE
            m = pattern.match(page, start)
        if not m:
            if page.find(">", start) < 0:  # no tag has an end any more
                stack[-1].items.append(page[start:])
                break
            stack[-1].items.append("<")
            at = start + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:  # an end tag closes up to its element, if that is open
            depth = opened.last((tag,))
            if depth and (tag in HOLDS or tag == "html" or depth > opened.last(WALLS)):
                opened.close(depth)
            continue
        if tag in BLOCK:  # a block ends an open paragraph
            depth = opened.last(("p",))
            if depth and depth > opened.last(HOLDS) and depth > opened.last(("button",)):
                opened.close(depth)
        if tag in ENDS:
            depth = opened.last(ENDS[tag])
            if depth and depth > opened.last(STOPS[tag]):
                opened.close(depth)
        child = Node(tag, stack[-1], m[3])
        up = stack[-1] if tag in ("article", "main") else None
        while up is not None and not up.holds:
            up.holds, up = True, up.parent
        stack[-1].items.append(child)
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "math"):
            continue
        if tag in RAW:  # up to its end tag, all is its text
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            stop = page.find(">", end.end()) if end else -1
            child.items.append(page[at : end.start() if stop >= 0 else size])
            at = stop + 1 if stop >= 0 else size
            continue
        opened.push(child)
    return root


def impossible(n: Node) -> bool:
    """Elements that can't be article text, whatever the page says of them."""
    if n.tag in CUT:
        return n.tag != "header" or not n.in_article
    if n.attrs:
        for k, v in attributes(n):
            if k == "role" and v.lower() in ROLES or k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and re.search(r"display\s*+:\s*+none", v):
                return not n.holds and n.tag not in ("html", "body", "article", "main")
    return False


def named(n: Node) -> bool:
    """Whether class or id name an advert, a notice, a sidebar, comments or the like."""
    if not n.attrs or n.tag in ("html", "body", "article", "main") or n.holds:
        return False
    return any(k in ("class", "id") and (word := NOT_TEXT.search(BESIDE.sub(" ", v))) and not ("header" in word[0].lower() and n.in_article) for k, v in attributes(n))


def attributes(n: Node):
    for m in _ATTR.finditer(n.attrs):
        yield m[1].lower(), m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""


def measure(root: Node, words: bool) -> tuple[list[Node], int]:
    """Counts of every node from its leaves up, without recursion: parents before children, and the characters of the largest block
    that is cut for its name (0: the names have cut nothing)."""
    order, stack, lost = [], [root], 0
    while stack:
        n = stack.pop()
        n.c = n.t = n.lc = n.lt = 0
        order.append(n)
        for x in n.items:
            if isinstance(x, Node):
                x.cut = impossible(x)
                if not x.cut and words and named(x):
                    x.cut = True
                    lost = max(lost, sum(len(_SPACE.sub("", y)) for y in texts(x)))
                if not x.cut:
                    stack.append(x)
    for n in reversed(order):
        for x in n.items:
            if isinstance(x, str):
                n.c += len(_SPACE.sub("", x))
            elif not x.cut:
                n.c += x.c
                n.t += x.t + 1
                n.lc += x.lc
                n.lt += x.lt + (x.tag == "a")
        if n.tag == "a":
            n.lc = n.c
    return order, lost


def texts(n: Node):
    """The strings of a subtree, without those of elements that can't be text."""
    stack = [n]
    while stack:
        x = stack.pop()
        for y in x.items:
            if isinstance(y, str):
                yield y
            elif y.tag not in CUT:
                stack.append(y)


def density(c: int, t: int, lc: int, lt: int, share: float) -> float:
    """share: link characters of the body over all of its characters.  Counts of 0 that would divide are taken as 1."""
    if not c:
        return 0.0
    base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
    t, lc, lt = max(1, t), max(1, lc), max(1, lt)
    return c / t * max(0.0, math.log(c / lc * t / lt) / base)


def weigh(order: list[Node], body: Node) -> None:
    share = body.lc / body.c if body.c else 0.0
    for n in reversed(order):
        n.density, n.sum, n.best = density(n.c, n.t, n.lc, n.lt, share), 0.0, n
        best = None
        for x in n.items:
            if isinstance(x, str):
                n.sum += density(len(_SPACE.sub("", x)), 0, 0, 0, share)
            elif not x.cut:
                n.sum += x.density
                if best is None or x.best.sum > best.sum:
                    best = x.best
        if best is not None and best.sum > n.sum:  # ties go to the outer node
            n.best = best


def container(n: Node) -> Node:
    """The block that a paragraph's or an item's text belongs to."""
    while n.tag in PARTS and n.tag not in CONTAINERS and n.parent is not None:
        n = n.parent
    return n


def selected(root: Node, order: list[Node]) -> tuple[list[Node], float]:
    """The nodes that are taken, and the threshold of the path from the node with the largest density sum to the body."""
    body = next((n for n in order if n.tag == "body"), root)
    weigh(order, body)
    best = body.best
    threshold, up, whole = best.density, best, None
    while up is not None:
        if up.c:
            threshold = min(threshold, up.density)
        if up.tag in ("article", "main"):
            whole = up
        if up is body:
            break
        up = up.parent
    if whole is not None:
        return [whole], threshold
    plain, out, stack = best.c - best.lc, [], [body]
    while stack:
        n = stack.pop()
        own = n.c - n.lc
        if not n.c or n.density < threshold and not (own >= PLAIN * plain and n.lc <= LINKED * n.c):
            continue
        out.append(container(n.best))
        stack.extend(x for x in n.items if isinstance(x, Node) and not x.cut)
    return out, threshold


def blocks(root: Node, taken: list[Node]) -> list[str]:
    """Text of the blocks of the taken subtrees in page order; a block tag ends the block that stands before it."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append(text)

    inside = {id(n) for n in taken}
    stack: list = [(root, id(root) in inside)]
    while stack:
        x, here = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            if here:
                run.append(x)
        elif x.cut:
            continue
        elif x.tag in ("br", "wbr"):
            run.append(" " if x.tag == "br" else "")
        else:
            here = here or id(x) in inside
            if x.tag in BLOCK or id(x) in inside:
                flush()
                stack.append((None, here))
            stack.extend((y, here) for y in reversed(x.items))
    flush()
    return out


def text_of(root: Node, words: bool) -> tuple[str, int]:
    order, lost = measure(root, words)
    taken, threshold = selected(root, order)
    for n in taken:
        prune(n, threshold)
    return "\n".join(blocks(root, taken)), lost


def extract(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page.replace("\0", "\ufffd"))
    text, lost = text_of(root, True)
    if lost and len(_SPACE.sub("", text)) < LEAST * lost:  # the names have cut the text itself
        text, _ = text_of(root, False)
    return text


def prune(top: Node, threshold: float) -> None:
    """Cuts link lists: blocks of several links, mostly link text, less dense than the path to the body."""
    stack = [top]
    while stack:
        n = stack.pop()
        for x in n.items:
            if isinstance(x, Node) and not x.cut:
                x.cut = x.tag in BLOCK and x.lt > 1 and x.lc > LINKED * x.c and x.density < threshold
                stack.append(x)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    bounded_batches(pages.sparkSession)

    def run(batches):
        for b in batches:
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, SCHEMA)
