"""Main text of web pages by wrapper induction.

Each page becomes a tree of its block elements.  Runs of equal siblings are
folded, so that the pages of a site have few distinct shapes.  For each host
the commonest shape is the template tree, and every other shape of the host is
aligned with it by simple tree matching, once for each shape and not for each
page.  Counting what stands in the aligned nodes over all distinct pages of the
host tells constant nodes, which are template and go, from varying slots, which
are content.  Pages that differ in little beside what looks constant are near
copies and count as one page; an article's nodes are content even if constant.  Elements that name their role (nav, footer, ads, comments, ...)
and the region that is marked as the article are known without a wrapper.
"""

from __future__ import annotations

import html as html_entities
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtools import slices
from .shared import materialize

#: Share of a host's distinct pages that hold a constant node, and how many
#: pages there must be; inside a marked main both are stricter.
SHARE, SUPPORT = 0.6, 4
ARTICLE_SHARE, ARTICLE_SUPPORT = 0.8, 20
#: Pages whose constant nodes hold more than this share of the text are near copies.
NEAR_SHARE = 0.75
#: Wrappers (host, shape) with constants up to this many are broadcast.
BROADCAST_WRAPPERS = 50_000
SALTS = 32

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu "
    "nav ol optgroup option p pre search section select summary svg table tbody td tfoot th thead tr ul "
    "button head hr object audio video canvas math".split()
)
_HIDDEN = frozenset(
    "head nav footer aside form button select option dialog menu svg script style noscript template "
    "textarea iframe object audio video canvas fieldset search".split()
)
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"))
_HIDDEN_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)
#: Parts of class names and ids that name what is not the article.
_BOILER = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense adslot banner banners billboard breadcrumb "
    "breadcrumbs byline comment comments commentlist consent cookie cookies copyright discussion disqus "
    "dropdown footer footers gdpr hidden login masthead menu menus modal nav navbar navigation navi newsletter "
    "notice notices notification overlay pager pagination paywall popup popups promo promos promotion recommend "
    "recommendations recommended related replies reply respond rail share sharebar sharing sidebar sidebars "
    "signup skip skyscraper social sponsor sponsored subscribe subscription tags teaser toolbar topbar trending "
    "widget widgets".split()
)
#: These too, but not inside an article.
_BOILER_OUTSIDE = frozenset(("header", "headers", "head", "top", "meta"))
#: Of these names only those of comments are believed where an element holds most of a page's text.
_COMMENTS = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
#: These also tell a layout ("has-sidebar", "top"), so that a single block may be the text.
_LAYOUT = frozenset("sidebar sidebars header headers head top meta".split())
#: Parts of class names and ids of what may be the article where no element says so.
_CONTENT = frozenset("article content entry main post story".split())
#: Share of a page's visible text that such elements must hold; of the text in articles and
#: mains, what articles must hold to be preferred; marks with less than the rest aren't believed.
CONTENT_SHARE = 0.6
#: What the end of an element implies: an open tag closes these before it.
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"),
    "tfoot": ("tr", "td", "th", "tbody"), "body": ("head",),
}
_SCOPE = frozenset("ul ol dl table html body article section div main td th select menu".split())
#: As HTML's tokenizer reads it: a quote opens a value only right behind ``=``.  Where it is never
#: closed it is part of a name, and the tag ends at the next ``>``.
_PAIR = r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?+"""
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    rf"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{re.sub(r"\((?!\?)", "(?:", _PAIR)})*+)>|[^<]+|<""",
    re.S,
)
#: A tag whose last quote is closed behind all ``>``, or never.
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(_PAIR)
_NAME = re.compile(r"[a-z]+|[0-9]+")
_SPACES = re.compile(r"\s+")
_LETTER = re.compile("[a-zA-Z]")


class Node:
    """A block element; ``named`` are the words that hide it by name, if its contents don't speak against it."""

    __slots__ = ("tag", "label", "parent", "children", "depth", "hidden", "shape", "size", "index", "marked", "named", "inside")

    def __init__(
        self, tag: str, label: str, parent: Node | None, hidden: bool, marked: str = "",
        named: frozenset[str] | set[str] = frozenset(),
    ):
        self.tag, self.label, self.parent, self.hidden, self.marked = tag, label, parent, hidden, marked
        self.named = named
        self.children: list[Node] = []
        self.depth = parent.depth + 1 if parent else 0
        self.shape = self.size = self.index = 0
        self.inside = bool(marked) or parent is not None and parent.inside  # of a marked region


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), a or b or c)
    return out


def _names(attributes: dict[str, str]) -> set[str]:
    """The words in class and id; camelCase and hyphens part them."""
    text = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", text).lower()
    return set(_NAME.findall(text))


def _new(tag: str, text: str, parent: Node) -> Node:
    attributes = _attributes(text) if text.strip() else {}
    names = _names(attributes)
    inside = parent.inside
    role = attributes.get("role", "").lower()
    hidden = (
        parent.hidden or tag in _HIDDEN or role in _HIDDEN_ROLES or "hidden" in attributes
        or attributes.get("aria-hidden") == "true"
        or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")))
        or (tag == "article" and bool(names & {"comment", "comments", "teaser", "related", "promo", "ad", "ads", "sponsored", "reply"}))
        or (not inside and tag == "header")
    )
    named: set[str] = set()
    if not hidden and tag not in ("html", "body", "article", "main"):
        named = names & (_BOILER if inside else _BOILER | _BOILER_OUTSIDE)
    marked = "" if hidden else "article" if tag == "article" else "main" if tag == "main" or role == "main" else ""
    if not hidden and not marked and tag in ("div", "section", "td") and names & _CONTENT:
        marked = "content"
    first = next(iter(sorted(x for x in names if not x.isdigit())), "")
    return Node(tag, f"{tag}.{first}" if first else tag, parent, hidden, marked, named)


def _hide_named(root: Node, blocks: list[tuple[Node, str]]) -> list[tuple[Node, str]]:
    """Hides the elements that their names say aren't the article; the blocks that are left.

    A name is not believed where the element holds an article or main, unless
    the page has more text in others, nor where it holds most of the page's
    text, in several blocks unless it may be named after the layout.  An element named after comments, which often are
    most of the text, must hold the first heading too.  Inside of an article
    an article in it doesn't count: those are comments or cards.
    """
    texts: dict[Node, list[int]] = {}  # of a named element: characters, blocks, characters in articles
    total = articles = 0
    holds: set[Node] = set()
    for node, text in blocks:
        above = list(_above(node))
        outermost = next((i for i in range(len(above) - 1, -1, -1) if above[i].marked in ("article", "main")), -1)
        total += len(text)
        articles += len(text) if outermost >= 0 else 0
        if not holds and any(n.tag in _HEADINGS for n in above):
            holds = set(above)
        for i, n in enumerate(above):
            if n.named:
                held = texts.setdefault(n, [0, 0, 0])
                held[0] += len(text)
                held[1] += 1
                held[2] += len(text) if i > outermost >= 0 else 0

    def believed(n: Node) -> bool:
        size, count, marked = texts.get(n, (0, 0, 0))
        if marked and 2 * marked >= articles:
            return False
        several = count > 1 or n.named <= _LAYOUT
        return not (2 * size > total and several and (n in holds or not n.named & _COMMENTS))

    pending = [root]
    while pending:
        node = pending.pop()
        if node.parent is not None and (node.parent.hidden or node.named and believed(node)):
            node.hidden, node.marked = True, ""
        pending += node.children
    return [(n, t) for n, t in blocks if not n.hidden]


def parse(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of block elements, and in page order the text of each block of visible ones."""
    root = Node("#", "#", None, False)
    here, blocks, parts = root, [], []
    inline_hidden: list[str] = []

    def flush() -> None:
        if parts:
            text = _SPACES.sub(" ", "".join(parts)).strip()
            parts.clear()
            if text and not here.hidden:
                blocks.append((here, text))

    at, size = 0, len(page)
    lowered = None
    while at < size:
        found = _TOKEN.match(page, at)
        if found[0] == "<":
            found = _LOOSE.match(page, at) or found
        at = found.end()
        tag = found[2]
        if tag is None:
            text = found[0]
            if not text.startswith(("<!", "<?")) and not inline_hidden:
                if text == "<" and _LETTER.match(page, at):  # a tag that never ends
                    break
                parts.append(html_entities.unescape(text) if "&" in text else text)
            continue
        tag = tag.lower()
        if found[1]:
            if inline_hidden and tag == inline_hidden[-1]:
                inline_hidden.pop()
            elif tag in _BLOCK:
                node = here
                while node is not root and node.tag != tag:
                    node = node.parent
                if node is not root:
                    flush()
                    inline_hidden.clear()
                    here = node.parent
            continue
        if tag in _RAW:
            lowered = page.lower() if lowered is None or len(lowered) != size else lowered
            end = lowered.find(f"</{tag}", at) if len(lowered) == size else page.find(f"</{tag}", at)
            at = size if end < 0 else end
            close = page.find(">", at)
            at = size if close < 0 else close + 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in _BLOCK:
            if tag not in _VOID and found[3] and not found[3].rstrip().endswith("/"):
                attributes = _attributes(found[3])
                if inline_hidden:
                    if tag == inline_hidden[-1]:
                        inline_hidden.append(tag)
                elif "hidden" in attributes or _names(attributes) & _BOILER and tag != "a":
                    inline_hidden.append(tag)
            elif inline_hidden and tag == inline_hidden[-1]:
                inline_hidden.append(tag)
            continue
        flush()
        inline_hidden.clear()
        closes = _CLOSES.get(tag, ())
        node = here
        while node is not root and (node.tag not in _SCOPE or node.tag in closes):
            if node.tag in closes or node.tag == "p":
                here = node.parent
            node = node.parent
        if tag in ("html", "body") and any(n.tag == tag for n in _above(here)):
            continue
        if tag == "hr":
            continue
        child = _new(tag, found[3], here)
        here.children.append(child)
        here = child
    flush()
    return root, _hide_named(root, blocks)


def _above(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def fold(root: Node) -> str:
    """The shape of a tree, with runs of equal siblings as one; numbers each node's place in it.

    A shape is its nodes in preorder, each as depth and label.  Trees of any
    depth are walked without recursion.
    """
    import xxhash

    nodes = [root]
    for node in nodes:  # parents before their children
        nodes += node.children
    for node in reversed(nodes):
        below, last, node.size = [node.label], None, 1
        for child in node.children:
            if child.shape != last:
                last = child.shape
                below.append(str(last))
                node.size += child.size
        node.shape = xxhash.xxh3_128_intdigest("\0".join(below))
    out: list[str] = []
    pending = [(root, 0, True)]
    while pending:
        node, depth, written = pending.pop()
        if written:
            out.append(f"{depth}:{node.label}")
        index, last, start, inner = node.index + 1, None, 0, []
        for child in node.children:
            first = child.shape != last
            if first:
                last, start = child.shape, index
                index += child.size
            child.index = start
            inner.append((child, depth + 1, written and first))
        pending += reversed(inner)
    return ";".join(out)


class Shape:
    """A shape as a tree; ``key`` is the same for equal trees."""

    __slots__ = ("label", "index", "children", "key")

    def __init__(self, label: str, index: int):
        self.label, self.index = label, index
        self.children: list[Shape] = []
        self.key = 0


def unfold(shape: str) -> Shape:
    """The tree that a shape's text stands for."""
    import xxhash

    path: list[Shape] = []
    nodes: list[Shape] = []
    for index, part in enumerate(shape.split(";")):
        depth, label = part.split(":", 1)
        node = Shape(label, index)
        del path[int(depth) :]
        if path:
            path[-1].children.append(node)
        path.append(node)
        nodes.append(node)
    for node in reversed(nodes):
        node.key = xxhash.xxh3_128_intdigest("\0".join([node.label, *(str(c.key) for c in node.children)]))
    return nodes[0]


class TreeMatching:
    """Simple tree matching: the largest matching of two trees that keeps order and parents.

    Children of equal trees at both ends of two child lists are matched with each
    other, which never costs a match.  What is between is aligned by dynamic
    programming over rows, halved like Hirschberg's, so that two lists of
    n children need memory for n numbers and not for n squared.  The size of a
    pair of trees is found once for each pair of different trees.
    """

    def __init__(self) -> None:
        self.sizes: dict[tuple[int, int], int] = {}

    def size(self, a: Shape, b: Shape) -> int:
        """How many nodes two trees match."""
        if a.label != b.label:
            return 0
        known = self.sizes.get((a.key, b.key))
        if known is None:
            head, x, y, tail = _between(a.children, b.children)
            same = a.children[:head] + a.children[len(a.children) - tail :]
            known = 1 + sum(self.size(c, c) for c in same) + (int(self._row(x, y)[-1]) if x and y else 0)
            self.sizes[a.key, b.key] = known
        return known

    def _row(self, x: list[Shape], y: list[Shape]) -> np.ndarray:
        """The last row of the table of ``x`` against all prefixes of ``y``."""
        kinds: dict[int, int] = {}
        column = np.array([kinds.setdefault(c.key, len(kinds)) for c in y])
        one_of = list({c.key: c for c in y}.values())  # in the order of their numbers
        weights: dict[int, np.ndarray] = {}
        row = np.zeros(len(y) + 1, dtype=np.int64)
        for c in x:
            if c.key not in weights:
                weights[c.key] = np.array([self.size(c, k) for k in one_of], dtype=np.int64)[column]
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights[c.key]))
        return row

    def _aligned(self, x: list[Shape], y: list[Shape]) -> list[tuple[Shape, Shape]]:
        """Matched children of two lists."""
        out, pending = [], [(x, y)]
        while pending:
            x, y = pending.pop()
            head, x2, y2, tail = _between(x, y)
            out += zip(x[:head], y[:head], strict=True)
            out += zip(x[len(x) - tail :], y[len(y) - tail :], strict=True)
            if not x2 or not y2:
                continue
            if len(x2) == 1:
                found = [self.size(x2[0], k) for k in y2]
                if best := max(found):
                    out.append((x2[0], y2[found.index(best)]))
                continue
            half = len(x2) // 2
            upper, lower = self._row(x2[:half], y2), self._row(x2[half:][::-1], y2[::-1])[::-1]
            cut = int(np.argmax(upper + lower))
            pending += [(x2[:half], y2[:cut]), (x2[half:], y2[cut:])]
        return out

    def pairs(self, a: Shape, b: Shape) -> list[tuple[int, int]]:
        """The matched nodes, by their places."""
        out, pending = [], [(a, b)]
        while pending:
            a, b = pending.pop()
            if a.label == b.label:
                out.append((a.index, b.index))
                pending += self._aligned(a.children, b.children)
        return out


def _between(x: list[Shape], y: list[Shape]) -> tuple[int, list[Shape], list[Shape], int]:
    """How many equal trees two lists begin with, what is between, and how many they end with."""
    least = min(len(x), len(y))
    head = next((i for i in range(least) if x[i].key != y[i].key), least)
    least -= head
    tail = next((i for i in range(least) if x[-1 - i].key != y[-1 - i].key), least)
    return head, x[head : len(x) - tail], y[head : len(y) - tail], tail


def simple_tree_matching(a: Shape, b: Shape) -> tuple[int, list[tuple[int, int]]]:
    """Size of the largest matching of two trees that keeps order and parents, and its pairs."""
    matching = TreeMatching()
    # sizes are found from the leaves up, a level of Python calls for each level of the trees
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 1000 + 4 * max(_depth(a), _depth(b))))
    try:
        return matching.size(a, b), matching.pairs(a, b)
    finally:
        sys.setrecursionlimit(limit)


def _depth(tree: Shape) -> int:
    level, depth = [tree], 0
    while level:
        level, depth = [c for node in level for c in node.children], depth + 1
    return depth


def slots(shape: str, template: str) -> list[int]:
    """For each node of a shape its slot: the template node it aligns with, else a number of its own.

    A node without a partner is told by its path of labels, so equal extras of
    two shapes are one slot.
    """
    import xxhash

    if shape == template:
        return list(range(shape.count(";") + 1))
    pairs = dict(simple_tree_matching(unfold(shape), unfold(template))[1])
    out, path = [], []
    for index, part in enumerate(shape.split(";")):
        depth, label = part.split(":", 1)
        del path[int(depth) :]
        path.append(xxhash.xxh64_intdigest(label, path[-1] if path else 0))
        out.append(pairs.get(index, -1 - (path[-1] >> 2)))
    return out


def page_blocks(page: str) -> tuple[str, str, list[tuple[int, str]]]:
    """A page's shape, "article" or "main" if these are its content, else "", and (node, text) of the blocks that may be content.

    These are all outermost articles, or with them all mains where articles
    hold less than CONTENT_SHARE of the marked text, and the headings before
    the last of them.  Where most of the page is outside of these, the elements
    named as content are taken likewise if together they hold CONTENT_SHARE of
    the page, else the whole page.
    """
    root, blocks = parse(page)
    shape = fold(root)
    kinds = ("article", "main", "content")
    above = [{n.marked: n for n in _above(node) if n.marked} for node, _ in blocks]  # the outermost of each kind
    size = dict.fromkeys((*kinds, "page", "marked"), 0)
    for tops, (_, text) in zip(above, blocks, strict=True):
        for kind in (*tops, "page", *(["marked"] if "article" in tops or "main" in tops else [])):
            size[kind] += len(text)
    if size["marked"] and size["marked"] > (1 - CONTENT_SHARE) * size["page"]:
        # beside articles that hold most of it, the rest of a main is no content
        trusted = kinds[:1] if size["article"] >= CONTENT_SHARE * size["marked"] else kinds[:2]
    elif size["content"] and size["content"] >= CONTENT_SHARE * size["page"]:
        trusted = kinds[2:]
    else:
        return shape, "", [(n.index, t) for n, t in blocks]
    kept, waiting = [], []
    for tops, (node, text) in zip(above, blocks, strict=True):
        inside = [tops[k] for k in trusted if k in tops]
        if inside:
            kept += waiting
            waiting = []
            if not _byline(node, min(inside, key=lambda n: n.depth)):
                kept.append((node.index, text))
        elif any(n.tag in _HEADINGS for n in _above(node)):
            waiting.append((node.index, text))  # a heading of the region that follows
    return shape, "" if trusted == kinds[2:] else trusted[-1], kept


def _byline(node: Node, region: Node) -> bool:
    """In the header of an article only headings are text."""
    path = []
    for n in _above(node):
        if n is region:
            break
        path.append(n.tag)
    return "header" in path and not _HEADINGS & set(path)


def parsed(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, shape, marked, blocks`` of each page."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", host.alias("host"), F.col("html").cast("string").alias("html"))
    block = T.StructType([T.StructField("node", T.IntegerType()), T.StructField("text", T.StringType())])
    schema = T.StructType(
        [
            rows.schema["page_id"], rows.schema["url"], T.StructField("host", T.StringType()),
            T.StructField("shape", T.StringType()), T.StructField("marked", T.StringType()),
            T.StructField("blocks", T.ArrayType(block)),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string())]))
        for batch in batches:
            for piece in slices(batch, "html"):
                found = [page_blocks(x) for x in pc.fill_null(piece["html"], "").to_pylist()]
                texts = [[{"node": n, "text": t} for n, t in f[2]] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece["page_id"], piece["url"], piece["host"],
                        pa.array([f[0] for f in found], type=pa.string()),
                        pa.array([f[1] for f in found], type=pa.string()),
                        pa.array(texts, type=kind),
                    ],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema)


def _is_constant(b: Column) -> Column:
    return F.array_contains(
        F.col("constants"),
        F.struct(
            F.get("slot_of", b["node"]).alias("slot"), F.xxhash64(b["text"]).alias("text"), F.col("marked").alias("marked")
        ),
    )


def _with_varying(rows: DataFrame, known: DataFrame, broadcast_limit: int) -> DataFrame:
    """The pages with their wrappers, and as ``varying`` their blocks that aren't constant."""
    if known.count() <= broadcast_limit:
        joined = rows.join(F.broadcast(known), ["host", "shape"], "left")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        joined = rows.withColumn("salt", salt).join(salted, ["host", "shape", "salt"], "left")
    varying = F.when(F.col("constants").isNull(), F.col("blocks")).otherwise(
        F.filter("blocks", lambda b: ~F.coalesce(_is_constant(b), F.lit(False)))
    )
    return joined.withColumn("varying", varying)


def _least(pages: Column) -> Column:
    """How many of a host's pages must hold a constant."""
    return F.when(F.col("marked") != "", F.greatest(F.lit(ARTICLE_SUPPORT), ARTICLE_SHARE * pages)).otherwise(
        F.greatest(F.lit(SUPPORT), SHARE * pages)
    )


def wrappers(pages: DataFrame, broadcast_limit: int = BROADCAST_WRAPPERS) -> DataFrame:
    """``host, shape, slot_of, constants`` where a host has constant nodes.

    ``constants`` are (slot, hash of text, marked); a text that is constant
    stands on more than SHARE of the pages, so each slot has few of them.  They
    are counted twice: what seems constant at first tells the near copies, and
    then all near copies of a host are one page.
    """
    # copies of one page say nothing about the template
    distinct = pages.select(
        "host", "shape", "marked", "blocks", F.xxhash64(F.col("blocks.text")).alias("sig")
    ).where((F.col("host") != "") & (F.size("blocks") > 0))
    first = distinct.groupBy("host", "sig").agg(F.min("shape").alias("shape"))
    by_shape = first.groupBy("host", "shape").agg(F.count("*").alias("n"))
    hosts = by_shape.groupBy("host").agg(
        F.sum("n").alias("pages"), F.max_by("shape", F.struct("n", "shape")).alias("template")
    )
    schema = "host string, shape string, slot_of array<long>"

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [slots(a, b) for a, b in zip(batch["shape"].to_pylist(), batch["template"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["host"], batch["shape"], pa.array(found, type=pa.list_(pa.int64()))],
                names=["host", "shape", "slot_of"],
            )

    enough = hosts.where(F.col("pages") >= SUPPORT)
    aligned = materialize(
        pages.select("host", "shape").distinct().join(enough.select("host", "template"), "host").mapInArrow(align, schema),
        "wrapper-slots",
    )
    blocks = distinct.where(F.col("marked") != "article").select(
        "host", "shape", "sig", "marked", F.explode(F.array_distinct("blocks")).alias("b")
    ).select("host", "shape", "sig", "marked", "b.node", F.xxhash64("b.text").alias("text"))
    held = (
        blocks.distinct()
        .groupBy("host", "shape", "node", "marked", "text")
        .agg(F.count("*").alias("n"))
        .join(aligned, ["host", "shape"])
        .withColumn("slot", F.get("slot_of", F.col("node")))
        .groupBy("host", "slot", "marked", "text")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= SUPPORT)
        .join(enough.select("host", "pages"), "host")
    )
    constants = held.where(F.col("n") >= _least(F.col("pages"))).groupBy("host").agg(
        F.collect_list(F.struct("slot", "text", "marked")).alias("constants")
    )
    seeming = materialize(aligned.join(constants, "host"), "wrapper-seeming")

    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, b: n + F.char_length(b["text"]))
    judged = (
        _with_varying(pages.where((F.col("marked") != "article") & (F.size("blocks") > 0)), seeming, broadcast_limit)
        .where(F.col("constants").isNotNull())
        .withColumn("sig", F.xxhash64(F.col("blocks.text")))
        .withColumn("near", size("varying") < (1 - NEAR_SHARE) * size("blocks"))
    )
    near = judged.where("near").select("host", "sig").distinct().groupBy("host").agg(F.count("*").alias("n_near"))
    slot = lambda b: F.struct(F.get("slot_of", b["node"]).alias("slot"), F.xxhash64(b["text"]).alias("text"))
    again = (
        judged.select(
            "host",
            "marked",
            F.when(~F.col("near"), F.col("sig")).alias("sig"),
            F.explode(F.array_distinct(F.transform(F.filter("blocks", _is_constant), slot))).alias("c"),
        )
        .distinct()
        .groupBy("host", "c.slot", "marked", "c.text")
        .agg(F.count("*").alias("n"))
        .join(enough.select("host", "pages"), "host")
        .join(near, "host", "left")
    )
    n_pages = F.coalesce(F.col("pages") - F.col("n_near") + 1, F.col("pages"))
    constants = again.where(F.col("n") >= _least(n_pages)).groupBy("host").agg(
        F.collect_list(F.struct("slot", "text", "marked")).alias("constants")
    )
    return aligned.join(constants, "host")


def extract(pages: DataFrame, broadcast_limit: int = BROADCAST_WRAPPERS) -> DataFrame:
    """The main text of each page: ``page_id, url, text, n_chars, host, n_blocks, n_template``.

    Blocks are joined by one line feed.  A null or empty html, and markup
    without text, give an empty text.  Pages without a host, or of a host with
    fewer than SUPPORT distinct pages, have no wrapper and rely on marked
    regions and roles, and so do articles.  Near copies that share less than
    NEAR_SHARE of their text can't be told from a template.  Where a page consists of constant nodes alone these are
    its content.  Repeated rows are answered one by one; rows of null page_id
    likewise; other columns are not read.
    """
    rows = materialize(parsed(pages), "wrapper-pages")
    known = materialize(wrappers(rows, broadcast_limit), "wrapper-constants")
    kept = _with_varying(rows, known, broadcast_limit)
    kept = kept.withColumn("kept", F.when(F.size("varying") > 0, F.col("varying")).otherwise(F.col("blocks")))
    return kept.select(
        "page_id",
        "url",
        F.array_join(F.col("kept.text"), "\n").alias("text"),
        "host",
        F.size("kept").cast("long").alias("n_blocks"),
        (F.size("blocks") - F.size("kept")).cast("long").alias("n_template"),
    ).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "host", "n_blocks", "n_template"
    )
