"""Main text of web pages by wrapper induction.

Pages of one host are parsed to trees and aligned with a reference page by simple tree
matching: equal roots, then the best ordered matching of their children, recursively;
runs of like siblings match as one node, and are judged one by one. Nodes whose text is the same on (nearly) all
aligned pages are the template, nodes whose text varies are slots. The slots are the
content; an ``article`` or ``main`` with at least half of their text settles its bounds,
and so does a container named like one on pages without a template. Page
furniture (menus, headers, footers, sidebars, notices, adverts, forms, reader comments:
by element or class name) takes no part.

Pages are dealt by host; a host with many pages is cut by the hash of the page into
groups of about ``group`` pages and a bound of bytes, each of which induces its own
wrapper. Only the hosts above that size are sent to all tasks, at most one for each
``group`` pages or that many bytes. A host of one page has no template; container and
furniture rules still hold.

Null and empty pages have no text. Equal pages of a group are one page with several rows:
they count once for the template, and each row is returned. Null and repeated page_ids
are rows like any other. A null url is a host of its own. Pages are whole: nothing is
capped. Further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
FURNITURE = frozenset("nav header footer aside form menu script style noscript template button select option input textarea iframe svg object canvas dialog head title".split())
CONTAINERS = ("article", "main")
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article section main div body html td th".split())
RAW = "script|style|textarea|title|noscript|template|iframe"
#: Words of a class or id that name furniture, and such that name content.
FURNITURE_WORDS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion banner sidebar side menu navbar nav navigation breadcrumb breadcrumbs header masthead footer cookie cookies consent notice notices alert popup modal newsletter subscribe signup login share sharing social related recommended comment comments reply replies respond disqus toolbar widget widgets pagination skip".split())
CONTENT_WORDS = frozenset("article content main post entry story body text".split())
#: A name with one of these says something about its element, not what it is.
MODIFIERS = frozenset("with has have no without open closed enabled disabled is".split())
#: Elements nested deeper are read as if they stood at this depth, which is that of browsers.
DEPTH = 512

_attributes = r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*"
_token = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b{_attributes}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/><]*)({_attributes})>|<[a-zA-Z!?/][^<>]*>", re.S | re.I)
_open_end = re.compile(r"<(?:[a-zA-Z/!?][^<>]*)?\Z")
_names = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Node:
    """An element; inline ones are part of the text of the element they are in."""

    __slots__ = ("kids", "tag", "words")

    def __init__(self, tag: str, words: frozenset[str]):
        self.tag, self.words, self.kids = tag, words, []

    @property
    def furniture(self) -> bool:
        return self.tag in FURNITURE or self.tag not in CONTAINERS and bool(self.words & FURNITURE_WORDS)

    @property
    def container(self) -> bool:
        return self.tag in CONTAINERS or bool(self.words & CONTENT_WORDS)

    @property
    def label(self) -> str:
        return f"{self.tag} {' '.join(sorted(self.words))}"


def _words(attributes: str) -> frozenset[str]:
    found = [a or b or c for _, a, b, c in _names.findall(attributes)] if "=" in attributes else []
    named = [{*re.split(r"[^a-z0-9]+", x)} for names in found for x in names.lower().split()]
    return frozenset(w for parts in named if not parts & MODIFIERS for w in parts if w)


def parse(page: str) -> Node:
    """The tree of a page: nodes, and strings of text with references decoded."""
    root = Node("html", frozenset())
    stack, at, deep = [root], 0, {}
    if m := _open_end.search(page):
        page = page[: m.start()]
    for m in _token.finditer(page):
        if m.start() > at:
            stack[-1].kids.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag or tag in ("html", "body"):
            continue
        if tag == "br":
            stack[-1].kids.append(" ")
        elif m[2]:
            if deep.get(tag):
                deep[tag] -= 1
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
        elif tag not in INLINE or "class" in m[4] or "id" in m[4]:
            if tag not in INLINE:
                # A block ends an open paragraph, a list item the one before it, and so on.
                ends = CLOSES.get(tag, set()) | {"p"}
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ends:
                        del stack[k:]
                        break
                    if stack[k].tag in SCOPES:
                        break
            node = Node(tag, _words(m[4]))
            stack[-1].kids.append(node)
            if tag not in VOID and not m[4].endswith("/"):
                # Furniture is known as such at any depth, and has no use for a depth of its own.
                if len(stack) < DEPTH or node.furniture and not stack[-1].furniture:
                    stack.append(node)
                else:
                    deep[tag] = deep.get(tag, 0) + 1
    if at < len(page):
        stack[-1].kids.append(entities.unescape(page[at:]))
    return root


def collapsed(node: Node) -> tuple[tuple, list]:
    """The node's shape, and its nodes in the shape's preorder, a list for each place.
    Neighbours of one shape are a run and take one place; inline elements take none."""
    shapes, places = [], []
    for kid in node.kids:
        if isinstance(kid, str) or kid.tag in INLINE:
            continue
        shape, own = collapsed(kid)
        if shapes and shapes[-1] == shape:
            for a, b in zip(places[-1], own, strict=True):
                a += b
        else:
            shapes.append(shape)
            places.append(own)
    return (node.label, tuple(shapes)), [[node], *(p for own in places for p in own)]


@lru_cache(50_000)
def _size(shape: tuple) -> int:
    return 1 + sum(map(_size, shape[1]))


@lru_cache(50_000)
def match(a: tuple, b: tuple) -> tuple[int, tuple[tuple[int, int], ...]]:
    """Simple tree matching of two shapes: matched nodes, and their places in preorder."""
    if a[0] != b[0]:
        return 0, ()
    x, y = a[1], b[1]
    # Equal children at both ends always match in some best matching.
    most = min(len(x), len(y))
    head = next((k for k in range(most) if x[k] != y[k]), most)
    tail = next((k for k in range(most - head) if x[-1 - k] != y[-1 - k]), most - head)
    inner = _aligned(x[head : len(x) - tail], y[head : len(y) - tail])
    ends = [(k, k) for k in range(head)] + [(len(x) - tail + k, len(y) - tail + k) for k in range(tail)]
    starts = [np.concatenate([[1], 1 + np.cumsum([_size(c) for c in kids])]).astype(int).tolist() for kids in (x, y)]
    total, pairs = 1, [(0, 0)]
    for i, j in sorted([*ends, *((head + i, head + j) for i, j in inner)]):
        size, own = match(x[i], y[j])
        total += size
        pairs += [(p + starts[0][i], q + starts[1][j]) for p, q in own]
    return total, tuple(pairs)


def _aligned(x: tuple, y: tuple) -> list[tuple[int, int]]:
    """Places of the children that a best ordered matching of two lists matches.

    The table is made a row at a time; rows are kept at distances and those between made
    again on the way back, so long lists are matched as short ones are.
    """
    m, n = len(x), len(y)
    if not m or not n:
        return []
    kinds = [list(dict.fromkeys(c)) for c in (x, y)]
    worth = np.array([[match(p, q)[0] for q in kinds[1]] for p in kinds[0]], np.int64)
    at = [{c: k for k, c in enumerate(kind)} for kind in kinds]
    row_of, column = [at[0][c] for c in x], np.array([at[1][c] for c in y])

    def rows(before: np.ndarray, first: int, last: int) -> list[np.ndarray]:
        out = [before]
        for i in range(first, last):
            best = out[-1].copy()
            best[1:] = np.maximum(best[1:], out[-1][:-1] + worth[row_of[i]][column])
            out.append(np.maximum.accumulate(best))
        return out

    step = max(16, int(m**0.5))
    kept = [np.zeros(n + 1, np.int64)]
    for first in range(0, m - step, step):
        kept.append(rows(kept[-1], first, first + step)[-1])
    pairs, i, j = [], m, n
    for k in range(len(kept) - 1, -1, -1):
        table = rows(kept[k], k * step, i)
        while i > k * step and j:
            row, above = table[i - k * step], table[i - 1 - k * step]
            if row[j] == above[j]:
                i -= 1
            elif row[j] == row[j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
        i = k * step
    return pairs[::-1]


def blocks(node: Node, skip: set[int], out: list[str] | None = None, top: bool = True) -> list[str]:
    """Texts of the blocks below ``node`` in page order, without furniture and ``skip``
    (ids of nodes). Pieces of a block are joined later; None ends a block."""
    out = [] if out is None else out
    for kid in node.kids:
        if isinstance(kid, str):
            out.append(kid)
        elif kid.furniture or id(kid) in skip:
            out.append(None)
        elif kid.tag in INLINE:
            blocks(kid, skip, out, False)
        else:
            out.append(None)
            blocks(kid, skip, out, False)
            out.append(None)
    return out


def joined(pieces: list[str | None]) -> str:
    """Blocks with single spaces inside and between them."""
    out, block = [], []
    for p in [*pieces, None]:
        if p is not None:
            block.append(p)
        elif block:
            if text := " ".join("".join(block).split()):
                out.append(text)
            block = []
    return " ".join(out)


def own_text(nodes: list[Node]) -> str:
    """The text right in these nodes, inline elements included."""
    out: list[str | None] = []

    def walk(node: Node) -> None:
        for kid in node.kids:
            if isinstance(kid, str):
                out.append(kid)
            elif kid.tag in INLINE and not kid.furniture:
                walk(kid)
            else:
                out.append(None)

    for node in nodes:
        walk(node)
        out.append(None)
    return joined(out)


class Wrapper:
    """Template and content of the pages of one group."""

    #: Pages that must show a text, and their share of those aligned, for it to be template.
    least, share = 8, 0.95

    def __init__(self, pages: list[Node]):
        shaped = [collapsed(p) for p in pages]
        # The reference: the largest shape, the first of equals.
        self.reference = max((s for s, _ in shaped), key=_size)
        values: dict[int, dict[str, int]] = {}
        seen = set()
        for shape, places in shaped:
            texts = [tuple(own_text([n]) for n in nodes) for nodes in places]
            if (whole := hash(tuple(texts))) in seen:
                continue
            seen.add(whole)
            for mine, place in match(shape, self.reference)[1]:
                # A page counts once for a text, however many members of a run have it.
                for text in {*texts[mine]} - {""}:
                    of = values.setdefault(place, {})
                    of[text] = of.get(text, 0) + 1
        self.constant: dict[int, set[str]] = {}
        for place, of in values.items():
            if fixed := {t for t, n in of.items() if n >= self.least and n >= self.share * len(seen)}:
                self.constant[place] = fixed

    def text(self, page: Node) -> str:
        shape, places = collapsed(page)
        to = dict(match(shape, self.reference)[1])
        template = {id(n): n for mine, nodes in enumerate(places) for n in nodes if own_text([n]) in self.constant.get(to.get(mine), ())}
        skip = {i for i, n in template.items() if not any(isinstance(k, Node) and k.tag not in INLINE for k in n.kids)}
        return joined([x for n in self.content(page, template) for x in (*blocks(n, skip), None)])

    @staticmethod
    def content(page: Node, template: dict[int, Node]) -> list[Node]:
        """The slot region. Every varying block of the page is in it, so that a title or a
        closing line beside one long paragraph stays; the template and furniture are not.
        Articles that hold at least half of the varying text (of the text, where none
        varies) bound it. Containers that are only named like content do so on pages that
        have no template to tell."""
        varying: dict[int, int] = {}
        lengths: dict[int, int] = {}
        articles: list[Node] = []
        named: list[Node] = []
        todo = [(page, False, False)]
        order: list[tuple[Node, Node | None]] = []
        above: dict[int, Node] = {}
        while todo:
            node, in_article, in_named = todo.pop()
            own = len(own_text([node]))
            varying[id(node)], lengths[id(node)] = own * (id(node) not in template), own
            if node.tag in CONTAINERS and not in_article:
                articles.append(node)
                in_article = True
            if node.container and not in_named:
                named.append(node)
                in_named = True
            order.append((node, above.get(id(node))))
            for kid in reversed(node.kids):
                if isinstance(kid, Node) and kid.tag not in INLINE and not kid.furniture:
                    above[id(kid)] = node
                    todo.append((kid, in_article, in_named))
        for node, up in reversed(order):
            if up is not None:
                varying[id(up)] += varying[id(node)]
                lengths[id(up)] += lengths[id(node)]
        if not lengths[id(page)]:
            return []
        held = varying if varying[id(page)] else lengths
        for bounds in (articles, named if varying[id(page)] in (0, lengths[id(page)]) else []):
            if bounds and 2 * sum(held[id(n)] for n in bounds) >= held[id(page)]:
                return bounds
        return [page]


def host(url):
    """The host of a URL, lower case; an unreadable one is empty."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def extract(pages: DataFrame, group: int = 200, most: int = 32 << 20) -> DataFrame:
    """page_id, url, text of every page. A group has about ``group`` pages and ``most`` bytes."""
    spark = pages.sparkSession
    common.workers_import(spark)
    mine = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host(F.col("url")).alias("host"), common.as_text(F.col("html")).alias("html"))
    grown = pages.select(host(F.col("url")).alias("host"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes")).groupBy("host").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    parts_of = F.ceil(F.greatest(F.col("n") / group, F.col("bytes") / most))
    sizes = common.stored(spark, grown.select("host", parts_of.alias("parts")).where("parts > 1"), "hosts")
    # Rows that repeat an id are spread too; only rows that are equal go together.
    spread = F.xxhash64("page_id", "html")
    dealt = mine.join(F.broadcast(sizes), "host", "left").withColumn("part", F.pmod(spread, F.coalesce("parts", F.lit(1)))).withColumn("order", spread)
    parts = max(common.partitions(spark), -(-pages.count() // (10 * group)))  # a task's share has a bound
    dealt = dealt.select("page_id", "url", "host", "part", "html", "order").repartition(parts, "host", "part").sortWithinPartitions("host", "part", "order", "page_id").drop("order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sys

        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEPTH))
        key, held = None, {}  # a page's rows under its text, which is held once

        def out() -> Iterator[pa.RecordBatch]:
            trees = {h: parse(h) for h in held}
            own = Wrapper([*trees.values()])
            for h, rows in held.items():
                text = own.text(trees[h])
                for at in range(0, len(rows), 1000):
                    some = rows[at : at + 1000]
                    yield pa.RecordBatch.from_pydict({"page_id": pa.array([i for i, _ in some], pa.int64()), "url": pa.array([u for _, u in some], pa.string()), "text": pa.array([text] * len(some), pa.string())})

        for b in batches:
            for page_id, url, *of, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and of != key:
                    yield from out()
                    held = {}
                key = of
                held.setdefault(page, []).append((page_id, url))
        if held:
            yield from out()

    return dealt.mapInArrow(run, "page_id long, url string, text string")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(common.table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
