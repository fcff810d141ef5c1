r"""Main text of web pages by wrapper induction.

Pages of one host are aligned as trees by simple tree matching: two nodes of one label match, and among their kids the
order-preserving matching with the most matched nodes is taken (dynamic programming). Folding a host's pages gives its
wrapper: every node with the number of pages it stands on and whether its text is the same on all of them. Constant
nodes are template. Each pair of nodes is compared once. Of the varying slots the one that holds most of the host's varying text, outside menus, adverts and
the like, is where the host keeps its content.

Each page is then aligned with its host's wrapper. Its content is the node at the host's content slot; article or main elements
widen it where they hold it and narrow it where they hold at least half of its text. They are the content themselves where the host has
one page, or nothing that varies, or the page nothing at the slot. Nodes that the wrapper calls constant on at least nine in ten of five
or more pages go. What varies from page to page and still is no article (adverts, reader comments, headers that name the page) goes by
its element, or by a class, id or role that is such a name as a whole: "comment-list" goes, "social-science" stays. What is left is cut into blocks.

Wrappers are folded inside each partition, merged under a salt, then by host, so that a hot host is never one
group; its pages meet its wrapper in a join that the engine may split.

Defined results: null html is the empty page and gives an empty text; a null or odd url belongs to the host of no name;
a host of one page has nothing constant, nor has one whose pages all say the same; repeated rows
are extracted each and count once for the wrapper; an empty table gives no rows; extra columns
play no part. Elements nested deeper than 150 count as kids of the 150th.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, named, slices, small_batches, tidy
from .html_dom import INLINE, Node, parse

#: Partial wrappers of a host are merged in so many groups first.
SALTS = 16
#: Wrappers that a worker holds at a time, and nodes of one: above that, the nodes on the fewest pages go, but none on CONSTANT_SHARE of the pages folded so far.
HOSTS, NODES = 2000, 3000
CONSTANT_SHARE, CONSTANT_PAGES = 0.9, 5

DROPPED = frozenset("script style noscript template iframe svg canvas object embed audio video nav header footer aside form button select textarea input label menu dialog title head option datalist".split())
#: Words of class, id or role that mark what is no part of an article (fixed list).
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices "
    "notification notifications alert popup popover modal overlay newsletter subscribe subscription signup sidebar sidebars rail widget widgets menu menus nav navbar navigation "
    "breadcrumb breadcrumbs toolbar topbar masthead header footer pagination pager share sharing social related recommended recommendations recirc teaser comment comments commentlist "
    "discussion respond reply replies disqus login search skip copyright contentinfo complementary".split()
)
#: Words that may stand beside a mark in one name: "site-header", "ad-slot", "comment-list". Any other makes it a name of its own, as in "social-science" or "comment-free" (fixed list).
BESIDE = frozenset("site page main top bottom left right box block list section wrap wrapper container inner outer area unit slot bar item items group panel row col column primary secondary global".split())
_MARK = re.compile(r"[a-z]+|[A-Z][a-z]*")
_HOST = re.compile(r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", re.I)
CONTAINERS = frozenset("html body div section article main center table tbody tr td details".split())
#: Siblings of one label that make one slot each, as they lay a page out; all others are items of one slot.
APART = frozenset("div section article main center table details".split())


def host_of(url: str | None) -> str:
    m = _HOST.match(url.strip()) if url else None
    return m[1].lower() if m else ""


def host_column(url: Column) -> Column:
    """host_of as a column."""
    return F.coalesce(F.lower(F.regexp_extract(F.trim(url), r"^(?i:[a-z][a-z0-9+.\-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), F.lit(""))


def is_dropped(node: Node) -> bool:
    if node.tag in DROPPED:
        return True
    a = node.attrs
    if not a or node.tag in ("html", "body"):
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
        return True
    return _marked(" ".join((a.get("class", ""), a.get("id", ""), a.get("role", ""))))


@lru_cache(1 << 14)
def _marked(names: str) -> bool:
    """Whether one of these names is made of marks, or of marks and words that stand beside them."""
    for name in names.split():
        words = {w.lower() for w in _MARK.findall(name)}
        if words & MARKS and words <= MARKS | BESIDE:
            return True
    return False


class Slot:
    """A node of a wrapper, or of one page (n = 1): label, pages it stands on, digest of its own text or "" where that varies, characters of it, kids; of a page also the nodes. `shape` stands for the labels of its whole tree."""

    __slots__ = ("label", "n", "digest", "chars", "kids", "nodes", "shape", "count", "_varying")

    def __init__(self, label: str, n: int, digest: str, chars: int, kids: list[Slot], nodes: list[Node] | None = None):
        self.label, self.n, self.digest, self.chars, self.nodes = label, n, digest, chars, nodes
        self.put(kids)

    def put(self, kids: list[Slot]) -> None:
        self.kids = kids
        self.shape = hash((self.label, *[k.shape for k in kids]))
        self.count = 1 + sum([k.count for k in kids])
        self._varying = -1

    @property
    def varying(self) -> int:
        """Characters of varying text in and below, menus and the like aside."""
        if self._varying < 0:
            own = self.chars if not self.digest or self.n == 1 else 0
            self._varying = own + sum([k.varying for k in self.kids if not _is_mark(k.label)])
        return self._varying

    def plain(self) -> list:
        return [self.label, self.n, self.digest, self.chars, [k.plain() for k in self.kids]]

    @staticmethod
    def of(x: list) -> Slot:
        return Slot(x[0], x[1], x[2], x[3], [Slot.of(k) for k in x[4]])


def page_slot(nodes: list[Node], label: str) -> Slot:
    """Nodes of one label as one slot. Neighbours of one label below them make one slot too, but for those that lay a page out. Inline elements are text of the block around them; script, style and the like play no part."""
    text: list[str] = []
    kids: list[tuple[str, Node]] = []
    for n in nodes:
        stack: list = n.kids[::-1]
        while stack:
            k = stack.pop()
            if isinstance(k, str):
                text.append(k)
            elif k.tag in INLINE:
                stack += reversed(k.kids)
            elif k.tag not in ("script", "style", "head", "noscript", "template", "meta", "link", "title"):
                kids.append((k.label, k))
    groups: list[tuple[str, list[Node]]] = []
    for name, k in kids:
        if groups and groups[-1][0] == name and k.tag not in APART:
            groups[-1][1].append(k)
        else:
            groups.append((name, [k]))
    own = " ".join("".join(text).split())
    digest = hashlib.blake2b(own.encode("utf-8", "replace"), digest_size=6).hexdigest()
    return Slot(label, 1, digest, len(own), [page_slot(g, name) for name, g in groups], nodes)


def same(a: Slot, b: Slot) -> bool:
    """Whether two trees have the same labels throughout."""
    return a.shape == b.shape and a.count == b.count


class Matching:
    """Simple tree matching of two trees. Each pair of nodes is compared once, so the work is bounded by the product of their sizes, however deep they are."""

    def __init__(self) -> None:
        self.sizes: dict[tuple[int, int], int] = {}
        self.kids: dict[tuple[int, int], list[tuple[Slot, Slot]]] = {}

    def size(self, a: Slot, b: Slot) -> int:
        """How many pairs of nodes match."""
        if a.label != b.label:
            return 0
        if same(a, b):
            return a.count
        key = (id(a), id(b))
        if key not in self.sizes:
            self.sizes[key] = 1 + sum([self.size(x, y) for x, y in self.aligned(a, b)])
        return self.sizes[key]

    def aligned(self, a: Slot, b: Slot) -> list[tuple[Slot, Slot]]:
        """The order-preserving matching of the kids of a and b with the most matched nodes."""
        key = (id(a), id(b))
        if key not in self.kids:
            self.kids[key] = self._align(a.kids, b.kids)
        return self.kids[key]

    def _align(self, a: list[Slot], b: list[Slot]) -> list[tuple[Slot, Slot]]:
        if len(a) == len(b) == len({x.label for x in a}) and all([x.label == y.label for x, y in zip(a, b, strict=True)]):
            return list(zip(a, b, strict=True))
        # nothing matches more of a tree than its equal, so equal trees at either end belong together
        head, most = 0, min(len(a), len(b))
        while head < most and same(a[head], b[head]):
            head += 1
        tail = 0
        while tail < most - head and same(a[-1 - tail], b[-1 - tail]):
            tail += 1
        first, last = list(zip(a[:head], b[:head], strict=True)), list(zip(a[len(a) - tail :], b[len(b) - tail :], strict=True))
        a, b = a[head : len(a) - tail], b[head : len(b) - tail]
        common = {x.label for x in a} & {y.label for y in b}
        a, b = [x for x in a if x.label in common], [y for y in b if y.label in common]
        if not a or not b:
            return first + last
        size = [[self.size(x, y) for y in b] for x in a]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + size[i][j] if size[i][j] else 0)
        out, i, j = [], len(a), len(b)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((a[i], b[j]))
        return first + out[::-1] + last


def merged(a: Slot, b: Slot, matching: Matching | None = None) -> Slot:
    """Two wrappers as one: matched nodes become one, others stay in order."""
    matching = matching or Matching()
    pairs = {id(x): y for x, y in matching.aligned(a, b)}
    taken = {id(y) for y in pairs.values()}
    kids: list[Slot] = []
    rest = iter(b.kids)
    for x in a.kids:
        y = pairs.get(id(x))
        if y is None:
            kids.append(x)
            continue
        for z in rest:
            if z is y:
                break
            if id(z) not in taken:
                kids.append(z)
        kids.append(merged(x, y, matching))
    kids += [z for z in rest if id(z) not in taken]
    return Slot(a.label, a.n + b.n, a.digest if a.digest == b.digest else "", a.chars + b.chars, kids)


def pruned(s: Slot, most: int = NODES) -> Slot:
    """s, without the nodes on the fewest pages if there are more than `most`; those on a share of CONSTANT_SHARE of the pages stay, however many."""
    least, keep = 1, math.ceil(CONSTANT_SHARE * s.n)
    while s.count > most and least < keep:
        least = min(2 * least, keep)
        _drop(s, least)
    return s


def _drop(s: Slot, least: int) -> None:
    kids = [k for k in s.kids if k.n >= least]
    for k in kids:
        _drop(k, least)
    s.put(kids)


@lru_cache(1 << 14)
def _is_mark(label: str) -> bool:
    tag, _, names = label.partition(".")
    return tag in DROPPED or _marked(names.replace("#", " "))


def content_slot(s: Slot) -> Slot:
    """From the root down while one container holds over 6 tenths of the varying text."""
    while True:
        best = max([k for k in s.kids if not _is_mark(k.label)], key=lambda k: k.varying, default=None)
        if best is None or best.label.partition(".")[0] not in CONTAINERS or best.varying * 10 <= s.varying * 6:
            return s
        s = best


def _find(root: Node, tags: tuple[str, ...]) -> list[Node]:
    """The outermost elements of these tags that are not inside a dropped one."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        if n.tag in tags:
            out.append(n)
            continue
        stack += [k for k in reversed(n.kids) if not isinstance(k, str) and not is_dropped(k)]
    return out


def blocks(nodes: list[Node], gone: set[int]) -> list[str]:
    """Texts of the blocks in page order, each with single spaces."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            if s := " ".join("".join(run).split()):
                out.append(s)
            run.clear()

    for n in nodes:
        stack: list = [(n, False, True)]
        while stack:
            x, left, top = stack.pop()
            if isinstance(x, str):
                run.append(x)
                continue
            if left:
                flush()
                continue
            if x.tag == "br":
                run.append(" ")
                continue
            if not top and (id(x) in gone or is_dropped(x)):
                if x.tag == "header" or "header" in x.attrs.get("class", ""):  # the title of the article stays
                    for h in _find_any(x, ("h1", "h2")):
                        flush()
                        run.extend(_texts(h))
                flush() if x.tag not in INLINE else None
                continue
            if x.tag not in INLINE:
                flush()
                stack.append((x, True, False))
            stack += [(k, False, False) for k in reversed(x.kids)]
        flush()
    return out


def _find_any(root: Node, tags: tuple[str, ...]) -> list[Node]:
    out, stack = [], list(reversed([k for k in root.kids if not isinstance(k, str)]))
    while stack:
        n = stack.pop()
        if n.tag in tags:
            out.append(n)
        else:
            stack += [k for k in reversed(n.kids) if not isinstance(k, str)]
    return out


def _texts(n: Node) -> list[str]:
    out, stack = [], [n]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append(" ")
        else:
            stack += reversed(x.kids)
    return out


def wrapper_of(pages: list[str]) -> Slot | None:
    out = None
    for p in pages:
        s = page_slot([parse(p)], "html")
        out = s if out is None else merged(out, s)
    return out


def extract(page: str, wrapper: Slot | None) -> str:
    """The main text of a page, by its host's wrapper."""
    root = parse(page)
    mine = page_slot([root], "html")
    gone: set[int] = set()
    nodes = _find(root, ("article",)) or _find(root, ("main",))
    if wrapper is not None:
        main = content_slot(wrapper)
        found: list[Node] | None = None
        varies = wrapper.varying > 0  # else all pages say the same, and nothing tells template from content
        matching = Matching()
        stack, enough = [(wrapper, mine)], max(CONSTANT_PAGES, CONSTANT_SHARE * wrapper.n)
        while stack:
            w, s = stack.pop()
            if w is main:
                found = s.nodes
            if varies and w is not wrapper and w.digest and w.n >= enough and not w.varying:
                gone.update(id(n) for n in s.nodes or [])
            stack += matching.aligned(w, s)
        if found and wrapper.n > 1 and varies:
            nodes = chosen(found, nodes, gone)
        nodes = nodes or found or []
    nodes = nodes or content_slot(mine).nodes or []
    return "\n\n".join(blocks(nodes, gone))


def chosen(found: list[Node], marked: list[Node], gone: set[int]) -> list[Node]:
    """The nodes at the host's content slot, or those of the article or main elements that hold them, or that hold at least half of their text."""
    inside = {id(x) for x in _below(found)}
    ids = {id(x) for x in found}
    around = [m for m in marked if any(id(x) in ids for x in _below([m]))]
    if around:
        return around
    within = [m for m in marked if id(m) in inside]
    size = lambda nodes: sum(map(len, blocks(nodes, gone)))
    return within if within and 2 * size(within) >= size(found) else found


def _below(nodes: list[Node]) -> Iterator[Node]:
    stack = list(nodes)
    while stack:
        n = stack.pop()
        yield n
        stack += [k for k in n.kids if not isinstance(k, str)]


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", salts: int = SALTS, nodes: int = NODES) -> DataFrame:
    """host, wrapper (JSON) of all pages, n_pruned (nodes that went because a wrapper had more than `nodes`; 0 where it is whole)."""
    small_batches(pages.sparkSession)
    rows = pages.select(named(url_col).cast("string").alias("url"), named(html_col).cast("string").alias("html"))
    # copies of a page say nothing about what is constant: each distinct page of a host counts once
    once = rows.groupBy(host_column(F.col("url")).alias("host"), F.sha2("html", 256).alias("digest")).agg(F.first("html").alias("html"))
    part = once.select("host", "html", (F.spark_partition_id() % salts).alias("salt"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], Slot] = {}
        lost: dict[tuple[str, int], int] = {}

        def out() -> pa.RecordBatch:
            columns = [pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int32()), pa.array([json.dumps(s.plain()) for s in held.values()], pa.string()), pa.array([lost.get(k, 0) for k in held], pa.int64())]
            held.clear()
            lost.clear()
            return pa.RecordBatch.from_arrays(columns, ["host", "salt", "wrapper", "n_pruned"])

        for b in batches:
            for host, page, salt in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                key = (host, salt)
                s = page_slot([parse(page or "")], "html")
                if key in held:
                    s = merged(held[key], s)
                    if s.count > nodes:
                        before = s.count
                        lost[key] = lost.get(key, 0) + before - pruned(s, nodes).count
                held[key] = s
                if len(held) >= HOSTS:
                    yield out()
        yield out()

    def join(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found, lost = None, int(group["n_pruned"].sum())
        for text in sorted(group["wrapper"]):
            s = Slot.of(json.loads(text))
            found = s if found is None else merged(found, s)
            before = found.count
            lost += before - pruned(found, nodes).count
        return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(found.plain())], "n_pruned": [lost]})

    kept = "wrapper string, n_pruned long"
    partial = part.mapInArrow(tidy(fold), f"host string, salt int, {kept}")
    salted = partial.groupBy("host", "salt").applyInPandas(join, f"host string, {kept}")
    return salted.groupBy("host").applyInPandas(join, f"host string, {kept}")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each input row: page_id, url, text (blocks joined by an empty line)."""
    small_batches(pages.sparkSession)
    found = cut(wrappers(pages, url_col, html_col), few=True).drop("n_pruned").withColumnRenamed("host", "h")
    rows = pages.select(named(id_col).alias("page_id"), named(url_col).cast("string").alias("url"), named(html_col).cast("string").alias("html"))
    both = rows.withColumn("host", host_column(F.col("url"))).join(found, F.col("host") == F.col("h"), "left").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Slot] = {}
        for b in batches:
            page = pc.fill_null(b.column(2), "")
            for i, j in slices(page):
                texts = []
                for p, w in zip(page.slice(i, j - i).to_pylist(), b.column(3).slice(i, j - i).to_pylist(), strict=True):
                    if w is not None and w not in known:
                        if len(known) >= HOSTS:
                            known.clear()
                        known[w] = Slot.of(json.loads(w))
                    texts.append(extract(p, known.get(w)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return both.mapInArrow(tidy(run), f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string")
