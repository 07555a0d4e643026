"""Operator 9, HTML extraction: wrapper induction by simple tree matching over pages of a host.

1. Every page is parsed into a tree of block elements; inline markup is transparent, and a run of
   siblings of one shape is one list slot. The different trees of a host, a few hundred bytes
   without text, are merged into the host's wrapper: what aligns is one node, what does not is added.
2. Every page is aligned with its host's wrapper by simple tree matching (the pairs of children in
   order that match most nodes), and its blocks of text are written down with their wrapper nodes.
3. A wrapper node is a slot unless most of the host's different pages that fill it have a text there
   that repeats; such texts are template. The host's region is the lowest container that holds most
   of the varying text outside links, with no heading or paragraph that varies beside it; varying
   slots around it (menus, adverts, footers) are template too.
4. Blocks of template nodes are dropped, the others are the text. No page is parsed again for that.

Elements that say themselves what they are (menus, adverts, forms, comments, by tag, class, id or
role) are template on any host, which settles hosts of one or two pages and what stands inside the
region; in an article or main element only whole class names count, and repeating texts stay.

Wrappers and template texts lie in the shared folder as sorted arrays that workers map, so that no
page travels to its host: a host with a third of all pages is no larger task than others.

Defined results: a null or empty html gives an empty text; a null or hostless URL is a host of its
own kind (''); cut-off or badly nested markup is read as far as it goes, at any depth; repeated rows
give repeated results, and copies of a page vote once; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import new_path, scope, stored, table
from loomgraph.llm.shared_files import mapped, write_arrays

# Fixed values of HTML.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg select button object audio video canvas head".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}, "dt": {"dl"}, "dd": {"dl"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold running text themselves, into which a region does not shrink.
PROSE = HEADINGS | frozenset("p pre blockquote li dt dd td th tr caption figcaption summary".split())
#: Of these, a text that varies beside a region is content too, so that the region grows over it.
BESIDE = HEADINGS | frozenset("p pre blockquote td th".split())
# What elements say of themselves.
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog header".split())
BOILERPLATE_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar side-bar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup share sharing social comment comments reply replies disqus respond related recommended footer header masthead site-header site-footer toolbar pagination pager login search hidden skip copyright".split())
#: Words that say only where an element stands, or what holds it: beside a boilerplate word they take nothing from it.
LAYOUT_WORDS = frozenset("site main page global top bottom left right primary secondary wrapper container box block area bar list item items link links slot unit widget section inner outer row col column group panel holder".split())
#: Words that inside an article may be its own.
OWN_WORDS = frozenset("header search skip copyright".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CONTENT_TAGS = frozenset(("article", "main"))

# a quote opens a value only behind an equals sign
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Of raw elements, those whose text goes on to the end of the page if nothing closes them.
TO_THE_END = frozenset("script style textarea title".split())
_CLOSING = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
#: Pages of a host on which a text repeats, and share of a node's pages whose texts do, from which these are template.
LEAST_PAGES = 2
REPEATING = 0.5
#: Different pages of a host from which it has a region, and the share of its varying text that this holds.
REGION_PAGES = 3
REGION = 0.75
#: Parts in which a host's shapes are merged before the parts are.
PARTS = 64
#: Entries of the caches of wrappers and alignments in a worker.
CACHED = 4096


class Node:
    __slots__ = ("label", "tag", "children", "parts", "boilerplate", "content", "groups")

    def __init__(self, tag: str, label: str, boilerplate: bool, content: bool) -> None:
        self.tag, self.label, self.boilerplate, self.content = tag, label, boilerplate, content
        self.children: list[Node] = []
        self.parts: list[tuple[int, str, int]] = []  # (order in the page, text of a block, characters of it in links)
        self.groups: list[list[Node]] = []  # runs of children of one shape


def _says_boilerplate(name: str) -> bool:
    """Whether a class or id is a boilerplate word, or such words and those of layout only: `ad-slot` and not `ad-hoc`."""
    parts = [x for x in re.split(r"[-_0-9]+", name) if x]
    return name in BOILERPLATE_WORDS or (not BOILERPLATE_WORDS.isdisjoint(parts) and all(x in BOILERPLATE_WORDS or x in LAYOUT_WORDS for x in parts))


def _label(tag: str, attributes: str, inside_content: bool) -> tuple[str, bool]:
    """(tag with its class and id, whether the element says that it is boilerplate)."""
    words, roles, hidden = [], "", False
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                words += value.split()
            elif name == "role":
                roles = value
            else:
                hidden |= name == "hidden" or value == "true"
    own = tag in BOILERPLATE_TAGS and not (tag == "header" and inside_content)
    bad = own or hidden or roles in BOILERPLATE_ROLES
    if not bad and words and tag not in ("html", "body", "article", "main"):
        if inside_content or tag in PROSE:
            bad = not BOILERPLATE_WORDS.isdisjoint(set(words) - OWN_WORDS)
        else:
            bad = any(_says_boilerplate(w) for w in words)
    label = ".".join([tag, *(re.sub(r"[0-9()*\s]+", "", w) for w in sorted(words) if w)])
    return re.sub(r"[()*\s]+", "", label), bad


def parse(html: str) -> Node:
    """The tree of block elements; every run of text between block boundaries is a part of its element."""
    root = Node("#", "#", False, False)
    stack, order = [root], 0
    text: list[str] = []
    linked, links = 0, 0
    opened: Counter = Counter()
    unclosed: set[str] = set()  # raw elements that nothing closes from here on
    at, end, last = 0, len(html), html.rfind(">")

    def flush() -> None:
        nonlocal order, linked
        if text:
            block = " ".join(entities.unescape("".join(text)).split())
            if block:
                stack[-1].parts.append((order, block, min(linked, len(block))))
                order += 1
            text.clear()
            linked = 0

    def close(to: int) -> None:
        for n in stack[to:]:
            opened[n.tag] -= 1
        del stack[to:]

    while at < end:
        m = _TAG.search(html, at) if at <= last else None
        if m is None:
            text.append(html[at:])
            break
        if m.start() > at:
            text.append(html[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if m[1] else 1
            continue
        if m[1]:
            if tag in BLOCKS and opened[tag]:
                flush()
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                closing = None if tag in unclosed else _CLOSING[tag].search(html, at)
                if closing is None:
                    unclosed.add(tag)
                at = closing.end() if closing else end if tag in TO_THE_END else at
            continue
        if tag == "br":
            text.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        if tag in ENDS:
            if any(opened[t] for t in ENDS[tag]):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ENDS[tag]:
                        close(k)
                    elif stack[k].tag in LIMITS[tag]:
                        break
            if stack[-1].tag == "p":
                close(len(stack) - 1)
        elif stack[-1].tag == "p":
            close(len(stack) - 1)
        parent = stack[-1]
        label, bad = _label(tag, m[3], parent.content)
        node = Node(tag, label, parent.boilerplate or bad, parent.content or tag in CONTENT_TAGS)
        parent.children.append(node)
        if tag not in VOID:
            stack.append(node)
            opened[tag] += 1
    flush()
    return root


class Slot:
    """A node of a page's tree with its lists folded, or of a wrapper."""

    __slots__ = ("label", "children", "nodes", "number")

    def __init__(self, label: str, nodes: list[Node]) -> None:
        self.label, self.nodes, self.number = label, nodes, -1
        self.children: list[Slot] = []


def fold(root: Node) -> Slot:
    """The tree with each run of children of one shape as one slot; equal shapes fold place by place."""
    nodes = [root]
    for n in nodes:  # grows: parents before children
        nodes += n.children
    shapes: dict[tuple, int] = {}
    shape: dict[int, int] = {}
    for n in reversed(nodes):
        n.groups = []
        inside = []
        for child in n.children:
            s = shape[id(child)]
            if n.groups and shape[id(n.groups[-1][0])] == s:
                n.groups[-1].append(child)
                inside[-1] = (s, True)
            else:
                n.groups.append([child])
                inside.append((s, False))
        shape[id(n)] = shapes.setdefault((n.label, *inside), len(shapes))
    top = Slot(root.label, [root])
    todo = [top]
    while todo:
        slot = todo.pop()
        for place in zip(*(n.groups for n in slot.nodes), strict=True):
            slot.children.append(Slot(place[0][0].label, [x for group in place for x in group]))
        todo += slot.children
    return top


def in_order(root: Slot) -> list[Slot]:
    """The slots, parents before children, as `written` lists them; numbered so."""
    out, todo = [], [root]
    while todo:
        slot = todo.pop()
        slot.number = len(out)
        out.append(slot)
        todo += reversed(slot.children)
    return out


def written(root: Slot) -> str:
    out: list[str] = []
    todo: list[Slot | None] = [root]
    while todo:
        slot = todo.pop()
        if slot is None:
            out.append(")")
        else:
            out.append(f"{slot.label}(")
            todo.append(None)
            todo += reversed(slot.children)
    return "".join(out)


def read_shape(text: str) -> list[Slot]:
    """The slots of a written tree in order, numbered; the first is its root."""
    slots: list[Slot] = []
    stack: list[Slot] = []
    for label in re.findall(r"([^()]+)\(|\)", text):
        if label:
            slot = Slot(label, [])
            slot.number = len(slots)
            slots.append(slot)
            if stack:
                stack[-1].children.append(slot)
            stack.append(slot)
        else:
            stack.pop()
    return slots


class Shapes:
    """Numbers of different subtrees: equal ones, wherever they stand, have one."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.label: list[str] = []
        self.children: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.height: list[int] = []

    def number(self, root: Slot) -> dict[int, int]:
        """The shape of each slot of a tree, by id()."""
        slots, out = [root], {}
        for x in slots:  # grows: parents before children
            slots += x.children
        for x in reversed(slots):
            inside = tuple(out[id(c)] for c in x.children)
            k = self.known.get((x.label, inside))
            if k is None:
                k = self.known[x.label, inside] = len(self.label)
                self.label.append(x.label)
                self.children.append(inside)
                self.size.append(1 + sum(self.size[c] for c in inside))
                self.height.append(1 + max((self.height[c] for c in inside), default=0))
            out[id(x)] = k
        return out

    def middle(self, x: int, y: int) -> tuple[int, int]:
        """How many children of two shapes are equal from the front, and of the rest from the back. To match equal
        subtrees with each other there is never worse than another choice."""
        a, b = self.children[x], self.children[y]
        most = min(len(a), len(b))
        front = next((k for k in range(most) if a[k] != b[k]), most)
        back = next((k for k in range(most - front) if a[-1 - k] != b[-1 - k]), most - front)
        return front, back


#: Cells of a table of alignments up to which plain lists are quicker than arrays, and up to which it is held whole.
FEW_CELLS = 1 << 10
HELD_CELLS = 1 << 26


def _last_row(a: list[int], b: list[int], weight: Callable[[int, int], int]) -> np.ndarray:
    """For each front part of b the weight of its best alignment with a."""
    values, at = np.unique(b, return_inverse=True)
    row, rows = np.zeros(len(b) + 1, np.int64), {}
    for x in a:
        if x not in rows:
            rows[x] = np.array([weight(x, y) for y in values.tolist()], np.int64)
        best = np.maximum(row[1:], row[:-1] + rows[x][at])
        row = np.concatenate([row[:1], np.maximum.accumulate(best)])
    return row


def best_alignment(a: list[int], b: list[int], weight: Callable[[int, int], int]) -> tuple[int, list[tuple[int, int]]]:
    """(weight, places) of pairs in order that weigh most; a pair without weight is none. Memory follows the cells up to
    HELD_CELLS of them, beyond that a is halved, and b where both halves weigh most."""
    if not a or not b:
        return 0, []
    if len(a) * len(b) > HELD_CELLS and len(a) > 1:
        half = len(a) // 2
        ahead, behind = _last_row(a[:half], b, weight), _last_row(a[half:][::-1], b[::-1], weight)[::-1]
        cut = int((ahead + behind).argmax())
        first, last = best_alignment(a[:half], b[:cut], weight), best_alignment(a[half:], b[cut:], weight)
        return first[0] + last[0], first[1] + [(i + half, j + cut) for i, j in last[1]]
    out, i, j = [], len(a), len(b)
    if len(a) * len(b) <= FEW_CELLS:
        table = [[0] * (j + 1)]
        for x in a:
            up, row = table[-1], [0]
            for k, y in enumerate(b):
                row.append(max(up[k + 1], row[k], up[k] + weight(x, y)))
            table.append(row)
        while i and j:
            w = weight(a[i - 1], b[j - 1])
            if w and table[i][j] == table[i - 1][j - 1] + w:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif table[i][j] == table[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return table[-1][-1], out[::-1]
    values, at = np.unique(b, return_inverse=True)
    row, rows, steps = np.zeros(j + 1, np.int64), {}, np.zeros((i, j), np.uint8)
    for k, x in enumerate(a):
        if x not in rows:
            rows[x] = np.array([weight(x, y) for y in values.tolist()], np.int64)
        w = rows[x][at]
        both = row[:-1] + w
        new = np.concatenate([row[:1], np.maximum.accumulate(np.maximum(row[1:], both))])
        steps[k] = np.where((w > 0) & (new[1:] == both), 2, np.where(new[1:] == row[1:], 1, 0))
        row = new
    while i and j:
        step = steps[i - 1, j - 1]
        if step == 2:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif step == 1:
            i -= 1
        else:
            j -= 1
    return int(row[-1]), out[::-1]


def align(page: Slot, wrapper: Slot) -> tuple[int, list[tuple[Slot, Slot]]]:
    """Simple tree matching: how many nodes match, and the pairs of a best matching. Equal subtrees match whole; two
    different shapes are compared once, however often they meet, and of their children only what lies between
    equal ones at the front and the back."""
    if page.label != wrapper.label:
        return 0, []
    shapes = Shapes()
    shape = shapes.number(page) | shapes.number(wrapper)
    label, size, children = shapes.label, shapes.size, shapes.children
    top = (shape[id(page)], shape[id(wrapper)])
    matched: dict[tuple[int, int], tuple[int, int, int, list[tuple[int, int]]]] = {}  # weight, front, back, places between

    def weight(x: int, y: int) -> int:
        return size[x] if x == y else matched[x, y][0] if label[x] == label[y] else 0

    pairs, seen = [top] if top[0] != top[1] else [], {top}
    for x, y in pairs:  # grows
        front, back = shapes.middle(x, y)
        by_label: dict[str, list[int]] = {}
        for c in set(children[y][front : len(children[y]) - back]):
            by_label.setdefault(label[c], []).append(c)
        for c in set(children[x][front : len(children[x]) - back]):
            for d in by_label.get(label[c], ()):
                if c != d and (c, d) not in seen:
                    seen.add((c, d))
                    pairs.append((c, d))
    for x, y in sorted(pairs, key=lambda p: shapes.height[p[0]]):  # children before parents
        front, back = shapes.middle(x, y)
        a, b = children[x], children[y]
        between, places = best_alignment(list(a[front : len(a) - back]), list(b[front : len(b) - back]), weight)
        equal = sum(size[c] for c in a[:front]) + sum(size[c] for c in a[len(a) - back :])
        matched[x, y] = (1 + equal + between, front, back, places)
    out, todo = [], [(page, wrapper)]
    while todo:
        p, w = todo.pop()
        out.append((p, w))
        x, y = shape[id(p)], shape[id(w)]
        if x == y:
            todo += zip(p.children, w.children, strict=True)
            continue
        _, front, back, places = matched[x, y]
        todo += zip(p.children[:front], w.children[:front], strict=True)
        todo += [(p.children[front + i], w.children[front + j]) for i, j in places]
        if back:
            todo += zip(p.children[-back:], w.children[-back:], strict=True)
    return weight(*top), out


def merge(wrapper: Slot, page: Slot) -> None:
    """Lays page into wrapper: what aligns is one node, what does not is a new one between its neighbours."""
    partner = {id(p): w for p, w in align(page, wrapper)[1]}
    todo = [(wrapper, page)]
    while todo:
        w, p = todo.pop()
        children, k = [], 0
        for child in p.children:
            other = partner.get(id(child))
            if other is None:
                children.append(child)
                continue
            while w.children[k] is not other:
                children.append(w.children[k])
                k += 1
            children.append(other)
            todo.append((other, child))
            k += 1
        w.children = children + w.children[k:]


def region(slots: list[Slot], plain: dict[int, int]) -> tuple[int, int]:
    """(first, last) node number of the region, given the varying characters outside links of each node."""
    inside = [plain.get(k, 0) for k in range(len(slots))]
    prose = [n > 0 and slots[k].label.split(".")[0] in BESIDE for k, n in enumerate(inside)]
    size = [1] * len(slots)
    for slot in reversed(slots):
        for child in slot.children:
            inside[slot.number] += inside[child.number]
            prose[slot.number] |= prose[child.number]
            size[slot.number] += size[child.number]
    at = slots[0]
    while True:
        best = max(at.children, key=lambda c: inside[c.number], default=None)
        if best is None or inside[best.number] < REGION * inside[0] or best.label.split(".")[0] in PROSE:
            break
        if plain.get(at.number, 0) and at.label.split(".")[0] in PROSE or any(prose[c.number] for c in at.children if c is not best):
            break
        at = best
    return at.number, at.number + size[at.number] - 1


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shapes = [written(fold(parse(h or ""))) for h in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shapes, pa.string())], ["host", "shape"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, shape): one wrapper for each run of rows (host, part, shape) of equal host and part."""
    key: tuple | None = None
    wrapper: Slot | None = None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([written(wrapper)], pa.string())], ["host", "shape"])

    for batch in batches:
        for host, part, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            tree = read_shape(text)[0]
            if key == (host, part):
                merge(wrapper, tree)
                continue
            if wrapper is not None:
                yield out()
            key, wrapper = (host, part), tree
    if wrapper is not None:
        yield out()


@dataclass
class Mapped:
    """Sorted 64-bit keys, dealt over files by their remainder, with a value each if there are any."""

    path: str
    buckets: int
    #: The buckets that have keys; a file of any of them that is not there is an error.
    full: frozenset[int] = frozenset()

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each key is there, its position in its bucket)."""
        hit, at = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        bucket = keys % self.buckets
        for b in np.unique(bucket).tolist():
            if b not in self.full:
                continue
            held = mapped(f"{self.path}/{b}")["keys"]
            of = bucket == b
            at[of] = np.minimum(np.searchsorted(held, keys[of]), len(held) - 1)
            hit[of] = held[at[of]] == keys[of]
        return hit, at

    def value(self, name: str, key: int, at: int) -> np.ndarray:
        """The slice of a blob that belongs to a key that was found."""
        held = mapped(f"{self.path}/{key % self.buckets}")
        ends = held[f"{name}-ends"]
        return held[name][(ends[at - 1] if at else 0) : ends[at]]


def _write(to: Mapped) -> Callable:
    """Rows (bucket, key) or (bucket, key, blob) as the files of `to`; a task gathers one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}
        blobs = False
        for batch in batches:
            blobs = batch.num_columns > 2
            values = batch.column(2).to_pylist() if blobs else [b""] * batch.num_rows
            for b, key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), values, strict=True):
                held.setdefault(b, []).append((key, value))
        for b, rows in held.items():
            rows = sorted(dict(rows).items())
            arrays = {"keys": np.array([k for k, _ in rows], np.int64)}
            if blobs:
                arrays["blob-ends"] = np.cumsum([len(v) for _, v in rows], dtype=np.int64)
                arrays["blob"] = np.frombuffer(b"".join(v for _, v in rows), np.uint8)
            write_arrays(f"{to.path}/{b}", arrays)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32())], ["bucket"])

    return run


def _put(d: DataFrame, name: str, keep: bool = False) -> Mapped:
    """d (key, or key and blob) as mapped files in the shared folder; keep: they outlive their scope."""
    spark = d.sparkSession
    to = Mapped(new_path(spark, name, keep), max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    rows = d.select(F.pmod("key", F.lit(to.buckets)).cast("int").alias("bucket"), *d.columns)
    written = rows.repartitionById(to.buckets, F.col("bucket")).mapInArrow(_write(to), "bucket int")
    to.full = frozenset(r[0] for r in written.collect())  # a row a bucket
    return to


_BLOCK = "array<struct<node:int,key:long,drop:boolean,content:boolean,text:string>>"
_SLOT = "array<struct<node:int,key:long,chars:long,linked:long>>"


def _blocks(wrappers: Mapped) -> Callable:
    """Rows (page_id, url, html, host, host_key) with their page's hash, its blocks of text in order and its filled slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, list[Slot]] = {}
        numbers: dict[tuple[int, str], list[int]] = {}
        for batch in batches:
            keys = batch.column(4).to_numpy(zero_copy_only=False)
            _, at = wrappers.find(keys)
            pages, blocks, slots = [], [], []
            for html, key, k in zip(batch.column(2).to_pylist(), keys.tolist(), at.tolist(), strict=True):
                top = fold(parse(html or ""))
                own, shape = in_order(top), written(top)
                if len(numbers) > CACHED:
                    numbers.clear()
                    trees.clear()
                if (key, shape) not in numbers:
                    if key not in trees:
                        trees[key] = read_shape(bytes(wrappers.value("blob", key, k)).decode())
                    found = {id(p): w.number for p, w in align(top, trees[key][0])[1]}
                    numbers[key, shape] = [found.get(id(s), -1) for s in own]
                of_page, filled = [], []
                for slot, number in zip(own, numbers[key, shape], strict=True):
                    parts = [(*p, n) for n in slot.nodes for p in n.parts]
                    if parts:
                        parts.sort(key=lambda p: p[0])
                        code = _hash(f"{key}\n{number}\n" + "\n".join(p[1] for p in parts))
                        filled.append((number, code, sum(len(p[1]) for p in parts), sum(p[2] for p in parts)))
                        of_page += [(order, number, code, n.boilerplate, n.content, text) for order, text, _, n in parts]
                of_page.sort(key=lambda p: p[0])
                pages.append(_hash(html or ""))
                blocks.append(of_page)
                slots.append(filled)
            yield _blocks_batch(batch, pages, blocks, slots)

    return run


def _lists(rows: list[list[tuple]], names: list[str], kinds: list[pa.DataType], first: int = 0) -> pa.Array:
    flat = [x for r in rows for x in r]
    ends = np.cumsum([0, *(len(r) for r in rows)])
    columns = [pa.array([x[first + k] for x in flat], kind) for k, kind in enumerate(kinds)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names))


def _blocks_batch(batch: pa.RecordBatch, pages: list, blocks: list, slots: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            *[batch.column(k) for k in (0, 1, 3, 4)],
            pa.array(pages, pa.int64()),
            _lists(blocks, ["node", "key", "drop", "content", "text"], [pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()], 1),
            _lists(slots, ["node", "key", "chars", "linked"], [pa.int32(), pa.int64(), pa.int64(), pa.int64()]),
        ],
        ["page_id", "url", "host", "host_key", "page", "blocks", "slots"],
    )


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, blob), the first and last node of each host, from (host_key, shape, plain: (node, characters) pairs)."""
    for batch in batches:
        found = [region(read_shape(shape), {p["node"]: p["chars"] for p in plain}) for shape, plain in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(f, np.int32).tobytes() for f in found], pa.binary())], ["key", "blob"])


def _chosen(template: Mapped, regions: Mapped) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = batch.column(2).to_numpy(zero_copy_only=False)
            known, at = regions.find(hosts)
            bounds = np.tile(np.array([0, np.iinfo(np.int32).max], np.int64), (len(hosts), 1))
            for k in np.flatnonzero(known).tolist():
                bounds[k] = np.frombuffer(bytes(regions.value("blob", int(hosts[k]), int(at[k]))), np.int32)
            blocks = batch.column(3)
            ends = blocks.offsets.to_numpy()
            flat = blocks.values.slice(ends[0], ends[-1] - ends[0]).flatten()
            node, key, drop, content = (flat[k].to_numpy(zero_copy_only=False) for k in range(4))
            row = np.repeat(np.arange(len(hosts)), np.diff(ends))
            around = (node >= 0) & ((node < bounds[row, 0]) | (node > bounds[row, 1]))
            keep = ~drop & (content | ~(around | template.find(key)[0]))
            texts = flat[4].filter(pa.array(keep)).to_pylist()
            upto = np.concatenate([[0], np.cumsum(keep)])[ends - ends[0]].tolist()
            joined = [" ".join(texts[a:b]) for a, b in zip(upto[:-1], upto[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(joined, pa.string())], ["page_id", "url", "text"])

    return run


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def induce(pages: DataFrame) -> DataFrame:
    """(host, host_key, shape): each host's wrapper. The distinct shapes of a host are merged in PARTS
    parts first, so that no task holds a large host's."""
    d = pages.select(host_of(F.col("url")).alias("host"), F.col("html"))
    part = F.pmod(F.xxhash64("shape"), F.lit(PARTS))
    shapes = d.mapInArrow(_shapes, "host string, shape string").distinct().select("host", part.alias("part"), "shape")
    parts = shapes.repartition("host", "part").sortWithinPartitions("host", "part", "shape").mapInArrow(_merged, "host string, shape string")
    whole = parts.select("host", F.lit(0).alias("part"), "shape").repartition("host").sortWithinPartitions("host", "part", "shape")
    return stored(whole.mapInArrow(_merged, "host string, shape string").select("host", F.xxhash64("host").alias("host_key"), "shape"), "wrappers")


def template_of(blocks: DataFrame, wrappers: DataFrame) -> tuple[Mapped, Mapped]:
    """(keys of repeating texts at template nodes, regions by host) from the slots that pages fill."""
    again = F.col("pages") >= LEAST_PAGES
    votes = blocks.select("host_key", "page", F.explode("slots").alias("s")).select("host_key", "page", "s.*")
    votes = votes.groupBy("host_key", "node", "key", "page").agg(F.max("chars").alias("chars"), F.max("linked").alias("linked"))
    texts = votes.groupBy("host_key", "node", "key").agg(F.count("*").alias("pages"), F.max("chars").alias("chars"), F.max("linked").alias("linked"))
    texts = stored(texts, "votes")
    plain = F.sum(F.when(~again, F.greatest(F.col("chars") - F.col("linked"), F.lit(0))))
    nodes = texts.groupBy("host_key", "node").agg(F.sum("pages").alias("all"), F.sum(F.when(again, F.col("pages"))).alias("repeating"), F.coalesce(plain, F.lit(0)).alias("chars"))
    nodes = stored(nodes, "votes-by-node")
    constant = nodes.where(F.col("repeating") >= REPEATING * F.col("all")).select("host_key", "node")
    template = _put(texts.where(again).join(constant, ["host_key", "node"]).select("key").distinct(), "template", keep=True)
    many = blocks.select("host_key", "page").distinct().groupBy("host_key").agg(F.count("*").alias("n")).where(F.col("n") >= REGION_PAGES).select("host_key")
    filled = nodes.where("node >= 0 and chars > 0").groupBy("host_key").agg(F.collect_list(F.struct("node", "chars")).alias("plain"))  # no more than a wrapper's nodes
    found = wrappers.join(many, "host_key").join(filled, "host_key").select("host_key", "shape", "plain")
    return template, _put(found.mapInArrow(_regions, "key long, blob binary"), "regions", keep=True)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row."""
    d = pages.select(F.col("page_id"), F.col("url"), F.col("html"), host_of(F.col("url")).alias("host"))
    kind = d.schema[0].dataType.simpleString()
    with scope(pages.sparkSession):
        wrappers = induce(pages)
        lookup = _put(wrappers.select(F.col("host_key").alias("key"), F.encode("shape", "UTF-8").alias("blob")), "wrapper-files")
        rows = d.withColumn("host_key", F.xxhash64("host")).mapInArrow(_blocks(lookup), f"page_id {kind}, url string, host string, host_key long, page long, blocks {_BLOCK}, slots {_SLOT}")
        blocks = stored(rows, "blocks", keep=True)
        template, regions = template_of(blocks, wrappers)
    return blocks.select("page_id", "url", "host_key", "blocks").mapInArrow(_chosen(template, regions), f"page_id {kind}, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
