"""Operator 4, n-gram Jaccard join: a grouped prefix join over distinct 5-word shingles.

1. A count sketch of fixed size (2**22 cells) over all shingles gives every shingle a frequency
   class; (class, hash) is the global order, rarest first, so that shared passages leave the prefixes.
2. Each document becomes (set size, digest of its set, prefix). Equal sets are one node; nodes of
   equal prefix and size are one group. Only groups meet each other.
3. Prefix tokens are dealt and sorted by token. Short runs of a token give all group pairs, long runs a
   star around their first group, and are put by. How many prefix tokens a pair shares bounds its
   whole intersection; pairs and sizes that cannot reach the threshold are left out.
4. Pairs are expanded to member nodes and verified exactly on whole sets; linked nodes are joined
   into components. What was put by then gives the pairs that still lie in different components,
   so that a run of thousands of near copies costs a star and not its square, and no link between
   components is lost.

Texts are hashed again for the sets of candidates only (step 4), which costs less than storing the
sets of all documents.

Defined results: a null or empty text, or one without words, has no shingles and is its own
component; with fewer than five words the whole sequence is the one shingle; repeated rows give
repeated results; a null id takes part as a text, but is no component's id unless the component has
no other; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import textcore
from loomgraph.llm.common import scope, stored, table

WORDS = 5
PERCENT = 75  # two sets link when 100 * |intersection| >= PERCENT * |union|
SKETCH_BITS = 22
BLOCKS = 64
#: Runs of a prefix token up to this length give all their pairs at once.
SHORT_RUN = 4
#: Pairs of a hub that meet one copy of its set.
HUB_PAIRS = 512
#: Groups up to this size give all pairs of their members; larger ones pairs that share a token behind the prefix.
SMALL_GROUP = 16
#: Bits of the candidate filter: 8 MB to each executor, whatever the input.
FILTER_BITS = 26
#: Rows of a run that are held before it is dealt with in pieces.
RUN_ROWS = 1 << 16
#: How many open tokens before one are looked at for a token that a pair already shares.
LOOK_BACK = 16


def shingles(h: np.ndarray, rows: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, first shingle of each row and one more); repeats are still in."""
    g = textcore.windows(h, k)
    n = np.diff(rows)
    keep = np.ones(len(h), bool)
    for j in range(1, k):
        last = rows[1:] - j
        keep[last[n >= j]] = False
    for d in np.flatnonzero((n > 0) & (n < k)):
        keep[rows[d]] = True
        g[rows[d]] = textcore.windows(h[rows[d] : rows[d + 1]], int(n[d]))[0]
    at = np.concatenate([[0], np.cumsum(keep)])
    return g[keep], at[rows]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, np.int32)
    for batch in batches:
        for _, data, offsets in textcore.chunks(batch.column(0)):
            g, _ = shingles(*textcore.words(data, offsets))
            np.add.at(counts, (g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
    for b, part in enumerate(np.split(counts, BLOCKS)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])], ["block", "counts"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(blob), np.int32)
            total[b] = total[b] + part if b in total else part.astype(np.int64)
    for b, part in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.floor(np.log2(part + 1)).astype(np.uint8).tobytes()])], ["block", "classes"])


def frequency_classes(docs: DataFrame, text_col: str) -> np.ndarray:
    """log2 of each sketch cell's count, over all documents: 4 MB, whatever the input."""
    parts = docs.select(text_col).mapInArrow(textcore.lean(_sketch), "block int, counts binary")
    merged = parts.repartition(BLOCKS, "block").mapInArrow(_merge, "block int, classes binary")
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    size = len(out) // BLOCKS
    for b, classes in merged.collect():
        out[b * size : (b + 1) * size] = np.frombuffer(classes, np.uint8)
    return out


def _sets(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles of each row as (class, hash) in the global order, first of each row and one more)."""
    g, at = shingles(*textcore.words(data, offsets))
    key = (classes[(g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (g >> np.uint64(6))
    for d in range(len(at) - 1):
        key[at[d] : at[d + 1]].sort()
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    first[at[:-1][at[:-1] < at[1:]]] = True
    upto = np.concatenate([[0], np.cumsum(first)])
    return key[first], upto[at]


def _digest(key: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order-free 64-bit digest of key[at:end] of each row, with its length."""
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textcore.mix(key + np.uint64(1)))])
    return textcore.mix((run[ends] - run[at]) ^ textcore.mix((ends - at).astype(np.uint64)))


def prefix_length(n: np.ndarray) -> np.ndarray:
    """Tokens of a set of n of which at least one is in the prefix of any set that links with it."""
    return np.where(n > 0, n - (PERCENT * n + 99) // 100 + 1, 0)


def _signatures(classes: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in textcore.chunks(batch.column(1)):
                key, at = _sets(data, offsets, classes.value)
                n = np.diff(at)
                p = prefix_length(n)
                node = _digest(key, at[:-1], at[1:])
                group = textcore.mix(_digest(key, at[:-1], at[:-1] + p) + n.astype(np.uint64))
                where = np.concatenate([[0], np.cumsum(p)])
                take = np.repeat(at[:-1] - where[:-1], p) + np.arange(where[-1])
                tokens = pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(key[take].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(n)), pa.array(n, pa.int64()), pa.array(node.view(np.int64)), pa.array(group.view(np.int64)), tokens], ["id", "n", "node", "grp", "prefix"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (token, position << 32 | n, group) in order: kind 0: group pairs (x, y) and how
    many short runs they share; kind 1: rows put by, of long runs.

    The first group of a run is its hub. That is where the token stands first, after the fewest rarer
    ones: among near copies the one with the fewest changes, which most of the others link with."""
    held: np.ndarray = np.zeros((3, 0), np.int64)
    long_run = False

    def emit(rows: np.ndarray, starts_long: bool, ends_long: bool) -> Iterator[pa.RecordBatch]:
        token, packed, group = rows
        if len(token) < 2 and not starts_long and not ends_long:
            return
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (packed[1:] != packed[:-1]) | (group[1:] != group[:-1])
        token, packed, group = token[new], packed[new], group[new]
        head = np.ones(len(token), bool)
        head[1:] = token[1:] != token[:-1]
        start = np.flatnonzero(head)
        length = np.diff(np.append(start, len(token)))
        run_length, hub = np.repeat(length, length), np.repeat(start, length)
        put_by = run_length > SHORT_RUN
        if starts_long and len(token):
            put_by |= token == token[0]
        if ends_long and len(token):
            put_by |= token == token[-1]
        at = np.arange(len(token))
        a, b, shared = [], [], []
        for s in range(1, SHORT_RUN):
            ok = ~put_by[s:] & (token[s:] == token[:-s])
            a.append(at[:-s][ok])
            b.append(at[s:][ok])
            shared.append(np.ones(len(a[-1]), np.int64))
        star = put_by & (hub != at)
        a.append(hub[star])
        b.append(at[star])
        shared.append(np.zeros(len(a[-1]), np.int64))
        x, y, n = np.concatenate(a), np.concatenate(b), np.concatenate(shared)
        ok = group[x] != group[y]
        lo, hi = np.minimum(group[x[ok]], group[y[ok]]), np.maximum(group[x[ok]], group[y[ok]])
        if len(lo):
            order = np.lexsort((hi, lo))
            lo, hi, n = lo[order], hi[order], n[ok][order]
            one = np.flatnonzero(np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
            count = np.add.reduceat(n, one)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(one), np.int32)), pa.array(lo[one]), pa.array(hi[one]), pa.array(count)], ["kind", "x", "y", "z"])
        if put_by.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(int(put_by.sum()), np.int32)), pa.array(token[put_by]), pa.array(packed[put_by]), pa.array(group[put_by])], ["kind", "x", "y", "z"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate([held, np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])], 1)
        cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))  # the last run may go on
        if cut:
            yield from emit(rows[:, :cut], long_run, False)
            held, long_run = rows[:, cut:], False
        else:
            held = rows
        if held.shape[1] > RUN_ROWS:
            yield from emit(held, long_run, True)
            held, long_run = held[:, [0]], True  # its hub goes on
    yield from emit(held, long_run, False)


def _candidate_sets(classes: object, wanted: object) -> Callable:
    """(node, items) of the documents whose id and set are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id, by_node = (np.frombuffer(w, np.uint8) for w in wanted.value)
        for batch in batches:
            cell = batch.column(0).to_numpy(zero_copy_only=False)
            rows = batch.column(1).filter(pa.array((by_id[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1))
            for _, data, offsets in textcore.chunks(rows):
                key, at = _sets(data, offsets, classes.value)
                node = _digest(key, at[:-1], at[1:])
                cell = (node & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
                hit = (by_node[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
                items = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(key.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), items], ["node", "items"]).filter(pa.array(hit))

    return run


def _filter_bits(cells: DataFrame) -> bytes:
    """A bit for each cell c of 2**FILTER_BITS that occurs: of fixed size, built in Spark."""
    parts = cells.groupBy(F.floor(F.col("c") / 32768).cast("int").alias("b")).agg(F.bitmap_construct_agg(F.pmod(F.col("c"), F.lit(32768))).alias("m"))
    out = bytearray((1 << FILTER_BITS) // 8)
    for b, m in parts.collect():
        out[b * 4096 : b * 4096 + len(m)] = m
    return bytes(out)


def _sets_of(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, classes: object, id_col: str, text_col: str) -> DataFrame:
    """(node, items) of the wanted nodes (node), written: a set a node, however many rows hold its text."""
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))
    ids = nodes.join(wanted, "node", "left_semi").select(cell("id").alias("c"))
    bits = [_filter_bits(ids), _filter_bits(wanted.select(F.pmod("node", F.lit(1 << FILTER_BITS)).alias("c")))]
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    rows = docs.select(cell(id_col).alias("c"), F.col(text_col).alias("t"))
    sets = rows.mapInArrow(textcore.lean(_candidate_sets(classes, sent)), "node long, items array<long>")
    return stored(sets.groupBy("node").agg(F.first("items").alias("items")), "sets")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, classes: object, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets link. Sets are built for candidates only. Hubs, which many
    pairs name, all stand on side a; their pairs are dealt to as many salts as HUB_PAIRS asks for, and a hub's set
    goes once to each, so one task has at most about that many of its pairs."""
    degree = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count(), "degrees")
    d = pairs.join(degree.select(F.col("node").alias("a"), F.col("count").alias("da")), "a").join(degree.select(F.col("node").alias("b"), F.col("count").alias("db")), "b")
    swap = F.col("da") < F.col("db")
    salts = lambda n: F.ceil(n / F.lit(HUB_PAIRS))
    d = d.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), salts(F.greatest("da", "db")).alias("salts"))
    d = d.select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    sets = _sets_of(degree.select("node"), docs, nodes, classes, id_col, text_col)
    one = d.join(sets.select(F.col("node").alias("b"), F.col("items").alias("ib")), "b")
    copies = sets.join(degree, "node").select(F.col("node").alias("a"), F.col("items").alias("ia"), F.explode(F.sequence(F.lit(0).cast("long"), salts(F.col("count")) - 1)).alias("salt"))
    both = one.join(copies, ["a", "salt"])
    common = F.size(F.array_intersect("ia", "ib")).cast("long")
    union = F.size("ia").cast("long") + F.size("ib").cast("long") - common
    return both.select("a", "b", common.alias("c"), union.alias("u")).where(100 * F.col("c") >= PERCENT * F.col("u")).select("a", "b")


def pairs_inside(split: DataFrame, docs: DataFrame, nodes: DataFrame, classes: object, id_col: str, text_col: str) -> DataFrame:
    """Pairs (a, b) that may link, of nodes (node, grp, n, root) of one group and different roots.

    Members have size n and prefix p in common, so what links shares need = ceil(PERCENT * 2n / (100 + PERCENT)) tokens in
    all, and one at least among any n - need + 1 that stand first behind the prefix in an order of the group's
    own. That order is by how many members hold a token, so that what all have in common stands last. Groups of
    SMALL_GROUP nodes at most, which have fewer pairs than tokens, go without."""
    sized = split.join(split.groupBy("grp").agg(F.count("*").alias("m")), "grp")

    def met(d: DataFrame, *on: str) -> DataFrame:
        p, q = (d.select(*on, F.col("node").alias(k), F.col("root").alias(f"r{k}")) for k in "ab")
        return p.join(q, list(on)).where("a < b and ra <> rb").select("a", "b").distinct()

    few = met(sized.where(F.col("m") <= SMALL_GROUP), "grp")
    many = stored(sized.where(F.col("m") > SMALL_GROUP), "many")
    if many.isEmpty():
        return few
    sets = _sets_of(many.select("node").distinct(), docs, nodes, classes, id_col, text_col)
    n = F.col("n")
    prefix = (n - F.ceil(PERCENT * n / F.lit(100)) + 1).cast("int")
    behind = (n - F.ceil(2 * PERCENT * n / F.lit(100 + PERCENT)) + 1).cast("int")
    tokens = stored(many.join(sets, "node").select("grp", "node", "root", behind.alias("behind"), F.explode(F.slice("items", prefix + 1, n.cast("int"))).alias("token")), "behind")
    held = tokens.groupBy("grp", "token").agg(F.count("*").alias("f"))
    order = F.sort_array(F.collect_list(F.struct("f", "token")))
    tokens = tokens.join(held, ["grp", "token"]).groupBy("grp", "node", "root", "behind").agg(order.alias("order"))
    tokens = stored(tokens.select("grp", "node", "root", F.explode(F.slice("order", F.lit(1), F.col("behind"))["token"]).alias("token")), "first")
    apart = tokens.groupBy("grp", "token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("grp", "token")
    return few.unionByName(met(tokens.join(apart, ["grp", "token"], "left_semi"), "grp", "token"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge: alternating large and small stars until nothing
    changes; each round is a few aggregations and joins over the edges, written to the shared folder."""
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), "edges")
    state = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")), "least").select(F.col("u"), F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now


def can_link(met: Column, na: Column, nb: Column) -> Column:
    """Whether sets of na and nb that share at most `met` prefix tokens can link: beyond the prefixes they
    share at most what one of them holds there."""
    beyond = lambda n: F.ceil(PERCENT * n / F.lit(100)) - 1
    need = F.ceil(PERCENT * (na + nb) / F.lit(100 + PERCENT))
    return (met + F.greatest(beyond(na), beyond(nb)) >= need) & (need <= F.least(na, nb))


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id), a row for each row of docs."""
    with scope(docs.sparkSession):
        return _clustered(docs, id_col, text_col)


def _clustered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    d = docs.select(F.col(id_col), F.col(text_col))
    classes = spark.sparkContext.broadcast(frequency_classes(d, text_col))
    id_type = d.schema[0].dataType.simpleString()
    sig = stored(d.mapInArrow(textcore.lean(_signatures(classes)), f"id {id_type}, n long, node long, grp long, prefix array<long>"), "signatures", keep=True)
    nodes = stored(sig.where("n > 0").groupBy("node", "n", "grp").agg(F.min("id").alias("id")), "nodes")

    tokens = sig.where("n > 0").select("grp", "n", F.posexplode("prefix").alias("i", "token")).select("token", (F.shiftleft(F.col("i").cast("long"), 32) + F.col("n")).alias("packed"), "grp")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = tokens.repartition(parts, "token").sortWithinPartitions("token", "packed", "grp")
    found = stored(dealt.mapInArrow(textcore.lean(_runs), "kind int, x long, y long, z long"), "runs")
    met = stored(found.where("kind = 0").groupBy("x", "y").agg(F.sum("z").alias("met")), "met")
    put_by = found.where("kind = 1").select(F.col("x").alias("token"), F.shiftright("y", 32).alias("i"), F.col("z").alias("grp")).distinct()
    put_by = stored(put_by, "put_by")

    # first round: a star in each group, and the first nodes of groups that met often enough
    long_runs = put_by.groupBy("grp").agg(F.count("*").alias("long"))
    first = nodes.groupBy("grp", "n").agg(F.min("node").alias("first"), F.count("*").alias("m")).join(long_runs, "grp", "left")
    first = stored(first.withColumn("long", F.coalesce("long", F.lit(0))), "groups")
    inside = nodes.join(first.where("m > 1").select("grp", "first"), "grp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    side = lambda g, c: first.select(F.col("grp").alias(g), F.col("first").alias(c), F.col("n").alias(f"n{c}"), F.col("long").alias(f"l{c}"))
    across = met.join(side("x", "a"), "x").join(side("y", "b"), "y").where(can_link(F.col("met") + F.least("la", "lb"), F.col("na"), F.col("nb"))).select("a", "b")
    tried = stored(inside.unionByName(across).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    links = stored(verified(tried, d, nodes, classes, id_col, text_col), "links")
    roots = components(links)

    # second round: whatever met and still lies in different components
    at = stored(nodes.join(roots, "node", "left").select("node", "grp", "n", "id", F.coalesce("root", "node").alias("root")), "rooted")
    wide = at.groupBy("grp").agg(F.count("*").alias("m"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    wide = stored(wide, "wide")
    split = at.join(wide.where("m > 1 and r0 <> r1").select("grp"), "grp", "left_semi")
    inside = pairs_inside(split, d, nodes, classes, id_col, text_col)
    some = met.join(wide.where("m > 1").select(F.col("grp").alias("x"), F.lit(1).alias("wx")), "x", "left").join(wide.where("m > 1").select(F.col("grp").alias("y"), F.lit(1).alias("wy")), "y", "left").where("wx = 1 or wy = 1").select("x", "y")
    across = some.join(at.select(F.col("grp").alias("x"), F.col("node").alias("a"), F.col("root").alias("ra")), "x").join(at.select(F.col("grp").alias("y"), F.col("node").alias("b"), F.col("root").alias("rb")), "y").where("ra <> rb").select("a", "b")
    put_by = put_by.join(wide.select("grp", "r0", "r1"), "grp")
    open_tokens = put_by.groupBy("token").agg(F.min("r0").alias("r0"), F.max("r1").alias("r1")).where("r0 <> r1").select("token")
    opened = stored(put_by.select("token", "i", "grp").join(open_tokens, "token", "left_semi"), "open")
    # what a group can share with any one other: its open tokens, and the most short runs of any pair
    own = opened.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("i", "token"))).alias("run"))
    most = met.select(F.explode(F.array("x", "y")).alias("grp"), "met").groupBy("grp").agg(F.max("met").alias("s"))
    size = at.join(own, "grp").join(most, "grp", "left").select("grp", "node", "root", "n", F.size("run").alias("o"), F.coalesce("s", F.lit(0)).alias("s"), "run")
    shared = size.select("node", "root", "n", "o", "s", F.col("run.token").alias("run"), F.posexplode("run").alias("k", "t"))
    before = F.slice("run", F.greatest(F.col("k") - (LOOK_BACK - 1), F.lit(1)), F.least(F.col("k"), F.lit(LOOK_BACK)))
    still = stored(shared.select(F.col("t.token").alias("token"), "node", "root", "n", "o", "s", F.col("t.i").alias("i"), before.alias("before")), "still")
    main = still.groupBy("token", "root").agg(F.count("*").alias("m")).groupBy("token").agg(F.max_by("root", F.struct("m", "root")).alias("main"))
    still = still.join(main, "token").withColumn("stray", F.col("root") != F.col("main")).drop("main")
    p, q = (still.select("token", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "root", "n", "o", "s", "i", "before", "stray")]) for k in "ab")
    na, nb, short = F.col("n_a"), F.col("n_b"), F.least("s_a", "s_b")
    # each pair of different roots once: a stray with the main component, or two strays in order; and not at
    # a token before which it shares one. All that it shares from its first open token on is behind it.
    once = (F.col("root_a") != F.col("root_b")) & (~F.col("stray_b") | (F.col("node_a") < F.col("node_b"))) & ~F.arrays_overlap("before_a", "before_b")
    behind = F.least(na - F.col("i_a"), nb - F.col("i_b")) + short
    meet = once & can_link(F.least("o_a", "o_b") + short, na, nb) & (behind >= F.ceil(PERCENT * (na + nb) / F.lit(100 + PERCENT)))
    runs = p.where("stray_a").join(q, "token").where(meet).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    rest = inside.unionByName(across).unionByName(runs).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = stored(rest.join(tried, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = verified(rest, d, nodes, classes, id_col, text_col)
        roots = components(links.unionByName(more))
    least = nodes.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    named = stored(least.groupBy("root").agg(F.min("id").alias("component_id")), "named")
    by_node = stored(least.join(named, "root").select("node", "component_id"), "components", keep=True)
    out = sig.select("id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(by_node, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component its document of smallest id stays, with all its columns; documents without
    an id or without words stay too. Rows of one id are one document."""
    gone = cluster(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti")
