"""Operator 2, approximate nearest neighbours: Gaussian (2-stable) projections to a few dimensions,
indexed by kd-trees, searched until a chi-square test holds.

For a row at distance d from a query the squared projected distance is d**2 times a chi-square
variable of M degrees. If t is its quantile PROBABILITY, a neighbour nearer than the k-th found so
far (d_k) lies within t * d_k**2 in projection with at least that probability: search ends there.

Equal vectors are one entry with its smallest ids, k + 1 at most, which is exact as ties go to
smaller ids; so neither a hot vector nor its queries meet in pairs. A kd-tree over a bounded sample
cuts the projected space into cells, one for each `part_rows` entries; every entry is then dealt to its
cell, and large cells into parts of about part_rows. A query searches in three rounds, each with the d_k of the
one before: its own cell, then the NEAR next ones by distance in projection, then all others within its radius,
which it finds by going down the tree. Each (part, block of queries) is a task's group of bounded size, in which
leaves come in the order of their distance until the test holds, and only rows within the radius are verified.

M and PROBABILITY are by measurement (README): how many cells a radius touches is the data's matter, as
distances of equal size, d_10 close to the median, leave no room between cells; what the test then saves is verifying.

Defined results: vectors that are null, zero, of another length than `dim` (by default the length that
most have), or with null or non-finite components take no part, as queries or as candidates; a null id takes no part; a query
with fewer candidates than k gets them all; repeated (id, vector) rows are one; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import scope, stored, table

K = 10
M = 24  # even: the chi-square distribution then has a closed form
PROBABILITY = 0.95
#: Cells of the second round.
NEAR = 8
#: Entries that the cells are cut on, a cell: those of smallest hash.
SAMPLE_A_CELL = 16
LEAST_SAMPLE = 1024
#: Of more entries the cells are larger, and have several parts; the driver's arrays stay below 100 MB.
MOST_SAMPLE = 1 << 18
PART_ROWS = 4096
BLOCK_QUERIES = 2048
LEAF = 64
#: Queries that go down the tree together.
REACH_ROWS = 256


def chi_square_quantile(p: float, m: int = M) -> float:
    """The x below which a chi-square variable of m (even) degrees falls with probability p."""

    def cdf(x: float) -> float:
        term = total = 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - np.exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def kd_leaves(points: np.ndarray, most: int, leaf: int) -> list[np.ndarray]:
    """The indices in each leaf of `kd_tree`."""
    return kd_tree(points, most, leaf)[1]


def kd_tree(points: np.ndarray, most: int, leaf: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(tree, indices of the points in each leaf): the largest leaf is halved at the median of its widest
    dimension until leaves have `leaf` points or there are `most`. A row of the tree is (dimension, cut,
    left, right); a point at the cut goes left. Leaf k stands as -1 - k; a tree of one leaf has no rows."""
    m = points.shape[1]
    rows: list[list[float]] = []
    done: list[np.ndarray] = []
    heap: list[tuple[int, int, np.ndarray, int, int]] = [(-len(points), 0, np.arange(len(points)), -1, 0)]  # (-size, order, indices, row and side above)
    order = 1

    def put(above: int, side: int, value: float) -> None:
        if above >= 0:
            rows[above][2 + side] = value

    while heap:
        _, _, at, above, side = heapq.heappop(heap)
        spread = points[at].max(0) - points[at].min(0) if len(at) else np.zeros(m)
        if len(heap) + len(done) + 1 >= most or len(at) <= leaf or spread.max() <= 0:
            put(above, side, -1.0 - len(done))
            done.append(at)
            continue
        dim = int(spread.argmax())
        cut = float(np.median(points[at, dim]))
        left = points[at, dim] <= cut
        if left.all():
            left = points[at, dim] < cut
            cut = float(points[at[left], dim].max())
        put(above, side, float(len(rows)))
        rows.append([float(dim), cut, 0.0, 0.0])
        for k, part in enumerate((at[left], at[~left])):
            heapq.heappush(heap, (-len(part), order, part, len(rows) - 1, k))
            order += 1
    return np.array(rows, float).reshape(-1, 4), done


@dataclass
class Cells:
    """Projection, and the tree of cells: 32 bytes a cell."""

    matrix: np.ndarray
    tree: np.ndarray

    def project(self, v: np.ndarray) -> np.ndarray:
        return v @ self.matrix

    def home(self, p: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out = np.zeros(len(p), np.int32)
        if not len(self.tree):
            return out
        at, todo = np.zeros(len(p), np.int64), np.arange(len(p))
        while len(todo):
            row = self.tree[at[todo]]
            right = p[todo, row[:, 0].astype(np.int64)] > row[:, 1]
            below = np.where(right, row[:, 3], row[:, 2]).astype(np.int64)
            out[todo[below < 0]] = (-1 - below[below < 0]).astype(np.int32)
            at[todo] = below
            todo = todo[below >= 0]
        return out

    def within(self, p: np.ndarray, radius2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, cell, squared distance) of the cells whose squared distance from a point is no more than its radius2."""
        if not len(self.tree):
            return np.arange(len(p)), np.zeros(len(p), np.int32), np.zeros(len(p))
        who, at = np.arange(len(p)), np.zeros(len(p), np.int64)
        gap = np.zeros((len(p), p.shape[1]))  # distance in each dimension, by the cuts gone past
        found = []
        while len(who):
            row = self.tree[at]
            dim = row[:, 0].astype(np.int64)
            over = p[who, dim] - row[:, 1]
            each = np.arange(len(who))
            parts = []
            for side, off in ((2, np.maximum(over, 0)), (3, np.maximum(-over, 0))):
                g = gap.copy()
                g[each, dim] = np.maximum(g[each, dim], off)
                ok = (g**2).sum(1) <= radius2[who]
                parts.append((who[ok], row[ok, side].astype(np.int64), g[ok]))
            who, at, gap = (np.concatenate(x) for x in zip(*parts, strict=True))
            leaf = at < 0
            found.append((who[leaf], (-1 - at[leaf]).astype(np.int32), (gap[leaf] ** 2).sum(1)))
            who, at, gap = who[~leaf], at[~leaf], gap[~leaf]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vec_col: str, dim: int | None = None) -> tuple[DataFrame, int]:
    """(id, v as array<double>) of the vectors that take part, and their length: dim, or that which most have."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    d = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    d = d.where(F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    if dim is None:
        most = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dim = most[0] if most else 0
    return d.where(F.size("v") == dim), dim


def _place(shared: object, dim: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = shared.value.home(shared.value.project(_matrix(batch.column(1), dim)))
            yield pa.RecordBatch.from_arrays([pa.array(cells), *batch.columns], ["cell", *batch.schema.names])

    return run


def _projected(matrix: np.ndarray, dim: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = (_matrix(batch.column(0), dim) @ matrix).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * M, pa.int32()), pa.array(p.ravel()))], ["p"])

    return run


def _reach(shared: object, dim: int, quantile: float, near: int | None) -> Callable:
    """(cell, query, v, limit) for the cells within a query's radius, but its own: the NEAR nearest, or with
    near None all but those. A smaller radius leaves out the last cells, so the nearest are the same ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = shared.value
            p = cells.project(_matrix(batch.column(1), dim))
            radius2 = quantile * batch.column(2).to_numpy(zero_copy_only=False) ** 2
            home = cells.home(p)
            for k in range(0, len(p), REACH_ROWS):
                row, cell, gap = cells.within(p[k : k + REACH_ROWS], radius2[k : k + REACH_ROWS])
                other = cell != home[k + row]
                row, cell, gap = row[other] + k, cell[other], gap[other]
                order = np.lexsort((cell, gap, row))
                row, cell = row[order], cell[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                some = place < NEAR if near is not None else place >= NEAR
                row, cell = row[some], cell[some]
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(cell), *[c.take(at) for c in batch.columns]], ["cell", *batch.schema.names])

    return run


def _search(shared: object, dim: int, k: int, quantile: float) -> Callable:
    """Incremental search of one part for one block of queries. left: entries (v, ids); right: (key, v, limit)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_id, out_d = [], [], []
        if left.num_rows and right.num_rows:
            v = _matrix(left.column("v"), dim)
            ids = left.column("ids").to_pylist()
            p = shared.value.project(v)
            leaves = kd_leaves(p, 1 << 30, LEAF)
            low = np.array([p[a].min(0) for a in leaves])
            high = np.array([p[a].max(0) for a in leaves])
            sizes = np.array([len(x) for x in ids])
            qv = _matrix(right.column("v"), dim)
            qp = shared.value.project(qv)
            for j, (key, limit) in enumerate(zip(right.column("key").to_pylist(), right.column("limit").to_pylist(), strict=True)):
                bound = (np.maximum(np.maximum(low - qp[j], qp[j] - high), 0) ** 2).sum(1)
                limit2 = np.inf if limit is None else limit * limit
                found_d, found_at = np.zeros(0), np.zeros(0, np.int64)
                for leaf in np.argsort(bound, kind="stable"):
                    if bound[leaf] > quantile * limit2:  # the chi-square test holds for all that is left
                        break
                    at = leaves[leaf]
                    at = at[((p[at] - qp[j]) ** 2).sum(1) <= quantile * limit2]
                    d = ((v[at] - qv[j]) ** 2).sum(1)
                    keep = d <= limit2
                    found_d, found_at = np.concatenate([found_d, d[keep]]), np.concatenate([found_at, at[keep]])
                    order = np.argsort(found_d, kind="stable")
                    enough = np.searchsorted(np.cumsum(sizes[found_at[order]]), k)
                    if enough < len(order):
                        limit2 = min(limit2, found_d[order[enough]])
                        stay = found_d <= limit2
                        found_d, found_at = found_d[stay], found_at[stay]
                best = sorted((d, i) for d, a in zip(found_d.tolist(), found_at.tolist(), strict=True) for i in ids[a])[:k]
                out_q += [key] * len(best)
                out_id += [i for _, i in best]
                out_d += [float(np.sqrt(d)) for d, _ in best]
        return pa.table({"key": pa.array(out_q, pa.int64()), "id": pa.array(out_id, pa.int64()), "score": pa.array(out_d, pa.float64())})

    return run


def _blocks(index: DataFrame, visits: DataFrame, run: Callable) -> DataFrame:
    """index (part, v, ids) and visits (part, key, v, limit), grouped by part and block of queries."""
    visits = stored(visits, "visits")
    count = visits.groupBy("part").agg(F.ceil(F.count("*") / F.lit(BLOCK_QUERIES)).cast("int").alias("n"))
    count = stored(count, "blocks")
    left = index.join(count, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"), "v", "ids")
    right = visits.join(count, "part").select("part", F.pmod(F.xxhash64("key"), F.col("n")).cast("int").alias("block"), "key", "v", "limit")
    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(run, "key long, id long, score double")


def search(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", probability: float = PROBABILITY, seed: int = 11, part_rows: int = PART_ROWS, dim: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every row for which is_query, a test of column `id`, holds."""
    with scope(vectors.sparkSession):
        return _searched(vectors, is_query, k, id_col, vec_col, probability, seed, part_rows, dim)


def _searched(vectors: DataFrame, is_query: Column, k: int, id_col: str, vec_col: str, probability: float, seed: int, part_rows: int, dim: int | None) -> DataFrame:
    spark = vectors.sparkSession
    d, dim = usable(vectors, id_col, vec_col, dim)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    kept = d.distinct().withColumn("r", first).where(F.col("r") <= k + 1)
    entries = stored(kept.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("key", F.element_at("ids", 1)), "entries")
    n = entries.count()
    cells = max(1, min(n // part_rows, MOST_SAMPLE // SAMPLE_A_CELL))
    matrix = np.random.default_rng(seed).standard_normal((dim, M))
    # of the entries those whose hash falls below a threshold, about SAMPLE_A_CELL a cell, as projections
    share = min(1.0, max(LEAST_SAMPLE, SAMPLE_A_CELL * cells) / max(n, 1))
    drawn = entries.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").mapInArrow(_projected(matrix, dim), "p array<float>")
    points = _matrix(drawn.toArrow().column(0), M)
    tree, _ = kd_tree(points, cells, 1)
    shared = spark.sparkContext.broadcast(Cells(matrix, tree))
    quantile = chi_square_quantile(probability)

    placed = stored(entries.select("v", "key", "ids").select("key", "v", "ids").mapInArrow(_place(shared, dim), "cell int, key long, v array<double>, ids array<long>"), "placed")
    sizes = {r[0]: -(-r[1] // part_rows) for r in placed.groupBy("cell").count().collect()}  # a row a cell
    start, parts = {}, 0
    for cell in sorted(sizes):
        start[cell], parts = parts, parts + sizes[cell]
    layout = spark.createDataFrame([(c, start[c], sizes[c]) for c in sorted(sizes)], "cell int, start int, n int")
    index = stored(placed.join(F.broadcast(layout), "cell").select((F.col("start") + F.pmod(F.xxhash64("key"), F.col("n"))).cast("int").alias("part"), "v", "ids"), "index")
    of_cell = lambda q: q.join(F.broadcast(layout), "cell").select(F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("part"), "key", "v", "limit")

    asked = stored(d.where(is_query).select("id", "v").distinct(), "asked", keep=True)
    keys = asked.groupBy("v").agg(F.min("id").alias("key"))
    wanted = stored(keys.select("key", "v").mapInArrow(_place(shared, dim), "cell int, key long, v array<double>").withColumn("limit", F.lit(None).cast("double")), "wanted")
    run = _search(shared, dim, k + 1, quantile)
    best = lambda x: x.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("score", "id"))).where(F.col("r") <= k + 1)
    home = stored(best(_blocks(index, of_cell(wanted), run)), "home", keep=True)

    def onward(so_far: DataFrame, near: int | None) -> DataFrame:
        """so_far and what the next cells hold, by the limits so far."""
        limits = so_far.where(F.col("r") == k + 1).select("key", F.col("score").alias("limit"))
        further = wanted.select("key", "v").join(limits, "key", "left").select("key", "v", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
        reached = further.mapInArrow(_reach(shared, dim, quantile, near), "cell int, key long, v array<double>, limit double")
        return best(so_far.select("key", "id", "score").unionByName(_blocks(index, of_cell(reached), run)))

    so_far = stored(onward(home, NEAR), "near", keep=True) if cells > 1 else home
    found = stored(onward(so_far, None), "found", keep=True) if cells > 1 + NEAR else so_far
    by_key = asked.join(keys, "v").select(F.col("id").alias("query_id"), "key")
    out = by_key.join(found, "key").where(F.col("query_id") != F.col("id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return out.select("query_id", rank.alias("rank"), F.col("id").alias("vec_id"), "score").where(F.col("rank") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
