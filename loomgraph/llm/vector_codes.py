"""Operator 11, vector code compression: codebooks over parts of vectors, learned over a trie of distinct parts.

Vectors become integers and are cut into PARTS equal parts. Spark counts the distinct parts of each position
once, and deals and sorts them by their components, so that a task's batch is a run of a lexicographic trie.
Depth first through that trie, a node's distances to all entries are its parent's plus the squares of one
component, so parts with a common prefix share them; nodes next to each other go down together, NODES at
most, which bounds memory to a matrix of NODES x entries for each level. A leaf takes the nearest entry, and
adds its part to that entry's sums as often as it occurs. A round's job returns a row for each entry.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do those
of another length than most have, or of one that parts don't divide; zero vectors do take part. Components are
held within 2**27 steps of 1 / scale either way, so that errors fit a long. Codebooks start from the rows of
the smallest ids, null ids last, equal ids by vector; with fewer rows than entries there are as many entries as rows.
Repeated rows count as often as they occur. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import grid_vectors, scope, stored, table

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Nodes of the trie that go down together.
NODES = 512
MOST = 1 << 27


def nearest(parts: np.ndarray, entries: np.ndarray, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) of each row of parts, which ascend and are distinct; ties to the lower entry."""
    n, dim = parts.shape
    at, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    # a row begins a node of each level below the first component in which it differs from the row before
    differs = np.concatenate([np.zeros((1, 0 if dim == 0 else dim), bool), parts[1:] != parts[:-1]]) if n else np.zeros((0, dim), bool)
    fork = np.where(differs.any(1), differs.argmax(1), dim) if dim else np.zeros(n, np.int64)
    if n:
        fork[0] = -1
    todo: list[tuple[int, np.ndarray, np.ndarray, int]] = [(0, np.zeros(1, np.int64), np.zeros((1, len(entries)), np.int64), n)] if n else []
    while todo:  # (level, first row of each node, their distances, row after the last)
        level, first, shared, end = todo.pop()
        if level == dim:
            at[first] = shared.argmin(1)
            distance[first] = shared[np.arange(len(first)), at[first]]
            continue
        begins = np.zeros(end - first[0], bool)
        begins[first - first[0]] = True
        begins |= fork[first[0] : end] <= level
        below = np.flatnonzero(begins) + first[0]
        for k in range((len(below) - 1) // nodes * nodes, -1, -nodes):  # the first run is on top of the stack
            some = below[k : k + nodes]
            parent = np.searchsorted(first, some, "right") - 1
            sums = shared[parent] + (parts[some, level][:, None] - entries[None, :, level]) ** 2
            todo.append((level + 1, some, sums, int(below[k + nodes]) if k + nodes < len(below) else end))
    return at, distance


def assigned(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`nearest` of rows in any order, repeats once."""
    distinct, inverse = np.unique(parts, axis=0, return_inverse=True)
    at, distance = nearest(distinct, entries)
    return at[inverse.ravel()], distance[inverse.ravel()]


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


def _sums(shared: object, width: int) -> Callable:
    """(position, entry, n, s) of (position, part, n): what each entry gathers in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        count = np.zeros(books.shape[:2], np.int64)
        total = np.zeros((*books.shape[:2], width), np.int64)
        for batch in batches:
            position = batch.column(0).to_numpy()
            parts, weight = _rows(batch.column(1), width), batch.column(2).to_numpy()
            for p in np.unique(position).tolist():
                own = np.flatnonzero(position == p)
                own = own[np.lexsort(parts[own].T[::-1])]  # as dealt; a task may read several sorted files
                at, _ = nearest(parts[own], books[p])
                np.add.at(count[p], at, weight[own])
                np.add.at(total[p], at, parts[own] * weight[own, None])
        p, e = np.nonzero(count)
        s = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * width, pa.int32()), pa.array(total[p, e].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), s], ["position", "entry", "n", "s"])

    return run


def _codes(shared: object, width: int) -> Callable:
    """(key, label, code, error) of (key, label, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            x = _rows(batch.column(2), width * len(books)).reshape(-1, len(books), width)
            both = [assigned(x[:, p], books[p]) for p in range(len(books))]
            code = ["".join(f"{c:02x}" for c in row) for row in np.stack([b[0] for b in both], 1).tolist()]
            error = np.sum([b[1] for b in both], 0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error)], ["key", "label", "code", "error"])

    return run


def learn(vectors: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks, an array (position, entry, component), of (key, x): at most parts * entries * dim / parts numbers."""
    spark, width = vectors.sparkSession, dim // parts
    start = vectors.orderBy(F.asc_nulls_last("key"), "x").select("x").limit(entries).collect()
    books = np.array([r[0] for r in start], np.int64).reshape(len(start), parts, width).transpose(1, 0, 2)
    cut = F.explode(F.array(*[F.struct(F.lit(p).alias("position"), F.slice("x", p * width + 1, width).alias("part")) for p in range(parts)])).alias("y")
    counted = vectors.select(cut).groupBy("y.position", "y.part").agg(F.count("*").alias("n"))
    trie = stored(counted.repartitionByRange("position", "part").sortWithinPartitions("position", "part"), "parts")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        found = trie.mapInArrow(_sums(shared, width), "position int, entry int, n long, s array<long>")
        sums = found.groupBy("position", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[j]) for j in range(width)]).alias("s"))
        books = books.copy()
        for r in sums.collect():  # a row an entry
            books[r.position, r.entry] = [s // r.n for s in r.s]
        shared.unpersist()
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((key, label, code, error) of every vector that takes part, codebooks). entries is 256 at most."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for each part")
    spark = vectors.sparkSession
    with scope(spark):
        d, dim = grid_vectors(vectors, scale, vec_col, {id_col: "key", label_col: "label"}, MOST)
        if dim == 0 or dim % parts:
            none = d.select("key", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).where("false")
            return none, np.zeros((parts, 0, 0), np.int64)
        d = stored(d, "vectors", keep=True)
        books = learn(d, dim, parts, entries, rounds)
        shared = spark.sparkContext.broadcast(books)
        kinds = f"key {d.schema['key'].dataType.simpleString()}, label {d.schema['label'].dataType.simpleString()}, code string, error long"
        return d.mapInArrow(_codes(shared, dim // parts), kinds), books


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scope(spark):
        codes, books = compress(table(spark, sf_dir, "embeddings"))
        codes = stored(codes, "codes", keep=True)
        sums = stored(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "errors", keep=True)
        out = codes.join(sums, F.col("label").eqNullSafe(F.col("of")))
        return out.select(F.col("key").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
