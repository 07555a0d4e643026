"""Operator 12, embedding whitening with MLlib's BlockMatrix.

Vectors become integers x. The fit list is each distinct x once, dealt by hash into blocks of about BLOCK_ROWS
rows; its centred rows form an IndexedRowMatrix and that a BlockMatrix, whose transpose times itself is the
scatter. That product is split along its middle dimension, so no task gets all blocks; the driver gets the
scatter alone, dimensions squared, whose eigenvectors it finds (`eigh`). The BlockMatrix times the whitening matrix projects the
fit list, and each row of the table takes the projection of its x. Rows of the blocks without a vector (hashing
leaves a few) are zero, which adds nothing to either product.

Blocks grow with the list beyond MOST_BLOCKS of them, as MLlib plans a product on the driver from the list of blocks.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do those
of another length than most have. x is held within 2**40 either way. Components are as many as asked for or as
dimensions; of one whose eigenvalue is zero (no more than 1e-12 of their sum) whitened is null, explained is 0, or null
where all vectors are equal, and identity_error leaves it out (null where none is left). deviation is
null where it does not fit a long. Repeated rows repeat and null ids stay; an empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import grid_vectors, scope, stored, table

SCALE = 256
COMPONENTS = 4
BLOCK_ROWS = 1024
MOST_BLOCKS = 1 << 18
#: Into how many parts the middle dimension of the scatter's product is split at most.
MOST_SPLITS = 4096
#: Share of the eigenvalues' sum up to which one counts as zero.
ZERO = 1e-12
MOST = 1 << 40


@dataclass
class Whitening:
    """n and sums of the fit list, eigenvalues falling, their vectors as columns, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def _multiplied(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """left times right, dealt into `splits` parts of the middle dimension (an argument that only the JVM's method has)."""
    java = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def indexed(fit: DataFrame, n: int, block_rows: int, most_blocks: int = MOST_BLOCKS) -> tuple[DataFrame, int]:
    """fit (x) with index, and rows a block: block * rows + place in it, by hash and without gaps but at a block's end."""
    blocks = min(-(-n // block_rows), most_blocks)
    place = F.row_number().over(Window.partitionBy("block").orderBy("x")) - 1
    d = stored(fit.withColumn("block", F.pmod(F.xxhash64("x"), F.lit(blocks))).withColumn("place", place), "fit-blocks")
    rows = d.agg(F.max("place")).first()[0] + 1
    return d.select((F.col("block") * rows + F.col("place")).alias("index"), "x"), rows


def _centred(n: int, sums: list[int]) -> Callable:
    """(index, x, c, deviation) of (index, x): c is x - S / n; deviation the sum of (n * x - S)**2, null beyond a long."""
    mean = np.array([s / n for s in sums])
    n_, sums_ = np.int64(n), np.array([(s + (1 << 63)) % (1 << 64) - (1 << 63) for s in sums], np.int64)  # modulo 2**64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(sums))
            c = x - mean
            about = ((c * n) ** 2).sum(1)
            deviation = ((n_ * x - sums_) ** 2).sum(1).tolist()  # exact modulo 2**64, and so where the sum is small
            for k in np.flatnonzero(about >= 2.0**62).tolist():
                exact = sum((n * v - s) ** 2 for v, s in zip(x[k].tolist(), sums, strict=True)) if about[k] < 2.0**64 else 1 << 63
                deviation[k] = exact if exact < 1 << 63 else None
            ends = pa.array(np.arange(len(c) + 1) * len(sums), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(c.ravel())), pa.array(deviation, pa.int64())], ["index", "x", "c", "deviation"])

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, Whitening | None, DataFrame]:
    """((key, deviation, whitened array<double>) of every vector that takes part; what was fitted, None for no vectors;
    (of, deviation, whitened) of the fit list)."""
    with scope(vectors.sparkSession):
        return _whitened(vectors, components, id_col, vec_col, scale, block_rows)


def _whitened(vectors: DataFrame, components: int, id_col: str, vec_col: str, scale: int, block_rows: int) -> tuple[DataFrame, Whitening | None, DataFrame]:
    d, dim = grid_vectors(vectors, scale, vec_col, {id_col: "key"}, MOST)
    if not dim:
        none = d.select("key", F.lit(0).cast("long").alias("deviation"), F.array(F.lit(0.0)).alias("whitened")).where("false")
        return none, None, none
    d = stored(d, "grid", keep=True)
    fit = stored(d.select("x").distinct(), "fit")
    most = F.max(F.greatest(F.array_max("x"), -F.array_min("x")))
    n, most = fit.agg(F.count("*"), most).first()
    wide = "decimal(38,0)" if n * int(most) >= 1 << 62 else "long"
    sums = [int(s) for s in fit.agg(*[F.sum(F.col("x")[j].cast(wide)) for j in range(dim)]).first()]

    fit, rows = indexed(fit, n, block_rows)
    fit = stored(fit.mapInArrow(_centred(n, sums), "index long, x array<long>, c array<double>, deviation long"), "centred")
    frame = MLUtils.convertVectorColumnsFromML(fit.select("index", array_to_vector("c").alias("v")), "v")
    matrix = IndexedRowMatrix(frame, numCols=dim).toBlockMatrix(rows, dim)
    blocks = -(-matrix.numRows() // rows)
    scatter = _multiplied(matrix.transpose(), matrix, min(blocks, MOST_SPLITS)).toLocalMatrix().toArray()
    values, eigen = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    values, eigen = np.maximum(values[::-1], 0.0), eigen[:, ::-1]
    found = Whitening(n, sums, values, eigen, float(values.sum()))

    k = min(components, dim)
    used = values[:k] > ZERO * found.trace
    by = eigen[:, :k] * np.where(used, 1 / np.sqrt(np.where(used, values[:k], 1.0)), 0.0)
    sc = vectors.sparkSession.sparkContext
    right = BlockMatrix(sc.parallelize([((0, 0), DenseMatrix(dim, k, by.ravel(order="F").tolist()))], 1), dim, k)
    projected = matrix.multiply(right).toIndexedRowMatrix()
    out = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)  # a DataFrame, without Python rows
    out = out.select(F.col("index").alias("at"), vector_to_array("vector").alias("w"))
    whitened = F.transform("w", lambda w, j: F.when(F.element_at(F.array(*[F.lit(bool(u)) for u in used]), j + 1), w))
    done = stored(fit.join(out, F.col("index") == F.col("at")).select(F.col("x").alias("of"), "deviation", whitened.alias("whitened")), "whitened", keep=True)
    return d.join(done, F.col("x") == F.col("of")).select("key", "deviation", "whitened"), found, done


def identity_error(whitened: DataFrame, components: int) -> float | None:
    """Largest absolute entry of the covariance of `whitened` minus the identity, over those that are not null."""
    w = [F.col("whitened")[j] for j in range(components)]
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    r = whitened.agg(*[F.avg(c) for c in w], *[F.avg(w[i] * w[j]) for i, j in pairs]).first()
    mean, second = r[:components], r[components:]
    errors = [abs(m - mean[i] * mean[j] - (i == j)) for (i, j), m in zip(pairs, second, strict=True) if m is not None]
    return max(errors, default=None)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found, done = whiten(table(spark, sf_dir, "embeddings"))
    k = min(COMPONENTS, len(found.values)) if found else 0
    error = identity_error(done, k) if found else None
    share = [float(v / found.trace) if found.trace > 0 else None for v in found.values[:k]] if found else []
    each = F.array(*[F.struct(F.lit(j + 1).alias("component"), F.col("whitened")[j].alias("whitened"), F.lit(e).cast("double").alias("explained")) for j, e in enumerate(share)])
    if not found:
        each = F.array(F.struct(F.lit(0).alias("component"), F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained")))
    out = rows.select(F.col("key").alias("vec_id"), F.lit(found.n if found else 0).cast("long").alias("n"), "deviation", F.explode(each).alias("e"))
    return out.select("vec_id", "e.component", "n", "deviation", "e.whitened", "e.explained", F.lit(error).cast("double").alias("identity_error"))
