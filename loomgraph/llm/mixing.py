"""Operator 7, mixing sources to target weights by hash-threshold histograms (native).

The hash of a document is the first 48 bits of md5(doc_id as text): three digits of 16 bits. Sizes
are summed by (source, first digit); the digit where the running sum passes the budget is the
boundary bucket, and only its rows are summed again by the next digit, and so on. A source whose
target passes its size takes every document once and a second copy below its threshold (nested
thresholds: what a smaller budget takes, a larger one takes too). No rows are sorted: windows run
over histograms, of 65,536 rows for a source at most, and over the sources of a range of names.

Defined results: a null text has size 0; the null source is one source, ordered last; documents of
one hash (repeated or null ids) are taken together; a source of size 0 has target 0; no rows give
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import stored, table, word_count

WEIGHTS = (3, 1, 2)
DIGITS = 3  # of 16 bits each


def digits(id_col: str) -> list[Column]:
    """The three 16-bit digits of a document's hash."""
    h = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return [F.conv(F.substring(h, 1 + 4 * k, 4), 16, 10).cast("int") for k in range(DIGITS)]


def ranked(sizes: DataFrame) -> DataFrame:
    """sizes with k, the place of src by code point, null last, from 0: sources are dealt by range, numbered
    within a partition and moved up by the partitions before, so that no task holds all of them."""
    key = [F.col("src").isNull(), F.col("src").cast("string").cast("binary")]
    parts = max(int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = stored(sizes.repartitionByRange(parts, *key).withColumn("p", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("p").agg(F.count("*").alias("c"))  # a row a partition
    before = counts.select("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("before"))
    within = F.row_number().over(Window.partitionBy("p").orderBy(*key)) - 1
    return dealt.withColumn("k", within).join(F.broadcast(before), "p").withColumn("k", F.col("k") + F.col("before")).drop("p", "before")


def targets(sizes: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, cap: int = 2) -> DataFrame:
    """(src, n, target) from (src, n): the shared budget by weight, each target at most cap * n.

    The level (words a weight) starts with no source capped and rises as the excess of those above it is
    shared again, until none is above; each step is one aggregate of two sums. One row a source."""
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (F.col("k") % len(weights)).cast("int") + 1)
    d = stored(ranked(sizes).select("src", "n", w.alias("w")), "weights")
    all_n, all_w = d.agg(F.sum("n"), F.sum("w")).first()
    n0 = w0 = 0
    level = share * (all_n or 0) / (all_w or 1)
    while True:
        above = cap * F.col("n") / F.col("w") < F.lit(level)
        n1, w1 = d.agg(F.coalesce(F.sum(F.when(above, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(above, F.col("w"))), F.lit(0))).first()
        if w1 == (all_w or 0) or (n1, w1) == (n0, w0):
            break
        n0, w0, level = n1, w1, (share * all_n - float(cap * n1)) / (all_w - w1)
    every = (cap * F.col("n")).cast("double")
    return d.select("src", "n", F.least(every, F.lit(float(level)) * F.col("w")).alias("target"))


def thresholds(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """(src, n, target, full, cut0, cut1, cut2): full copies of every document, and the hash, digit by
    digit, below which documents are taken once more.

    sized: (src, size, h0, h1, h2). Each level reads only rows of the boundary bucket before it."""
    full = F.when(F.col("n") > 0, F.floor(F.col("target") / F.col("n"))).otherwise(0)
    at = goal.withColumn("full", full.cast("long")).withColumn("left", F.col("target") - F.col("full") * F.col("n"))
    rows = sized
    for k in range(DIGITS):
        hist = rows.groupBy("src", f"h{k}").agg(F.sum("size").alias("b"))
        upto = Window.partitionBy("src").orderBy(f"h{k}")
        hist = hist.select(F.col("src").alias("s"), f"h{k}", "b", F.sum("b").over(upto).alias("sum"))
        hist = hist.join(at.select("src", "left"), F.col("s").eqNullSafe(F.col("src")))
        over = F.col("sum") > F.col("left")
        bucket = hist.groupBy("s").agg(F.min(F.when(over, F.struct(F.col(f"h{k}").alias("h"), (F.col("left") - F.col("sum") + F.col("b")).alias("left"), F.col("b").alias("b")))).alias("x"))
        at = at.drop(f"cut{k}").join(bucket.withColumnRenamed("s", "_s"), F.col("src").eqNullSafe(F.col("_s")), "left")
        # no bucket passes the budget: everything lies below the cut
        at = at.select(*[c for c in at.columns if c not in ("_s", "x", "left", "b")], F.coalesce("x.h", F.lit(1 << 16)).alias(f"cut{k}"), F.coalesce("x.left", F.lit(0.0)).alias("left"), F.coalesce("x.b", F.lit(0)).alias("b"))
        at = stored(at, f"mix{k}")
        if k + 1 < DIGITS:
            cut = at.select(F.col("src").alias("_s"), *[F.col(f"cut{j}") for j in range(k + 1)])
            match = F.col("src").eqNullSafe(F.col("_s"))
            for j in range(k + 1):
                match = match & (F.col(f"h{j}") == F.col(f"cut{j}"))
            rows = sized.join(cut, match, "left_semi")
    # the last boundary is one hash: taken too if that brings the sum nearer to the target
    nearer = (F.col("b") > 0) & (2 * F.col("left") > F.col("b"))
    return at.withColumn(f"cut{DIGITS - 1}", F.col(f"cut{DIGITS - 1}") + nearer.cast("int")).drop("left", "b")


def below(cuts: str = "") -> Column:
    """Whether hash (h0, h1, h2) lies below (cut0, cut1, cut2)."""
    out = F.lit(False)
    for k in reversed(range(DIGITS)):
        out = (F.col(f"h{k}") < F.col(f"cut{k}")) | ((F.col(f"h{k}") == F.col(f"cut{k}")) & out)
    return out


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """size, source_size, target and copies (0, 1 or 2) of every row, with the id or, if carry, the
    whole input row as struct `row`."""
    d = docs.select(F.struct("*" if carry else id_col).alias("row"), F.col(source_col).alias("src"), word_count(F.col(text_col)).alias("size"), *[h.alias(f"h{k}") for k, h in enumerate(digits(id_col))])
    sized = d.drop("row") if carry else d
    if not carry:
        sized = d = stored(d, "sizes")
    else:
        sized = stored(sized, "sizes")
    goal = stored(targets(sized.groupBy("src").agg(F.sum("size").alias("n")), share, weights), "targets")
    cuts = thresholds(sized.drop("row"), goal)
    one = cuts.withColumnRenamed("src", "_src")
    out = d.join(one, F.col("src").eqNullSafe(F.col("_src")), "left")
    return out.select("row", "size", F.col("n").alias("source_size"), "target", (F.col("full") + below().cast("long")).alias("copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mix(table(spark, sf_dir, "documents"))
    return d.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: never, once or twice."""
    d = mix(docs, carry=True).where("copies > 0")
    return d.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("row.*")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source),
r AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS BIGINT) AS w FROM s),
a AS (SELECT CAST(sum(n) AS DOUBLE) AS all_n, CAST(sum(w) AS DOUBLE) AS all_w FROM r),
l(level) AS (
  SELECT CAST(1.5 AS DOUBLE) * all_n / all_w FROM a
  UNION
  SELECT (CAST(1.5 AS DOUBLE) * any_value(all_n) - coalesce(CAST(sum(CASE WHEN 2 * n / w < level THEN 2 * n END) AS DOUBLE), 0)) / (any_value(all_w) - coalesce(CAST(sum(CASE WHEN 2 * n / w < level THEN w END) AS DOUBLE), 0))
  FROM l, r, a GROUP BY level),
t AS (SELECT source, n, least(CAST(2 * n AS DOUBLE), (SELECT max(level) FROM l) * w) AS target FROM r),
f AS (SELECT *, CASE WHEN n > 0 THEN CAST(floor(target / n) AS BIGINT) ELSE 0 END AS copies FROM t),
g AS (SELECT d.doc_id, d.size, f.n, f.target, f.copies, f.target - f.copies * f.n AS rest,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
        sum(d.size) OVER (PARTITION BY d.source, d.h) AS same
      FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, n AS source_size, target,
       CAST(size * (copies + CASE WHEN upto <= rest OR (upto - same <= rest AND 2 * (rest - (upto - same)) > same) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM g
"""
