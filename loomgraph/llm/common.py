"""Shared helpers: tables, words, and cutting lineage through the folder that all executors see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.shared import new_path, scope

__all__ = ["new_path", "scope", "stored", "table", "word_count", "words_of"]

#: Java pattern for one run of the separators of `[^\x20\x09-\x0D]+`.
SPACES = "[ \\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, so a lost
    executor costs a read and not the work before it. keep: a result that is still to run reads it, so
    that it outlives its scope and is left to the one around that, if any."""
    spark = df.sparkSession
    path = new_path(spark, name, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Array of the `[^\\x20\\x09-\\x0D]+` of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def word_count(text: Column) -> Column:
    """How many `[^\\x20\\x09-\\x0D]+` a text has, as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\x09-\\x0D]+")), F.lit(0)).cast("long")


def grid_vectors(vectors: DataFrame, scale: int, vec_col: str, keep: dict[str, str], most: int) -> tuple[DataFrame, int]:
    """(columns of keep as they are named there, x array<long>) and the length of x: floor(scale * component), within
    -most..most, of the vectors without null or non-finite components and of that length which most of them have
    (of equally many the shortest). A vector without components takes no part."""
    v = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    d = vectors.select(*[F.col(c).alias(new) for c, new in keep.items()], v.alias("v"))
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    d = d.where(F.forall("v", fine) & (F.size("v") > 0))
    first = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = first[0] if first else 0
    held = lambda c: F.greatest(F.lit(-float(most)), F.least(F.lit(float(most)), F.floor(c * F.lit(float(scale))).cast("double"))).cast("long")
    return d.where(F.size("v") == dim).select(*keep.values(), F.transform("v", held).alias("x")), dim
