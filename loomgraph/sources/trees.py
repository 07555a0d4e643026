"""Source trees, recorded traces and source lines as tables; graphs as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.paths import is_pruned, language, language_order
from loomgraph.operators.trace import parse
from loomgraph.sources import tree_files


def scan(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(files (path, content), directories (path)) below root, relative to it, a job each: see `tree_files`."""
    tree_files.register(spark)
    tree = spark.read.format("source_tree").option("path", root).load()
    return tree.where("not is_dir").select("path", "content"), tree.where("is_dir").select("path")


def without_pruned(files: DataFrame) -> DataFrame:
    """The same rule over a table of paths."""
    return files.where(~is_pruned(F.col("path")))


def routed(files: DataFrame) -> DataFrame:
    """files with lang and lang_ord; null for files that no extractor takes."""
    return files.withColumn("lang", language(F.col("path"))).withColumn("lang_ord", language_order(F.col("lang")))


def source_lines(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, line_no, text), from 1; what follows the last line break is a line only if not empty."""
    content = F.col(content_col)
    parts = F.split(content, r"\r?\n")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return files.where(content.isNotNull()).select(F.col(path_col).alias("path"), F.posexplode(parts).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line_no"), "text")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Events of a recorded trace (value, fn, file, line, args, bad), the raw line kept."""
    return parse(spark.read.text(path))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes and edges as tables; edges by type, so that a walk over calls reads no other."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def export_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(value): the graph as JSON, a node or an edge a line; zero lines are left out. It grows with the
    graph without ever being one value."""
    zero = lambda c: F.when(F.col(c) != 0, F.col(c)).alias(c)
    n = nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), "id", "type", "name", "path", zero("line"), zero("end_line"))).alias("value"))
    e = edges.select(F.to_json(F.struct(F.lit("edge").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), "type", zero("line"))).alias("value"))
    return n.unionByName(e)
