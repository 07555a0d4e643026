"""Lookups of nodes and source text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def functions_named(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where((F.col("type") == "function") & (F.col("name") == name)).orderBy("id")


def node_details(nodes: DataFrame, id_: str) -> DataFrame:
    return nodes.where(F.col("id") == id_)


def symbols_of_file(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where((F.col("type") == "function") & (F.col("path") == path)).orderBy("line", "id")


def source_slices(nodes: DataFrame, lines: DataFrame, extra: int = 20) -> DataFrame:
    """(id, source): the lines from line to end_line of each node; without an end_line `extra` more than
    the first. Bucketed by line, so that a long file is not met by each of its functions as a whole."""
    end = F.when(F.coalesce("end_line", F.lit(0)) == 0, F.col("line") + extra).otherwise(F.col("end_line"))
    n = nodes.select("id", "path", "line", end.alias("to")).where("to >= line")
    n = n.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("line") / 64), F.floor(F.col("to") / 64))))
    s = lines.select("path", "line_no", "text", F.floor(F.col("line_no") / 64).alias("bucket"))
    d = n.join(s, ["path", "bucket"]).where("line_no between line and to")
    rows = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return d.groupBy("id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("source"))


def search_nodes(nodes: DataFrame, part: str) -> DataFrame:
    """The node of smallest id whose name holds the part, whatever the case."""
    return nodes.where(F.contains(F.lower("name"), F.lit(part.lower()))).orderBy("id").limit(1)


def search_history(events: DataFrame, part: str) -> DataFrame:
    """The first event of each run whose function holds the part, whatever the case."""
    d = events.where(F.contains(F.lower("fn"), F.lit(part.lower())))
    return d.groupBy("run_id").agg(F.min_by(F.struct("seq", "fn", "file", "line"), "seq").alias("e")).select("run_id", "e.*")


def signatures(at: DataFrame, lines: DataFrame) -> DataFrame:
    """at (path, line) with the trimmed source line as signature, '' where there is none."""
    s = lines.select("path", F.col("line_no").alias("line"), F.trim("text").alias("signature"))
    return at.join(s, ["path", "line"], "left").withColumn("signature", F.coalesce("signature", F.lit("")))
