"""The containment tree in the order in which it is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.sources.shared import cut, scope

RANK = {"directory": 0, "file": 1, "function": 2}


def _key(prefix: str = "") -> Column:
    """Siblings: directories, files, functions; functions by line and the others by name; then by id."""
    kind = F.col(f"{prefix}type")
    rank = F.when(kind == "directory", 0).when(kind == "file", 1).otherwise(2)
    line = F.when(kind == "function", F.coalesce(F.col(f"{prefix}line"), F.lit(0))).otherwise(0)
    name = F.when(kind == "function", "").otherwise(F.coalesce(F.col(f"{prefix}name"), F.lit("")))
    return F.struct(rank.alias("rank"), line.alias("line"), name.alias("name"), F.col(f"{prefix}id").alias("id"))


def sibling_order(nodes: DataFrame, contains: DataFrame) -> DataFrame:
    """(parent, id, position): each parent's children in order, from 1."""
    d = contains.select(F.col("src").alias("parent"), F.col("dst").alias("id")).distinct().join(nodes, "id")
    return d.select("parent", "id", F.row_number().over(Window.partitionBy("parent").orderBy(_key())).alias("position"))


def flatten(nodes: DataFrame, contains: DataFrame, roots: DataFrame) -> DataFrame:
    """(path_key, id, label, depth, type, has_children) in pre-order of path_key; directories end in '/';
    a node of two parents stands under both. A job a level; a cycle ends where a node would hold itself."""
    with scope(nodes.sparkSession):
        return cut(_flattened(nodes, contains, roots), keep=True)


def _flattened(nodes: DataFrame, contains: DataFrame, roots: DataFrame) -> DataFrame:
    kids = contains.select(F.col("src").alias("parent"), F.col("dst").alias("id")).distinct().join(nodes.select("id", "type", "name", "line"), "id")
    kids = cut(kids.withColumn("key", _key()))
    has = kids.select(F.col("parent").alias("id")).distinct().withColumn("has", F.lit(True))
    level = cut(roots.select("id", "type", "name", "line").withColumn("path_key", F.array(_key())).withColumn("depth", F.lit(0)).select("id", "type", "name", "path_key", "depth"))
    out = level
    while True:
        up = level.select(F.col("id").alias("parent"), F.col("path_key").alias("above"), "depth")
        new = kids.join(up, "parent").where(~F.exists("above", lambda k: k["id"] == F.col("id")))
        level = cut(new.select("id", "type", "name", F.concat("above", F.array("key")).alias("path_key"), (F.col("depth") + 1).alias("depth")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    label = F.when(F.col("type") == "directory", F.concat("name", F.lit("/"))).otherwise(F.col("name"))
    return out.join(has, "id", "left").select("path_key", "id", label.alias("label"), "depth", "type", F.coalesce("has", F.lit(False)).alias("has_children"))
