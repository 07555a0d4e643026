"""Nodes, edges and what is read off them without iteration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.paths import basename, dirname, language_label


def last_wins(symbols: DataFrame) -> DataFrame:
    """Function nodes (id, name, path, line, end_line): of symbols with one id the last."""
    row = F.struct("name", "path", F.col("start_line").alias("line"), "end_line")
    return symbols.groupBy("id").agg(F.max_by(row, "sym_ord").alias("n")).select("id", "n.*")


def directories_of(paths: DataFrame) -> DataFrame:
    """(path): every directory above the files' paths, and the root '.'."""
    parts = F.split("path", "/")
    d = paths.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path"))
    return d.select(F.when(F.col("path") == "", ".").otherwise(F.col("path")).alias("path")).distinct()


def all_nodes(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Directory, file and function nodes (id, type, name, path, line, end_line)."""
    none = F.lit(None).cast("int")
    dirs = directories_of(files).select(F.col("path").alias("id"), F.lit("directory").alias("type"), basename(F.col("path")).alias("name"), "path", none.alias("line"), none.alias("end_line"))
    fs = files.select("path").distinct().select(F.col("path").alias("id"), F.lit("file").alias("type"), basename(F.col("path")).alias("name"), "path", none.alias("line"), none.alias("end_line"))
    fn = last_wins(symbols).select("id", F.lit("function").alias("type"), "name", "path", "line", "end_line")
    return dirs.unionByName(fs).unionByName(fn)


def containment_edges(symbols: DataFrame, files: DataFrame, ordered: bool = False) -> DataFrame:
    """(src, dst): directory in directory, file in directory, and function in file, a row for each symbol.
    ordered: with edge_ord, in which a function's edges stand as its symbols do."""
    dirs = directories_of(files).where("path <> '.'").select(dirname(F.col("path")).alias("src"), F.col("path").alias("dst"))
    fs = files.select("path").distinct().select(dirname(F.col("path")).alias("src"), F.col("path").alias("dst"))
    fn = symbols.select(F.col("path").alias("src"), F.col("id").alias("dst"), *([F.col("sym_ord").alias("edge_ord")] if ordered else []))
    return dirs.unionByName(fs).unionByName(fn, allowMissingColumns=ordered)


def typed_edges(calls: DataFrame, contains: DataFrame) -> DataFrame:
    one = calls.select("src", "dst", F.lit("calls").alias("type"), "line")
    return one.unionByName(contains.select("src", "dst", F.lit("contains").alias("type"), F.lit(0).alias("line")))


def direct_callers(calls: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, id, line): a row for each call of a seed."""
    return calls.join(seeds.select(F.col("id").alias("seed")), F.col("dst") == F.col("seed")).select("seed", F.col("src").alias("id"), "line")


def direct_callees(calls: DataFrame, seeds: DataFrame) -> DataFrame:
    return calls.join(seeds.select(F.col("id").alias("seed")), F.col("src") == F.col("seed")).select("seed", F.col("dst").alias("id"), "line")


def neighbour_details(neighbours: DataFrame, nodes: DataFrame, lines: DataFrame, callers: bool = True) -> DataFrame:
    """(seed, id, name, file, jump_line, signature): callers jump to the call, callees to their
    definition; ids that are no node are left out; a missing source line gives ''."""
    d = neighbours.withColumnRenamed("line", "call_line").join(nodes.select("id", "name", "path", "line"), "id")
    d = d.withColumn("jump_line", F.col("call_line") if callers else F.col("line"))
    s = lines.select(F.col("path"), F.col("line_no").alias("jump_line"), F.trim("text").alias("signature"))
    return d.join(s, ["path", "jump_line"], "left").select("seed", "id", "name", basename(F.col("path")).alias("file"), "jump_line", F.coalesce("signature", F.lit("")).alias("signature"))


def call_view(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """The nodes that some call edge touches."""
    return nodes.join(calls.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_semi")


def structure_view(contains: DataFrame, nodes: DataFrame) -> DataFrame:
    """The contains edges of which both ends are nodes."""
    ids = nodes.select("id").distinct()
    return contains.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def roots(nodes: DataFrame, contains: DataFrame) -> DataFrame:
    """Directories and files that nothing contains."""
    return nodes.where("type <> 'function'").join(contains.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: functions, calls, nodes, edges."""
    n = nodes.agg(F.count_if(F.col("type") == "function").alias("functions"), F.count("*").alias("nodes"))
    e = edges.agg(F.count_if(F.col("type") == "calls").alias("calls"), F.count("*").alias("edges"))
    return n.join(e)  # one row each


def function_count(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count_if(F.col("type") == "function").alias("functions"))


def language_list(paths: DataFrame) -> DataFrame:
    """One row: the labels of the files' languages, sorted and joined, or Unknown."""
    names = F.array_join(F.sort_array(F.collect_set(language_label(F.col("path")))), ", ")
    return paths.agg(F.when(names == "", "Unknown").otherwise(names).alias("languages"))


def hit_counts(event_functions: DataFrame) -> DataFrame:
    return event_functions.groupBy("id").agg(F.count("*").alias("hits"))


def adjacency(calls: DataFrame, reverse: bool = False) -> DataFrame:
    """(id, neighbours): the other ends in edge order, repeats kept."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    rows = F.array_sort(F.collect_list(F.struct("edge_ord", F.col(b).alias("n"))))
    return calls.groupBy(F.col(a).alias("id")).agg(F.transform(rows, lambda x: x["n"]).alias("neighbours"))


def with_children(nodes: DataFrame, contains: DataFrame) -> DataFrame:
    """(id, n_children, has_children) of every node."""
    n = contains.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("n"))
    count: Column = F.coalesce("n", F.lit(0))
    return nodes.select("id").join(n, "id", "left").select("id", count.alias("n_children"), (count > 0).alias("has_children"))
