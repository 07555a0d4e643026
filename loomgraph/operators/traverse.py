"""Iterative walks over call and containment edges: a job a level, lineage cut at each.

What a walk returns is one table; those of its levels are removed when it ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.shared import cut, scope


def closure(calls: DataFrame, seeds: DataFrame, callers: bool = True, max_depth: int | None = None) -> DataFrame:
    """(seed, id, depth): everything that calls a seed (or is called by it) directly or not, with the
    fewest calls between. A seed itself is in only if it lies on a cycle. All seeds walk together."""
    with scope(calls.sparkSession):
        return cut(_closed(calls, seeds, callers, max_depth), keep=True)


def _closed(calls: DataFrame, seeds: DataFrame, callers: bool, max_depth: int | None) -> DataFrame:
    near, far = ("dst", "src") if callers else ("src", "dst")
    steps = cut(calls.select(F.col(near).alias("at"), F.col(far).alias("id")).distinct())
    frontier = seeds.select(F.col("id").alias("seed"), F.col("id").alias("at")).distinct()
    seen, depth = None, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = frontier.join(steps, "at").select("seed", "id").distinct()
        if seen is not None:
            new = new.join(seen.select("seed", "id"), ["seed", "id"], "left_anti")
        new = cut(new.withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        seen = new if seen is None else seen.unionByName(new)
        if depth % 8 == 0:
            seen = cut(seen)  # one table and not a union of every level
        frontier = new.select("seed", F.col("id").alias("at"))
    if seen is None:
        seen = frontier.select("seed", F.col("at").alias("id"), F.lit(0).alias("depth")).where(F.lit(False))
    return seen


def shortest_paths(calls: DataFrame, requests: DataFrame) -> DataFrame:
    """(start, end, step, id): a shortest call path for each request that has one, step by step; of
    equal ones that whose list of edge_ord is smallest, which is what a first-in-first-out search meets
    first. A start that is the end is a path of itself.

    Distances to the end are found level by level backwards; each node's next step is then its edge of
    smallest edge_ord that comes one nearer, so no path is carried along."""
    with scope(calls.sparkSession):
        return cut(_shortest(calls, requests), keep=True)


def _shortest(calls: DataFrame, requests: DataFrame) -> DataFrame:
    edges = cut(calls.groupBy("src", "dst").agg(F.min("edge_ord").alias("edge_ord")))
    want = cut(requests.select("start", "end").distinct())
    level = want.select("end", F.col("end").alias("id"), F.lit(0).alias("d")).distinct()
    dist, depth = cut(level), 0  # the levels so far, eight tables at most beside one of all before
    waiting = want.where(F.col("start") != F.col("end"))
    level = dist
    while True:
        depth += 1
        open_ends = waiting.join(dist.select("end", F.col("id").alias("start")), ["end", "start"], "left_anti").select("end").distinct()
        new = level.join(open_ends, "end", "left_semi").join(edges, F.col("id") == F.col("dst")).select("end", F.col("src").alias("id")).distinct()
        level = cut(new.join(dist, ["end", "id"], "left_anti").withColumn("d", F.lit(depth)))
        if level.isEmpty():
            break
        dist = dist.unionByName(level)
        if depth % 8 == 0:
            dist = cut(dist)
    nearer = edges.join(dist.select("end", F.col("id").alias("src"), "d"), "src").join(dist.select("end", F.col("id").alias("dst"), F.col("d").alias("d2")), ["end", "dst"]).where("d2 = d - 1")
    after = cut(nearer.groupBy("end", F.col("src").alias("id")).agg(F.min_by("dst", "edge_ord").alias("next")))
    at = want.join(dist.select("end", F.col("id").alias("start")), ["end", "start"], "left_semi")
    at = cut(at.unionByName(want.where(F.col("start") == F.col("end"))).distinct().select("start", "end", F.lit(0).alias("step"), F.col("start").alias("id")))
    out = at
    while True:
        at = cut(at.where(F.col("id") != F.col("end")).join(after, ["end", "id"]).select("start", "end", (F.col("step") + 1).alias("step"), F.col("next").alias("id")))
        if at.isEmpty():
            return out
        out = out.unionByName(at)


def ancestors(contains: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, id, distance): what contains a seed, up to the root; of several parents that of the first
    edge (smallest edge_ord where contains has it, else smallest id). On a cycle a walk ends where it
    would meet an id again."""
    with scope(contains.sparkSession):
        return cut(_above(contains, seeds), keep=True)


def _above(contains: DataFrame, seeds: DataFrame) -> DataFrame:
    order = "edge_ord" if "edge_ord" in contains.columns else "src"
    parent = cut(contains.groupBy(F.col("dst").alias("at")).agg(F.min_by("src", F.struct(order, "src")).alias("id")))
    level = seeds.select(F.col("id").alias("seed"), F.col("id").alias("at")).distinct()
    out, distance = None, 0
    while True:
        distance += 1
        new = level.join(parent, "at").where(F.col("id") != F.col("seed")).select("seed", "id", F.lit(distance).alias("distance"))
        if out is not None:
            new = new.join(out.select("seed", "id"), ["seed", "id"], "left_anti")
        new = cut(new)
        if new.isEmpty():
            return new if out is None else out
        out = new if out is None else out.unionByName(new)
        if distance % 8 == 0:
            out = cut(out)  # one table and not a union of every level
        level = new.select("seed", F.col("id").alias("at"))
