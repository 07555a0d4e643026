"""Call sites and trace events to functions.

First match always means the smallest `sym_ord`, a column (or struct) that orders symbols; nothing
depends on the physical order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines that one bucket of the interval join spans.
BUCKET_LINES = 64


def enclosing_function(facts: DataFrame, symbols: DataFrame, innermost: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(fact_ord, caller): the first symbol of the same file whose lines hold the call site's; with
    innermost, that which starts last. Call sites outside any function are left out. carry: more columns
    of the call sites to keep.

    Of symbols of the same lines only the first (innermost: the last) can be the answer. What is left is laid
    into every bucket of lines that it touches, a row a bucket with its distinct spans in order; a call site meets
    the one row of its own bucket and takes the first span that holds it. So a long file does not meet itself as
    a whole, a file of one line has one span, and no pair of a call site and a symbol is ever a row."""
    buckets = F.sequence(F.floor(F.col("start_line") / BUCKET_LINES), F.floor(F.col("end_line") / BUCKET_LINES))
    last, best = (F.max_by, F.max) if innermost else (F.min_by, F.min)
    spans = symbols.where("start_line <= end_line").groupBy("path", "start_line", "end_line").agg(last("id", "sym_ord").alias("id"), best("sym_ord").alias("sym_ord"))
    order = ("s0", "sym_ord", "s1", "id") if innermost else ("sym_ord", "s0", "s1", "id")
    s = spans.select("path", "id", "sym_ord", F.col("start_line").alias("s0"), F.col("end_line").alias("s1"), F.explode(buckets).alias("bucket"))
    s = s.groupBy("path", "bucket").agg(F.sort_array(F.collect_list(F.struct(*order)), asc=not innermost).alias("spans"))
    f = facts.select("fact_ord", "path", "start_line", "end_line", F.floor(F.col("start_line") / BUCKET_LINES).alias("bucket"), *carry)
    holds = F.filter("spans", lambda x: (F.col("start_line") >= x["s0"]) & (F.col("end_line") <= x["s1"]))
    met = f.join(s, ["path", "bucket"]).select("fact_ord", F.get(holds, F.lit(0))["id"].alias("caller"), *carry)
    return met.where("caller is not null")


def _asked(facts: DataFrame, ignore_qualifiers: tuple[str, ...], *keep: str) -> DataFrame:
    """(keep, name, qualifier, dir) of the call sites."""
    q = F.col("callee_qualifier")
    q = F.when(q.isin(*ignore_qualifiers), "").otherwise(q) if ignore_qualifiers else q
    return facts.select(*keep, F.col("callee_name").alias("name"), q.alias("qualifier"), "dir")


def _answers(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, qualifier, dir, callee) for each distinct (name, qualifier, dir) that resolves."""
    s = symbols.groupBy("name", "id", "dir").agg(F.min("sym_ord").alias("sym_ord"))
    some = asked.where("qualifier <> ''").select("name", "qualifier").distinct()
    held = some.join(s.select("name", "id").distinct(), "name").where(F.contains("id", "qualifier"))
    fit = s.withColumn("qualifier", F.lit("")).unionByName(s.join(held, ["name", "id"]))
    here = fit.groupBy("name", "qualifier", "dir").agg(F.min(F.struct("sym_ord", "id")).alias("here"))
    first = here.groupBy("name", "qualifier").agg(F.min("here").alias("first"))
    best = asked.distinct().join(first, ["name", "qualifier"]).join(here, ["name", "qualifier", "dir"], "left")
    return best.select("name", "qualifier", "dir", F.coalesce("here.id", "first.id").alias("callee"))


def resolve_callees(facts: DataFrame, symbols: DataFrame, ignore_qualifiers: tuple[str, ...] = ()) -> DataFrame:
    """(fact_ord, callee): of the symbols of that name whose id holds the qualifier, the first in the
    caller's directory, or else the first. Unresolved call sites are left out.

    The answer depends on (name, qualifier, directory) only, however many call sites repeat them. Without
    a qualifier it is one of two minima, by (name, directory) and by name, the second taken from the first.
    Distinct (name, qualifier) meet distinct (name, id) to tell which ids hold them, and the same two minima
    follow; so the directories of a hot name never meet its symbols' directories in pairs."""
    f = _asked(facts, ignore_qualifiers, "fact_ord")
    return f.join(_answers(f.drop("fact_ord"), symbols), ["name", "qualifier", "dir"]).select("fact_ord", "callee")


def call_edges(facts: DataFrame, callers: DataFrame, callees: DataFrame) -> DataFrame:
    """(edge_ord, src, dst, line): a row for each call site with both ends, repeats and self calls included."""
    d = facts.select("fact_ord", "line").join(callers, "fact_ord").join(callees, "fact_ord")
    return d.select(F.col("fact_ord").alias("edge_ord"), F.col("caller").alias("src"), F.col("callee").alias("dst"), "line")


def build_edges(facts: DataFrame, symbols: DataFrame, ignore_qualifiers: tuple[str, ...] = (), innermost: bool = False) -> DataFrame:
    """What call_edges gives for both ends, in one pass: call sites keep their columns through the interval
    join, and then meet the answers for their (name, qualifier, directory), so no two tables of the size of the
    call sites are joined."""
    carry = ("line", "callee_name", "callee_qualifier", "dir")
    inside = _asked(enclosing_function(facts, symbols, innermost, carry), ignore_qualifiers, "fact_ord", "caller", "line")
    answers = _answers(_asked(facts, ignore_qualifiers), symbols)
    d = inside.join(answers, ["name", "qualifier", "dir"])
    return d.select(F.col("fact_ord").alias("edge_ord"), F.col("caller").alias("src"), F.col("callee").alias("dst"), "line")


def resolve_events(events: DataFrame, nodes: DataFrame, strict_path: bool = False) -> DataFrame:
    """Events with the function they ran (inner): its name is fn or fn's last dotted part, and the
    event's file ends with its path (after a slash, if strict_path); of several the smallest id."""
    n = nodes.select("id", F.col("name").alias("_name"), F.col("path").alias("_path"), F.col("line").alias("_line"))
    last = F.substring_index("fn", ".", -1)
    ends = F.col("file").endswith(F.col("_path"))
    if strict_path:
        ends = (F.col("file") == F.col("_path")) | F.col("file").endswith(F.concat(F.lit("/"), F.col("_path")))
    return events.join(n, (last == F.col("_name")) & ends)


def event_functions(events: DataFrame, nodes: DataFrame, strict_path: bool = False) -> DataFrame:
    """(seq, id) of the events that resolve. Distinct (fn, file) meet the nodes, not every event."""
    pairs = resolve_events(events.select("fn", "file").distinct(), nodes, strict_path).groupBy("fn", "file").agg(F.min("id").alias("id"))
    return events.select("seq", "fn", "file").join(pairs, ["fn", "file"]).select("seq", "id")


def events_with_fallback(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seq, id, path, line) of every event: the function's, or else the event's own under `dynamic-fallback`."""
    n = F.struct("id", F.col("_path").alias("path"), F.col("_line").alias("line"))
    pairs = resolve_events(events.select("fn", "file").distinct(), nodes).groupBy("fn", "file").agg(F.min(n).alias("n"))
    d = events.select("seq", "fn", "file", "line").join(pairs, ["fn", "file"], "left")
    return d.select("seq", F.coalesce("n.id", F.lit("dynamic-fallback")).alias("id"), F.coalesce("n.path", "file").alias("path"), F.coalesce("n.line", "line").alias("line"))


def resolve_symbols(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """(symbol, status, matches) for each requested symbol: `exact` if it is an id of any type, else by
    function name `unique`, `ambiguous` or `not_found`."""
    r = requests.select("symbol").distinct()
    exact = nodes.select(F.col("id").alias("symbol"), F.lit(True).alias("is_id")).distinct()
    named = nodes.where("type = 'function'").groupBy(F.col("name").alias("symbol")).agg(F.sort_array(F.collect_set("id")).alias("ids"))
    d = r.join(exact, "symbol", "left").join(named, "symbol", "left")
    n = F.size(F.coalesce("ids", F.array().cast("array<string>")))
    status = F.when(F.col("is_id"), "exact").when(n == 1, "unique").when(n > 1, "ambiguous").otherwise("not_found")
    matches = F.when(F.col("is_id"), F.array("symbol")).otherwise(F.coalesce("ids", F.array().cast("array<string>")))
    return d.select("symbol", status.alias("status"), matches.alias("matches"))
