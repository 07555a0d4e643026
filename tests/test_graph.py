import random
from collections import deque
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomgraph.operators import graph, hierarchy, lookup, resolve, traverse
from loomgraph.sources import shared

EDGE = "edge_ord long, src string, dst string, line int"
SYMBOL = "sym_ord int, id string, name string, path string, dir string, start_line int, end_line int"
FACT = "fact_ord long, path string, dir string, line int, start_line int, end_line int, callee_name string, callee_qualifier string"


def edges_of(spark, pairs):
    return spark.createDataFrame([(i, a, b, i) for i, (a, b) in enumerate(pairs)], EDGE)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def reached(pairs, start, back=True):
    seen, todo = set(), [start]
    while todo:
        at = todo.pop()
        for a, b in pairs:
            near, far = (b, a) if back else (a, b)
            if near == at and far not in seen:
                seen.add(far)
                todo.append(far)
    return seen


def first_path(pairs, start, end):
    if start == end:
        return [start]
    queue, came = deque([start]), {start: None}
    while queue:
        at = queue.popleft()
        for a, b in pairs:
            if a == at and b not in came:
                came[b] = at
                if b == end:
                    path = [b]
                    while came[path[-1]] is not None:
                        path.append(came[path[-1]])
                    return path[::-1]
                queue.append(b)
    return None


def test_closure_holds_its_seed_only_on_a_cycle(spark):
    pairs = [("a", "b"), ("b", "c"), ("x", "x"), ("c", "d"), ("d", "b")]
    got = {(r.seed, r.id) for r in traverse.closure(edges_of(spark, pairs), ids(spark, "a", "c", "x", "nobody")).collect()}
    assert got == {("c", "a"), ("c", "b"), ("c", "c"), ("c", "d"), ("x", "x")}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_walks_match_breadth_first_search(spark, seed):
    r = random.Random(seed)
    names = "abcdefg"
    pairs = [(r.choice(names), r.choice(names)) for _ in range(r.randrange(1, 14))]
    e = edges_of(spark, pairs)
    got = {(x.seed, x.id) for x in traverse.closure(e, ids(spark, *names), callers=False).collect()}
    assert got == {(s, t) for s in names for t in reached(pairs, s, back=False)}
    want = [(a, b) for a in "abc" for b in names]
    paths = {}
    for x in sorted(traverse.shortest_paths(e, spark.createDataFrame(want, "start string, end string")).collect(), key=lambda x: x.step):
        paths.setdefault((x.start, x.end), []).append(x.id)
    assert paths == {(a, b): p for a, b in want if (p := first_path(pairs, a, b))}


def test_outermost_and_innermost_callers(spark):
    s = spark.createDataFrame([(1, "m.out", "out", "p", ".", 1, 500), (2, "m.in", "in", "p", ".", 70, 90), (3, "q.f", "f", "q", ".", 1, 5)], SYMBOL)
    f = spark.createDataFrame([(1, "p", ".", 80, 80, 80, "x", ""), (2, "p", ".", 499, 499, 501, "x", ""), (3, "q", ".", 9, 9, 9, "x", ""), (4, "q", ".", 5, 5, 5, "x", "")], FACT)
    assert sorted(map(tuple, resolve.enclosing_function(f, s).collect())) == [(1, "m.out"), (4, "q.f")]
    assert sorted(map(tuple, resolve.enclosing_function(f, s, innermost=True).collect())) == [(1, "m.in"), (4, "q.f")]


def test_callees_prefer_their_directory_then_order(spark):
    s = spark.createDataFrame([(1, "a.f", "f", "x/a.py", "x", 1, 2), (2, "b.f", "f", "y/b.py", "y", 1, 2), (3, "c.f", "f", "y/c.py", "y", 1, 2)], SYMBOL)
    f = spark.createDataFrame([(k, "p", d, 1, 1, 1, n, q) for k, (d, n, q) in enumerate([("y", "f", ""), ("z", "f", ""), ("y", "f", "c"), ("x", "f", "self"), ("x", "g", "")])], FACT)
    assert sorted(map(tuple, resolve.resolve_callees(f, s).collect())) == [(0, "b.f"), (1, "a.f"), (2, "c.f")]
    assert dict(map(tuple, resolve.resolve_callees(f, s, ignore_qualifiers=("self",)).collect()))[3] == "a.f"


def test_call_edges_keep_repeats(spark):
    f = spark.createDataFrame([(1, "p", ".", 3, 3, 3, "f", ""), (2, "p", ".", 3, 3, 3, "f", "")], FACT)
    a = spark.createDataFrame([(1, "m.f"), (2, "m.f")], "fact_ord long, caller string")
    b = spark.createDataFrame([(1, "m.f"), (2, "m.f")], "fact_ord long, callee string")
    assert [tuple(r)[1:] for r in resolve.call_edges(f, a, b).collect()] == [("m.f", "m.f", 3)] * 2


def test_tree_order_and_flags(spark):
    s = spark.createDataFrame([(1, "m.b", "b", "d/m.py", "d", 9, 9), (2, "m.a", "a", "d/m.py", "d", 20, 20), (3, "m.b", "b", "d/m.py", "d", 1, 2)], SYMBOL)
    nodes, has = graph.all_nodes(s, s.select("path")), graph.containment_edges(s, s.select("path"))
    tree = hierarchy.flatten(nodes, has, graph.roots(nodes, has)).orderBy("path_key").collect()
    assert [(r.label, r.depth, r.has_children) for r in tree] == [("./", 0, True), ("d/", 1, True), ("m.py", 2, True), ("b", 3, False), ("a", 3, False)]
    assert graph.last_wins(s).where("id = 'm.b'").first().line == 1
    assert has.where("dst = 'm.b'").count() == 2  # an edge for each symbol row
    assert {r.id: r.n_children for r in graph.with_children(nodes, has).collect()}["d/m.py"] == 2


def test_requests_for_symbols(spark):
    nodes = spark.createDataFrame([("m.f", "function", "f"), ("n.f", "function", "f"), ("m.g", "function", "g"), ("f.py", "file", "f.py")], "id string, type string, name string")
    got = {r.symbol: (r.status, r.matches) for r in resolve.resolve_symbols(spark.createDataFrame([(x,) for x in ("m.f", "f", "g", "f.py", "h")], "symbol string"), nodes).collect()}
    assert got == {"m.f": ("exact", ["m.f"]), "f": ("ambiguous", ["m.f", "n.f"]), "g": ("unique", ["m.g"]), "f.py": ("exact", ["f.py"]), "h": ("not_found", [])}


def test_events_match_by_last_name_and_path_end(spark):
    nodes = spark.createDataFrame([("m.f", "f", "a/m.py", 3), ("z.f", "f", "m.py", 4)], "id string, name string, path string, line int")
    events = spark.createDataFrame([(1, "f", "/x/a/m.py", 9), (2, "C.f", "/x/bm.py", 9), (3, "f", "other.py", 9), (4, "xf", "/x/m.py", 9)], "seq long, fn string, file string, line int")
    assert sorted(map(tuple, resolve.event_functions(events, nodes).collect())) == [(1, "m.f"), (2, "z.f")]
    assert sorted(map(tuple, resolve.event_functions(events, nodes, strict_path=True).collect())) == [(1, "m.f")]
    back = {r.seq: (r.id, r.path, r.line) for r in resolve.events_with_fallback(events, nodes).collect()}
    assert back[3] == ("dynamic-fallback", "other.py", 9) and back[1] == ("m.f", "a/m.py", 3)


def test_slices_without_an_end_go_on_for_twenty_lines(spark):
    lines = spark.createDataFrame([("p", k, f" l{k} ") for k in range(1, 60)], "path string, line_no int, text string")
    nodes = spark.createDataFrame([("a", "p", 2, 3), ("b", "p", 5, 0), ("c", "q", 1, 2)], "id string, path string, line int, end_line int")
    got = {r.id: r.source for r in lookup.source_slices(nodes, lines).collect()}
    assert got["a"] == " l2 \n l3 " and got["b"].count("\n") == 20 and "c" not in got
    at = spark.createDataFrame([("p", 4), ("p", 99)], "path string, line int")
    assert sorted(r.signature for r in lookup.signatures(at, lines).collect()) == ["", "l4"]


@pytest.mark.parametrize("paths, want", [([], "Unknown"), (["a.txt"], "Unknown"), (["b.go", "a.py", "c.go"], "Go, Python")])
def test_language_list(spark, paths, want):
    assert graph.language_list(spark.createDataFrame([(p,) for p in paths], "path string")).first()[0] == want


def test_ancestors_take_the_first_edge_and_end_on_cycles(spark):
    d = spark.createDataFrame([("z", "f", 1), ("a", "f", 2), ("r", "z", 3), ("q", "r", 4), ("r", "q", 5)], "src string, dst string, edge_ord int")
    got = sorted(tuple(r) for r in traverse.ancestors(d, spark.createDataFrame([("f",)], "id string")).collect())
    assert got == [("f", "q", 3), ("f", "r", 2), ("f", "z", 1)]
    chain = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(3)], "src string, dst string")
    assert traverse.ancestors(chain, spark.createDataFrame([("n3",)], "id string")).count() == 3


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("fg"), st.sampled_from(["x.f", "y.f", "x.g", "y.z.g"]), st.sampled_from("de")), min_size=1, max_size=8), st.lists(st.tuples(st.sampled_from("fgh"), st.sampled_from(["", "x", "y", "nope"]), st.sampled_from("dek")), min_size=1, max_size=8))
def test_callees_match_a_plain_search(spark, symbols, facts):
    s = spark.createDataFrame([(k, *x) for k, x in enumerate(symbols)], "sym_ord int, name string, id string, dir string")
    f = spark.createDataFrame([(k, *x) for k, x in enumerate(facts)], "fact_ord int, callee_name string, callee_qualifier string, dir string")
    want = {}
    for k, (name, q, d) in enumerate(facts):
        fits = [(x[2] != d, o, x[1]) for o, x in enumerate(symbols) if x[0] == name and q in x[1]]
        if fits:
            want[k] = min(fits)[2]
    assert {r.fact_ord: r.callee for r in resolve.resolve_callees(f, s).collect()} == want


def test_walks_leave_one_table(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    pairs = [(f"n{k}", f"n{k + 1}") for k in range(10)]
    before = set(folder.iterdir())
    got = traverse.closure(edges_of(spark, pairs), ids(spark, "n10"))
    assert len(set(folder.iterdir()) - before) == 1 and got.count() == 10
    with shared.scope(spark):
        assert traverse.ancestors(edges_of(spark, pairs), ids(spark, "n10")).count() == 10
    assert len(set(folder.iterdir()) - before) == 1
    shared.clear(spark)
    assert not set(folder.iterdir()) - before
