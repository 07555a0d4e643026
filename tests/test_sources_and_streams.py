import json
import os
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, Not, StringStartsWith

from loomgraph.operators import graph, resolve, trace
from loomgraph.sources import shared, tree_files, trees
from loomgraph.streaming import checks, growing, live


def test_scan_sees_hidden_names_and_prunes(spark, tmp_path):
    for p in ("a/__init__.py", "a/.hidden/x.py", "node_modules/b/y.js", "a/env/z.py", "envy/_w.go"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    for root in (str(tmp_path), f"file://{tmp_path}"):
        files, dirs = trees.scan(spark, root)
        assert {r.path: r.content for r in files.collect()} == {p: p for p in ("a/__init__.py", "a/.hidden/x.py", "envy/_w.go")}
        assert {r.path for r in dirs.collect()} == {".", "a", "a/.hidden", "envy"}


def test_scan_pushes_tests_down_and_hands_on_what_it_does_not_list(spark, tmp_path):
    for k in range(40):
        p = tmp_path / f"d{k % 4}" / f"e{k % 5}" / f"f{k}.{('py', 'go')[k % 2]}"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x\xff" * k)
    (tmp_path / "d0" / "loop").symlink_to(tmp_path, target_is_directory=True)
    (tmp_path / "d0" / "gone.py").symlink_to(tmp_path / "nothing")
    (tmp_path / "d3" / "e9").mkdir()
    read = lambda **o: spark.read.format("source_tree").options(path=str(tmp_path), **o).load()
    tree_files.register(spark)
    every = {tuple(r) for r in read().collect()}
    assert len([r for r in every if not r[1]]) == 40 and len(every) == 40 + 1 + 4 + 20 + 1
    assert {r[3] for r in every if r[0].endswith("f3.go")} == {"x\ufffd" * 3}
    for o in ({"plan_entries": 1}, {"plan_entries": 6}, {"partition_bytes": 1}):
        assert {tuple(r) for r in read(**o).collect()} == every
    assert read(partition_bytes=1).rdd.getNumPartitions() >= 40
    for test, fits in (
        ("path like 'd1/%' and not is_dir", lambda r: r[0].startswith("d1/") and not r[1]),
        ("path like '%.py'", lambda r: r[0].endswith(".py")),
        ("path in ('d2/e3/f18.py', 'd2', 'none')", lambda r: r[0] in ("d2/e3/f18.py", "d2")),
        ("path = '.'", lambda r: r[0] == "."),
        ("is_dir", lambda r: r[1]),
        ("path like 'd1%' and path not like '%.go' and size > 9", lambda r: r[0].startswith("d1") and not r[0].endswith(".go") and (r[2] or 0) > 9),
    ):
        for o in ({}, {"plan_entries": 1}):
            assert {tuple(r) for r in read(**o).where(test).collect()} == {r for r in every if fits(r)}, test

    reader = tree_files.TreeReader({"path": str(tmp_path)})
    listed, entries = [], tree_files.Tree.entries
    tree_files.Tree.entries = lambda self, path: listed.append(path) or entries(self, path)
    try:
        assert list(reader.pushFilters([StringStartsWith(("path",), "d1/e1/"), Not(EqualTo(("is_dir",), True)), GreaterThan(("size",), 1)])) == [GreaterThan(("size",), 1)]
        assert {e[0] for p in reader.partitions() for e in p.entries} == {r[0] for r in every if r[0].startswith("d1/e1/") and not r[1]}
        assert sorted(listed) == [".", "d1", "d1/e1"]
    finally:
        tree_files.Tree.entries = entries
    with pytest.raises(Exception, match="no_such"):
        spark.read.format("source_tree").option("path", str(tmp_path / "no_such")).load().collect()


def test_source_lines(spark):
    d = spark.createDataFrame([("p", "a\r\nb\n\nc\n"), ("q", ""), ("r", None), ("s", "x")], "path string, content string")
    assert sorted(map(tuple, trees.source_lines(d).collect())) == [("p", 1, "a"), ("p", 2, "b"), ("p", 3, ""), ("p", 4, "c"), ("s", 1, "x")]


def test_lines_that_are_no_events(spark):
    lines = ['{"fn":"f","file":"a.py","line":3,"args":{"x":1}}', "{bad", "[1]", "7", '{"fn":"g","line":"x"}', '{"other":1}', ""]
    got = trace.parse(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.bad for r in got[:5]] == [False, True, True, True, True]
    assert (got[5].bad, got[5].fn, got[5].line) == (False, "", 0) and got[0].args == {"x": "1"}


def test_graph_files_and_export(spark, tmp_path):
    nodes = spark.createDataFrame([("m.f", "function", "f", "m.py", 1, 2), (".", "directory", ".", ".", None, None)], "id string, type string, name string, path string, line int, end_line int")
    edges = spark.createDataFrame([("m.f", "m.f", "calls", 1), (".", "m.py", "contains", 0)], "src string, dst string, type string, line int")
    trees.write_graph(nodes, edges, str(tmp_path / "g"))
    n, e = trees.read_graph(spark, str(tmp_path / "g"))
    assert n.count() == 2 and e.where("type = 'calls'").count() == 1
    got = [json.loads(r.value) for r in trees.export_lines(nodes, edges).collect()]
    assert {"kind": "node", "id": "m.f", "type": "function", "name": "f", "path": "m.py", "line": 1, "end_line": 2} in got
    assert {"kind": "node", "id": ".", "type": "directory", "name": ".", "path": "."} in got
    assert [x.get("line") for x in got if x["kind"] == "edge"] == [1, None] and len(got) == 4


def events(spark, n=60):
    rows = [(k, k % 3, ("C.f", "<listcomp>", "g")[k % 3], ("/app/m.py", "/app/m.py", "/usr/lib/x.py")[k % 3] if k % 2 else "/app/m.py", 1) for k in range(n)]
    return spark.createDataFrame(rows, "seq long, run_id long, fn string, file string, line int")


def test_stream_equals_batch(spark):
    e = events(spark)
    nodes = spark.createDataFrame([("m.f", "f", "m.py", 1, 2), ("m.g", "g", "m.py", 3, 4), ("n.g", "g", "m.py", 3, 4)], "id string, name string, path string, line int, end_line int")
    clean = trace.without_noise(e)
    batch = graph.hit_counts(resolve.event_functions(clean, nodes))
    assert sorted(map(tuple, checks.hits(e, nodes).collect())) == sorted(map(tuple, batch.collect()))
    want = {(str(r.run_id), r.seq, r.number) for r in trace.numbered(clean).collect()}
    assert {tuple(r) for r in checks.numbers(e).collect()} == want
    sizes = {str(r.run_id): r.n for r in trace.run_sizes(clean).collect()}
    assert {r.run_id: (r.n, r["last"]) for r in checks.state_numbers(e).collect()} == {k: (n, n) for k, n in sizes.items()}
    assert sorted(map(tuple, checks.recorded(e).collect())) == sorted(map(tuple, e.select("seq", "fn", "file", "line").collect()))
    assert {(r.run_id, r.seq) for r in checks.latest(e).collect()} == {(str(r.run_id), r.seq) for r in trace.playhead(clean).collect()}


def test_an_event_counts_once_in_a_stream(spark):
    nodes = spark.createDataFrame([("b.f", "f", "m.py", 1, 2), ("a.f", "f", "a/m.py", 1, 2)], "id string, name string, path string, line int, end_line int")
    e = spark.createDataFrame([(k, k % 5, "f", "/x/a/m.py" if k % 2 else "/x/m.py", 1) for k in range(40)], "seq long, run_id long, fn string, file string, line int")
    assert sorted(map(tuple, checks.hits(e, nodes).collect())) == [("a.f", 20), ("b.f", 20)]


def test_batches_that_run_again_change_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    write = live.upserting(path, ["k"], "k string, n long", compact_every=3)
    want = {}
    for number in range(11):
        new = {f"k{j}": number for j in range(number % 4, 7, 2)}
        want |= new
        batch = spark.createDataFrame(list(new.items()), "k string, n long")
        write(batch, number)
        write(batch, number)
        assert {r.k: r.n for r in live.upserted(spark, path, ["k"], "k string, n long").collect()} == want
    kept = [p.name for p in (tmp_path / "t").iterdir()]
    assert sum(n.startswith("base=") for n in kept) == 1 and len(kept) <= 5
    assert live.upserted(spark, f"file://{tmp_path}/none", ["k"], "k string, n long").count() == 0


def test_batches_write_what_changed(spark, tmp_path):
    """200 kinds of events, then batches of one event each: each writes one row."""
    rows = [(k, f"f{k % 200}", "/app/m.py", 1) for k in range(400)] + [(400, "f0", "/app/m.py", 1), (401, "f1", "/app/m.py", 1)]
    for k, (low, high) in enumerate(((0, 400), (400, 401), (401, 402))):
        (tmp_path / f"in{k}.jsonl").write_text("".join(f'{{"seq":{s},"fn":"{f}","file":"{p}","line":{n}}}\n' for s, f, p, n in rows[low:high]))
    stream = live.running_hits(live.events_of(live.read_lines(spark, f"file://{tmp_path}", 1)))
    path = f"file://{tmp_path}/_out"
    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/_c").foreachBatch(live.upserting(path, live.HIT_KEYS, live.HIT_SCHEMA)).trigger(availableNow=True).start()
    q.awaitTermination()
    sizes = sorted(spark.read.parquet(f"{path}/batch={n}").count() for n in range(3))
    assert sizes == [1, 1, 200]
    got = {r.fn: r.n for r in live.upserted(spark, path, live.HIT_KEYS, live.HIT_SCHEMA).collect()}
    assert got == {f"f{k}": 2 + (k < 2) for k in range(200)}


def test_growing_files_are_read_once(spark, tmp_path):
    growing.register(spark)
    folder, out, check = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/check"
    (folder / "run_id=a").mkdir(parents=True)

    def run():
        stream = spark.readStream.format("growing_lines").option("path", str(folder)).option("partition_bytes", "7").load()
        stream.writeStream.option("checkpointLocation", check).format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.parquet(out).select("run_id", "value").collect()))

    a, b = folder / "run_id=a" / "x", folder / "b.jsonl"
    a.write_bytes("one\r\ntwo é\nhal".encode())
    assert run() == [("a", "one"), ("a", "two é")]
    with a.open("ab") as f:
        f.write(b"f\n\nlong line of more than one range\n")
    b.write_bytes(b"other\n" * 3)
    want = [("a", ""), ("a", "half"), ("a", "long line of more than one range"), ("a", "one"), ("a", "two é"), *[("b.jsonl", "other")] * 3]
    assert run() == want
    with b.open("ab") as f:
        f.write(b"unfinished")
    assert run() == want
    reader = growing.GrowingReader({"path": str(folder)})
    before = reader.latestOffset()
    b.write_bytes(b"short\n")
    with pytest.raises(ValueError, match="shorter"):
        reader.partitions(before, reader.latestOffset())


def test_lines_are_routed_to_two_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"fn":"f","file":"a"}\n{bad\n\n')
    (tmp_path / "b.jsonl").write_text("worse\n")
    out = f"file://{tmp_path}/_out"
    checks._finish(live.read_lines(spark, f"file://{tmp_path}", 1), live.routed(out))
    assert [r.fn for r in spark.read.parquet(f"{out}/events").collect()] == ["f"]
    bad = spark.read.parquet(f"{out}/malformed")
    assert sorted(map(tuple, bad.select("value", "run_id", "batch").collect())) in ([("", "a.jsonl", n), ("worse", "b.jsonl", 1 - n), ("{bad", "a.jsonl", n)] for n in (0, 1))


def test_scopes_of_two_threads(spark):
    """A thread's scope ends while another's is open: each removes its own tables."""
    inside, ended = threading.Event(), threading.Event()
    found = {}

    def first():
        with shared.scope(spark):
            t = shared.cut(spark.range(3))
            with shared.scope(spark):
                kept = shared.cut(spark.range(5), keep=True)
            inside.set()
            ended.wait(60)
            found["first"] = (t.count(), kept.count())
        found["gone"] = not os.path.exists(t.inputFiles()[0].removeprefix("file://"))

    def second():
        inside.wait(60)
        with shared.scope(spark):
            found["second"] = shared.cut(spark.range(4)).count()
        ended.set()

    threads = [threading.Thread(target=f) for f in (first, second)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert found == {"first": (3, 5), "second": 4, "gone": True}


def test_lines_name_their_runs(spark, tmp_path):
    (tmp_path / "run_id=7").mkdir()
    (tmp_path / "run_id=7" / "x.txt").write_text('{"fn":"f","file":"a","seq":4}\n{bad\n')
    (tmp_path / "solo.jsonl").write_text('{"fn":"g"}\n')
    got = checks._appended(live.read_lines(spark, f"file://{tmp_path}"))
    assert sorted((r.run_id, r.value[:6]) for r in got.collect()) == [("7", '{"fn":'), ("7", "{bad"), ("solo.jsonl", '{"fn":')]
    d = spark.createDataFrame([(b"r1", b'{"fn":"f"}')], "key binary, value binary")
    assert tuple(live.events_of(live.lines_of_messages(d)).select("run_id", "fn", "seq").first()) == ("r1", "f", None)


def test_malformed_lines_come_through_as_they_were(spark):
    d = spark.createDataFrame([("{bad", "r"), ('{"fn":"f"}', "r")], "value string, run_id string")
    assert [r.value for r in live.malformed(d).collect()] == ["{bad"]
    assert live.events_of(d).select("fn").first().fn == "f"


def test_trace_order(spark):
    e = events(spark, 9)
    assert [r.seq for r in trace.first_events(e, 2).collect()] == [0, 1]
    assert trace.first_events(e, 0).count() == 9
    assert {r.run_id: r.seq for r in trace.playhead(e).collect()} == {0: 6, 1: 7, 2: 8}
    assert {r.run_id: r.seq for r in trace.playhead(e, 2).collect()} == {0: 3, 1: 4, 2: 5}
    assert trace.numbered(e).where(F.col("number") > F.col("n")).count() == 0
