"""Long files: what is held, moved and met must not grow with the square of a file, nor with all of its tokens."""

import pyarrow as pa

from loomgraph.extract import line_rules, registry, token_rules, tokens
from loomgraph.plans.registry import corpus_files


def plan(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_no_window_up_to_the_last_row(spark):
    """Such a frame is computed anew for each row."""
    files = spark.createDataFrame([("a.js", "const f = (a) => {\n};\n"), ("b.go", "func f() {\n}\n"), ("c.c", "int f(int a) {\n}\n"), ("d.py", "def f():\n    pass\n"), ("e.rs", "fn f(a: bool) {\n}\n")], "path string, content string")
    rules = [line_rules.Rule("rust", "def", r"\bfn\s+(\w+)\s*\(", suffixes=(".rs",))]
    symbols, _ = registry.extract_symbols(files, rules=rules)
    assert "unboundedfollowing" not in plan(symbols).replace("unboundedpreceding$(), unboundedfollowing$()", "")
    assert sorted((r.lang, r.start_line, r.end_line) for r in symbols.collect()) == [("c", 1, 2), ("go", 1, 2), ("js", 1, 2), ("python", 1, 2), ("rust", 1, 2)]


def test_calls_meet_no_file_again(spark):
    """A join with the files' tokens, small where compressed, was broadcast whole through the driver."""
    code = "function f(a) {\n" + "  if (a) { foo().g(3); arr[0].b.h(2); } // skip(f)\n" * 50 + "}\n"
    facts, _ = registry.extract_calls(spark.createDataFrame([("a.js", code)], "path string, content string"))
    text = plan(facts)
    assert "raw" not in text and "tokens" not in text
    assert sorted({(r.callee_qualifier, r.callee_name) for r in facts.collect()}) == [("", "foo"), ("arr[0].b", "h"), ("foo()", "g")]


def test_a_long_file_is_few_rows_at_a_time():
    """A task holds a bounded number of rows; what no rule asks for is no row."""
    n = 40_000
    code = "function f(a) { if (a) { b(1, 2, [3]); } }\n" * n
    batch = pa.RecordBatch.from_arrays([pa.array(["a.js"]), pa.array(["js"]), pa.array([code])], ["path", "lang", "content"])
    for what, rows in (("definitions", 2 * n), ("calls", 3 * n)):  # `f` and `if`; `f`, `if` and `b`
        sizes = [b.num_rows for b in tokens._sites(what)(iter([batch]))]
        assert sum(sizes) == rows and max(sizes) <= 2 * tokens.ROWS


def test_corpus_of_one_long_file(spark):
    """All functions of a path with all call sites of a path would be 400 million pairs."""
    n = 20_000
    symbols = spark.range(n).selectExpr("'a.py' AS path", "lpad(id, 6, '0') AS sym_ord", "concat('f', id) AS name", "CAST(20 * id + 1 AS INT) AS start_line")
    called = spark.range(n).where("id % 3 > 0").selectExpr("'a.py' AS path", "CAST(20 * id + 4 + 17 * (id % 2) AS INT) AS start_line", "concat('g', id) AS callee_name")
    d = corpus_files(symbols, called, 4)
    assert "bucket" in plan(d)
    of = {}
    for k in range(n):
        if k % 3:
            of.setdefault(k + k % 2, []).append(f"g{k}")
    want = "\n".join("\n".join([f"function f{k}(a) {{", *sorted(f"  if (a) {{ {c}(); }} // skip(f{k})" for c in of.get(k, [""])), "}"]) for k in range(n))
    (got,) = d.collect()
    assert (got.path, got.content) == ("a.js", want)


def test_definitions_are_dealt_once(spark):
    """Each window used to have a key of its own, by which whole sites were shuffled again."""
    d = tokens.sites(spark.createDataFrame([("a.js", "js", "const zero = 0,\nf = (a) => {\n};\n")], "path string, lang string, content string"), "definitions")
    for rules in (token_rules.js_definitions, token_rules.c_definitions, token_rules.go_definitions):
        assert rules(d)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [(r.name, r.start_line, r.end_line) for r in token_rules.js_definitions(d).collect()] == [("f", 2, 3)]


def test_plain_code_is_cut_by_few_calls():
    """Each token used to be a match, and a dozen steps in Python, of its own."""
    code = "function f(a) { if (a) { b(1, 2, [3]); } } // skip(f)\n"
    calls = []
    whole = tokens._WHOLE["js"]

    class Counted:
        def findall(self, *a):
            calls.append(a[1:])
            return whole.findall(*a)

    tokens._WHOLE["js"] = Counted()
    try:
        placed = tokens.Placed(code * 10_000, "js")
    finally:
        tokens._WHOLE["js"] = whole
    assert placed.n == 240_000 and len(calls) <= 10 and placed.fault is None
    tail = [x[1:3] for x in tokens.scan("a = \n" * 9000 + "/[/*]/.c(1) / `x ${ {}.d(/}/) } y`", "js")][-18:]
    assert tail == [("regex", "/[/*]/"), ("punct", "."), ("name", "c"), ("punct", "("), ("num", "1"), ("punct", ")"), ("punct", "/"), ("str", "`x "), ("punct", "${"), ("punct", "{"), ("punct", "}"), ("punct", "."), ("name", "d"), ("punct", "("), ("regex", "/}/"), ("punct", ")"), ("punct", "}"), ("str", " y`")]


def test_faults_alone_are_few_rows_at_a_time(monkeypatch):
    """Files with nothing but a fault used to be held until a site came, each as a batch of its own."""
    monkeypatch.setattr(tokens, "ROWS", 64)
    monkeypatch.setattr(tokens.np, "isin", None)  # a sort for each question about a word
    batch = pa.RecordBatch.from_arrays([pa.array([f"{k}.go" for k in range(300)]), pa.array(["go"] * 300), pa.array([")"] * 300)], ["path", "lang", "content"])
    assert [b.num_rows for b in tokens._sites("calls")(iter([batch]))] == [64, 64, 64, 64, 44]
