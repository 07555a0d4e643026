import collections

from loomgraph.extract import registry

FILES = [
    ("pkg/m.py", "class A:\n    def f(self):\n        def inner():\n            g()\n        self.h(a.b.k())\n        return inner\n\nasync def f():\n    A.f()\n"),
    ("pkg/bad.py", "def broken(:\n"),
    ("web/a.js", "class Box {\n  open(x) {\n    if (x) { this.shut(); }\n  }\n}\nfunction top() {\n  // no call();\n  const s = 'f() {';\n  api.v1.get(s);\n}\nconst arrow = (x) => {\n  return top();\n};\n"),
    ("svc/run.go", "package svc\nfunc Start(n int) {\n\tgo work(n)\n\tlog.Print(n)\n}\nfunc (s *Server) Stop() {\n\ts.close()\n}\n"),
    ("lib/x.c", "/* f(); */\nstatic int add(int a, int b) {\n  return sum(a, b);\n}\nint declared(int a);\n"),
    ("README", "f()"),
]


def files(spark):
    return spark.createDataFrame(FILES, "path string, content string")


def test_definitions(spark):
    symbols, errors = registry.extract_symbols(files(spark))
    got = sorted((r.id, r.start_line, r.end_line) for r in symbols.collect())
    assert got == [("a.Box.open", 2, 4), ("a.arrow", 11, 13), ("a.top", 6, 10), ("m.A.f", 2, 6), ("m.A.inner", 3, 4), ("m.f", 8, 9), ("svc.*Server.Stop", 6, 8), ("svc.Start", 2, 5), ("x.c::add", 2, 4)]
    assert [r.path for r in errors.collect()] == ["pkg/bad.py"]
    langs = [r.lang for r in symbols.orderBy("sym_ord").collect()]
    assert langs == sorted(langs, key=["c", "go", "js", "python"].index)


def test_calls(spark):
    facts, _ = registry.extract_calls(files(spark))
    got = {(r.lang, r.line, r.callee_qualifier, r.callee_name) for r in facts.collect()}
    assert {("python", 4, "", "g"), ("python", 5, "self", "h"), ("python", 5, "", "k"), ("python", 9, "A", "f"), ("js", 3, "this", "shut"), ("js", 9, "api.v1", "get"), ("js", 12, "", "top"), ("go", 3, "", "work"), ("go", 4, "log", "Print"), ("go", 7, "s", "close"), ("c", 3, "", "sum")} <= got
    assert not any(n in ("call", "if", "return") or (lang == "c" and line in (1, 2)) for lang, line, _, n in got)


def test_definition_sites_take_the_first_pattern(spark):
    code = "class A {\n  constructor(x) {\n    if (x) {}\n  }\n  *gen() {\n  }\n}\nobj.h = (x) => {\n}\nlet g = async (a,\n b) => {\n}\nexports.k = function (a) {\n}\nasync function z() {\n}\n"
    d = spark.createDataFrame([("a.js", code), ("b.js", None)], "path string, content string")
    got = sorted((r.line, r.name) for r in registry.definition_sites(d).collect())
    assert got == [(2, "constructor"), (5, "gen"), (8, "h"), (10, "g"), (13, "function"), (15, "z")]


def names(spark, path, code):
    d = spark.createDataFrame([(path, code)], "path string, content string")
    symbols = sorted((r.start_line, r.end_line, r.id) for r in registry.extract_symbols(d)[0].collect())
    calls = sorted((r.line, r.callee_qualifier, r.callee_name) for r in registry.extract_calls(d)[0].collect())
    return symbols, calls


def test_words_of_one_language_are_names_in_others(spark):
    go = "package p\nfunc of() {\n\tcatch(x)\n\tgo run(1)\n}\nfunc function(a int) {\n}\n"
    assert names(spark, "p/a.go", go) == ([(2, 5, "p.of"), (6, 7, "p.function")], [(3, "", "catch"), (4, "", "run")])
    assert names(spark, "a.c", "int new(int a) {\n  with(a);\n}\n") == ([(1, 3, "a.c::new")], [(2, "", "with")])
    js = "class B {\n  constructor(a) {\n    go(1);\n  }\n  static async *gen(x = f()) {\n  }\n  get size() { return 1; }\n}\n"
    assert names(spark, "b.js", js) == ([(2, 4, "b.B.constructor"), (5, 6, "b.B.gen"), (7, 7, "b.B.size")], [(3, "", "go"), (5, "", "f")])


def test_headers_over_several_lines(spark):
    c = "int add(int a,\n        int (*f)(int))\n\n{\n  return sum(a,\n    b(1));\n}\nstatic void g(void)\n{\n}\n"
    assert names(spark, "x.c", c) == ([(1, 7, "x.c::add"), (8, 10, "x.c::g")], [(5, "", "sum"), (6, "", "b")])
    js = "function f(\n  a,\n  b\n) {\n  if (a &&\n      b) {\n    h()\n  }\n}\n"
    assert names(spark, "x.js", js) == ([(1, 9, "x.f")], [(7, "", "h")])
    go = "package q\nfunc (s *S) M(a int,\n\tb int) (int, error) {\n\treturn s.n(b)\n}\n"
    assert names(spark, "q/x.go", go) == ([(2, 5, "q.*S.M")], [(4, "s", "n")])


def test_comments_and_strings_over_several_lines(spark):
    c = "/* one\n * and include/*.h\n */\nint f(void) {\n  char *s = \"}{ /* g() */\";\n  // h() {\n  return k(s);\n}\n"
    assert names(spark, "x.c", c) == ([(4, 8, "x.c::f")], [(7, "", "k")])
    js = "const t = `one {\n two() {\n`;\nfunction f() {\n  return t;\n}\n"
    assert names(spark, "x.js", js) == ([(4, 6, "x.f")], [])


def test_python_by_indentation(spark):
    code = '"""Doc: def no():\n    x()\n"""\nimport os\n\nclass A(Base):\n    @wrap(1)\n    def f(self, a,\n          b=(1,\n2)):\n        x = """\nzero column\n""".join(a)\n        # comment\n\n    async def g(self): return await h()\n\n    z = 1\ndef top(a):\n    def inner():\n        a.b.k()\n    return (inner(),\nother())  # tail()\n\n\nvalue = top(2) \\\n  + A().f\n'
    symbols, calls = names(spark, "m.py", code)
    assert symbols == [(8, 13, "m.A.f"), (16, 16, "m.A.g"), (19, 23, "m.top"), (20, 21, "m.inner")]
    assert calls == [(7, "", "wrap"), (13, "", "join"), (16, "", "h"), (21, "", "k"), (22, "", "inner"), (23, "", "other"), (26, "", "top"), (27, "", "A")]


def test_definitions_of_real_files_match_the_parser(spark):
    """The line scan against the standard library's parser, over the library's own sources."""
    import ast
    import glob
    import os

    files = [(os.path.basename(f), open(f, encoding="utf-8").read()) for f in sorted(glob.glob(os.path.join(os.path.dirname(ast.__file__), "[a-d]*.py")))]
    d = spark.createDataFrame(files, "path string, content string")
    symbols, errors = registry.extract_symbols(d)
    got = {(r.path, r.name, r.start_line, r.end_line) for r in symbols.collect()}
    want = {(p, n.name, n.lineno, n.end_lineno) for p, text in files for n in ast.walk(ast.parse(text)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}
    assert errors.count() == 0 and len(want) > 500
    assert len(got ^ want) <= 0.002 * len(want)
    found = collections.Counter((r.path, r.line, r.callee_name, r.callee_qualifier) for r in registry.extract_calls(d)[0].collect())
    named = [(p, n.func.end_lineno, n.func.id, "") if isinstance(n.func, ast.Name) else (p, n.func.end_lineno, n.func.attr, n.func.value.id if isinstance(n.func.value, ast.Name) else "") for p, text in files for n in ast.walk(ast.parse(text)) if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute))]
    assert sum((found & collections.Counter(named)).values()) >= 0.99 * max(len(named), sum(found.values()))


def test_rules_from_files(spark, tmp_path):
    (tmp_path / "rules.json").write_text('{"lang":"go","kind":"def","pattern":"^fn (\\\\w+)"}\n')
    rules = registry.read_rules(spark, str(tmp_path / "rules.json"))
    d = spark.createDataFrame([("a/x.go", "fn one {\n}\nfunc two() {\n}\n"), ("y.c", "int f(int a) {\n}\n")], "path string, content string")
    assert sorted(r.name for r in registry.extract_symbols(d, rules=rules)[0].collect()) == ["f", "one"]


def test_files_that_do_not_close_are_errors(spark):
    d = spark.createDataFrame([("deep.py", "def g():\n  (" + "(" * 100_000), ("ok.py", "def f(): pass"), ("none.go", None), ("empty.c", ""), ("x.c", "int f(int a) {\n")], "path string, content string")
    symbols, errors = registry.extract_symbols(d)
    assert sorted(r.id for r in symbols.collect()) == ["ok.f", "x.c::f"]
    assert sorted(r.path for r in errors.collect()) == ["deep.py", "none.go", "x.c"]
    assert registry.extract_symbols(d.limit(0))[0].count() == 0


def test_own_extractor(spark):
    registry.register_extractor(registry.Extractor("toy", (".toy",), definitions=lambda path, content: [{"lang": "toy", "path": path, "name": w, "start_line": 1, "end_line": 1, "start_col": k} for k, w in enumerate(content.split())]))
    try:
        symbols, _ = registry.extract_symbols(spark.createDataFrame([("a.toy", "x y")], "path string, content string"), id_scheme="path")
        assert sorted(r.id for r in symbols.collect()) == ["a.toy.x", "a.toy.y"]
    finally:
        registry._all.pop("toy")
