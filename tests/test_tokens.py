"""The token stream's rules: forms that a scan of lines can't tell."""

import re

import pyarrow as pa
from loomgraph.extract import registry, tokens

JS = {
    "one.js": "class A { run() { go(1); } stop() { halt(); } }\nfunction one() { return 1; } function two() {\n  b();\n}\n",
    "literal.js": "const o = {\n  m() { return n(1); },\n  async *gen(a) {\n    yield q(a);\n  },\n  get size() { return 2; },\n  plain: function (x) { return x; },\n  if(a) { return a; },\n};\nfoo(a, {\n  inner(b) { b(); }\n});\n",
    "arrows.js": "const f = async (a = g(h(1))) => {\n  k();\n};\nlet p = 1, r = b => b,\n  s = ({ a, b }) =>\n    a + b\nvar t = async x => x\nx.y = c => c; z = 1, w = d => d;\nfunction q(u, v = e => e) { }\nconst last = y => z(\n  y\n)\n",
    "calls.js": "new Thing(4); new a.b.Deep(1); new Foo(1).bar(2);\nfoo().chain(3);\narr[0].elem(2);\nobj?.opt(1); fn?.(7);\na.b // note\n  .c(d(1)[2].e());\nthis.x(); super.y(); super(1);\nobj.catch(1).delete(2); (a + b).plus();\n`x ${inner(1)} ${`deep ${more(2)}`}`.trim();\nif (q) { } while (w()) { }\nvoid f()(2); import('m');\n'text'.at(0); tag`x`.go();\n",
    "regex.js": "const a = /\"/.test(s) ? left(1) : /[/'}]/g;\nfunction f() { return /}/.exec(x); }\nlet c = d / e(1) / 2; g(\"'\");\n",
    "classes.js": "class Base extends mixin(Other) {\n  #secret() { return 1; }\n  static x = make();\n  constructor() { super(); this.#secret(); }\n  catch(e) { return e; }\n  run = () => { this.go(); }\n}\nconst E = class Named { m() { } };\nclass Out { a() { return class In { b() { } }; } }\nexport default class D { z() { } }\n",
    "expressions.js": "const v = function named(a) { return a; };\n(function iife() { })();\nexport default async function main() { }\nfunction* gen() { }\nx = async function late() { };\n",
}
C = {
    "own.c": "#include <a.h>\n#define M(x) \\\n  call(x)\n#define N M(2)\nstatic int\nfoo(int a)\n{\n  return M(a);\n}\n\nint K(a) int a; {\n  return k(a);\n}\n",
    "more.c": "int declared(int a);\nchar *named(int n) { return dup(n); }\nstruct s { int (*f)(int); } v;\nextern \"C\" {\nvoid g(void) { s.call(1); p->m(2); x = y * z(3); }\n}\nint x = init(1);\n#if defined(A)\n#endif\nconst struct s *h(void);\n/* c() */ void w(void) { if (a) { do b(); while (c()); } }\n",
}
GO = {
    "p/a.go": "package p\ntype I interface {\n\tClose() error\n}\nfunc F[T any](a T) (int, error) { return g(a), nil }\nfunc (s *S[T]) M(f func(int) int) struct{} {\n\ta.b.c(1); x.y(2); z()(3); q[0].r(4)\n\tdefer func() { done() }()\n\treturn struct{}{}\n}\nfunc (S) N() func(int) int {\n\treturn h\n}\nvar v = make([]int, 2)\nfunc outside(a int) int\nfunc Last() { s := `raw } ${` + \"}\" }\n",
}


def extracted(spark, files):
    d = spark.createDataFrame(list(files.items()), "path string, content string")
    symbols, calls, errors = {}, {}, registry.extract_symbols(d)[1].collect()
    for r in registry.extract_symbols(d)[0].collect():
        symbols.setdefault(r.path, []).append((r.start_line, r.end_line, r.id))
    for r in registry.extract_calls(d)[0].collect():
        calls.setdefault(r.path, []).append((r.start_line, r.end_line, r.callee_qualifier, r.callee_name))
    return {k: sorted(v) for k, v in symbols.items()}, {k: sorted(v) for k, v in calls.items()}, errors


def test_javascript(spark):
    symbols, calls, errors = extracted(spark, JS)
    assert not errors
    assert symbols["one.js"] == [(1, 1, "one.A.run"), (1, 1, "one.A.stop"), (2, 2, "one.one"), (2, 4, "one.two")]
    assert symbols["literal.js"] == [(2, 2, "literal.m"), (3, 5, "literal.gen"), (6, 6, "literal.size"), (11, 11, "literal.inner")]
    assert symbols["arrows.js"] == [(1, 3, "arrows.f"), (4, 4, "arrows.r"), (5, 6, "arrows.s"), (7, 7, "arrows.t"), (9, 9, "arrows.q"), (10, 12, "arrows.last")]
    assert symbols["classes.js"] == [(4, 4, "classes.Base.constructor"), (5, 5, "classes.Base.catch"), (8, 8, "classes.m"), (9, 9, "classes.Out.a"), (9, 9, "classes.Out.b"), (10, 10, "classes.D.z")]
    assert symbols["expressions.js"] == [(3, 3, "expressions.main")]
    assert symbols["regex.js"] == [(2, 2, "regex.f")]
    assert calls["one.js"] == [(1, 1, "", "go"), (1, 1, "", "halt"), (3, 3, "", "b")]
    assert calls["literal.js"] == [(2, 2, "", "n"), (4, 4, "", "q"), (10, 12, "", "foo"), (11, 11, "", "b")]
    assert calls["arrows.js"] == [(1, 1, "", "g"), (1, 1, "", "h"), (2, 2, "", "k"), (10, 12, "", "z")]
    want = [(1, 1, "new Foo(1)", "bar"), (2, 2, "", "foo"), (2, 2, "foo()", "chain"), (3, 3, "arr[0]", "elem"), (4, 4, "", "fn"), (4, 4, "obj", "opt")]
    want += [(5, 6, "a.b", "c"), (6, 6, "", "d"), (6, 6, "d(1)[2]", "e"), (7, 7, "super", "y"), (7, 7, "this", "x"), (8, 8, "(a + b)", "plus"), (8, 8, "obj", "catch"), (8, 8, "obj.catch(1)", "delete")]
    want += [(9, 9, "", "inner"), (9, 9, "", "more"), (9, 9, "`x ${inner(1)} ${`deep ${more(2)}`}`", "trim"), (10, 10, "", "w"), (11, 11, "", "f"), (12, 12, "'text'", "at"), (12, 12, "tag`x`", "go")]
    assert calls["calls.js"] == sorted(want)
    assert calls["regex.js"] == [(1, 1, "", "left"), (1, 1, '/"/', "test"), (2, 2, "/}/", "exec"), (3, 3, "", "e"), (3, 3, "", "g")]
    assert calls["classes.js"] == [(1, 1, "", "mixin"), (3, 3, "", "make"), (6, 6, "this", "go")]


def test_c_and_go(spark):
    symbols, calls, errors = extracted(spark, C | GO)
    assert not errors
    assert symbols["own.c"] == [(5, 9, "own.c::foo")]
    assert calls["own.c"] == [(8, 8, "", "M"), (12, 12, "", "k")]
    assert symbols["more.c"] == [(5, 5, "more.c::g"), (11, 11, "more.c::w")]
    assert calls["more.c"] == [(2, 2, "", "dup"), (5, 5, "", "z"), (7, 7, "", "init"), (11, 11, "", "b"), (11, 11, "", "c")]
    assert symbols["p/a.go"] == [(5, 5, "p.F"), (6, 10, "p.*S.M"), (11, 13, "p.S.N"), (15, 15, "p.outside"), (16, 16, "p.Last")]
    assert calls["p/a.go"] == [(5, 5, "", "g"), (7, 7, "", "z"), (7, 7, "x", "y"), (8, 8, "", "done"), (14, 14, "", "make")]


def test_faults_name_the_first_bracket(spark):
    files = [("a.js", "f(]\n"), ("b.js", "x = (1,\n[2)];"), ("c.c", "int f(void) {\n  g(1;\n}\n"), ("d.go", "func f() {\n}}\n"), ("e.py", "a = [(1, 2]\nb = )\n"), ("f.js", "`${f(1)} {`; '('; /[(]/;"), ("g.js", "({[`${[]}`]})")]
    errors = {r.path: r.error for r in registry.extract_symbols(spark.createDataFrame(files, "path string, content string"))[1].collect()}
    assert errors == {"a.js": "line 1: ], ) expected", "b.js": "line 2: ), ] expected", "c.c": "line 3: }, ) expected", "d.go": "line 2: }, nothing is open", "e.py": "line 1: ], ) expected"}


def test_scanner_keeps_every_character():
    for lang in tokens.LANGUAGES:
        for text in [*JS.values(), *C.values(), *GO.values(), "", "`", "`${", "'a\\", '"\n', "/*", "a /", "#", "\\\n", "xé \U0001f600`${`${", "}" * 5]:
            out = tokens.scan(text, lang)
            assert text.startswith("".join(t[3] + t[2] for t in out))
            assert text[len("".join(t[3] + t[2] for t in out)) :].strip() in ("", "/*")
            at = 1
            for line, _, piece, gap in out:
                at += gap.count("\n")
                assert line == at
                at += piece.count("\n")


def test_no_files(spark):
    d = spark.createDataFrame([("a.js", ""), ("b.c", None)], "path string, content string")
    symbols, errors = registry.extract_symbols(d)
    assert symbols.count() == 0 and [r.error for r in errors.collect()] == ["no content"]
    assert registry.extract_calls(d)[0].count() == 0


def rows_of(text, lang, what="calls"):
    batch = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([lang]), pa.array([text])], ["path", "lang", "content"])
    return [r for b in tokens._sites(what)(iter([batch])) for r in b.to_pylist()]


def test_blocks_give_what_a_whole_file_gives(monkeypatch):
    """Calls whose brackets, chains and neighbours lie in other blocks; also of files with faults of brackets."""
    odd = ["a(b(c)(d)[e].f(`x ${g(h).i(1)} y`).j(k)).l(m);" * 3, "f([1], [2](", "f)(]g(h", "class A { m(a) { n(a); } }\nnew B(c(1)).d(e)", "a?.(b)?.c(\n)", "x.y(" * 9 + ")" * 5]
    texts = [("js", t) for t in [*JS.values(), *odd]] + [("c", t) for t in [*C.values(), *odd, "#a\n #b(c)\n d(e) #f(g)\n"]] + [("go", t) for t in [*GO.values(), *odd]]
    whole = [rows_of(t, lang) for lang, t in texts]
    short = lambda p: re.compile(p.pattern.replace("{0,16384}", "{0,1}"))
    monkeypatch.setattr(tokens, "_RUN", {k: short(p) for k, p in tokens._RUN.items()})
    monkeypatch.setattr(tokens, "_IN_TEMPLATE", short(tokens._IN_TEMPLATE))
    order = lambda rows: sorted(rows, key=lambda r: (r["k"], r["kind"]))
    for size in (1, 2, 5, 30):
        monkeypatch.setattr(tokens, "BLOCK", size)
        for (lang, t), want in zip(texts, whole, strict=True):
            assert order(rows_of(t, lang)) == order(want)


def test_calls_are_read_a_block_at_a_time(monkeypatch):
    """All tokens of a file used to be arrays at once, some 60 bytes for each of its text."""
    held = []
    off = tokens.Placed.off
    monkeypatch.setattr(tokens.Placed, "off", lambda self, *a: held.append(self.n) or off(self, *a))
    line = "if (a) { foo().g(b[1]); x = `${h(2)}`; }"
    for end in ("\n", " "):  # also a file of one line
        text = "outer(() => {" + (line + end) * 8_000 + "}).last();\n"
        rows = rows_of(text, "js")
        assert len(rows) == 4 * 8_000 + 2 and max(held) < 130_000 < 27 * 8_000
        outer, last = min(rows, key=lambda r: r["k"]), max(rows, key=lambda r: r["k"])
        assert (outer["text"], outer["n1"]["close_line"], outer["n1"]["after"]) == ("outer", text.count("\n"), ".")
        assert (last["text"], last["head"]["text"], last["opened"], last["object"]) == ("last", "outer", 1, text[: -len(".last();\n")])
        assert {(r["text"], r["object"], r["encl"]["brace"]) for r in rows} >= {("foo", None, "{"), ("g", "foo()", "{"), ("h", None, "${")}


def test_code_in_strings_is_read_a_block_at_a_time(monkeypatch):
    """Templates and slashes whose tokens before lie in another block."""
    held = []
    off = tokens.Placed.off
    monkeypatch.setattr(tokens.Placed, "off", lambda self, *a: held.append(self.n) or off(self, *a))
    n = 9_000
    line = '  if (a) { x = `no(1) ${b(`${1}`)} no(2)`; y = /"/.test("no(3)") || z.last(); } // skip(f)\n'
    rows = rows_of("function f(a) {\n" + line * n + "}\n", "js")
    hits = [(r["line"], r["text"], r["object"]) for r in rows if r["text"] in ("b", "test", "last", "no")]
    assert hits == [(k, *x) for k in range(2, n + 2) for x in (("b", None), ("test", '/"/'), ("last", "z"))]
    assert max(held) < 130_000 < 30 * n
