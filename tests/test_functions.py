from pyspark.sql import functions as F

from loomgraph.functions import paths as P


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_paths(spark):
    got = values(spark, [("/r",), ("/r/a/b.py",), ("/rx/c",), ("bare",)], "p string", P.relative_path(F.col("p"), "/r/"), P.dirname(F.col("p")), P.basename(F.col("p")))
    assert got == [(".", ".", "r"), ("a/b.py", "/r/a", "b.py"), ("/rx/c", "/rx", "c"), ("bare", ".", "bare")]


def test_languages_and_pruning(spark):
    rows = [("a/x.tsx",), ("x.h",), ("x.rb",), ("x.PY",), ("env/x.py",), ("environment/x.go",), (None,)]
    got = values(spark, rows, "p string", P.language(F.col("p")), P.language_label(F.col("p")), P.is_pruned(F.col("p")))
    assert got == [("js", None, False), ("c", None, False), (None, "Ruby", False), (None, None, False), ("python", "Python", True), ("go", "Go", False), (None, None, None)]


def test_heat_boundaries(spark):
    got = values(spark, [(n,) for n in (0, 1, 5, 6, 20, 21, 100, 101)], "n int", P.heat(F.col("n")))
    assert [g[0] for g in got] == ["none", "low", "low", "med", "med", "high", "high", "blazing"]


def test_arguments_are_cut_after_120(spark):
    got = values(spark, [("x" * 120,), ("x" * 121,), (None,)], "v string", P.cut_argument(F.col("v")))
    assert [g[0] for g in got] == ["x" * 120, "x" * 120 + "...", None]


def test_ids(spark):
    one = spark.range(1)
    c = lambda lang, path, scope, **k: P.function_id(F.lit(lang), F.lit(path), F.lit(scope), F.lit("f"), **k)
    got = one.select(c("python", "a/m.py", "C"), c("js", "a/m.js", None), c("c", "a/m.c", None), c("go", "a/b/m.go", "*T", package=P.go_package(F.lit("a/b/m.go"))), P.go_package(F.lit("m.go"))).first()
    assert tuple(got) == ("m.C.f", "m.f", "m.c::f", "b.*T.f", "main")
