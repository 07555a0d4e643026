"""Every query with SQL gives the same rows in Spark and DuckDB over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
OURS = [n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline"))]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", OURS)
def test_query_equals_sql(spark, duck, name):
    d = entry.queries()[name](spark, SF)
    columns = sorted(d.columns)
    r = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(x[names.index(c)] for c in columns)) for x in r.fetchall())
    assert sorted(repr(tuple(x[c] for c in columns)) for x in d.collect()) == want


def test_slices_reach_all_documents(spark, duck):
    got = {r.id: r.source for r in entry.queries()["f5_source_slice_all"](spark, SF).collect()}
    texts = dict(duck.execute("SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND text <> ''").fetchall())
    n_docs = duck.execute("SELECT count(*) FROM documents").fetchone()[0]
    n_part = duck.execute("SELECT count(*) FROM part").fetchone()[0]
    assert {k % n_docs for k in got} == {d for d in texts if d < n_part}
    assert max(len(s.split("\n")) for k, s in got.items() if k % 4 == 0) > 4 >= max(len(s.split("\n")) for k, s in got.items() if k % 4)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_extraction_errors_match_a_plain_scan(spark):
    import re

    from loomgraph.extract.line_rules import TOKENS

    token = re.compile(TOKENS["python"].replace(r"\z", r"\Z"))

    def closes(text):
        stack = []
        for c in re.findall(r"[(\[{}\])]", token.sub("", text)):
            if c in "([{":
                stack.append(c)
            elif not stack or "([{".index(stack.pop()) != ")]}".index(c):
                return False
        return not stack

    want = {f"{r.doc_id}.py" for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text is None or not closes(("x = (" if r.doc_id % 2 else "") + r.text)}
    got = [r.path for r in entry.queries()["x9_extraction_errors"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and want
