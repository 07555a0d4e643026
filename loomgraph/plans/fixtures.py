"""Code graph and trace tables derived from the TPC-H-like ones, over all of their rows.

One SQL text for both engines: Spark runs it with DataFrames as parameters, DuckDB over its views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# (name, tables that it reads, text); {x} is a table, and {n_part} how many rows part has
VIEWS: list[tuple[str, tuple[str, ...], str]] = [
    ("symbols", ("part",), """
SELECT concat(path, '|', lpad(CAST(p_partkey AS STRING), 12, '0')) AS sym_ord, concat(module, '.', fname) AS id, fname AS name,
       path, dir, start_line, CAST(start_line + 15 + 20 * (p_size % 3) AS INT) AS end_line, p_partkey
FROM (SELECT p_partkey, p_size, lower(p_type) AS module, replace(p_name, ' ', '_') AS fname,
             concat('src/', replace(p_brand, '#', '_')) AS dir,
             concat('src/', replace(p_brand, '#', '_'), '/', lower(p_type), '.py') AS path,
             CAST(row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS INT) * 20 - 19 AS start_line
      FROM {part}) t"""),
    ("facts", ("lineitem", "symbols"), """
SELECT l_orderkey * 1000 + l_linenumber * 100 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS fact_ord,
       s.path AS path, s.dir AS dir, s.start_line + 3 * l_linenumber AS line, s.start_line + 3 * l_linenumber AS start_line,
       s.start_line + 3 * l_linenumber AS end_line, c.name AS callee_name,
       CASE WHEN l_returnflag = 'R' THEN '' WHEN l_returnflag = 'A' THEN split_part(c.id, '.', 1) ELSE 'self' END AS callee_qualifier
FROM {lineitem} l JOIN {symbols} s ON s.p_partkey = l.l_partkey
JOIN {symbols} c ON c.p_partkey = (l.l_suppkey * 13 + l.l_orderkey) % {n_part}"""),
    ("trace", ("events", "symbols"), """
SELECT e.event_id AS seq, e.user_id % 8 AS run_id,
  CASE e.event_type WHEN 'click' THEN concat('Cls.', s.name) WHEN 'signup' THEN '<listcomp>' ELSE s.name END AS fn,
  CASE e.event_type WHEN 'error' THEN concat('/usr/lib/python3/', s.name, '.py') ELSE concat('/app/', s.path) END AS file,
  s.start_line AS line, e.props AS props
FROM {events} e JOIN {symbols} s ON s.p_partkey = (e.user_id * 7 + e.event_id % 3) % {n_part}"""),
    ("named_files", ("documents",), """
SELECT doc_id, concat(coalesce(source, 'none'), '/', coalesce(lang, 'none'), '/f', CAST(doc_id AS STRING),
  CASE doc_id % 11 WHEN 0 THEN '.py' WHEN 1 THEN '.go' WHEN 2 THEN '.js' WHEN 3 THEN '.ts' WHEN 4 THEN '.rb' WHEN 5 THEN '.rs'
       WHEN 6 THEN '.java' WHEN 7 THEN '.h' WHEN 8 THEN '.tsx' WHEN 9 THEN '' ELSE '.txt' END) AS path FROM {documents}"""),
    ("corpus_lines", ("symbols", "called"), """
SELECT path, sym_ord AS o1, 0 AS o2, concat('function ', name, '(a) {{') AS text FROM {symbols}
UNION ALL
SELECT s.path, s.sym_ord, 1, concat('  if (a) {{ ', coalesce(f.callee_name, ''), '(); }} // skip(', s.name, ')')
FROM {symbols} s LEFT JOIN {called} f ON f.path = s.path AND f.start_line >= s.start_line AND f.start_line <= s.start_line + 19
UNION ALL
SELECT path, sym_ord, 2, '}}' FROM {symbols}"""),
]
_CALLED = "SELECT path, start_line, max(callee_name) AS callee_name FROM {facts} GROUP BY path, start_line"
VIEWS.insert(4, ("called", ("facts",), _CALLED))
BY_NAME = {n: (needs, text) for n, needs, text in VIEWS}

# The steps from call sites to edges, nodes and hits, for DuckDB only: in Spark they are operators.
STEPS = """
caller AS (SELECT fact_ord, id AS caller FROM (SELECT f.fact_ord, s.id, row_number() OVER (PARTITION BY f.fact_ord ORDER BY s.sym_ord) rn
  FROM facts f JOIN symbols s ON s.path = f.path AND f.start_line >= s.start_line AND f.end_line <= s.end_line) t WHERE rn = 1),
callee AS (SELECT fact_ord, id AS callee FROM (SELECT f.fact_ord, s.id, row_number() OVER (PARTITION BY f.fact_ord ORDER BY CASE WHEN s.dir = f.dir THEN 0 ELSE 1 END, s.sym_ord) rn
  FROM facts f JOIN symbols s ON s.name = f.callee_name AND (f.callee_qualifier = '' OR contains(s.id, f.callee_qualifier))) t WHERE rn = 1),
edges AS (SELECT f.fact_ord AS edge_ord, a.caller AS src, b.callee AS dst, f.line FROM facts f JOIN caller a ON a.fact_ord = f.fact_ord JOIN callee b ON b.fact_ord = f.fact_ord),
fnodes AS (SELECT id, name, path, start_line AS line, end_line FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sym_ord DESC) rn FROM symbols) t WHERE rn = 1),
paths AS (SELECT DISTINCT path FROM symbols),
dirs AS (SELECT DISTINCT CASE WHEN n = 0 THEN '.' ELSE array_to_string(list_slice(string_split(path, '/'), 1, n), '/') END AS path FROM paths, unnest(range(len(string_split(path, '/')))) u(n)),
nodes AS (SELECT path AS id, 'directory' AS type, split_part(path, '/', -1) AS name, path, NULL::INT AS line, NULL::INT AS end_line FROM dirs
  UNION ALL SELECT path, 'file', split_part(path, '/', -1), path, NULL, NULL FROM paths
  UNION ALL SELECT id, 'function', name, path, line, end_line FROM fnodes),
has AS (SELECT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS src, path AS dst FROM dirs WHERE path <> '.'
  UNION ALL SELECT regexp_replace(path, '/[^/]*$', ''), path FROM paths UNION ALL SELECT path, id FROM symbols),
hit AS (SELECT seq, id FROM (SELECT t.seq, n.id, row_number() OVER (PARTITION BY t.seq ORDER BY n.id) rn
  FROM trace t JOIN fnodes n ON (n.name = t.fn OR ends_with(t.fn, '.' || n.name)) AND ends_with(t.file, n.path)) x WHERE rn = 1),
seed AS (SELECT dst AS id FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1),
wide AS (SELECT DISTINCT l_partkey AS src, (l_suppkey * 13 + l_orderkey) % (SELECT count(*) FROM part) AS dst FROM lineitem)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """A derived table in Spark, or one of the given ones; made: tables that are there already."""
    if name in (made or {}):
        return made[name]
    if name not in BY_NAME:
        return table(spark, sf_dir, name)
    needs, text = BY_NAME[name]
    if "{n_part}" in text:
        text = text.replace("{n_part}", str(table(spark, sf_dir, "part").count()))
    return spark.sql(text, **{n: view(spark, sf_dir, n, made) for n in needs})


def oracle(query: str) -> str:
    """DuckDB SQL: query over the derived tables."""
    views = ",\n".join(f"{n} AS ({text.format(n_part="(SELECT count(*) FROM part)", **{t: t for t in needs})})" for n, needs, text in VIEWS)
    return f"WITH RECURSIVE {views},\n{STEPS}\n{query}"
