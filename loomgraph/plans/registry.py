"""Every query of the library by name, and DuckDB SQL for those that SQL can express.

Each query applies one operator to whole tables, given or derived by Spark from given ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.extract import registry as extract
from loomgraph.functions import paths as P
from loomgraph.operators import graph, hierarchy, lookup, resolve, trace, traverse
from loomgraph.plans.fixtures import oracle, table, view
from loomgraph.sources import trees
from loomgraph.sources.shared import cut, new_path
from loomgraph.streaming import checks as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Data:
    """The derived tables of one data set, built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = getattr(type(self), f"make_{name}")(self) if hasattr(type(self), f"make_{name}") else view(self.spark, self.sf_dir, name)
        return self.made[name]

    def make_callers(self) -> DataFrame:
        return resolve.enclosing_function(self.facts, self.symbols)

    def make_callees(self) -> DataFrame:
        return resolve.resolve_callees(self.facts, self.symbols)

    def make_symbols(self) -> DataFrame:
        return cut(view(self.spark, self.sf_dir, "symbols"))

    def make_facts(self) -> DataFrame:
        return cut(view(self.spark, self.sf_dir, "facts", {"symbols": self.symbols}))

    def make_edges(self) -> DataFrame:
        return cut(resolve.build_edges(self.facts, self.symbols))

    def make_fnodes(self) -> DataFrame:
        return graph.last_wins(self.symbols)

    def make_nodes(self) -> DataFrame:
        return cut(graph.all_nodes(self.symbols, self.symbols.select("path")))

    def make_has(self) -> DataFrame:
        return graph.containment_edges(self.symbols, self.symbols.select("path"))

    def make_hit(self) -> DataFrame:
        return resolve.event_functions(self.trace, self.fnodes)

    def make_seed(self) -> DataFrame:
        return cut(self.edges.groupBy(F.col("dst").alias("id")).count().orderBy(F.desc("count"), "id").limit(1).select("id"))

    def make_wide(self) -> DataFrame:
        n = self.part.count()
        return self.lineitem.select(F.col("l_partkey").alias("src"), ((F.col("l_suppkey") * 13 + F.col("l_orderkey")) % n).alias("dst")).distinct()

    def make_lines(self) -> DataFrame:
        return trees.source_lines(self.documents.select(F.col("doc_id").cast("string").alias("path"), "text"), content_col="text")

    def make_called(self) -> DataFrame:
        """(path, start_line, callee_name) as the view has it, call sites reduced by their keys before they get a path."""
        n = self.part.count()
        sites = self.lineitem.select("l_partkey", "l_linenumber", ((F.col("l_suppkey") * 13 + F.col("l_orderkey")) % n).alias("c"))
        names = self.symbols.select(F.col("p_partkey").alias("c"), F.col("name").alias("callee_name"))
        d = sites.join(names, "c").groupBy("l_partkey", "l_linenumber").agg(F.max("callee_name").alias("callee_name"))
        d = d.join(self.symbols.select(F.col("p_partkey").alias("l_partkey"), "path", "start_line"), "l_partkey")
        return d.groupBy("path", (F.col("start_line") + 3 * F.col("l_linenumber")).alias("start_line")).agg(F.max("callee_name").alias("callee_name"))

    def make_corpus(self) -> DataFrame:
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.symbols.count() // 20_000)
        return cut(corpus_files(self.symbols, self.called, parts))


def corpus_files(symbols: DataFrame, called: DataFrame, parts: int) -> DataFrame:
    """The files of corpus_lines. Call sites meet the functions of their 20 lines only, a function's lines are one text
    before they meet in their file, and files are dealt one by one, not together by what they take compressed."""
    bucket = lambda c: F.floor(c / 20)
    at = called.select(F.col("path").alias("of"), F.col("start_line").alias("at"), bucket(F.col("start_line")).alias("b"), F.coalesce("callee_name", F.lit("")).alias("callee"))
    spans = symbols.select("path", "sym_ord", "name", "start_line", F.explode(F.array_distinct(F.array(bucket(F.col("start_line")), bucket(F.col("start_line") + 19)))).alias("bucket"))
    within = (F.col("path") == F.col("of")) & (F.col("bucket") == F.col("b")) & (F.col("at") >= F.col("start_line")) & (F.col("at") <= F.col("start_line") + 19)
    d = spans.join(at.hint("merge"), within, "left").groupBy("path", "sym_ord", "name").agg(F.collect_list("callee").alias("callees"))
    callees = F.when(F.size("callees") > 0, F.col("callees")).otherwise(F.array(F.lit("")))
    calls = F.array_sort(F.transform(callees, lambda x: F.concat(F.lit("  if (a) { "), x, F.lit("(); } // skip("), F.col("name"), F.lit(")"))))
    code = F.array_join(F.concat(F.array(F.concat(F.lit("function "), F.col("name"), F.lit("(a) {"))), calls, F.array(F.lit("}"))), "\n")
    d = d.select("path", F.struct("sym_ord", code.alias("code")).alias("x")).repartition(parts, "path")
    d = d.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["code"]), "\n").alias("content"))
    return d.select(F.regexp_replace("path", r"\.py$", ".js").alias("path"), "content")


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[Data], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Data(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return f

    return add


# Paths, ids, arguments and counts
query("p1_relative_path", "SELECT p_partkey, CASE WHEN path = 'src' THEN '.' WHEN starts_with(path, 'src/') THEN substr(path, 5) ELSE path END AS rel FROM symbols")(lambda d: d.symbols.select("p_partkey", P.relative_path(F.col("path"), "src").alias("rel")))
query("p2_dirname_basename", "SELECT page_id, CASE WHEN regexp_replace(url, '/?[^/]*$', '') = '' THEN '.' ELSE regexp_replace(url, '/?[^/]*$', '') END AS dir, split_part(url, '/', -1) AS base FROM pages")(lambda d: d.pages.select("page_id", P.dirname(F.col("url")).alias("dir"), P.basename(F.col("url")).alias("base")))
_LABEL = "CASE regexp_extract(path, '(\\.[^./]+)$', 1) WHEN '.py' THEN 'Python' WHEN '.go' THEN 'Go' WHEN '.js' THEN 'JavaScript' WHEN '.ts' THEN 'TypeScript' WHEN '.rb' THEN 'Ruby' WHEN '.rs' THEN 'Rust' WHEN '.java' THEN 'Java' END"
query("p3_language_label", f"SELECT doc_id, {_LABEL} AS label FROM named_files")(lambda d: d.named_files.select("doc_id", P.language_label(F.col("path")).alias("label")))
query("p4_function_id", "SELECT p_partkey, regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') || '.' || name AS py, split_part(path, '/', -1) || '::' || name AS c, split_part(path, '/', -2) || '.*T.' || name AS go FROM symbols")(
    lambda d: d.symbols.select("p_partkey", P.function_id(F.lit("python"), F.col("path"), F.lit(None).cast("string"), F.col("name")).alias("py"), P.function_id(F.lit("c"), F.col("path"), F.lit(None), F.col("name")).alias("c"), P.function_id(F.lit("go"), F.col("path"), F.lit("*T"), F.col("name"), P.go_package(P.dirname(F.col("path")))).alias("go"))
)
query("p5_noise_filter", "SELECT seq, fn, file FROM trace WHERE NOT contains(file, 'lib/') AND NOT contains(file, 'site-packages') AND NOT contains(file, '<frozen') AND fn NOT IN ('<module>', '<genexpr>', '<listcomp>', '<dictcomp>', '__annotate__', 'root') AND contains(file, '/app/')")(lambda d: trace.without_noise(d.trace, "/app/").select("seq", "fn", "file"))
query("p5_noise_filter_js", "SELECT seq, file FROM trace WHERE starts_with(file, '/app/src/') AND NOT contains(file, 'node_modules') AND NOT contains(file, 'js_trace')")(lambda d: d.trace.where(~P.is_noise_js(F.col("file"), "/app/src/")).select("seq", "file"))
query("p6_cut_arguments", "SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE text END AS arg FROM documents")(lambda d: trace.with_cut_arguments(d.documents.select("doc_id", F.create_map(F.lit("text"), "text").alias("args"))).select("doc_id", F.col("args")["text"].alias("arg")))
query("p7_heat", "SELECT id, count(*) AS hits, CASE WHEN count(*) > 100 THEN 'blazing' WHEN count(*) > 20 THEN 'high' WHEN count(*) > 5 THEN 'med' ELSE 'low' END AS heat FROM hit GROUP BY id")(lambda d: graph.hit_counts(d.hit).withColumn("heat", P.heat(F.col("hits"))))

# Sources and sinks
query("s1_pruned_paths", "SELECT page_id, url AS path FROM pages WHERE NOT list_has_any(string_split(url, '/'), ['.git', 'node_modules', 'venv', '.venv', 'env', '__pycache__', '.tox'])")(lambda d: trees.without_pruned(d.pages.select("page_id", F.col("url").alias("path"))))
@query("s1_scan_tree", "SELECT doc_id, 'lang=' || coalesce(nullif(lang, ''), '__HIVE_DEFAULT_PARTITION__') AS dir, text FROM documents")
def _scan_tree(d: Data) -> DataFrame:
    """All documents as lines of files in a folder a language, scanned."""
    root = new_path(d.spark, "tree")
    d.documents.select("lang", F.to_json(F.struct("doc_id", "text")).alias("value")).write.partitionBy("lang").option("maxRecordsPerFile", 500).text(root)
    files = trees.scan(d.spark, root)[0].where("path like '%.txt' and path like 'lang=%'")
    lines = trees.source_lines(files).select(P.dirname(F.col("path")).alias("dir"), F.from_json("text", "doc_id long, text string").alias("r"))
    return lines.select("r.doc_id", "dir", "r.text")


query("s2_route_language", "SELECT doc_id, path, CASE WHEN s IN ('.c', '.h') THEN 'c' WHEN s = '.go' THEN 'go' WHEN s IN ('.jsx', '.js', '.ts', '.tsx', '.mjs', '.cjs') THEN 'js' WHEN s = '.py' THEN 'python' END AS lang FROM (SELECT *, regexp_extract(path, '(\\.[^./]+)$', 1) AS s FROM named_files)")(lambda d: trees.routed(d.named_files).select("doc_id", "path", "lang"))


@query("s3_read_trace", "SELECT seq, fn, file, line FROM trace")
def _read_trace(d: Data) -> DataFrame:
    lines = d.trace.select("seq", F.to_json(F.struct("fn", "file", "line")).alias("value"))
    return trace.parse(lines).where("not bad").select("seq", "fn", "file", "line")


query("s4_source_lines", "SELECT path, CAST(n AS INT) AS line_no, parts[n] AS text FROM (SELECT path, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS parts FROM (SELECT CAST(doc_id AS STRING) AS path, regexp_split_to_array(text, '\\r?\\n') AS parts FROM documents WHERE text IS NOT NULL)), unnest(range(1, len(parts) + 1)) u(n)")(lambda d: d.lines)
_JSON_LINE = "CASE WHEN coalesce({c}, 0) <> 0 THEN ',\"{c}\":' || {c} ELSE '' END"
query("s5_export_graph", "SELECT '{\"kind\":\"node\",\"id\":\"' || id || '\",\"type\":\"' || type || '\",\"name\":\"' || name || '\",\"path\":\"' || path || '\"' || " + _JSON_LINE.format(c="line") + " || " + _JSON_LINE.format(c="end_line") + " || '}' AS value FROM nodes UNION ALL SELECT '{\"kind\":\"edge\",\"from\":\"' || src || '\",\"to\":\"' || dst || '\",\"type\":\"' || type || '\"' || " + _JSON_LINE.format(c="line") + " || '}' FROM (SELECT src, dst, 'calls' AS type, line FROM edges UNION ALL SELECT src, dst, 'contains', 0 FROM has)")(lambda d: trees.export_lines(d.nodes, graph.typed_edges(d.edges, d.has)))
query("s6_record_trace", "SELECT seq, fn, file, line FROM trace")(lambda d: streams.recorded(d.trace))

# Lookups
query("f1_resolve_symbol", "SELECT s AS symbol, CASE WHEN e THEN 'exact' WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'ambiguous' ELSE 'not_found' END AS status, CASE WHEN e THEN s ELSE coalesce(m, '') END AS matches FROM (SELECT s, s IN (SELECT id FROM nodes) AS e, (SELECT count(*) FROM fnodes WHERE name = s) AS n, (SELECT string_agg(id, ',' ORDER BY id) FROM fnodes WHERE name = s) AS m FROM (SELECT DISTINCT replace(p_name, ' ', '_') AS s FROM part UNION SELECT DISTINCT id FROM symbols UNION SELECT DISTINCT p_brand FROM part))")(
    lambda d: resolve.resolve_symbols(d.symbols.select(F.col("name").alias("symbol")).union(d.symbols.select("id")).union(d.part.select("p_brand")), d.nodes).withColumn("matches", F.array_join("matches", ","))
)
query("f2_find_symbol", "SELECT * FROM nodes WHERE type = 'function' AND name = 'red_widget'")(lambda d: lookup.functions_named(d.nodes, "red_widget"))
query("f3_node_details", "SELECT * FROM nodes WHERE id = 'economy.red_widget'")(lambda d: lookup.node_details(d.nodes, "economy.red_widget"))
query("f4_file_symbols", "SELECT * FROM nodes WHERE type = 'function' AND path = (SELECT min(path) FROM fnodes)")(lambda d: lookup.symbols_of_file(d.nodes, d.fnodes.agg(F.min("path")).first()[0]))
query("f5_source_slice", "SELECT f.p_partkey AS id, string_agg(l.text, chr(10) ORDER BY l.n) AS source FROM (SELECT p_partkey, p_partkey % (SELECT count(*) FROM documents) AS doc, start_line AS a, start_line + p_partkey % 40 AS b FROM symbols) f JOIN (SELECT doc_id, n, parts[n] AS text FROM (SELECT doc_id, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS parts FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS parts FROM documents WHERE text IS NOT NULL)), unnest(range(1, len(parts) + 1)) u(n)) l ON l.doc_id = f.doc AND l.n BETWEEN f.a AND f.b GROUP BY f.p_partkey")(
    lambda d: lookup.source_slices(d.symbols.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % d.documents.count()).cast("string").alias("path"), F.col("start_line").alias("line"), (F.col("start_line") + F.col("p_partkey") % 40).cast("int").alias("end_line")), d.lines)
)

@query("f5_source_slice_all", "SELECT f.p_partkey AS id, string_agg(l.text, chr(10) ORDER BY l.n) AS source FROM (SELECT p_partkey, doc_id, p_partkey * 31 % len(parts) + 1 AS a, p_partkey * 31 % len(parts) + 1 + CASE WHEN p_partkey % 4 = 0 THEN 20 ELSE p_partkey % 4 END AS b FROM symbols JOIN (SELECT doc_id, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS parts FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS parts FROM documents WHERE text IS NOT NULL)) ON doc_id = p_partkey % (SELECT count(*) FROM documents) WHERE len(parts) > 0) f JOIN (SELECT doc_id, n, parts[n] AS text FROM (SELECT doc_id, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS parts FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS parts FROM documents WHERE text IS NOT NULL)), unnest(range(1, len(parts) + 1)) u(n)) l ON l.doc_id = f.doc_id AND l.n BETWEEN f.a AND f.b GROUP BY f.p_partkey")
def _slices_of_all(d: Data) -> DataFrame:
    """Slices of all documents and over all of their lines; every fourth function has no end_line."""
    lengths = d.lines.groupBy("path").agg(F.count("*").alias("n"))
    at = d.symbols.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % d.documents.count()).cast("string").alias("path")).join(lengths, "path")
    at = at.withColumn("line", (F.col("id") * 31 % F.col("n") + 1).cast("int"))
    return lookup.source_slices(at.select("id", "path", "line", F.when(F.col("id") % 4 == 0, 0).otherwise(F.col("line") + F.col("id") % 4).cast("int").alias("end_line")), d.lines)


query("f6_trace_of_function", "SELECT seq, file, line FROM trace WHERE fn = 'red_widget'")(lambda d: trace.of_function(d.trace, "red_widget").select("seq", "file", "line"))
query("f7_search_node", "SELECT * FROM nodes WHERE contains(lower(name), 'widg') ORDER BY id LIMIT 1")(lambda d: lookup.search_nodes(d.nodes, "WIDG"))
query("f8_search_history", "SELECT run_id, min(seq) AS seq, arg_min(fn, seq) AS fn, arg_min(file, seq) AS file, arg_min(line, seq) AS line FROM trace WHERE contains(lower(fn), 'cls.') GROUP BY run_id")(lambda d: lookup.search_history(d.trace, "cls."))
@query("f9_signature", "SELECT p_partkey, coalesce(trim(parts[p_partkey * 7 % coalesce(len(parts), 1) + 1], ' '), '') AS signature FROM (SELECT p_partkey, regexp_split_to_array(text, '\\r?\\n') AS parts FROM symbols LEFT JOIN documents ON doc_id = p_partkey)")
def _signatures(d: Data) -> DataFrame:
    """A line of every document that a symbol has, over all of its lines."""
    lengths = d.documents.where("text is not null").select(F.col("doc_id").alias("p_partkey"), F.size(F.split("text", "\r?\n")).alias("n"))
    at = d.symbols.join(lengths, "p_partkey", "left").withColumn("line", (F.col("p_partkey") * 7 % F.coalesce("n", F.lit(1)) + 1).cast("int"))
    return lookup.signatures(at.select("p_partkey", F.col("p_partkey").cast("string").alias("path"), "line"), d.lines).select("p_partkey", "signature")


# Joins
query("j1_enclosing_function", "SELECT * FROM caller")(lambda d: d.callers)
query("j2_resolve_callee", "SELECT * FROM callee")(lambda d: d.callees)
query("j3_call_edges", "SELECT * FROM edges")(lambda d: d.edges)
query("j4_direct_callers", "SELECT dst AS seed, src AS id, line FROM edges WHERE dst IN (SELECT id FROM seed)")(lambda d: graph.direct_callers(d.edges, d.seed))
query("j5_direct_callees", "SELECT src AS seed, dst AS id, line FROM edges WHERE src IN (SELECT id FROM seed)")(lambda d: graph.direct_callees(d.edges, d.seed))
query("j6_event_function", "SELECT * FROM hit")(lambda d: d.hit)
query("j7_event_fallback", "SELECT t.seq, coalesce(n.id, 'dynamic-fallback') AS id, coalesce(n.path, t.file) AS path, coalesce(n.line, t.line) AS line FROM trace t LEFT JOIN hit h ON h.seq = t.seq LEFT JOIN fnodes n ON n.id = h.id")(lambda d: resolve.events_with_fallback(d.trace, d.fnodes))


@query("j8_neighbour_details", "SELECT e.dst AS seed, n.id, n.name, split_part(n.path, '/', -1) AS file, e.line AS jump_line, coalesce(trim(c.text), '') AS signature FROM edges e JOIN fnodes n ON n.id = e.src LEFT JOIN (SELECT path, row_number() OVER (PARTITION BY path ORDER BY o1, o2, text) AS k, text FROM corpus_lines) c ON c.path = n.path AND c.k = e.line")
def _details(d: Data) -> DataFrame:
    lines = trees.source_lines(d.corpus).withColumn("path", F.regexp_replace("path", r"\.js$", ".py"))
    seeds = d.edges.select(F.col("dst").alias("id")).distinct()
    return graph.neighbour_details(graph.direct_callers(d.edges, seeds), d.nodes.where("type = 'function'"), lines)


@query("j8_callee_details", "SELECT e.src AS seed, n.id, n.name, split_part(n.path, '/', -1) AS file, n.line AS jump_line, coalesce(trim(c.text), '') AS signature FROM edges e JOIN fnodes n ON n.id = e.dst LEFT JOIN (SELECT path, row_number() OVER (PARTITION BY path ORDER BY o1, o2, text) AS k, text FROM corpus_lines) c ON c.path = n.path AND c.k = n.line")
def _callee_details(d: Data) -> DataFrame:
    lines = trees.source_lines(d.corpus).withColumn("path", F.regexp_replace("path", r"\.js$", ".py"))
    seeds = d.edges.select(F.col("src").alias("id")).distinct()
    return graph.neighbour_details(graph.direct_callees(d.edges, seeds), d.nodes.where("type = 'function'"), lines, callers=False)


query("j9_call_view", "SELECT * FROM nodes WHERE id IN (SELECT src FROM edges UNION SELECT dst FROM edges)")(lambda d: graph.call_view(d.nodes, d.edges))
query("j10_structure_view", "SELECT src, dst FROM has WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)")(lambda d: graph.structure_view(d.has, d.nodes))
query("j11_roots", "SELECT * FROM nodes WHERE type <> 'function' AND id NOT IN (SELECT dst FROM has)")(lambda d: graph.roots(d.nodes, d.has))

# Aggregations
query("a1_graph_summary", "SELECT (SELECT count(*) FROM fnodes) AS functions, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS calls, (SELECT count(*) FROM edges) + (SELECT count(*) FROM has) AS edges")(lambda d: graph.summary(d.nodes, graph.typed_edges(d.edges, d.has)))
query("a2_function_count", "SELECT count(*) AS functions FROM fnodes")(lambda d: graph.function_count(d.nodes))
query("a3_language_list", f"SELECT coalesce(string_agg(DISTINCT {_LABEL}, ', ' ORDER BY {_LABEL}), 'Unknown') AS languages FROM named_files")(lambda d: graph.language_list(d.named_files))
query("a4_hit_counts", "SELECT id, count(*) AS hits FROM hit GROUP BY id")(lambda d: graph.hit_counts(d.hit))
query("a5_last_wins", "SELECT * FROM fnodes")(lambda d: d.fnodes)
query("a6_adjacency", "SELECT src AS id, string_agg(dst, ',' ORDER BY edge_ord) AS neighbours FROM edges GROUP BY src")(lambda d: graph.adjacency(d.edges).withColumn("neighbours", F.array_join("neighbours", ",")))
query("a7_children", "SELECT id, coalesce(n, 0) AS n_children, coalesce(n, 0) > 0 AS has_children FROM nodes LEFT JOIN (SELECT src, count(DISTINCT dst) AS n FROM has GROUP BY src) ON src = id")(lambda d: graph.with_children(d.nodes, d.has))
query("a8_trace_size", "SELECT run_id, count(*) AS n FROM trace GROUP BY run_id")(lambda d: trace.run_sizes(d.trace))

# Walks
query("g1_containment_edges", "SELECT * FROM has")(lambda d: d.has)
_WALK = "walk AS (SELECT DISTINCT {far} AS id FROM edges WHERE {near} IN (SELECT id FROM seed) UNION SELECT e.{far} FROM walk w JOIN (SELECT DISTINCT src, dst FROM edges) e ON e.{near} = w.id)"
query("g2_transitive_impact", ", " + _WALK.format(far="src", near="dst") + " SELECT (SELECT id FROM seed) AS seed, id FROM walk")(lambda d: traverse.closure(d.edges, d.seed).select("seed", "id"))
query("g3_transitive_callees", ", " + _WALK.format(far="dst", near="src") + " SELECT (SELECT id FROM seed) AS seed, id FROM walk")(lambda d: traverse.closure(d.edges, d.seed, callers=False).select("seed", "id"))
query("g2_wide_impact", ", top AS (SELECT dst AS id FROM wide GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1), walk AS (SELECT src AS id FROM wide WHERE dst IN (SELECT id FROM top) UNION SELECT e.src FROM walk w JOIN wide e ON e.dst = w.id) SELECT (SELECT id FROM top) AS seed, id FROM walk")(
    lambda d: traverse.closure(d.wide, d.wide.groupBy(F.col("dst").alias("id")).count().orderBy(F.desc("count"), "id").limit(1).select("id")).select("seed", "id")
)


@query(
    "g4_shortest_path",
    """, goal AS (SELECT min(id) AS a, (SELECT id FROM seed) AS b FROM fnodes WHERE id IN (SELECT src FROM edges)),
reach(id, d) USING KEY (id) AS (SELECT b, 0 FROM goal UNION SELECT e.src, min(r.d) + 1 FROM reach r JOIN (SELECT DISTINCT src, dst FROM edges) e ON e.dst = r.id WHERE e.src NOT IN (SELECT id FROM recurring.reach) GROUP BY e.src),
dist AS (SELECT id, d FROM reach),
nxt AS (SELECT e.src AS id, arg_min(e.dst, e.edge_ord) AS n FROM edges e JOIN dist p ON p.id = e.src JOIN dist q ON q.id = e.dst AND q.d = p.d - 1 GROUP BY e.src),
path AS (SELECT a AS id, 0 AS step FROM goal WHERE a IN (SELECT id FROM dist) UNION ALL SELECT n.n, p.step + 1 FROM path p JOIN nxt n ON n.id = p.id WHERE p.id <> (SELECT b FROM goal))
SELECT g.a AS start, g.b AS "end", p.step, p.id FROM path p, goal g""",
)
def _shortest(d: Data) -> DataFrame:
    first = d.edges.agg(F.min("src").alias("start"))
    return traverse.shortest_paths(d.edges, first.join(d.seed.select(F.col("id").alias("end"))))  # one row each


query("g5_ancestors", "SELECT DISTINCT s.id AS seed, CASE k WHEN 1 THEN s.path WHEN 2 THEN s.dir WHEN 3 THEN 'src' ELSE '.' END AS id, CAST(k AS INT) AS distance FROM (SELECT id, min(path) AS path, min(dir) AS dir FROM symbols GROUP BY id) s, unnest([1, 2, 3, 4]) u(k)")(lambda d: traverse.ancestors(graph.containment_edges(d.symbols, d.symbols.select("path"), ordered=True), d.fnodes))
query("g6_flatten_tree", "SELECT n.id, CASE WHEN n.type = 'directory' THEN n.name || '/' ELSE n.name END AS label, CAST(depth AS INT) AS depth, n.type, n.id IN (SELECT src FROM has) AS has_children FROM (SELECT '.' AS id, 0 AS depth UNION ALL SELECT 'src', 1 UNION ALL SELECT path, 2 FROM dirs WHERE path LIKE 'src/%' UNION ALL SELECT path, 3 FROM paths UNION ALL SELECT DISTINCT id, 4 FROM (SELECT DISTINCT path, id FROM symbols)) t JOIN nodes n ON n.id = t.id WHERE depth < 4 UNION ALL SELECT n.id, n.name, 4, n.type, false FROM (SELECT DISTINCT path, id FROM symbols) t JOIN nodes n ON n.id = t.id")(
    lambda d: hierarchy.flatten(d.nodes, d.has, graph.roots(d.nodes, d.has)).select("id", "label", "depth", "type", "has_children")
)

# Order and limits
query("w1_neighbour_order", "SELECT dst AS seed, src AS id, line FROM edges")(lambda d: graph.direct_callers(d.edges, d.edges.select(F.col("dst").alias("id")).distinct()).orderBy("seed", "id", "line"))
query("w2_sibling_order", "SELECT src AS parent, id, CAST(row_number() OVER (PARTITION BY src ORDER BY CASE type WHEN 'directory' THEN 0 WHEN 'file' THEN 1 ELSE 2 END, CASE WHEN type = 'function' THEN line ELSE 0 END, CASE WHEN type = 'function' THEN '' ELSE name END, id) AS INT) AS position FROM (SELECT DISTINCT src, dst FROM has) h JOIN nodes n ON n.id = h.dst")(lambda d: hierarchy.sibling_order(d.nodes, d.has))
query("w3_first_events", "SELECT seq, fn, file, line FROM trace WHERE fn = 'red_widget' ORDER BY seq LIMIT 20")(lambda d: trace.first_events(trace.of_function(d.trace, "red_widget"), 20).select("seq", "fn", "file", "line"))
query("w4_sequence_number", "SELECT run_id, seq, CAST(row_number() OVER (PARTITION BY run_id ORDER BY seq) AS INT) AS number, count(*) OVER (PARTITION BY run_id) AS n FROM trace")(lambda d: trace.numbered(d.trace).select("run_id", "seq", "number", "n"))
query("w5_event_at", "SELECT run_id, seq, fn, file, line FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS number FROM trace) WHERE number = 7")(lambda d: trace.playhead(d.trace, 7))
query("w3_all_events", "SELECT seq, fn, file, line FROM trace WHERE fn = 'red_widget' ORDER BY seq")(lambda d: trace.first_events(trace.of_function(d.trace, "red_widget"), 0).select("seq", "fn", "file", "line"))
query("w5_playhead", "SELECT run_id, max(seq) AS seq, arg_max(fn, seq) AS fn, arg_max(file, seq) AS file, arg_max(line, seq) AS line FROM trace GROUP BY run_id")(lambda d: trace.playhead(d.trace))

# Extraction over the generated corpus, and union over languages
_CORPUS = "numbered AS (SELECT regexp_replace(path, '\\.py$', '.js') AS path, CAST(row_number() OVER (PARTITION BY path ORDER BY o1, o2, text) AS INT) AS k, o1, o2, text FROM corpus_lines)"
query("x3_js_definitions", f", {_CORPUS} SELECT regexp_replace(split_part(n.path, '/', -1), '\\.js$', '') || '.' || s.name AS id, s.name, n.path, min(k) AS start_line, max(k) AS end_line FROM numbered n JOIN symbols s ON s.sym_ord = n.o1 GROUP BY n.path, s.sym_ord, s.name")(lambda d: extract.extract_symbols(d.corpus)[0].select("id", "name", "path", "start_line", "end_line"))
query("x4_js_calls", f", {_CORPUS} SELECT path, k AS line, regexp_extract(text, '\\{{ ([A-Za-z_0-9]+)\\(', 1) AS callee_name, '' AS callee_qualifier FROM numbered WHERE o2 = 1 AND regexp_extract(text, '\\{{ ([A-Za-z_0-9]+)\\(', 1) <> ''")(lambda d: extract.extract_calls(d.corpus)[0].select("path", "line", "callee_name", "callee_qualifier"))


def _as(d: Data, suffix: str, head: str) -> DataFrame:
    """The corpus in another language: its definition lines rewritten."""
    return d.corpus.select(F.regexp_replace("path", r"\.js$", suffix).alias("path"), F.regexp_replace("content", r"function (\w+)\(a\)", head).alias("content"))


_DEFS = f", {_CORPUS} SELECT {{id}} AS id, s.name, regexp_replace(n.path, '\\.js$', '{{suffix}}') AS path, min(k) AS start_line, max(k) AS end_line FROM numbered n JOIN symbols s ON s.sym_ord = n.o1 GROUP BY n.path, s.sym_ord, s.name"
query("x5_go_definitions", _DEFS.format(id="split_part(n.path, '/', -2) || '.*T.' || s.name", suffix=".go"))(lambda d: extract.extract_symbols(_as(d, ".go", "func (t *T) $1(a bool)"))[0].select("id", "name", "path", "start_line", "end_line"))
query("x7_c_definitions", _DEFS.format(id="regexp_replace(split_part(n.path, '/', -1), '\\.js$', '.c') || '::' || s.name", suffix=".c"))(lambda d: extract.extract_symbols(_as(d, ".c", "static int $1(int a)"))[0].select("id", "name", "path", "start_line", "end_line"))
_CALLS = f", {_CORPUS} SELECT regexp_replace(path, '\\.js$', '{{suffix}}') AS path, k AS line, regexp_extract(text, '\\{{{{ ([A-Za-z_0-9]+)\\(', 1) AS callee_name FROM numbered WHERE o2 = 1 AND regexp_extract(text, '\\{{{{ ([A-Za-z_0-9]+)\\(', 1) <> ''"
query("x6_go_calls", _CALLS.format(suffix=".go"))(lambda d: extract.extract_calls(_as(d, ".go", "func (t *T) $1(a bool)"))[0].select("path", "line", "callee_name"))
query("x8_c_calls", _CALLS.format(suffix=".c"))(lambda d: extract.extract_calls(_as(d, ".c", "static int $1(int a)"))[0].select("path", "line", "callee_name"))


# The same corpus in forms over several lines: each symbol takes two lines more; and as methods of one class
_RANKED = f", {_CORPUS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY sym_ord) AS r FROM symbols)"
_NEXT_LINE = "static int $1(int a, /* and include/*.h\n  */ int b)\n"
query("x7_c_definitions_next_line", _RANKED + " SELECT regexp_replace(split_part(n.path, '/', -1), '\\.js$', '.c') || '::' || s.name AS id, CAST(min(k) + 2 * (r - 1) AS INT) AS start_line, CAST(max(k) + 2 * r AS INT) AS end_line, regexp_replace(n.path, '\\.js$', '.c') AS path FROM numbered n JOIN ranked s ON s.sym_ord = n.o1 GROUP BY n.path, s.sym_ord, s.name, s.r")(lambda d: extract.extract_symbols(_as(d, ".c", _NEXT_LINE))[0].select("id", "start_line", "end_line", "path"))
query("x8_c_calls_next_line", _RANKED + " SELECT regexp_replace(n.path, '\\.js$', '.c') AS path, CAST(k + 2 * r AS INT) AS line, regexp_extract(text, '\\{ ([A-Za-z_0-9]+)\\(', 1) AS callee_name FROM numbered n JOIN ranked s ON s.sym_ord = n.o1 WHERE o2 = 1 AND regexp_extract(text, '\\{ ([A-Za-z_0-9]+)\\(', 1) <> ''")(lambda d: extract.extract_calls(_as(d, ".c", _NEXT_LINE))[0].select("path", "line", "callee_name"))
_METHOD = "  static async *$1(a = f()) "
query("x3_js_methods", f", {_CORPUS} SELECT regexp_replace(split_part(n.path, '/', -1), '\\.js$', '') || '.Box.' || s.name AS id, n.path, min(k) + 1 AS start_line, max(k) + 1 AS end_line FROM numbered n JOIN symbols s ON s.sym_ord = n.o1 GROUP BY n.path, s.sym_ord, s.name")(
    lambda d: extract.extract_symbols(_as(d, ".js", _METHOD).withColumn("content", F.concat(F.lit("class Box {\n"), "content", F.lit("\n}\n"))))[0].select("id", "path", "start_line", "end_line")
)
query("x10_assigned_sites", f", {_CORPUS} SELECT n.path, s.name, n.k AS line FROM numbered n JOIN symbols s ON s.sym_ord = n.o1 WHERE n.o2 = 0")(lambda d: extract.definition_sites(_as(d, ".js", "obj.$1 = async (a) =>")).select("path", "name", "line"))


# The same corpus in forms that only the token stream tells
_ONE = "SELECT regexp_replace(split_part(n.path, '/', -1), '\\.js$', '') || '{scope}.' || s.name AS id, n.path, {start} AS start_line, {end} AS end_line FROM numbered n JOIN symbols s ON s.sym_ord = n.o1 GROUP BY n.path, s.sym_ord, s.name"
_ID = ("id", "path", "start_line", "end_line")


def _one_line(d: Data) -> DataFrame:
    """All of a file's functions as methods of a class on one line."""
    code = F.regexp_replace(F.regexp_replace(F.regexp_replace("content", "// (.*)", "/* $1 */"), "function ", ""), "\n", " ")
    return d.corpus.select("path", F.concat(F.lit("class Box { "), code, F.lit(" }")).alias("content"))


def _wrapped(d: Data, head: str, definition: str, end: str, tail: str) -> DataFrame:
    code = F.regexp_replace(F.regexp_replace("content", r"function (\w+)\(a\)", definition), r"(?m)^\}", end)
    return d.corpus.select("path", F.concat(F.lit(head + "\n"), code, F.lit("\n" + tail)).alias("content"))


def _called_as(d: Data, calls: str) -> DataFrame:
    return d.corpus.select("path", F.regexp_replace("content", r"\{ (\w+)\(\); \}", calls).alias("content"))


query("x3_js_one_line", f", {_CORPUS} " + _ONE.format(scope=".Box", start=1, end=1))(lambda d: extract.extract_symbols(_one_line(d))[0].select(*_ID))
query("x3_js_object_methods", f", {_CORPUS} " + _ONE.format(scope="", start="min(k) + 1", end="max(k) + 1"))(lambda d: extract.extract_symbols(_wrapped(d, "const box = {", "async $1(a)", "},", "};"))[0].select(*_ID))
_DECLARATOR = "$1 = async (a = g(h(1))) =>"
query("x3_js_declarators", f", {_CORPUS} " + _ONE.format(scope="", start="min(k) + 1", end="max(k) + 1"))(lambda d: extract.extract_symbols(_wrapped(d, "const zero = 0,", _DECLARATOR, "},", "end = 1;"))[0].select(*_ID))
_OF_CALLS = "(SELECT path, k, regexp_extract(text, '\\{{ ([A-Za-z_0-9]+)\\(', 1) AS name FROM numbered WHERE o2 = 1 AND regexp_extract(text, '\\{{ ([A-Za-z_0-9]+)\\(', 1) <> '')"
query("x4_js_default_calls", f", {_CORPUS} SELECT path, k + 1 AS line, name AS callee_name FROM {_OF_CALLS.format()} UNION ALL SELECT path, k + 1, unnest(['g', 'h']) FROM numbered WHERE o2 = 0")(lambda d: extract.extract_calls(_wrapped(d, "const zero = 0,", _DECLARATOR, "},", "end = 1;"))[0].select("path", "line", "callee_name"))
query("x4_js_qualifiers", f", {_CORPUS} SELECT path, k AS line, unnest(['foo', name, name, name]) AS callee_name, unnest(['', 'foo()', 'arr[0].b', 'obj']) AS callee_qualifier FROM {_OF_CALLS.format()}")(lambda d: extract.extract_calls(_called_as(d, "{ foo().$1(3); arr[0].b.$1(2); obj?.$1(1); new $1(4); }"))[0].select("path", "line", "callee_name", "callee_qualifier"))
query("x4_js_code_in_strings", f", {_CORPUS} SELECT path, k AS line, unnest([name, 'test', 'last']) AS callee_name, unnest(['', '/\"/', 'z']) AS callee_qualifier FROM {_OF_CALLS.format()}")(lambda d: extract.extract_calls(_called_as(d, "{ x = `no(1) ${$1(`${1}`)} no(2)`; y = /\"/.test(\"no(3)\") || z.last(); }".replace("${", "\\${")))[0].select("path", "line", "callee_name", "callee_qualifier"))
_TYPE_LINE = "#define M$1(x) \\\\\n  no(x)\nstatic int\n$1(int a)\n"
query("x7_c_type_line", _RANKED + " SELECT regexp_replace(split_part(n.path, '/', -1), '\\.js$', '.c') || '::' || s.name AS id, CAST(min(k) + 4 * r - 2 AS INT) AS start_line, CAST(max(k) + 4 * r AS INT) AS end_line, regexp_replace(n.path, '\\.js$', '.c') AS path FROM numbered n JOIN ranked s ON s.sym_ord = n.o1 GROUP BY n.path, s.sym_ord, s.name, s.r")(lambda d: extract.extract_symbols(_as(d, ".c", _TYPE_LINE))[0].select("id", "start_line", "end_line", "path"))
query("x8_c_preprocessor", _RANKED + " SELECT regexp_replace(n.path, '\\.js$', '.c') AS path, CAST(k + 4 * r AS INT) AS line, regexp_extract(text, '\\{ ([A-Za-z_0-9]+)\\(', 1) AS callee_name FROM numbered n JOIN ranked s ON s.sym_ord = n.o1 WHERE o2 = 1 AND regexp_extract(text, '\\{ ([A-Za-z_0-9]+)\\(', 1) <> ''")(lambda d: extract.extract_calls(_as(d, ".c", _TYPE_LINE))[0].select("path", "line", "callee_name"))


def _python(d: Data) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("sym_ord", "name")))
    body = F.transform(rows, lambda x: F.concat(F.lit("def "), x["name"], F.lit("(a):\n    return obj."), x["name"], F.lit("(print(a))\n")))
    return d.symbols.groupBy("path").agg(F.array_join(body, "\n").alias("content"))


query("x1_python_definitions", "SELECT path, name, regexp_replace(split_part(path, '/', -1), '\\.py$', '') || '.' || name AS id, CAST(3 * row_number() OVER (PARTITION BY path ORDER BY sym_ord) - 2 AS INT) AS start_line FROM symbols")(lambda d: extract.extract_symbols(_python(d))[0].select("path", "name", "id", "start_line"))
query("x2_python_calls", "SELECT path, line, unnest([name, 'print']) AS callee_name, unnest(['obj', '']) AS callee_qualifier FROM (SELECT path, name, CAST(3 * row_number() OVER (PARTITION BY path ORDER BY sym_ord) - 1 AS INT) AS line FROM symbols)")(lambda d: extract.extract_calls(_python(d))[0].select("path", "line", "callee_name", "callee_qualifier"))


# Brackets of a text one after the other: a state is the string of those that are open, or * and the first fault
_BRACKETS = "SELECT path, i, text[i] AS c, length(text[1:i]) - length(replace(text[1:i], chr(10), '')) + 1 AS line FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM code) WHERE text[i] IN ('(', '[', '{', ')', ']', '}')"
_STEP = "CASE WHEN a[1:1] = '*' THEN a WHEN c[1] IN ('(', '[', '{') THEN a || c WHEN a <> '' AND a[-1:] = '' THEN a WHEN translate(c[1], ')]}', '([{') = regexp_extract(a, '([(\\[{])[0-9]+$', 1) THEN regexp_replace(a, '[(\\[{][0-9]+$', '') ELSE '*' || c || '/' || translate(regexp_extract(a, '([(\\[{])[0-9]+$', 1), '([{', ')]}') END"


@query(
    "x9_bracket_faults",
    """, code AS (SELECT CAST(doc_id AS STRING) || CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.go' ELSE '.c' END AS path,
  CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '([' ELSE '{' END || regexp_replace(coalesce(text, ''), '["''`#/\\x5c]', ' ', 'g') || CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '])' ELSE '}' END AS text FROM documents WHERE text IS NOT NULL),
runs AS (SELECT path, list_reduce(list_prepend('', list(c || line ORDER BY i)), lambda a, c: """
    + _STEP
    + """) AS state FROM ("""
    + _BRACKETS
    + """) GROUP BY path)
SELECT path, CASE WHEN state[1:1] = '*' THEN 'line ' || regexp_extract(state, '^\\*.([0-9]+)', 1) || ': ' || state[2:2] || ', ' || CASE WHEN state[-1:] = '/' THEN 'nothing is open' ELSE state[-1:] || ' expected' END
  ELSE 'line ' || regexp_extract(state, '^.([0-9]+)', 1) || ': ' || state[1:1] || ', ' || translate(state[1:1], '([{', ')]}') || ' expected' END AS error FROM runs WHERE state <> ''""",
)
def _bracket_faults(d: Data) -> DataFrame:
    """Every document as a file of one of the four languages, most with brackets put around them; quotes and comments are taken out."""
    k = F.col("doc_id")
    suffix = F.when(k % 4 == 0, ".py").when(k % 4 == 1, ".js").when(k % 4 == 2, ".go").otherwise(".c")
    code = F.concat(F.when(k % 3 == 0, "").when(k % 3 == 1, "([").otherwise("{"), F.regexp_replace("text", "[\"'`#/\\\\]", " "), F.when(k % 5 == 0, "").when(k % 5 == 1, "])").otherwise("}"))
    files = d.documents.where("text is not null").select(F.concat(k.cast("string"), suffix).alias("path"), code.alias("content"))
    return extract.extract_symbols(files)[1]


@query("x9_extraction_errors")
def _extraction_errors(d: Data) -> DataFrame:
    """The documents as Python files, of which every second one opens a bracket that it does not close."""
    opened = F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("x = ("), F.col("text"))).otherwise(F.col("text"))
    return extract.extract_symbols(d.documents.select(F.concat(F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), opened.alias("content")))[1]


@query("e3_rule_file", _DEFS.format(id="regexp_replace(split_part(n.path, '/', -1), '\\.js$', '') || '.' || s.name", suffix=".rs"))
def _rule_file(d: Data) -> DataFrame:
    """A fifth language, known by a file of rules alone."""
    path = new_path(d.spark, "rules")
    rows = [("rust", "def", r"\bfn\s+(\w+)\s*\(", [".rs"]), ("rust", "call", r"(?<![\w.])(\w+)\s*\(", [".rs"])]
    d.spark.createDataFrame(rows, "lang string, kind string, pattern string, suffixes array<string>").write.json(path)
    return extract.extract_symbols(_as(d, ".rs", "pub fn $1(a: bool)"), rules=extract.read_rules(d.spark, path))[0].select("id", "name", "path", "start_line", "end_line")


query("x10_definition_sites", f", {_CORPUS} SELECT n.path, s.name, n.k AS line FROM numbered n JOIN symbols s ON s.sym_ord = n.o1 WHERE n.o2 = 0")(lambda d: extract.definition_sites(d.corpus).select("path", "name", "line"))
query("u1_union_symbols", f", {_CORPUS} SELECT 'js' AS lang, s.name, min(k) AS start_line FROM numbered n JOIN symbols s ON s.sym_ord = n.o1 GROUP BY n.path, s.sym_ord, s.name UNION ALL SELECT 'python', name, CAST(3 * row_number() OVER (PARTITION BY path ORDER BY sym_ord) - 2 AS INT) FROM symbols")(lambda d: extract.extract_symbols(d.corpus.unionByName(_python(d)))[0].select("lang", "name", "start_line"))

# Streams, run to their end over tables dealt into files
query("t1_live_events", "SELECT CAST(run_id AS STRING) AS run_id, fn, file, line FROM trace WHERE NOT contains(file, 'lib/') AND fn <> '<listcomp>'")(lambda d: streams.live_events(d.trace))
query("t1_growing_files", "SELECT CAST(run_id AS STRING) AS run_id, fn, file, line FROM trace WHERE NOT contains(file, 'lib/') AND fn <> '<listcomp>'")(lambda d: streams.growing_events(d.trace))
query("t1_messages", "SELECT CAST(run_id AS STRING) AS run_id, fn, file, line FROM trace WHERE NOT contains(file, 'lib/') AND fn <> '<listcomp>'")(lambda d: streams.message_events(d.trace))
query("t2_malformed_lines", "SELECT 'event' AS kind, fn || '|' || file || '|' || line AS value FROM trace UNION ALL SELECT 'malformed', parts[n] FROM (SELECT CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS parts FROM (SELECT regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS parts FROM documents WHERE text IS NOT NULL)), unnest(range(1, len(parts) + 1)) u(n)")(lambda d: streams.routed_lines(d.trace, d.documents))
query("t3_running_hits", "SELECT id, count(*) AS hits FROM hit WHERE seq IN (SELECT seq FROM trace WHERE NOT contains(file, 'lib/') AND fn <> '<listcomp>') GROUP BY id")(lambda d: streams.hits(d.trace, d.fnodes))
_CLEAN = "(SELECT CAST(run_id AS STRING) AS run_id, seq, fn, file, line FROM trace WHERE NOT contains(file, 'lib/') AND fn <> '<listcomp>')"
query("t4_running_numbers", f"SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS number FROM {_CLEAN}")(lambda d: streams.numbers(d.trace))
query("t4_state_numbers", f"SELECT run_id, count(*) AS n, count(*) AS last FROM {_CLEAN} GROUP BY run_id")(lambda d: streams.state_numbers(d.trace))
query("t5_latest_events", f"SELECT run_id, max(seq) AS seq, arg_max(fn, seq) AS fn, arg_max(file, seq) AS file, arg_max(line, seq) AS line FROM {_CLEAN} GROUP BY run_id")(lambda d: streams.latest(d.trace))
