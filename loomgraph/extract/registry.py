"""Extractors by language, and the jobs that run them over a table of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.extract import line_rules, token_rules, tokens
from loomgraph.functions.paths import LANGUAGE_SUFFIXES, dirname, function_id, go_package, suffix
from loomgraph.sources.shared import cut

SYMBOLS = pa.schema([("lang", pa.string()), ("path", pa.string()), ("scope", pa.string()), ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("start_col", pa.int32()), ("error", pa.string())])
CALLS = pa.schema([("lang", pa.string()), ("path", pa.string()), ("line", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("start_col", pa.int32()), ("callee_name", pa.string()), ("callee_qualifier", pa.string()), ("error", pa.string())])
SYMBOL_TYPE = "lang string, path string, scope string, name string, start_line int, end_line int, start_col int, error string"
CALL_TYPE = "lang string, path string, line int, start_line int, end_line int, start_col int, callee_name string, callee_qualifier string, error string"


@dataclass
class Extractor:
    """Rules for the line scan, or the windows over tokens that the library has for the language, or functions
    (path, content) -> rows of a user's own."""

    lang: str
    suffixes: tuple[str, ...]
    definitions: Callable | None = None
    calls: Callable | None = None
    rules: list[line_rules.Rule] = field(default_factory=list)
    by_tokens: bool = False


_all: dict[str, Extractor] = {}


def register_extractor(extractor: Extractor) -> None:
    """Makes a language known, or replaces it."""
    _all[extractor.lang] = extractor


def extractors() -> list[Extractor]:
    return list(_all.values())


for _lang, _suffixes in LANGUAGE_SUFFIXES:
    register_extractor(Extractor(_lang, _suffixes, rules=[r for r in line_rules.RULES if r.lang == _lang], by_tokens=_lang in tokens.LANGUAGES))


def _known(rules: list[line_rules.Rule] | None) -> list[Extractor]:
    """The registered extractors, and behind them those of languages that only the rules know, by their suffixes."""
    new: dict[str, tuple[str, ...]] = {}
    for r in rules or []:
        if r.lang not in _all:
            new[r.lang] = (*new.get(r.lang, ()), *r.suffixes)
    return [*_all.values(), *(Extractor(lang, suffixes) for lang, suffixes in new.items())]


def _routed(files: DataFrame, rules: list[line_rules.Rule] | None) -> DataFrame:
    s, lang, order = suffix(F.col("path")), F.lit(None).cast("string"), F.lit(None).cast("int")
    for k, e in enumerate(_known(rules)):
        lang, order = F.when(s.isin(*e.suffixes), e.lang).otherwise(lang), F.when(s.isin(*e.suffixes), k).otherwise(order)
    return files.select("path", "content", lang.alias("lang"), order.alias("lang_ord")).where("lang is not null")


def over_files(rows_of: Callable, schema: pa.Schema) -> Callable:
    """A mapInArrow function over (path, content): a file that fails gives one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += rows_of(path, content or "")
                except Exception as e:  # a user's function: its failure is the file's, and the others go on
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}"[:300]})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _of_functions(files: DataFrame, part: str, schema: pa.Schema, kind: str) -> DataFrame | None:
    out = None
    for e in _all.values():
        fn = getattr(e, part)
        if fn is not None:
            d = files.where(F.col("lang") == e.lang).select("path", "content").mapInArrow(over_files(fn, schema), kind)
            d = d.withColumn("lang", F.coalesce("lang", F.lit(e.lang)))
            out = d if out is None else out.unionByName(d)
    return out


def _no_content(files: DataFrame, langs: list[str]) -> DataFrame:
    return files.where(F.col("lang").isin(*langs) & F.col("content").isNull()).select("path", F.lit("no content").alias("error"))


def _clean(files: DataFrame, rules: list[line_rules.Rule]) -> tuple[DataFrame, DataFrame]:
    """(path, lang, code) of the files that rules scan, and (path, error) of those without content or
    whose brackets do not close. Python files of the second kind are left out: their lines cannot be told."""
    langs = sorted({r.lang for r in rules})
    clean = cut(line_rules.clean_files(files.where(F.col("lang").isin(*langs)), langs))  # each rule reads it
    bad = tokens.fault_text(tokens.faults(line_rules.brackets(clean)))
    errors = bad.unionByName(_no_content(files, langs))
    return clean.join(bad.join(clean.where("lang = 'python'").select("path"), "path", "left_semi").select("path"), "path", "left_anti"), errors


def _tokens(files: DataFrame, langs: list[str], what: str) -> tuple[DataFrame, DataFrame]:
    """(sites for the rules of `what`, errors) of the files in langs."""
    sites = cut(tokens.sites(files.where(F.col("lang").isin(*langs)), what))  # each rule reads it
    found = sites.where("kind = 'fault'").select("path", "line", F.col("text").alias("found"), "expected")
    return sites.where("kind <> 'fault'"), tokens.fault_text(found).unionByName(_no_content(files, langs))


def _rules(rules: list[line_rules.Rule] | None) -> tuple[list[line_rules.Rule], list[str]]:
    """Of each language the given rules, or where there are none its registered ones; and the languages read by tokens."""
    given = {r.lang for r in rules or []}
    by_tokens = [e.lang for e in _all.values() if e.by_tokens and e.lang not in given]
    return [*(rules or []), *(r for e in _all.values() if e.lang not in given and not e.by_tokens for r in e.rules)], by_tokens


def extract_symbols(files: DataFrame, id_scheme: str = "module", rules: list[line_rules.Rule] | None = None) -> tuple[DataFrame, DataFrame]:
    """(symbols, errors) of files (path, content). sym_ord orders by language, path part by part, line and
    column; id_scheme `path` puts the whole relative path in place of the module."""
    f = _routed(files, rules)
    by_lines, by_tokens = _rules(rules)
    clean, errors = _clean(f, by_lines)
    rows = line_rules.definitions(cut(line_rules.logical_lines(clean)), by_lines)
    sites, token_errors = _tokens(f, by_tokens, "definitions")
    rows, errors = rows.unionByName(token_rules.definitions(sites)), errors.unionByName(token_errors)
    own = _of_functions(f, "definitions", SYMBOLS, SYMBOL_TYPE)
    if own is not None:
        rows = rows.unionByName(own.where("error is null").drop("error"))
        errors = errors.unionByName(own.where("error is not null").select("path", "error"))
    ok = rows.join(F.broadcast(f.select("lang", "lang_ord").distinct()), "lang")  # a row a language
    sym_ord = F.struct("lang_ord", F.split("path", "/").alias("parts"), "start_line", "start_col")
    by_module = function_id(F.col("lang"), F.col("path"), F.col("scope"), F.col("name"), go_package(F.col("path")))
    id_ = F.concat_ws(".", "path", "scope", "name") if id_scheme == "path" else by_module
    symbols = ok.select(sym_ord.alias("sym_ord"), id_.alias("id"), "name", F.lit("function").alias("kind"), "lang", "path", dirname(F.col("path")).alias("dir"), "start_line", "end_line")
    return symbols, errors


def extract_calls(files: DataFrame, rules: list[line_rules.Rule] | None = None) -> tuple[DataFrame, DataFrame]:
    """(call sites, errors) of files (path, content), ordered by fact_ord as symbols are."""
    f = _routed(files, rules)
    of, by_tokens = _rules(rules)
    clean, errors = _clean(f, of)
    sites, token_errors = _tokens(f, by_tokens, "calls")
    errors = errors.unionByName(token_errors)
    defined = line_rules.hits(line_rules.logical_lines(clean), "def", of).select("path", "line_no", "name").distinct()
    rows = line_rules.calls(line_rules.physical_lines(clean), defined, of).unionByName(token_rules.calls(sites))
    own = _of_functions(f, "calls", CALLS, CALL_TYPE)
    if own is not None:
        rows = rows.unionByName(own.where("error is null").drop("error"))
        errors = errors.unionByName(own.where("error is not null").select("path", "error"))
    ok = rows.join(F.broadcast(f.select("lang", "lang_ord").distinct()), "lang")
    fact_ord = F.struct("lang_ord", F.split("path", "/").alias("parts"), "start_line", "start_col", "callee_name")
    facts = ok.select(fact_ord.alias("fact_ord"), "lang", "path", dirname(F.col("path")).alias("dir"), "line", "start_line", "end_line", "callee_name", "callee_qualifier")
    return facts, errors


def read_rules(spark: SparkSession, path: str) -> list[line_rules.Rule]:
    """Rules from JSON lines {"lang", "kind", "pattern", "name", "other", "unless", "suffixes"}, a few rows that the
    driver holds; pass them as `rules`. Languages that the files do not name keep their own; a new one needs suffixes."""
    schema = "lang string, kind string, pattern string, name int, other int, unless array<string>, suffixes array<string>"
    return [line_rules.Rule(r.lang, r.kind, r.pattern, 1 if r.name is None else r.name, r.other or 0, tuple(r.unless or ()), tuple(r.suffixes or ())) for r in spark.read.schema(schema).json(path).collect()]


# Definition sites of JavaScript in their order of precedence, and names that are none.
SITES = (
    r"function\s+(\w+)\s*\([^)]*\)\s*\{",
    r"async\s+function\s+(\w+)\s*\([^)]*\)\s*\{",
    r"(\w+)\s*\([^)]*\)\s*\{",
    r"(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>\s*\{",
    r"(\w+)\s*=\s*(?:async\s+)?function\s*\([^)]*\)\s*\{",
)
NO_SITES = ("if", "else", "for", "while", "switch", "catch", "do")


def definition_sites(files: DataFrame, patterns: tuple[str, ...] = SITES) -> DataFrame:
    """(path, name, line, brace): of patterns that end at one brace the first counts, also where its name
    is then none; the line is that on which the match begins. null content has no sites. Patterns have one group.

    Each pattern is matched with the text before it, and the text behind the last match with no name, so that a
    match's place is the length of all before: a sum over a file's matches."""
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), *[F.regexp_extract_all("content", F.lit(rf"((?s:.*?))(?:{p}|\z)"), g).alias(name) for g, name in ((0, "whole"), (1, "gap"), (2, "name"))]) for k, p in enumerate(patterns)])
    d = files.where("content is not null").select("path", F.explode(kinds).alias("m"))
    d = d.select("path", "m.k", F.posexplode(F.arrays_zip("m.whole", "m.gap", "m.name")).alias("j", "x")).select("path", "k", "j", "x.*")
    breaks = lambda c: F.length(F.regexp_replace(c, r"[^\n]", ""))
    d = d.select("path", "k", "j", "name", F.length("whole").alias("size"), breaks("whole").alias("lines"), breaks("gap").alias("above"))
    upto = Window.partitionBy("path", "k").orderBy("j")
    before = F.coalesce(F.sum("lines").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.select("path", "name", (before + F.col("above") + 1).cast("int").alias("line"), (F.sum("size").over(upto) - 1).alias("brace"), "k").where("name <> ''")
    first = d.groupBy("path", "brace").agg(F.min_by(F.struct("name", "line"), "k").alias("x")).select("path", "x.name", "x.line", "brace")
    return first.where(~F.col("name").isin(*NO_SITES))
