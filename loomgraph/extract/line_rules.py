"""Definitions and call sites from source text, by a table of rules (native): Python, and languages with rules of a
user's own. C, Go and JavaScript are read by tokens; their rules here are what a user's start from.

1. Strings and comments are blanked over the whole file, so that quotes and comments of several lines
   are one token; their line breaks stay as marks. A parameter list over several lines, and a brace on
   the line after one, are drawn onto the line where the list begins.
2. Each line has a depth before and after it: of braces, or in Python of indentation.
3. Rules are applied to each line. A definition ends on the first line at or after it that takes the
   depth back to that before it; its class is the innermost one around it.

Known gaps: calls inside string interpolation, and for rules of brace languages regular-expression literals
that hold quotes or braces, parameter lists with parentheses nested more than once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """kind: def, class or call; pattern: one match a hit; name, other: groups of name and scope or
    qualifier, 0 for none; unless: names that are no hit; suffixes: of the files of a language that no extractor knows."""

    lang: str
    kind: str
    pattern: str
    name: int = 1
    other: int = 0
    unless: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()


# Words of each language that look like names before a parenthesis.
NOT_C = ("if", "for", "while", "switch", "return", "else", "do", "case", "sizeof", "void", "char", "short", "int", "long", "float", "double", "signed", "unsigned", "const", "volatile", "struct", "union", "enum", "defined")
NOT_GO = ("if", "for", "switch", "return", "func", "else", "case", "go", "defer", "select", "range")
NOT_JS = ("if", "for", "while", "switch", "catch", "return", "function", "else", "do", "case", "typeof", "new", "await", "in", "of", "with", "super", "void", "delete", "throw", "yield", "import")
NOT_JS_METHOD = ("if", "for", "while", "switch", "catch", "function", "with")
NOT_PYTHON = ("if", "elif", "else", "while", "for", "in", "return", "not", "and", "or", "is", "lambda", "assert", "yield", "del", "raise", "except", "with", "class", "def", "import", "from", "await", "async")
_NAME = r"[A-Za-z_$][\w$]*"
_WORD = r"[A-Za-z_]\w*"
RULES: list[Rule] = [
    Rule("js", "class", rf"\bclass\s+({_NAME})"),
    Rule("js", "def", rf"\bfunction\s*\*?\s*({_NAME})\s*\("),
    Rule("js", "def", rf"\b(?:const|let|var)\s+({_NAME})\s*=\s*(?:async\s*)?(?:\([^()]*\)|{_NAME})\s*=>"),
    Rule("js", "def", rf"^\s*(?:(?:static|async|get|set)\s+)*(?:\*\s*)?(#?{_NAME})\s*\([^()]*(?:\([^()]*\)[^()]*)*\)[^;(){{}}=]*\{{", unless=NOT_JS_METHOD),
    Rule("js", "call", rf"(?:((?:{_NAME}\.)*{_NAME})\.)?(?<![\w$])({_NAME})\s*\(", 2, 1, NOT_JS),
    Rule("go", "def", rf"^\s*func\s+({_NAME})\s*[\[(]"),
    Rule("go", "def", rf"^\s*func\s*\(\s*(?:{_NAME}\s+)?(\*?{_NAME})(?:\[[^\]]*\])?\s*\)\s*({_NAME})\s*\(", 2, 1),
    Rule("go", "call", rf"(?<![\w.)\]])(?:({_NAME})\.)?({_NAME})\s*\(", 2, 1, NOT_GO),
    Rule("c", "def", rf"^[A-Za-z_][\w\s*]*?[\s*]({_NAME})\s*\([^;{{}}]*\)[^;(){{}}=]*\{{", unless=NOT_C),
    Rule("c", "call", rf"(?<![\w.>])({_NAME})\s*\(", unless=NOT_C),
    Rule("python", "class", rf"^\s*class\s+({_WORD})"),
    Rule("python", "def", rf"^\s*(?:async\s+)?def\s+({_WORD})"),
    Rule("python", "call", rf"(?:(?<![\w.)\]\"'])({_WORD})\.)?(?<!\w)(?<!\bclass\s)(?<!\bdef\s)({_WORD})\s*\(", 2, 1, NOT_PYTHON),
]

_DOUBLE, _SINGLE, _TICK = (rf"{q}[^{q}\\\n]*+(?:\\(?s:.)[^{q}\\\n]*+)*+{q}?" for q in ('"', "'", "`"))
_COMMENTS = r"/\*(?s:.*?)(?:\*/|\z)|//[^\n]*+"
#: What is blanked, by language: comments and strings; the first character tells which.
TOKENS = {
    "c": rf"{_COMMENTS}|{_DOUBLE}|{_SINGLE}",
    "go": rf"{_COMMENTS}|{_DOUBLE}|{_SINGLE}|`[^`]*+`?",
    "js": rf"{_COMMENTS}|{_DOUBLE}|{_SINGLE}|`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`?",
    "python": r"#[^\n]*+|" + "|".join(rf"{q * 3}(?:[^\\{q}]|\\(?s:.)|{q}(?!{q * 2}))*+(?:{q * 3}|\z)" for q in "\"'") + rf"|{_DOUBLE}|{_SINGLE}|\\\r?\n",
}
_PLAIN = {lang: r"[^#\"'\\]++" if lang == "python" else r"[^/\"'`]++" for lang in TOKENS}
#: A parameter list and what may stand between it and the brace that opens the body.
_HEADER = r"\((?:[^(){};]|\([^(){};]*+\))*+\)[^\n;{}=]*(?:=>)?\s*\{"
#: In place of a line break inside a token.
MARK = "\x01"


def blanked(content: Column, lang: str) -> Column:
    """A file without comments and the insides of its strings; line breaks inside them are marks."""
    pieces = F.regexp_extract_all(content, F.lit(f"(?:{TOKENS[lang]}|{_PLAIN[lang]}|(?s:.))"), 0)
    marks = lambda x: F.regexp_replace(F.regexp_replace(x, r"[^\n]", ""), r"\n", MARK)
    comment = r"^(?:#|\\)" if lang == "python" else r"^/[/*]"

    def clean(x: Column) -> Column:
        string = F.substring(x, 1, 1).isin('"', "'", "`")
        return F.when(string, F.concat(F.lit('""'), marks(x))).when(x.rlike(comment), F.concat(F.lit(" "), marks(x))).otherwise(x)

    return F.array_join(F.transform(pieces, clean), "")


def with_headers(code: Column) -> Column:
    """Parameter lists and the opening brace after them on one line; their line breaks become marks."""
    pieces = F.regexp_extract_all(code, F.lit(rf"(?:{_HEADER}|[^(]++|\()"), 0)
    return F.array_join(F.transform(pieces, lambda x: F.when(x.startswith("(") & x.endswith("{"), F.regexp_replace(x, r"\r?\n", MARK)).otherwise(x)), "")


def _count(code: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(code, f"[^{chars}]", ""))


def clean_files(files: DataFrame, langs: list[str] | None = None) -> DataFrame:
    """(path, lang, code) of files (path, content, lang) in langs; a language without tokens of its own has those of C."""
    code = F.lit(None).cast("string")
    for lang in TOKENS if langs is None else langs:
        one = blanked(F.col("content"), lang if lang in TOKENS else "c")
        code = F.when(F.col("lang") == lang, one if lang == "python" else with_headers(one)).otherwise(code)
    return files.where(F.col("content").isNotNull()).select("path", "lang", code.alias("code"))


def physical_lines(clean: DataFrame) -> DataFrame:
    """(path, lang, line_no, code, before) from clean_files, every line of the file."""
    lines = F.posexplode(F.split(F.translate("code", MARK, "\n"), "\n")).alias("k", "code")
    return clean.select("path", "lang", lines).select("path", "lang", (F.col("k") + 1).alias("line_no"), "code", F.lit(0).alias("before"))


def logical_lines(clean: DataFrame) -> DataFrame:
    """(path, lang, line_no, end_no, code, before, after) from clean_files: lines that hold code, those
    that go on over several once, with the depth before and after them."""
    by_path = Window.partitionBy("path").orderBy("k")
    d = clean.select("path", "lang", F.posexplode(F.split("code", "\n")).alias("k", "code"))
    d = d.withColumn("more", _count(F.col("code"), MARK))
    d = d.withColumn("end_no", (F.sum(F.col("more") + 1).over(by_path)).cast("int")).withColumn("line_no", (F.col("end_no") - F.col("more")).cast("int"))
    python = F.col("lang") == "python"
    d = d.withColumn("step", F.when(python, _count(F.col("code"), "(\\[{") - _count(F.col("code"), ")\\]}")).otherwise(_count(F.col("code"), "{") - _count(F.col("code"), "}")))
    d = d.withColumn("after", F.sum("step").over(by_path)).withColumn("before", F.col("after") - F.col("step"))
    d = d.where(F.regexp_replace("code", rf"[\s{MARK}]", "") != "")
    # Python: lines inside brackets belong to the one before; depth is indentation, tabs count to the next eighth
    first = F.when(~python | (F.col("before") <= 0), 1).otherwise(0)
    d = d.withColumn("group", F.sum(first).over(by_path)).withColumn("first", first == 1)
    d = d.withColumn("end_no", F.max("end_no").over(Window.partitionBy("path", "group"))).where("first")
    indent = F.length(F.regexp_replace(F.regexp_extract("code", r"^([ \t]*)", 1), r" {0,7}\t", " " * 8))
    d = d.withColumn("indent", indent)
    following = F.coalesce(F.lead("indent").over(by_path), F.lit(0))
    return d.select("path", "lang", "line_no", "end_no", "code", F.when(python, F.col("indent")).otherwise(F.col("before")).cast("int").alias("before"), F.when(python, following).otherwise(F.col("after")).cast("int").alias("after"))


def brackets(clean: DataFrame) -> DataFrame:
    """(path, k, line, text, is_punct) of the brackets of clean_files, in their order."""
    lines = clean.select("path", F.posexplode(F.split(F.translate("code", MARK, "\n"), "\n")).alias("n", "code"))
    found = lines.select("path", "n", F.posexplode(F.regexp_extract_all("code", F.lit(r"[(\[{}\])]"), 0)).alias("j", "text"))
    return found.select("path", F.struct("n", "j").alias("k"), (F.col("n") + 1).alias("line"), "text", F.lit(True).alias("is_punct"))


def _matches(r: Rule, place: int) -> Column:
    """The rule's matches in a line (place, name, other), placed from `place` on."""
    names = F.regexp_extract_all("code", F.lit(r.pattern), r.name)
    others = F.regexp_extract_all("code", F.lit(r.pattern), r.other) if r.other else F.transform(names, lambda _: F.lit(""))
    both = F.zip_with(names, others, lambda a, b: F.struct(a.alias("name"), b.alias("other")))
    placed = F.transform(both, lambda x, i: F.struct((i + place).alias("place"), x["name"].alias("name"), x["other"].alias("other")))
    return F.filter(placed, lambda x: (x["name"] != "") & ~x["name"].isin(*r.unless))


def hits(lines: DataFrame, kind: str, rules: list[Rule] | None = None) -> DataFrame:
    """lines with name, other and place: every match of the rules of a kind; place is its order among the line's
    matches, rule by rule. One pass: a line's matches of all its language's rules are one array."""
    own = [c for c in lines.columns if c != "code"]
    none = F.lit(None).cast("array<struct<place: int, name: string, other: string>>")
    found, k = none, 0
    by_lang: dict[str, list[Rule]] = {}
    for r in RULES if rules is None else rules:
        if r.kind == kind:
            by_lang.setdefault(r.lang, []).append(r)
    for lang, some in by_lang.items():
        found = F.when(F.col("lang") == lang, F.concat(*[_matches(r, 1000 * (k + j)) for j, r in enumerate(some)])).otherwise(found)
        k += len(some)
    return lines.select(*own, F.explode(found).alias("x")).select(*own, "x.place", "x.name", "x.other")


def _with_end(found: DataFrame, lines: DataFrame) -> DataFrame:
    """found with end_line: its own line if that closes what it opens, else the next line of the file that
    takes the depth back to that before it, or the last line. One window over (path, depth), backwards: a frame up to
    the last row would be computed anew for each row."""
    closed = lines.where("after < before").select("path", F.explode(F.sequence(F.col("after"), F.col("before") - 1)).alias("before"), "line_no", F.col("end_no").alias("closes"))
    names = [c for c in found.columns if c not in ("path", "before", "line_no")]
    both = found.withColumns({"closes": F.lit(None).cast("int"), "is_found": F.lit(True)}).unionByName(closed.withColumn("is_found", F.lit(False)), allowMissingColumns=True)
    later = Window.partitionBy("path", "before").orderBy(F.desc("line_no"), "is_found").rowsBetween(Window.unboundedPreceding, -1)
    d = both.withColumn("next", F.last("closes", ignorenulls=True).over(later)).where("is_found")
    last = lines.groupBy("path").agg(F.max("end_no").alias("last"))
    d = d.join(last, "path")
    end = F.when(F.col("after") <= F.col("before"), F.col("end_no")).otherwise(F.coalesce("next", "last"))
    return d.select("path", "line_no", "before", *names, end.cast("int").alias("end_line"))


def definitions(lines: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(lang, path, scope, name, start_line, end_line, start_col) from logical_lines; a method's scope is
    the innermost class around it, or its receiver."""
    keys = ("path", "lang", "line_no", "end_no", "before", "after", "name")
    found = hits(lines, "def", rules).groupBy(*keys).agg(F.min("place").alias("place"), F.max("other").alias("other"))
    classes = hits(lines, "class", rules)
    d = _with_end(found.withColumn("is_class", F.lit(False)).unionByName(classes.select(*keys, "place", "other").withColumn("is_class", F.lit(True))), lines)
    # classes are laid into the 64-line buckets that they span, so that a long file is not met by each as a whole
    bucket = lambda c: F.floor(F.col(c) / 64)
    c = d.where("is_class").select(F.col("path").alias("of"), F.col("line_no").alias("c0"), F.col("end_line").alias("c1"), F.col("name").alias("class_name"), F.explode(F.sequence(bucket("line_no"), bucket("end_line"))).alias("bucket"))
    d = d.where("not is_class").withColumn("at", bucket("line_no"))
    d = d.join(c.hint("merge"), (F.col("path") == F.col("of")) & (F.col("at") == F.col("bucket")) & (F.col("line_no") > F.col("c0")) & (F.col("end_line") <= F.col("c1")), "left")
    d = d.groupBy("lang", "path", "name", "line_no", "end_line", "place", "other").agg(F.max_by("class_name", "c0").alias("class_name"))
    scope = F.when(F.col("other") != "", F.col("other")).otherwise(F.col("class_name"))
    return d.select("lang", "path", scope.alias("scope"), "name", F.col("line_no").alias("start_line"), "end_line", F.col("place").alias("start_col"))


def calls(lines: DataFrame, defined: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(lang, path, line, start_line, end_line, start_col, callee_name, callee_qualifier) from
    physical_lines; names that the line defines (path, line_no, name) are no calls."""
    d = hits(lines, "call", rules).join(defined, ["path", "line_no", "name"], "left_anti")
    line = F.col("line_no")
    return d.select("lang", "path", line.alias("line"), line.alias("start_line"), line.alias("end_line"), F.col("place").alias("start_col"), F.col("name").alias("callee_name"), F.col("other").alias("callee_qualifier"))
