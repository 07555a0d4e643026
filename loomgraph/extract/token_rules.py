"""Definitions and call sites of C, Go and JavaScript as windows over the token stream.

A definition or a call is a window of tokens around a name: what stands before it, after it, and behind the
bracket that it opens. Of the tokens that one bracket directly holds, those at which something begins or ends are a window
of their own (path, encl): in it a statement begins behind the last break, and an arrow function's body ends at the next
one. Windows look back only, those for what comes next over the opposite order: a frame up to the last row would be
computed anew for each row. A call's qualifier is its chain's text before the last dot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from loomgraph.extract.line_rules import NOT_C, NOT_GO, NOT_JS, NOT_JS_METHOD
from loomgraph.extract.tokens import in_expression

# Words that stand before a method's name, and C words that stand before an expression.
MODIFIERS = ("static", "async", "get", "set")
C_EXPRESSION = ("return", "else", "do", "case", "goto", "sizeof")
#: Tokens of a file that share a bucket in the join of definitions and the classes around them.
BUCKET = 256


def _at() -> WindowSpec:
    """The tokens that the bracket around a token, `at`, directly holds. A column of its own, so that all windows over it
    share one shuffle."""
    return Window.partitionBy("path", "at").orderBy("k")


def _before() -> WindowSpec:
    return _at().rowsBetween(Window.unboundedPreceding, -1)


def _after() -> WindowSpec:
    """All rows behind, the nearest last."""
    return Window.partitionBy("path", "at").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)


def _is(c: str, *values: str) -> Column:
    """Whether a neighbour's text is one of values; false where there is no neighbour."""
    return F.coalesce(F.col(f"{c}.text").isin(*values), F.lit(False))


def _kind(c: str, *kinds: str) -> Column:
    return F.coalesce(F.col(f"{c}.kind").isin(*kinds), F.lit(False))


def _eq(c: str, value: str) -> Column:
    return F.coalesce(F.col(c) == value, F.lit(False))


def js_definitions(t: DataFrame) -> DataFrame:
    """Function declarations, methods of classes and object literals, and arrow functions of declarators."""
    declares = F.when((F.col("kind") == "name") & F.col("text").isin("const", "let", "var"), True).when(F.col("is_punct") & (F.col("text") == ";"), False)
    # a break ends an expression body: a comma or semicolon, or a line that doesn't go on
    goes_on = in_expression(F.col("p1")) | _is("p1", ".", "?.") | (F.col("is_punct") & ~F.col("text").isin("{", "(", "[", "++", "--", "!", "~")) | (F.col("kind") == "name") & F.col("text").isin("in", "of", "instanceof")
    breaks = (F.col("is_punct") & F.col("text").isin(",", ";")) | (F.col("line") > F.col("p1.line")) & ~F.coalesce(goes_on, F.lit(False))

    opens_body = _is("n1", "(") & _eq("n1.after", "{")
    behind = F.when(_is("p2", "async"), F.col("p3")).otherwise(F.col("p2"))
    function = _is("p1", "function") & _is("n1", "(") & ~in_expression(behind) & opens_body
    braces = F.col("encl.brace")
    method = opens_body & ~_is("p1", "function", ".", "?.", "new", "=") & ((braces == "class") | (braces == "object") & (_is("p1", "{", ",", "*") | _is("p1", *MODIFIERS)) & ~F.col("text").isin(*NOT_JS_METHOD))
    params = lambda j: _is(f"n{j}", "(") & _eq(f"n{j}.after", "=>") | _kind(f"n{j}", "name") & _is(f"n{j + 1}", "=>")
    value = params(2) | _is("n2", "async") & (_is("n3", "(") & _eq("n3.after", "=>") | _kind("n3", "name") & _is("n4", "=>"))
    assigns = _is("n1", "=") & value
    kind = F.when(F.col("kind") == "name", F.when(function, "function").when(method, "method").when(assigns & _is("p1", "const", "let", "var"), "arrow").when(assigns & _is("p1", ","), "next"))
    first = F.when(F.col("what") == "method", F.when(_is("p1", *MODIFIERS, "*") & (F.col("p1.line") < F.col("line")), F.col("p1.line")))
    first = F.when((F.col("what") == "function") & _is("p2", "async"), F.col("p2.line")).when(F.col("what") == "function", F.col("p1.line")).otherwise(first)

    # what stands around a token is told before the windows: they move few numbers
    d = t.where("lang = 'js'").withColumn("what", kind)
    d = d.select("lang", "path", F.col("encl.k").alias("at"), "k", "line", "what", F.when(F.col("what").isNotNull(), F.col("text")).alias("name"), first.alias("first"), F.col("n1.after_close_line").alias("body_end"),
        declares.alias("declares"), F.when(breaks, F.col("p1.line")).alias("breaks"), (F.col("is_punct") & (F.col("text") == "=>")).alias("is_arrow"), F.when(F.col("n1.text") == "{", F.struct(F.col("n1.close_line").alias("line"))).alias("block"))
    d = d.withColumn("declares", F.coalesce(F.last("declares", ignorenulls=True).over(_before()), F.lit(False)))
    d = d.withColumn("ends", F.coalesce(F.last("breaks", ignorenulls=True).over(_after()), F.max("line").over(_after()), F.col("line")))
    arrow = F.when(F.col("is_arrow"), F.when(F.col("block").isNotNull(), F.col("block.line")).otherwise(F.col("ends")))
    d = d.withColumn("arrow_end", F.last(arrow, ignorenulls=True).over(_after()))
    d = d.where("what is not null and (what <> 'next' or declares)")
    end = F.when(F.col("what").isin("arrow", "next"), F.col("arrow_end")).otherwise(F.col("body_end"))
    return d.select("lang", "path", "k", F.lit(None).cast("string").alias("scope"), "name", F.coalesce("first", "line").alias("start_line"), F.coalesce(end, "line").alias("end_line"), (F.col("what") == "method").alias("in_class"))


def c_definitions(t: DataFrame) -> DataFrame:
    """A name with a type before it, a parameter list and a body; it begins where its statement does."""
    breaks = (F.col("is_punct") & F.col("text").isin(";", "}")) | (F.col("kind") == "directive")
    defines = (F.col("kind") == "name") & ~F.col("text").isin(*NOT_C) & _typed() & _is("n1", "(") & _eq("n1.after", "{")
    d = t.where("lang = 'c'").select("lang", "path", F.col("encl.k").alias("at"), "k", "line", breaks.alias("breaks"), F.when(defines, F.col("text")).alias("name"), F.col("n1.after_close_line").alias("body_end"))
    d = d.withColumn("statement", F.coalesce(F.sum(F.when(F.col("breaks"), 1).otherwise(0)).over(_before()), F.lit(0)))
    d = d.withColumn("first", F.min(F.when(~F.col("breaks"), F.col("line"))).over(Window.partitionBy("path", "at", "statement")))
    return d.where("name is not null").select("lang", "path", "k", F.lit(None).cast("string").alias("scope"), "name", F.coalesce("first", "line").alias("start_line"), F.coalesce("body_end", "line").alias("end_line"), F.lit(False).alias("in_class"))


def _typed() -> Column:
    return _kind("p1", "name") & ~_is("p1", *C_EXPRESSION)


def go_definitions(t: DataFrame) -> DataFrame:
    """`func name(` and `func (receiver) name(` outside of all brackets."""
    function = _kind("n1", "name") & _is("n2", "(", "[")
    method = _is("n1", "(") & _eq("n1.after_kind", "name") & F.coalesce(F.col("n1.after2").isin("(", "["), F.lit(False))
    starts = (F.col("kind") == "name") & (F.col("text") == "func") & (function | method)
    body = F.col("is_punct") & (F.col("text") == "{") & ~_is("p1", "struct", "interface")
    mark = F.when(starts, F.struct(F.lit(None).cast("int").alias("line"))).when(body, F.struct(F.col("close_line").alias("line")))
    pointer = F.when(_is("n2", "*"), F.concat(F.lit("*"), F.col("n3.text"))).when(_is("n3", "*"), F.concat(F.lit("*"), F.col("n4.text")))
    receiver = pointer.when(_is("n3", ")", "["), F.col("n2.text")).otherwise(F.col("n3.text"))
    name = F.when(method, F.col("n1.after")).otherwise(F.col("n1.text"))
    d = t.where("lang = 'go' and encl.k = -1").select("lang", "path", F.col("encl.k").alias("at"), "k", "line", starts.alias("starts"), mark.alias("mark"), F.when(starts & method, receiver).alias("scope"), F.when(starts, name).alias("name"))
    d = d.withColumn("body", F.last("mark", ignorenulls=True).over(_after())).where("starts")
    return d.select("lang", "path", "k", "scope", "name", F.col("line").alias("start_line"), F.coalesce("body.line", "line").alias("end_line"), F.lit(False).alias("in_class"))


def definitions(t: DataFrame) -> DataFrame:
    """(lang, path, scope, name, start_line, end_line, start_col) of sites; start_col orders by place in the file."""
    d = js_definitions(t).unionByName(c_definitions(t)).unionByName(go_definitions(t))
    bucket = lambda c: F.floor(F.col(c) / BUCKET)
    classes = t.where("class_name is not null and close_k is not null").select(F.col("path").alias("of"), F.col("k").alias("k0"), F.col("close_k").alias("k1"), "class_name", F.explode(F.sequence(bucket("k"), bucket("close_k"))).alias("bucket"))
    d = d.withColumn("own", F.when(F.col("in_class"), bucket("k")))
    within = (F.col("path") == F.col("of")) & (F.col("own") == F.col("bucket")) & (F.col("k") > F.col("k0")) & (F.col("k") < F.col("k1"))
    d = d.join(classes.hint("merge"), within, "left").groupBy("lang", "path", "k", "scope", "name", "start_line", "end_line").agg(F.max_by("class_name", "k0").alias("class_name"))
    return d.select("lang", "path", F.coalesce("scope", "class_name").alias("scope"), "name", F.col("start_line").cast("int"), F.col("end_line").cast("int"), F.col("k").cast("int").alias("start_col"))


def js_calls(t: DataFrame) -> DataFrame:
    """`f(`, `o.f(` and their optional forms, but for definitions, operators of words, and what `new` makes."""
    t = t.where("lang = 'js'")
    member = _is("p1", ".", "?.")
    plain = _is("n1", "(")
    optional = _is("n1", "?.") & _is("n2", "(")
    ends = F.when(plain, F.col("n1.close_line")).otherwise(F.col("n2.close_line"))
    defines = _is("p1", "function") | _is("p2", "function") & _is("p1", "*") | (plain & F.col("encl.brace").isin("class", "object") & _eq("n1.after", "{"))
    declares = (F.col("encl.brace") == "class") & (_is("p1", "{", "}", ";", "*") | _is("p1", *MODIFIERS))
    arrow = (F.col("text") == "async") & _eq("n1.after", "=>")
    made = (F.col("head.text") == "new") & (F.col("opened") == 0)
    d = t.where((F.col("kind") == "name") & (plain | optional) & ~F.coalesce(arrow | made, F.lit(False)) & (member | ~defines & ~declares & ~F.col("text").isin(*NOT_JS)))
    return d.select("lang", "path", "k", F.coalesce(F.when(member, F.col("head.line")), F.col("line")).alias("line"), ends.alias("end_line"), F.col("text").alias("name"), F.when(member, F.col("object")).otherwise("").alias("qualifier"))


def c_calls(t: DataFrame) -> DataFrame:
    """`f(` that is no declaration: no type before it and, outside of all brackets, no `*`."""
    declares = _typed() | ((F.col("encl.k") == -1) | (F.col("encl.brace") == "linkage")) & _is("p1", "*") | _is("p1", "*") & _eq("n1.after", "{")
    d = t.where((F.col("lang") == "c") & (F.col("kind") == "name") & _is("n1", "(") & ~F.col("text").isin(*NOT_C) & ~_is("p1", ".", "->") & ~declares)
    return _plain(d, F.lit(""), F.col("line"))


def go_calls(t: DataFrame) -> DataFrame:
    """`f(` and `x.f(` where x is a name alone; no names of definitions or of an interface's methods."""
    member = _is("p1", ".")
    alone = _kind("p2", "name") & ~_is("p3", ".")
    defines = _is("p1", "func") | (F.col("encl.k") == -1) & _is("p1", ")")
    d = t.where((F.col("lang") == "go") & (F.col("kind") == "name") & _is("n1", "(") & ~F.col("text").isin(*NOT_GO) & (F.col("encl.brace") != "interface") & ~defines & (~member | alone))
    return _plain(d, F.when(member, F.col("p2.text")).otherwise(""), F.coalesce(F.when(member, F.col("p2.line")), F.col("line")))


def _plain(d: DataFrame, qualifier: Column, line: Column) -> DataFrame:
    return d.select("lang", "path", "k", line.alias("line"), F.col("n1.close_line").alias("end_line"), F.col("text").alias("name"), qualifier.alias("qualifier"))


def calls(t: DataFrame) -> DataFrame:
    """(lang, path, line, start_line, end_line, start_col, callee_name, callee_qualifier) of sites; a call begins where
    its object does."""
    d = js_calls(t).unionByName(c_calls(t)).unionByName(go_calls(t))
    return d.select("lang", "path", F.col("line").cast("int").alias("line"), F.col("line").cast("int").alias("start_line"), F.coalesce("end_line", "line").cast("int").alias("end_line"), F.col("k").cast("int").alias("start_col"), F.col("name").alias("callee_name"), F.col("qualifier").alias("callee_qualifier"))
