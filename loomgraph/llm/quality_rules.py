"""Operator 5, quality rules: decision lists learned by sequential covering (native).

`text_statistics` is one narrow projection: no shuffle, no Python. `learn_rules` grows threshold
conjunctions on one part of a bounded sample of labelled statistics and prunes them on the other;
`rules_expression` turns the ordered list into one conditional expression.

Defined results: a null or empty text has zero words and fails the base rule; null labels teach
nothing; with no usable labels the list is empty and the base rule alone decides; repeated rows
give repeated results; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import table, words_of

#: Labelled rows the learner may see; the sample is the rows of smallest md5(doc_id).
SAMPLE_ROWS = 20_000
FEATURES = ("n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "mark_rate")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_windows(words: Column, n: Column) -> Column:
    """Words that stand in a 3-word window found twice or more. Windows are 64-bit hashes; their
    positions are sorted only in texts that hold one twice."""
    pairs = F.zip_with(words, F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b))
    return F.slice(F.zip_with(pairs, F.slice(words, 3, n), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(n - 2, F.lit(0)))


def _placed(hashes: Column) -> Column:
    return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each row: `row` (the input row as a struct, so that no column name can clash), n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words and further counts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.struct("*").alias("row"), text.alias("t"), words_of(F.col(text_col)).alias("w"))
    d = d.select("row", "t", "w", F.size("w").alias("n"), F.length(F.array_join("w", "")).cast("long").alias("chars"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]"))
    d = d.select("row", "t", "n", "chars", repeated_windows(F.col("w"), F.greatest(F.col("n"), F.lit(1))).alias("h"), lines.alias("l"))
    d = d.select("*", F.when(F.size("h") > F.size(F.array_distinct("h")), _placed(F.col("h"))).alias("p"))
    same = F.zip_with("p", F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    d = d.select("*", same.alias("same"))
    before = F.concat(F.array(F.lit(False)), F.col("same"))
    marked = F.zip_with(F.zip_with("same", before, lambda a, b: F.coalesce(a, F.lit(False)) | b), F.col("p"), lambda hit, x: F.when(hit, x["i"]))
    d = d.select("*", F.sort_array(F.filter(marked, lambda i: i.isNotNull())).alias("at"))
    gaps = F.zip_with("at", F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    repeat = F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g.cast("long")), F.lit(0).cast("long"))
    count = lambda others: F.length(F.regexp_replace("t", others, "")).cast("long")
    return d.select(
        "row",
        F.col("n").cast("long").alias("n_words"),
        F.col("chars").alias("word_chars"),
        count("[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        count("\\P{Lu}+").alias("n_upper"),
        count("[^0-9]+").alias("n_digits"),
        count("[^!?.]+").alias("n_marks"),
    )


def with_features(stats: DataFrame) -> DataFrame:
    """The learner's columns, all double and never null."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return stats.withColumns({
        "mean_word": F.col("word_chars") / words,
        "symbol_rate": F.col("n_symbols") / words,
        "dup_line_rate": F.col("n_dup_lines") / lines,
        "repeat_rate": F.col("n_repeat_words") / words,
        "upper_rate": F.col("n_upper") / chars,
        "digit_rate": F.col("n_digits") / chars,
        "mark_rate": F.col("n_marks") / words,
    })


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, is_at_least, threshold); the texts it covers are rejected."""

    tests: tuple[tuple[str, bool, float], ...]
    precision: float
    covered: int


def _covers(x: np.ndarray, tests: list[tuple[int, bool, float]]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, least, cut in tests:
        hit &= (x[:, f] >= cut) if least else (x[:, f] <= cut)
    return hit


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information that a test adds over the texts it keeps (rejects p of p0, clean n of n0)."""
    return p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2((p0 + 1e-9) / (p0 + n0 + 1e-9)))


def learn_rules(x: np.ndarray, bad: np.ndarray, features: tuple[str, ...] = FEATURES, max_tests: int = 4, cuts: int = 64, precision: float = 0.95, least: int = 8) -> list[Rule]:
    """Sequential covering. A rule grows on two thirds of the rows by the test of most gain, is
    pruned from its end while the last third prefers the shorter one, and is kept while it is
    precise there; what it covers then leaves both parts. Ties fall to the first feature and cut."""
    rules: list[Rule] = []
    if not len(x):
        return rules
    part = np.arange(len(x)) % 3 < 2
    alive = np.ones(len(x), bool)
    grid = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, cuts))) for f in range(x.shape[1])]
    for f in range(x.shape[1]):  # the bad rows' own quantiles too, as they may all lie beyond one cut
        if bad.any():
            grid[f] = np.unique(np.concatenate([grid[f], np.quantile(x[bad, f], np.linspace(0, 1, cuts))]))
    while True:  # each rule takes `least` bad rows at least away
        grow, prune = alive & part, alive & ~part
        tests: list[tuple[int, bool, float]] = []
        rows = np.flatnonzero(grow)
        while len(tests) < max_tests and (~bad[rows]).any() and bad[rows].any():
            p0, n0, best = bad[rows].sum(), (~bad[rows]).sum(), (1e-6, None)
            for f in range(x.shape[1]):
                v = x[rows, f]
                order = np.argsort(v, kind="stable")
                sv, cb = v[order], np.concatenate([[0], np.cumsum(bad[rows][order])])
                for at_least, k in ((True, np.searchsorted(sv, grid[f], "left")), (False, np.searchsorted(sv, grid[f], "right"))):
                    p = p0 - cb[k] if at_least else cb[k]
                    n = (len(rows) - k if at_least else k) - p
                    g = np.where(p >= least, _gain(p.astype(float), n.astype(float), p0, n0), -1)
                    j = int(np.argmax(g))
                    if g[j] > best[0]:
                        best = (float(g[j]), (f, at_least, float(grid[f][j])))
            if best[1] is None:
                break
            tests.append(best[1])
            rows = np.flatnonzero(grow & _covers(x, tests))
        if not tests:
            break

        def worth(t: list, prune: np.ndarray = prune) -> float:
            hit = prune & _covers(x, t)
            p, n = (hit & bad).sum(), (hit & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests.pop()
        hit = alive & _covers(x, tests)
        p, n, checked = int((hit & bad).sum()), int((hit & ~bad).sum()), hit & prune
        cp, cn = int((checked & bad).sum()), int((checked & ~bad).sum())
        if p < least or p < precision * (p + n) or cp < precision * (cp + cn):
            break
        rules.append(Rule(tuple((features[f], a, c) for f, a, c in tests), p / (p + n), p + n))
        alive &= ~hit
    return rules


def rules_expression(rules: list[Rule]) -> Column:
    """The ordered list as one conditional: the number of the first rule that covers the row, 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = F.lit(True)
        for f, at_least, cut in rule.tests:
            test = test & ((F.col(f) >= F.lit(cut)) if at_least else (F.col(f) <= F.lit(cut)))
        out = F.when(test, k) if out is None else out.when(test, k)
    return F.lit(0) if out is None else out.otherwise(0)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, bad) of at most `rows` labelled documents, chosen by md5(doc_id). The ids are
    taken before any text is read, and so few (bounded by `rows`) that they may be broadcast."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("_q"))
    chosen = ids.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    d = docs.select(F.col("doc_id"), F.col("text"))
    return d.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", (F.col("_q") == 0).alias("bad"))


def fit_rules(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules for what the labels call bad, from a bounded sample; texts that fail the base rule
    teach nothing, as that rule rejects them before."""
    sample = labelled_sample(docs, labels, rows)
    sample = sample.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)  # repeated ids can't pass the bound
    d = with_base(with_features(text_statistics(sample)))
    got = d.select("base_failed", "row.bad", *[F.col(f).cast("double") for f in FEATURES]).collect()
    got = [r for r in got if not r[0]]  # filtered here: Catalyst would push the test down and compute every statistic twice
    return learn_rules(np.array([r[2:] for r in got], float).reshape(len(got), len(FEATURES)), np.array([r[1] for r in got], bool))


def with_base(stats: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumn("base_failed", failed)


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Statistics, base_failed, rule (number of the rule that rejects, else 0) and kept of every row."""
    d = with_base(with_features(text_statistics(docs))).withColumn("rule", rules_expression(rules))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit_rules(docs, table(spark, sf_dir, "labels"))
    return apply_rules(docs, rules).select("row.doc_id", *BASE, "base_failed", "rule", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned list rejects go; the rest keep all their columns.
    The verdict is computed beside the row, so no join is needed to apply it."""
    rules = fit_rules(docs, table(spark, sf_dir, "labels"))
    d = apply_rules(docs, rules)
    # a generator and not where(): a filter would be pushed below the statistics, which it would then compute twice
    kept = F.when(F.col("kept"), F.array("row")).otherwise(F.slice(F.array("row"), 1, 0))
    return d.select(F.explode(kept).alias("row")).select("row.*")
