"""Operator 3, chat formatting: preference pairs with their common prefix rendered once (native).

Of a chosen and a rejected conversation the longest common prefix of turns (equal role and text, in
order) is the prompt; what follows in each is its completion. Completions are lists of segments with a
training mask: 1 for what the model is to learn (the turns of the trained role, with their end mark),
0 for the rest. One aggregation gathers the turns of each conversation, which is a row of the result
itself; one join brings the two sides together.

Defined results: turns are ordered by turn, then role and text, nulls first; null roles and texts equal
each other and render as empty; a side without a conversation is empty, and then so is the prompt;
equal conversations have empty completions; rows of a null conversation id are left out; repeated rows
are repeated turns; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import stored, table

START, MIDDLE, STOP = "<|start|>", "<|message|>", "<|end|>\n"
TRAINED_ROLE = "assistant"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's (role, text) in order."""
    one = F.struct(F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    d = conversations.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    return d.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two conversations share from their beginning."""
    same = F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() & y.isNotNull() & x.eqNullSafe(y), 1).otherwise(0))
    differs = F.array_position(same, 0)
    return F.when(differs > 0, differs.cast("int") - 1).otherwise(F.size(same))


def _header(x: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(x["role"], F.lit("")), F.lit(MIDDLE))


def _message(x: Column) -> Column:
    return F.concat(F.coalesce(x["text"], F.lit("")), F.lit(STOP))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(_header(x), _message(x))), "")


def masked(turns: Column) -> Column:
    """Segments (text, mask) of a completion: a header is never learned, a message if its role is."""
    parts = F.transform(turns, lambda x: F.array(F.struct(_header(x).alias("text"), F.lit(0).alias("mask")), F.struct(_message(x).alias("text"), F.coalesce((x["role"] == TRAINED_ROLE).cast("int"), F.lit(0)).alias("mask"))))
    return F.flatten(parts)


def format_preferences(pairs: DataFrame, conversations: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, rejected_id, n_prompt_turns, prompt, chosen, rejected) for pairs of
    (pair_id, chosen_id, rejected_id); chosen and rejected are masked segments."""
    t = stored(turns_of(conversations), "turns")
    sides = pairs.join(t.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("a")), "chosen_id", "left").join(t.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("b")), "rejected_id", "left")
    return _formatted(sides)


def _formatted(sides: DataFrame) -> DataFrame:
    empty = F.slice(F.array(F.struct(F.lit("").alias("role"), F.lit("").alias("text"))), 1, 0)
    d = sides.select("pair_id", "chosen_id", "rejected_id", F.coalesce("a", empty).alias("a"), F.coalesce("b", empty).alias("b"))
    d = d.select("*", common_turns(F.col("a"), F.col("b")).alias("n"))
    rest = lambda x: F.slice(x, F.col("n") + 1, F.greatest(F.size(x), F.lit(1)))
    return d.select("pair_id", "chosen_id", "rejected_id", F.col("n").cast("long").alias("n_prompt_turns"), rendered(F.slice("a", 1, F.col("n"))).alias("prompt"), masked(rest(F.col("a"))).alias("chosen"), masked(rest(F.col("b"))).alias("rejected"))


def pair_by_id(conversations: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, rejected_id, a, b): conversation 2k is the chosen side of pair k and 2k + 1
    the rejected. Both ends of a pair come from one aggregation, so that no join is needed."""
    t = turns_of(conversations).withColumn("pair_id", F.shiftright(F.col("conv_id").cast("long"), 1))
    side = lambda r, c: F.max(F.when(F.pmod(F.col("conv_id"), F.lit(2)) == r, F.col(c)))
    turns = lambda r: F.max(F.when(F.pmod(F.col("conv_id"), F.lit(2)) == r, F.col("turns")))
    return t.groupBy("pair_id").agg(side(0, "conv_id").alias("chosen_id"), side(1, "conv_id").alias("rejected_id"), turns(0).alias("a"), turns(1).alias("b"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _formatted(pair_by_id(table(spark, sf_dir, "conversations")))
    text = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), "")
    learned = lambda c: F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + F.when(x["mask"] == 1, F.length(x["text"]).cast("long")).otherwise(0)), F.lit(0))
    return d.select("pair_id", "chosen_id", "rejected_id", "n_prompt_turns", "prompt", text("chosen").alias("chosen"), text("rejected").alias("rejected"), learned("chosen").alias("chosen_learned"), learned("rejected").alias("rejected_learned"))


SQL = """
WITH t AS (
  SELECT conv_id, conv_id >> 1 AS pair_id, conv_id & 1 AS side, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
         '<|start|>' || coalesce(role, '') || '<|message|>' || coalesce(text, '') || '<|end|>' || chr(10) AS r,
         CASE WHEN role = 'assistant' THEN length(coalesce(text, '')) + 8 ELSE 0 END AS learned
  FROM conversations WHERE conv_id IS NOT NULL),
m AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id,
        min(CASE WHEN a.k IS NULL OR b.k IS NULL OR a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text THEN coalesce(a.k, b.k) END) AS differs, count(*) AS n
      FROM (SELECT * FROM t WHERE side = 0) a FULL JOIN (SELECT * FROM t WHERE side = 1) b ON a.pair_id = b.pair_id AND a.k = b.k GROUP BY 1),
p AS (SELECT pair_id, coalesce(differs - 1, n) AS n FROM m)
SELECT t.pair_id, max(CASE WHEN side = 0 THEN conv_id END) AS chosen_id, max(CASE WHEN side = 1 THEN conv_id END) AS rejected_id,
       CAST(p.n AS BIGINT) AS n_prompt_turns,
       coalesce(string_agg(CASE WHEN side = 0 AND k <= p.n THEN r END, '' ORDER BY k), '') AS prompt,
       coalesce(string_agg(CASE WHEN side = 0 AND k > p.n THEN r END, '' ORDER BY k), '') AS chosen,
       coalesce(string_agg(CASE WHEN side = 1 AND k > p.n THEN r END, '' ORDER BY k), '') AS rejected,
       CAST(sum(CASE WHEN side = 0 AND k > p.n THEN learned ELSE 0 END) AS BIGINT) AS chosen_learned,
       CAST(sum(CASE WHEN side = 1 AND k > p.n THEN learned ELSE 0 END) AS BIGINT) AS rejected_learned
FROM t JOIN p ON t.pair_id = p.pair_id GROUP BY t.pair_id, p.n
"""
