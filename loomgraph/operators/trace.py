"""Recorded traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.paths import cut_arguments, is_noise

EVENT = T.StructType([T.StructField("fn", T.StringType()), T.StructField("file", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("args", T.MapType(T.StringType(), T.StringType()))])
_CORRUPT = T.StructType([*EVENT.fields, T.StructField("_bad", T.StringType())])


def parse(lines: DataFrame) -> DataFrame:
    """Columns of lines (value, ...) with fn, file, line, args, seq (unless lines have one: the number that
    a line carries, or null) and bad: whether the line is no event. Missing fields are '' and 0. Works on
    streams too."""
    e = F.from_json("value", _CORRUPT, {"columnNameOfCorruptRecord": "_bad"})
    d = lines.withColumn("_e", e)
    bad = F.col("_e").isNull() | F.col("_e._bad").isNotNull()
    seq = [] if "seq" in lines.columns else [F.col("_e.seq").alias("seq")]
    return d.select(*lines.columns, *seq, F.coalesce("_e.fn", F.lit("")).alias("fn"), F.coalesce("_e.file", F.lit("")).alias("file"), F.coalesce("_e.line", F.lit(0)).alias("line"), F.col("_e.args").alias("args"), bad.alias("bad"))


def without_noise(events: DataFrame, root: str | None = None) -> DataFrame:
    return events.where(~is_noise(F.col("fn"), F.col("file"), root))


def with_cut_arguments(events: DataFrame) -> DataFrame:
    return events.withColumn("args", cut_arguments(F.col("args")))


def of_function(events: DataFrame, fn: str) -> DataFrame:
    return events.where(F.col("fn") == fn)


def first_events(events: DataFrame, limit: int) -> DataFrame:
    d = events.orderBy("seq")
    return d if limit <= 0 else d.limit(limit)


def numbered(events: DataFrame) -> DataFrame:
    """Events with their number in the run, from 1, and the run's size."""
    run = Window.partitionBy("run_id")
    return events.withColumns({"number": F.row_number().over(run.orderBy("seq")), "n": F.count("*").over(run)})


def run_sizes(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id").agg(F.count("*").alias("n"))


def playhead(events: DataFrame, index: int | None = None) -> DataFrame:
    """Each run's event of that number (from 1), or its last."""
    if index is None:
        return events.groupBy("run_id").agg(F.max_by(F.struct("seq", "fn", "file", "line"), "seq").alias("e")).select("run_id", "e.*")
    return numbered(events).where(F.col("number") == index).select("run_id", "seq", "fn", "file", "line")
