"""Traces as streams: the same transforms as for recorded ones, and running results over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomgraph.operators.resolve import event_functions
from loomgraph.operators.trace import parse, without_noise
from loomgraph.sources.shared import remove


def read_lines(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """(value, run_id): lines of the files that appear in a folder or below it. A file's run is named by a
    directory run_id=... above it, or else by the file itself."""
    d = spark.readStream.format("text").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)
    file = F.input_file_name()
    run = F.regexp_extract(file, "/run_id=([^/]*)/", 1)
    return d.select("value", F.when(run != "", run).otherwise(F.element_at(F.split(file, "/"), -1)).alias("run_id"))


def lines_of_messages(messages: DataFrame) -> DataFrame:
    """(value, run_id) of a message stream (key, value as binary, as from Kafka); the key names the run."""
    return messages.select(F.col("value").cast("string").alias("value"), F.col("key").cast("string").alias("run_id"))


def events_of(lines: DataFrame, root: str | None = None) -> DataFrame:
    """Well-formed events without noise."""
    return without_noise(parse(lines).where("not bad").drop("bad"), root)


def malformed(lines: DataFrame) -> DataFrame:
    """The lines that are no events, as they came."""
    return parse(lines).where("bad").select(*lines.columns)


def upserting(path: str, keys: list[str], schema: str, of_batch: Callable[[DataFrame], DataFrame] = lambda d: d, compact_every: int = 32) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for a stream in update mode, whose rows are the new values of the keys that changed. A
    batch writes them, and nothing else, under its number; so it may run again. Every compact_every batches those
    of the batches before become one table, and go. `upserted` reads the whole."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        of_batch(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        base, deltas = _layers(spark, path)
        done = [n for n in deltas if n < number]
        if len(done) >= compact_every:
            upserted(spark, path, keys, schema, before=number).write.mode("overwrite").parquet(f"{path}/base={done[-1]}")
            for n in done:
                remove(spark, f"{path}/batch={n}")
            if base is not None:
                remove(spark, f"{path}/base={base}")

    return write


def _layers(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """The last base that is whole, and the batches behind it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None, []
    there = [x.getPath() for x in fs.listStatus(at)]
    whole = [x.getName().split("=") for x in there if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    base = max((int(n) for kind, n in whole if kind == "base"), default=None)
    return base, sorted(int(n) for kind, n in whole if kind == "batch" and (base is None or int(n) > base))


def upserted(spark: SparkSession, path: str, keys: list[str], schema: str, before: int | None = None) -> DataFrame:
    """The table that batches have come to: of each key the row of the last batch that has one."""
    base, deltas = _layers(spark, path)
    read = spark.read.schema(schema)
    parts = [(n, f"{path}/batch={n}") for n in deltas if before is None or n < before] + ([(-1, f"{path}/base={base}")] if base is not None else [])
    if not parts:
        return spark.createDataFrame([], schema)
    numbers = F.regexp_extract(F.input_file_name(), "/batch=([0-9]+)/", 1)
    d = read.parquet(*[p for _, p in parts]).withColumn("_batch", F.coalesce(F.nullif(numbers, F.lit("")).cast("long"), F.lit(-1)))
    names = [c for c in d.columns if c != "_batch"]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in names if c not in keys]), "_batch").alias("_v")).select(*[c if c in keys else F.col(f"_v.{c}").alias(c) for c in names])


#: What is kept of the events of a stream: how often each (fn, file) came, and each run's last event.
HIT_KEYS, HIT_SCHEMA = ["fn", "file"], "fn string, file string, n long"
LAST_KEYS, LAST_SCHEMA = ["run_id"], "run_id string, seq long, fn string, file string, line int"


def running_hits(events: DataFrame) -> DataFrame:
    """(fn, file, n) in update mode: how often an event of each kind has come; the counts are the stream's state."""
    return events.groupBy("fn", "file").agg(F.count("*").alias("n"))


def hits_of(counts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, hits) of running_hits: each kind of event is resolved once, as in a batch, to the smallest id that it fits."""
    ids = event_functions(counts.withColumn("seq", F.struct("fn", "file")), nodes)
    return ids.join(counts.select(F.struct("fn", "file").alias("seq"), "n"), "seq").groupBy("id").agg(F.sum("n").alias("hits"))


def running_numbers(events: DataFrame) -> DataFrame:
    """(run_id, seq, fn, file, line, number): state is one number a run. Events of one batch are numbered by
    seq where they carry it, else as they come. Needs the RocksDB state store."""

    class Counter(StatefulProcessor):
        """Numbers a run's events batch by batch; Spark hands over the rows of a run in the order of seq."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.count = handle.getValueState("count", "n long")

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
            n = self.count.get()[0] if self.count.exists() else 0
            for part in rows:
                out = part.assign(number=range(n + 1, n + 1 + len(part)))
                n += len(part)
                yield out[["run_id", "seq", "fn", "file", "line", "number"]]
            self.count.update((n,))

        def close(self) -> None:
            pass

    d = events.select("run_id", "seq", "fn", "file", "line")
    return d.groupBy("run_id").transformWithStateInPandas(Counter(), "run_id string, seq long, fn string, file string, line int, number long", "Append", "None")


def numbered_in_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for events with seq: (run_id, seq, fn, file, line, number), each batch's events
    in the order of seq behind those of the batches before. What is kept is one count a run, of the last
    two batches."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = Window.partitionBy("run_id").orderBy("seq")
        d = batch.select("run_id", "seq", "fn", "file", "line", F.row_number().over(run).cast("long").alias("k"))
        sizes = batch.groupBy("run_id").agg(F.count("*").alias("n"))
        if number:
            before = spark.read.schema("run_id string, n long").parquet(f"{path}/counts={number - 1}")
            d = d.join(before, "run_id", "left").withColumn("k", F.col("k") + F.coalesce("n", F.lit(0))).drop("n")
            sizes = sizes.unionByName(before).groupBy("run_id").agg(F.sum("n").alias("n"))
        d.withColumnRenamed("k", "number").write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        sizes.write.mode("overwrite").parquet(f"{path}/counts={number}")
        if number > 1:
            remove(spark, f"{path}/counts={number - 2}")

    return write


def latest_events(events: DataFrame) -> DataFrame:
    """(run_id, seq, fn, file, line) in update mode: each run's last event by seq; a row a run is the stream's state."""
    return events.groupBy("run_id").agg(F.max_by(F.struct("seq", "fn", "file", "line"), "seq").alias("e")).select("run_id", "e.*")


def routed(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for lines: events go to one folder and lines that are none, as they came, to another,
    both under the batch's number. The batch is read once and kept for the second."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            parse(kept).where("not bad").drop("bad", "value").write.mode("overwrite").parquet(f"{path}/events/batch={number}")
            malformed(kept).write.mode("overwrite").parquet(f"{path}/malformed/batch={number}")
        finally:
            kept.unpersist()

    return write


def record(lines: DataFrame, path: str, checkpoint: str) -> Any:
    """A started query that writes the raw lines to files, each once."""
    return lines.select("value").writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
