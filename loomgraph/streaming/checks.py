"""Streams run to their end: a trace is written as JSON lines, a folder a run, and read back as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.trace import parse
from loomgraph.sources.shared import new_path
from loomgraph.streaming import growing, live

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _path(df: DataFrame) -> str:
    return new_path(df.sparkSession, "stream")


def _lines(trace: DataFrame) -> DataFrame:
    args = ["args"] if "args" in trace.columns else []
    return trace.select(F.to_json(F.struct("fn", "file", "line", "seq", *args)).alias("value"), F.col("run_id").cast("string").alias("run_id"))


def _stream(trace: DataFrame, files_per_batch: int = 1000) -> DataFrame:
    path = _path(trace)
    _lines(trace.repartition("run_id").sortWithinPartitions("run_id", "seq")).write.partitionBy("run_id").text(path)
    return live.read_lines(trace.sparkSession, path, files_per_batch)


def _finish(stream: DataFrame, batch: Callable) -> int:
    """Runs the stream to its end; the number of its last batch."""
    q = stream.writeStream.option("checkpointLocation", _path(stream)).foreachBatch(batch).trigger(availableNow=True).start()
    q.awaitTermination()
    return q.lastProgress["batchId"] if q.lastProgress else -1


def _appended(stream: DataFrame) -> DataFrame:
    """The rows that an appending stream has written once its input is read."""
    path = _path(stream)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    _finish(stream, write)
    return stream.sparkSession.read.schema(stream.schema).parquet(path).select(*stream.columns)


def _upserted(stream: DataFrame, keys: list[str], schema: str, compact_every: int = 32) -> DataFrame:
    """The table that a stream in update mode has come to."""
    path = _path(stream)
    write = live.upserting(path, keys, schema, compact_every=compact_every)
    q = stream.writeStream.outputMode("update").option("checkpointLocation", _path(stream)).foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    return live.upserted(stream.sparkSession, path, keys, schema)


def live_events(trace: DataFrame) -> DataFrame:
    return _appended(live.events_of(_stream(trace)).select("run_id", "fn", "file", "line"))


def growing_events(trace: DataFrame) -> DataFrame:
    """live_events of the same lines in one growing file a run, by the data source that follows such files."""
    spark, path = trace.sparkSession, _path(trace)
    growing.register(spark)
    _lines(trace.repartition("run_id").sortWithinPartitions("run_id", "seq")).write.partitionBy("run_id").text(path)
    stream = spark.readStream.format("growing_lines").option("path", path).load()
    return _appended(live.events_of(stream).select("run_id", "fn", "file", "line"))


def message_events(trace: DataFrame) -> DataFrame:
    """live_events of the same lines as messages, a run a key."""
    spark, path = trace.sparkSession, _path(trace)
    _lines(trace).select(F.encode("run_id", "UTF-8").alias("key"), F.encode("value", "UTF-8").alias("value")).write.parquet(path)
    stream = live.lines_of_messages(spark.readStream.schema("key binary, value binary").option("maxFilesPerTrigger", 3).parquet(path))
    return _appended(live.events_of(stream).select("run_id", "fn", "file", "line"))


def routed_lines(trace: DataFrame, documents: DataFrame) -> DataFrame:
    """(kind, value) out of the two sinks of one stream: events as fn, file and line, and the lines that are none
    as they came. The documents' lines are such lines; they arrive beside the trace's in files of their own."""
    spark, path, out = trace.sparkSession, _path(trace), _path(trace)
    _lines(trace).write.partitionBy("run_id").text(path)
    documents.select("text", F.lit("documents").alias("run_id")).write.partitionBy("run_id").mode("append").text(path)
    _finish(live.read_lines(spark, path, 3), live.routed(out))
    events = spark.read.schema("fn string, file string, line int").parquet(f"{out}/events")
    events = events.select(F.lit("event").alias("kind"), F.concat_ws("|", "fn", "file", "line").alias("value"))
    return events.unionByName(spark.read.schema("value string").parquet(f"{out}/malformed").select(F.lit("malformed").alias("kind"), "value"))


def hits(trace: DataFrame, nodes: DataFrame, compact_every: int = 32) -> DataFrame:
    """(id, hits) that a trace's stream has come to."""
    counts = _upserted(live.running_hits(live.events_of(_stream(trace, 3))), live.HIT_KEYS, live.HIT_SCHEMA, compact_every)
    return live.hits_of(counts, nodes)


def numbers(trace: DataFrame) -> DataFrame:
    """(run_id, seq, number): each run's events with their numbers."""
    stream = live.events_of(_stream(trace, 3))
    path = _path(trace)
    _finish(stream, live.numbered_in_batches(path))
    return trace.sparkSession.read.schema("run_id string, seq long, fn string, file string, line int, number long").parquet(f"{path}/rows").select("run_id", "seq", "number")


def state_numbers(trace: DataFrame) -> DataFrame:
    """(run_id, n, last): the same by arbitrary state: how many events each run has numbered, and the last number.
    The state store is set in a session of the stream's own."""
    spark = trace.sparkSession.newSession()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    path = _path(trace)
    _lines(trace.repartition("run_id").sortWithinPartitions("run_id", "seq")).write.partitionBy("run_id").text(path)
    out = _appended(live.running_numbers(live.events_of(live.read_lines(spark, path))))
    return out.groupBy("run_id").agg(F.count("*").alias("n"), F.max("number").alias("last"))


def latest(trace: DataFrame) -> DataFrame:
    """Each run's last event."""
    return _upserted(live.latest_events(live.events_of(_stream(trace, 3))), live.LAST_KEYS, live.LAST_SCHEMA)


def recorded(trace: DataFrame) -> DataFrame:
    """The lines of a trace after they went through the recording sink, read back as a recorded trace."""
    path = _path(trace)
    live.record(_stream(trace), path, _path(trace)).awaitTermination()
    return parse(trace.sparkSession.read.text(path)).select("seq", "fn", "file", "line")
