"""Cutting lineage through the folder that all executors see, and removing what was written there."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths of the scopes that are open in this thread or task of asyncio, innermost last; and, by application, those
#: that no scope has.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("loomgraph_scopes", default=())
_unscoped: defaultdict[str, list[str]] = defaultdict(list)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a session in one local process gets a
    temporary one; a cluster has no folder of its own that all its machines see, so there it is an error."""
    conf, master = spark.conf, spark.sparkContext.master
    at = conf.get("spark.checkpoint.dir", None)
    if not at:
        if not master.startswith("local[") and master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-loomgraph-")
        conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str = "table", keep: bool = False) -> str:
    """A path of its own in the shared folder. It goes with the innermost scope; keep: with the one around that."""
    path = f"{shared_dir(spark)}/loomgraph-{name}-{uuid.uuid4().hex}"
    owners = [_unscoped[spark.sparkContext.applicationId], *_scopes.get()]
    owners[-2 if keep and len(owners) > 1 else -1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables cut inside by this thread, but for those to keep, are removed at its end."""
    own: list[str] = []
    before = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(before)
        for path in own:
            remove(spark, path)


def clear(spark: SparkSession) -> None:
    """Removes the tables that no scope has: results returned before can't be read any more."""
    for path in _unscoped.pop(spark.sparkContext.applicationId, []):
        remove(spark, path)


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """df written to the shared folder and read back: later steps plan over a table and not over all
    steps before, and a lost executor costs a read. keep: a result still to run reads it, so it
    outlives its scope."""
    spark = df.sparkSession
    path = new_path(spark, keep=keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
