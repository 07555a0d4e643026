"""A Python streaming data source of lines appended to files, by any number of producers.

    register(spark)
    spark.readStream.format("growing_lines").option("path", folder).load()  # value string, run_id string

An offset is how many bytes of each file are read, up to the end of its last whole line; a batch's partitions are the
ranges between two offsets, of about partition_bytes each. A line goes to the range that it begins in. Offsets
are in the query's checkpoint, so a restarted query goes on where it stopped. A file's run is named as by
`live.read_lines`. Files are only ever appended to; one that gets shorter is an error. An offset has an entry for
each file of the folder, read or not, so a folder should hold the runs of a time and not of all times.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PARTITION_BYTES = 32 << 20
#: Bytes of a file's end that are looked at for its last line break at once.
TAIL = 1 << 16
HIDDEN = ("_", ".")


def _store(path: str) -> tuple:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


class Range(InputPartition):
    def __init__(self, file: str, first: int, last: int) -> None:
        self.file, self.first, self.last = file, first, last


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def _whole(self, store: object, file: str, size: int) -> int:
        """Where the file's last whole line ends."""
        with store.open_input_file(file) as f:
            end = size
            while end > 0:
                first = max(0, end - TAIL)
                f.seek(first)
                at = f.read(end - first).rfind(b"\n")
                if at >= 0:
                    return first + at + 1
                end = first
        return 0

    def latestOffset(self) -> dict:  # noqa: N802
        from pyarrow import fs

        store, root = _store(self.path)
        out = {}
        for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            hidden = any(p.startswith(HIDDEN) for p in f.path[len(root) :].split("/"))
            if f.type == fs.FileType.File and not hidden:
                out[f.path] = self._whole(store, f.path, f.size)
        return {"files": json.dumps(out, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, out = json.loads(start["files"]), []
        for file, last in json.loads(end["files"]).items():
            first = before.get(file, 0)
            if last < first:
                raise ValueError(f"{file} has become shorter: {first} bytes of it were read, now it has {last}")
            out += [Range(file, k, min(k + self.bytes, last)) for k in range(first, last, self.bytes)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        store, _ = _store(self.path)
        named = re.search(r"/run_id=([^/]*)/", partition.file)
        run = named[1] if named else partition.file.rsplit("/", 1)[-1]
        with store.open_input_file(partition.file) as f:
            at = max(partition.first - 1, 0)
            f.seek(at)
            rest, begun = b"", partition.first == 0  # whether a line begins at `at`
            while True:
                block = f.read(1 << 20)
                if not block:
                    return
                lines = (rest + block).split(b"\n")
                rest = lines.pop()
                for line in lines:
                    if begun and at >= partition.last:
                        return
                    if begun:
                        yield line.removesuffix(b"\r").decode("utf-8", "replace"), run
                    at, begun = at + len(line) + 1, True
                if begun and at >= partition.last:
                    return

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "value string, run_id string"

    def streamReader(self, schema: object) -> GrowingReader:  # noqa: N802
        return GrowingReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingLines)
