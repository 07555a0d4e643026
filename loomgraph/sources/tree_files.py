"""A Python batch data source of source trees: one job, whatever the depth.

    register(spark)
    spark.read.format("source_tree").option("path", root).load()  # path, is_dir, size, content

Paths are relative to the root, which is "."; directories have null content and size. Pruned directories are not
entered, hidden and underscored names are in, links to directories are not followed and those to nothing are no files. A
directory or file that can't be read fails the job. Bytes that are no UTF-8 are replaced, in names too.

Planning lists the tree level by level, many directories at once, and packs files into partitions of about
`partition_bytes`. It stops at `plan_entries` entries: directories that are still unlisted then go to tasks as they are,
which walk them, so the driver's share has a bound. Tests on `path` (equality, start, end) and `is_dir` are pushed down:
a start or an equality leaves directories unlisted, and a file that fails a test is never opened.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, Not, StringEndsWith, StringStartsWith

from loomgraph.functions.paths import PRUNED_DIRECTORIES

PARTITION_BYTES = 64 << 20
PLAN_ENTRIES = 1 << 20
#: What opening a file counts for, in bytes.
OPEN_BYTES = 64 << 10
#: Bytes of content that one batch of rows holds, beside its last file.
BATCH_BYTES = 16 << 20
#: Partitions that unlisted directories are dealt to.
WALKS = 4096
LISTERS = 32
SCHEMA = "path string, is_dir boolean, size long, content string"

#: A path below the root as the store has it, whether it is a directory, its bytes.
Entry = tuple[str, bool, int]


class Tree:
    """A folder, local or in a store that pyarrow knows by its URI."""

    def __init__(self, root: str) -> None:
        from pyarrow import fs

        self.store, at = fs.FileSystem.from_uri(root) if ":/" in root else (fs.LocalFileSystem(), os.path.abspath(root))
        self.root, self.local = at.rstrip("/") or "/", isinstance(self.store, fs.LocalFileSystem)

    def _at(self, path: str) -> str:
        return self.root if path == "." else f"{self.root.rstrip('/')}/{path}"

    def entries(self, path: str) -> list[Entry]:
        from pyarrow import fs

        below = "" if path == "." else f"{path}/"
        if self.local:
            with os.scandir(self._at(path)) as found:
                out = [(below + e.name, d, 0 if d else e.stat().st_size) for e in found if (d := e.is_dir(follow_symlinks=False)) or e.is_file()]
        else:
            found = self.store.get_file_info(fs.FileSelector(self._at(path)))
            out = [(below + f.base_name, f.type == fs.FileType.Directory, f.size or 0) for f in found if f.type in (fs.FileType.Directory, fs.FileType.File)]
        return [e for e in out if not e[1] or e[0].rsplit("/", 1)[-1] not in PRUNED_DIRECTORIES]

    def content(self, path: str) -> str:
        if self.local:
            with open(self._at(path), "rb") as f:
                return f.read().decode("utf-8", "replace")
        with self.store.open_input_stream(self._at(path)) as f:
            return f.read().decode("utf-8", "replace")


def shown(path: str) -> str:
    """A name as it is in the table."""
    return path.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


@dataclass
class Tests:
    """What pushed-down tests say of a path; all must hold."""

    is_dir: list[bool] = field(default_factory=list)
    starts: list[str] = field(default_factory=list)
    ends: list[str] = field(default_factory=list)
    among: list[list[str]] = field(default_factory=list)

    def take(self, f: Filter) -> bool:
        """Whether the test is one that this takes over."""
        negated, f = (True, f.child) if isinstance(f, Not) else (False, f)
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if column == "is_dir" and isinstance(f, EqualTo) and isinstance(f.value, bool):
            self.is_dir.append(f.value != negated)
        elif negated or column != "path":
            return False
        elif isinstance(f, StringStartsWith):
            self.starts.append(f.value)
        elif isinstance(f, StringEndsWith):
            self.ends.append(f.value)
        elif isinstance(f, (EqualTo, In)):
            self.among.append(list(f.value) if isinstance(f, In) else [f.value])
        else:
            return False
        return True

    def passes(self, path: str, is_dir: bool) -> bool:
        p = shown(path)
        return all(is_dir == x for x in self.is_dir) and all(p.startswith(x) for x in self.starts) and all(p.endswith(x) for x in self.ends) and all(p in x for x in self.among)

    def enters(self, path: str) -> bool:
        """Whether something below a directory can pass."""
        if path == ".":
            return True
        p = f"{shown(path)}/"
        return all(p.startswith(x) or x.startswith(p) for x in self.starts) and all(any(v is not None and v.startswith(p) for v in x) for x in self.among)


@dataclass
class Part(InputPartition):
    entries: list[Entry]
    walks: list[str]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.plan_entries = int(options.get("plan_entries", PLAN_ENTRIES))
        self.tests = Tests()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if not self.tests.take(f):
                yield f

    def partitions(self) -> list[Part]:
        tree, found, level, seen = Tree(self.root), [(".", True, 0)], ["."], 1
        with ThreadPoolExecutor(LISTERS) as pool:
            while level and seen < self.plan_entries:
                now, level = level[: self.plan_entries], level[self.plan_entries :]
                for entries in pool.map(tree.entries, now):
                    seen += len(entries)
                    found += entries
                    level += [p for p, is_dir, _ in entries if is_dir and self.tests.enters(p)]
        parts: list[Part] = []
        size = 0
        for path, is_dir, n in sorted(e for e in found if self.tests.passes(e[0], e[1])):
            cost = OPEN_BYTES // 64 if is_dir else n + OPEN_BYTES
            if not parts or size + cost > self.partition_bytes:
                parts.append(Part([], []))
                size = 0
            parts[-1].entries.append((path, is_dir, n))
            size += cost
        step = -(-len(level) // WALKS) or 1
        return parts + [Part([], level[k : k + step]) for k in range(0, len(level), step)] or [Part([], [])]

    def _below(self, tree: Tree, path: str) -> Iterator[Entry]:
        todo = [path]
        while todo:
            for e in tree.entries(todo.pop()):
                if self.tests.passes(e[0], e[1]):
                    yield e
                if e[1] and self.tests.enters(e[0]):
                    todo.append(e[0])

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        tree, rows, size = Tree(self.root), [], 0

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.bool_(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["path", "is_dir", "size", "content"])

        def wanted() -> Iterator[Entry]:
            yield from partition.entries
            for w in partition.walks:
                yield from self._below(tree, w)

        for path, is_dir, n in wanted():
            rows.append((shown(path), is_dir, None if is_dir else n, None if is_dir else tree.content(path)))
            size += OPEN_BYTES // 64 if is_dir else len(rows[-1][3])
            if size > BATCH_BYTES:
                yield batch()
                rows, size = [], 0
        yield batch()


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> TreeReader:
        return TreeReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes format("source_tree") known, and its predicate pushdown."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)
