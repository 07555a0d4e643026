"""Operator 8, WARC: a PySpark Python data source that writes and reads WARC/1.1 archives.

Writing: every task writes one archive at a time into the target folder under a name of its own and
starts another at MAX_FILE_BYTES; only files of tasks that were committed are renamed into view, so a
task that runs again, or twice, leaves no second copy. Each record is a gzip member of its own that
carries its own length (the `sl` extra field), so that a reader can step over it.

Reading: partitions are planned over files by size, `.warc.gz` and `.warc`, in the folder or below it.
Predicates on the record type and on header columns are pushed down and tested on the parsed header; the
payload of a record that fails, and every payload when `payload` is false, is not decoded: members with a
length are stepped over without being inflated, plain records by their Content-Length, and other gzip
members, whose length only inflating tells, are inflated in pieces that are not kept. Header names are
read whatever their case. A record without an HTTP message (warcinfo, metadata, resource, ...) has its
block for a payload. Digests other than SHA-1 are read, not checked; page_id and refers_to are null where
ids are not of this writer's form. Headers may end their lines with a bare line feed. A chunked HTTP body is put
together, and held against the digest in either form; where payloads are not read its payload_bytes are those of the chunks.
A file is read by one task: gzip archives can only be read from their start, and plain ones go with them.

A record that is odd does not stop the read (unless the option `strict` is true, which raises): it comes with what
its header tells and an `error`: a payload that differs from its digest, a Content-Length that is no number, a record,
member or file that is cut off, bytes that are no record. Reading goes on at the next thing that looks like a record.

Defined results: a null payload is empty; a null record type is response; line breaks in a URL are
percent-encoded; a null URL, id or reference leaves its header out and is read as null; rows are
independent, so repeats repeat; extra columns of a written frame are refused by Spark's schema check.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from loomgraph.llm.common import new_path, stored, table

SCHEMA = "page_id long, record_type string, url string, payload_digest string, payload_bytes long, refers_to long, payload binary, error string"
HEADERS = ("page_id", "record_type", "url", "payload_digest", "payload_bytes", "refers_to")
MAX_FILE_BYTES = 64 << 20
PARTITION_BYTES = 32 << 20
ID = "urn:page:"
#: Long enough for the headers of nearly all records; a longer header is read on.
HEAD_BYTES = 4096
PIECE_BYTES = 1 << 16
_BLANK = re.compile(rb"\r?\n\r?\n")
_LINE = re.compile("\r?\n")
_CHUNK = re.compile(rb"(?:\r?\n)?([0-9A-Fa-f]{1,15})[^\r\n]*\r?\n")
#: What a record looks like: a gzip header, or a line that begins one.
_RECORD = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]|\nWARC/[01]\.")
#: Repeating digests, of about 100 bytes each, up to which they are broadcast.
BROADCAST_DIGESTS = 100_000
SALTS = 64


def _store(path: str) -> tuple[object, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in value)


def record(page_id: int | None, kind: str, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record: WARC header, HTTP header and, unless it is a revisit, the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {date}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <{ID}{page_id}>")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            lines.append(f"WARC-Refers-To: <{ID}{refers_to}>")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field `sl` says how long it is, packed and unpacked."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    whole = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + struct.pack("<IBB", 0, 0, 255) + struct.pack("<H2sHII", 12, b"sl", 8, whole & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _fields(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-case name; lines that go on with white space belong to the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _page(value: str | None) -> int | None:
    """The number in an id of this writer's form."""
    value = (value or "").strip("<>")
    number = value.removeprefix(ID)
    return int(number) if value.startswith(ID) and re.fullmatch(r"-?[0-9]+", number) else None


def _dechunked(body: bytes) -> bytes | None:
    """The body that chunks make up; None if they are not well-formed."""
    parts, at = [], 0
    while m := _CHUNK.match(body, at):
        n = int(m[1], 16)
        if not n:
            return b"".join(parts)
        if m.end() + n > len(body):
            return None
        parts.append(body[m.end() : m.end() + n])
        at = m.end() + n
    return None


def parse_header(text: bytes) -> tuple[dict, int, int] | None:
    """(columns, where the payload begins, where the block ends) of a record; None if its headers, or those
    of the HTTP message in it, go on beyond text. A length that is no number ends the block where it begins."""
    end = _BLANK.search(text)
    if end is None:
        return None
    fields = _fields(_LINE.split(text[: end.start()].decode("utf-8", "replace"))[1:])
    given = fields.get("content-length", "0")
    length = int(given) if given.isdecimal() and given.isascii() else 0
    start, stop = end.end(), end.end() + length
    size, chunked = length, False
    if fields.get("content-type", "").lower().replace(" ", "").startswith("application/http") and length:
        http_end = _BLANK.search(text, start, stop)
        if http_end is None and len(text) < stop:
            return None
        if http_end is not None:
            http = _fields(_LINE.split(text[start : http_end.start()].decode("latin-1"))[1:])
            start = http_end.end()
            size = stop - start
            chunked = "chunked" in http.get("transfer-encoding", "").lower()
            if fields.get("warc-type") == "revisit" and http.get("content-length", "").isdigit():
                size = int(http["content-length"])  # of the payload that it stands for
    digest_ = fields.get("warc-payload-digest", "")
    sha = digest_.split(":", 1)[1] if digest_.lower().startswith("sha1:") else digest_
    return {
        "page_id": _page(fields.get("warc-record-id")),
        "record_type": fields.get("warc-type"),
        "url": fields.get("warc-target-uri", "").strip("<>") or None,
        "payload_digest": sha or None,
        "payload_bytes": size,
        "refers_to": _page(fields.get("warc-refers-to")),
        "chunked": chunked,
        "error": None if given == "0" or length or set(given) == {"0"} else f"Content-Length is {given!r}",
    }, start, stop


def _with_payload(row: dict, payload: bytes) -> None:
    """Puts the payload into a row, held against a SHA-1 in base32."""
    whole = _dechunked(payload) if row["chunked"] else None
    row["payload"] = payload if whole is None else whole
    row["payload_bytes"] = len(row["payload"])
    sha = row["payload_digest"]
    if sha and re.fullmatch("[A-Z2-7]{32}", sha) and sha not in (digest(row["payload"]), digest(payload)):
        row["error"] = "payload and digest differ"


class _Member:
    """A gzip member read forward in pieces: from its start, or with its length from behind its header. broken says what
    is wrong with it, if anything."""

    def __init__(self, source: object, at: int, length: int = 0) -> None:
        self.source, self.end, self.left = source, at + (24 if length else 0), max(length - 24, 0)
        self.inflate = zlib.decompressobj(-15 if length else 31)
        self.sized, self.broken = bool(length), ""
        source.seek(self.end)

    def more(self) -> bytes:
        """Some further bytes; none at the end of the member."""
        while not self.inflate.eof and not self.broken:
            raw = self.source.read(min(PIECE_BYTES, self.left) if self.sized else PIECE_BYTES)
            if not raw:
                self.broken = "a gzip member is cut off"
                break
            self.left -= len(raw)
            try:
                out = self.inflate.decompress(raw)
            except zlib.error as e:
                self.broken = f"a gzip member is broken: {e}"
                break
            self.end += len(raw) - len(self.inflate.unused_data)
            if out:
                return out
        return b""


def _take(more: Callable[[], bytes], passes: Callable[[dict], bool], payload: bool) -> tuple[dict | None, int]:
    """(the record if it passes, its payload in it if that is wanted; its bytes) from pieces."""
    text = b""
    while (parsed := parse_header(text)) is None:
        piece = more()
        if not piece:
            return {"error": "no whole record header"}, 0
        text += piece
    row, start, stop = parsed
    if not passes(row):
        return None, stop
    if payload and row["record_type"] != "revisit" and not row["error"]:
        parts, have = [text], len(text)
        while have < stop:
            piece = more()
            if not piece:
                row["error"] = "the record is cut off"
                return row, stop
            parts.append(piece)
            have += len(piece)
        _with_payload(row, b"".join(parts)[start:stop])
    return row, stop


def _resumed(source: object, at: int, size: int) -> int:
    """Where from `at` on something looks like a record; size if nothing does."""
    while at < size:
        source.seek(at)
        piece = source.read(PIECE_BYTES)
        m = _RECORD.search(piece)
        if m:
            return at + m.start() + (m[0][:1] == b"\n")
        at += max(len(piece) - 8, 1) if len(piece) == PIECE_BYTES else size
    return size


def records(source: object, size: int, wanted: list, payload: bool, strict: bool = False) -> Iterator[dict]:
    """The records of an open archive that pass the tests; only theirs are decoded beyond the header. Odd ones have an error."""
    passes = lambda row: all(test(row) for test in wanted)
    at = 0
    while at < size:
        begin = at
        source.seek(at)
        head = source.read(64)
        if head[:2] == b"\x1f\x8b":
            length = struct.unpack("<I", head[16:20])[0] if head[:4] == b"\x1f\x8b\x08\x04" and head[12:14] == b"sl" and len(head) >= 20 else 0
            member_ = _Member(source, at, length)
            row, _ = _take(member_.more, passes, payload)
            if length:
                at += length
                if at > size:
                    member_.broken = member_.broken or "a gzip member is cut off"
            else:
                while member_.more():  # to its end, piece by piece
                    pass
                at = member_.end
            if member_.broken:
                if row is not None and (row["error"] or "payload" not in row):
                    row["error"] = member_.broken
                at = at if length and at <= size else _resumed(source, begin + 2, size)
        elif head.lstrip(b"\r\n")[:5] == b"WARC/":
            at += len(head) - len(head.lstrip(b"\r\n"))
            source.seek(at)
            row, stop = _take(lambda: source.read(HEAD_BYTES), passes, payload)
            odd = not stop or (row is not None and (row["error"] or "").startswith("Content-Length"))
            at = _resumed(source, at + 5, size) if odd else at + stop
            if at > size and row is not None and not row["error"]:
                row["error"] = "the record is cut off"
        elif not head.strip(b"\r\n\0"):
            at, row = at + len(head), None
        else:
            row, at = {"error": "no record"}, _resumed(source, at + 1, size)
        if row is not None and row["error"]:
            row["error"] = f"byte {begin}: {row['error']}"
            if strict:
                raise ValueError(row["error"])
            row = row if len(row) > 1 or passes(dict.fromkeys(HEADERS)) else None
        if row is not None:
            yield row


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, partition_bytes: int, strict: bool = False) -> None:
        self.path, self.payload, self.partition_bytes, self.strict = path, payload, partition_bytes, strict
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Tests on header columns are taken over; the others go back to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, EqualNullSafe, In, IsNotNull)):
                kind = "not null" if isinstance(f, IsNotNull) else "in"
                values = [] if isinstance(f, IsNotNull) else list(f.value) if isinstance(f, In) else [f.value]
                self.tests.append((column, kind, values))
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, at = _store(self.path)
        info = store.get_file_info(at)
        listed = [info] if info.is_file else store.get_file_info(fs.FileSelector(at, recursive=True))
        found = sorted((f.path, f.size) for f in listed if f.is_file and f.path.endswith((".warc.gz", ".warc")))
        out: list[Files] = []
        size = 0
        for path, n in found:
            if not out or size + n > self.partition_bytes:
                out.append(Files([]))
                size = 0
            out[-1].paths.append((path, n))
            size += n
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        wanted = [(lambda row, c=c, v=v: row[c] is not None) if kind == "not null" else (lambda row, c=c, v=v: row[c] in v) for c, kind, v in self.tests]
        names = [*HEADERS, "payload", "error"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

        for path, n in partition.paths:
            with store.open_input_file(path) as source:
                for row in records(source, n, wanted, self.payload, self.strict):
                    rows.append(row)
                    size += 200 + len(row.get("payload") or b"")
                    if size > 8 << 20:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, date: str, file_bytes: int) -> None:
        self.path, self.date, self.file_bytes, self.job = path, date, file_bytes, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        names: list[str] = []
        out, size = None, 0
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "record_type", "url", "refers_to", "payload")]
            for page, kind, url, refers, payload in zip(*(c.to_pylist() for c in columns), strict=True):
                data = member(record(page, kind or "response", url, payload or b"", refers, self.date))
                if out is None or size + len(data) > self.file_bytes:
                    if out is not None:
                        out.close()
                    names.append(uuid.uuid4().hex)
                    out, size = store.open_output_stream(f"{at}/_{self.job}-{names[-1]}.part", compression=None), 0
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _store(self.path)
        for name in (n for m in messages if m for n in m.names):
            store.move(f"{at}/_{self.job}-{name}.part", f"{at}/{name}.warc.gz")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Removes what tasks of this job that failed, or ran twice, have left."""
        from pyarrow import fs

        store, at = _store(self.path)
        for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if f.base_name.startswith(f"_{self.job}-"):
                store.delete_file(f.path)


class WarcSource(DataSource):
    """Format `warc`; options: path, payload (true), strict (false), date, file_bytes, partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true", int(self.options.get("partition_bytes", PARTITION_BYTES)), self.options.get("strict", "false").lower() == "true")

    def writer(self, schema: object, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("date", "2024-01-01T00:00:00Z"), int(self.options.get("file_bytes", MAX_FILE_BYTES)))


def register(spark: SparkSession) -> None:
    """Makes format("warc") known, and its predicate pushdown."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, record_type, url, refers_to, payload): of pages with equal payloads of at least
    least_bytes, that of largest page_id is the response and the others revisit it."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    again = d.where(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1")
    again = stored(again.select("sha", "last"), "payloads")
    # only payloads that repeat can be revisits: where their digests are too many to be broadcast they are
    # dealt in SALTS copies, so that a payload of a third of all pages is many tasks
    if again.count() <= BROADCAST_DIGESTS:
        d = d.join(F.broadcast(again), "sha", "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        d = d.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(again.withColumn("salt", salts), ["sha", "salt"], "left")
    revisit = F.coalesce((F.col("page_id").isNull() | (F.col("page_id") != F.col("last"))) & F.col("last").isNotNull() & (F.octet_length("payload") >= least_bytes), F.lit(False))
    return d.select("page_id", F.when(revisit, "revisit").otherwise("response").alias("record_type"), "url", F.when(revisit, F.col("last")).alias("refers_to"), "payload")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    register(pages.sparkSession)
    d = with_revisits(pages, least_bytes)
    d = d.select("page_id", "record_type", "url", F.lit(None).cast("string").alias("payload_digest"), F.lit(None).cast("long").alias("payload_bytes"), "refers_to", "payload", F.lit(None).cast("string").alias("error"))
    d.write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True, strict: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("strict", str(strict).lower()).load(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses are read with their payloads, which the reader holds against their digests; of revisits
    the headers tell all, so that no payload is decoded for them."""
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    got = read_archives(spark, path, strict=True).where("record_type = 'response'").unionByName(read_archives(spark, path, payload=False, strict=True).where("record_type = 'revisit'"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("stored_bytes"))
