"""Operator 13, byte-level BPE encoding and decoding: merges by a rank queue over a hierarchical bitmap.

A text is cut into pre-tokens by the public pattern, and each is merged by itself: of all neighbouring pairs
whose bytes together are a token, that of the lowest rank is merged first, of equal ones the leftmost.
The queue has a bucket for each rank with the positions where a pair of that rank begins. Which buckets have
entries is a bitmap of words of _BITS bits, above it a bitmap of the words that are not zero, and so on up to
one word; find-first-set from the top down gives the lowest rank in as many steps as there are levels. Tokens
are a linked list over byte positions. Merging never moves bytes, so an entry (rank, position) holds if a pair
begins there and ends as many bytes later as the rank's token has; other entries are stale and are skipped. A
pre-token of n bytes takes O(n log n), which also suits very long ones. The new pre-tokens of a chunk of texts
share one queue, as no pair crosses their edges.

Cutting goes by classes of characters (letter, number, white space, other), which is the pattern's meaning
as array steps over a chunk. Equal pre-tokens, known by a 64-bit hash of their bytes, are merged once: a worker
remembers up to REMEMBERED of them and then starts anew. Ranks come from a public vocabulary file, whose path
is a parameter; nothing is trained. Texts beyond CHUNK_BYTES go in pieces that end before white space.

Defined results: a null or empty text has no ids and decodes to no bytes; texts are whole, however long; a
special token's string in a text is ordinary text; bytes of a text that are no UTF-8 count as U+FFFD; rows are
independent, so repeats repeat; null ids are skipped in decoding; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import textcore
from loomgraph.llm.common import table

#: Pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 1 << 19
_BITS = 256
_LETTER, _NUMBER, _SPACE = 1, 2, 3
# What the pattern takes with an apostrophe, and by how many characters.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
# Letters and numbers of Unicode 16, which the rank files' library knows and Python's tables do not yet.
SINCE = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x16139), (0x16D40, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FA))
_CUT = re.compile(rb"[A-Za-z0-9][ \n]")
_EXACT = textcore._RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class RankQueue:
    """Positions by rank; which ranks have some is told by a bitmap of levels."""

    def __init__(self, ranks: int) -> None:
        self.levels: list[list[int]] = []  # the lowest level first; the last has one word
        n = ranks
        while not self.levels or n > 1:
            n = -(-n // _BITS)
            self.levels.append([0] * max(n, 1))
        self.buckets: dict[int, list[int]] = {}

    def put(self, rank: int, positions: list[int]) -> None:
        """A bucket for a rank that has none."""
        self.buckets[rank] = positions
        at = rank
        for words in self.levels:
            at, bit = divmod(at, _BITS)
            had = words[at]
            words[at] = had | 1 << bit
            if had:  # the levels above have it already
                return

    def first(self) -> int:
        """The lowest rank that has a bucket, or -1."""
        at = 0
        for words in reversed(self.levels):
            word = words[at]
            if not word:
                return -1
            at = at * _BITS + (word & -word).bit_length() - 1
        return at

    def take(self, rank: int) -> list[int]:
        """The bucket of a rank, ascending; it is gone then."""
        at = rank
        for words in self.levels:
            at, bit = divmod(at, _BITS)
            words[at] &= ~(1 << bit)
            if words[at]:
                break
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return bucket


class Codec:
    """Ranks of a vocabulary and what decoding needs: a few MB, whatever the corpus."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks}

    @cached_property
    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens' bytes end to end, by id where each begins, and its length; -1 for ids that are none."""
        size = max(self.ranks.values(), default=-1) + 1
        text, first, length = [b""] * size, np.zeros(size, np.int64), np.full(size, -1, np.int64)
        for token, k in self.ranks.items():
            text[k], length[k] = token, len(token)
        first[1:] = np.cumsum(np.maximum(length, 0))[:-1]
        return np.frombuffer(b"".join(text), np.uint8), first, length

    @cached_property
    def pairs(self) -> np.ndarray:
        """The rank of every two bytes, or -1."""
        out = np.full(1 << 16, -1, np.int64)
        for token, k in self.ranks.items():
            if len(token) == 2:
                out[token[0] << 8 | token[1]] = k
        return out

    @cached_property
    def kinds(self) -> np.ndarray:
        """The class of every character; what later versions of Unicode add is none."""
        out = np.zeros(0x110000, np.uint8)
        since = {c for a, b in SINCE for c in range(a, b + 1)}
        every = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) != "Cn" or ord(c) in since)
        for kind, name in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
            out[[ord(c) for c in regex.findall(name, every)]] = kind
        return out

    @cached_property
    def encoder(self) -> Encoder:
        return Encoder(self)

    def merge(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, how many of each) of the pre-tokens of data; starts: where each begins."""
        ranks, n = self.ranks, len(data)
        length = self.pieces[2].tolist()
        queue = RankQueue(len(length))
        put, buckets = queue.put, queue.buckets
        ends = np.append(starts[1:], n)
        edge = np.zeros(n + 1, bool)
        edge[starts] = edge[n] = True
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        todo = np.ones(n, bool)  # bytes of pre-tokens that are no token as they stand
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a > 1 and data[a:b] in ranks:
                todo[a:b], after[a] = False, b
        raw = np.frombuffer(data, np.uint8).astype(np.int64)
        rank = np.where(todo[:-1] & ~edge[1:n], self.pairs[raw[:-1] << 8 | raw[1:]], -1) if n > 1 else np.zeros(0, np.int64)
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        cut = np.flatnonzero(np.diff(rank[at], prepend=-1))
        for r, some in zip(rank[at[cut]].tolist(), np.split(at, cut[1:]), strict=False):
            put(r, some.tolist())
        after, before, edge = after.tolist(), before.tolist(), edge.tolist()
        while (r := queue.first()) >= 0:
            bucket, size = queue.take(r), length[r]
            for k, p in enumerate(bucket):
                middle = after[p]
                if middle < 0 or edge[middle]:
                    continue  # stale
                end = after[middle]
                if end - p != size:
                    continue  # stale
                after[p], after[middle], low = end, -1, False
                before[end] = p
                if not edge[end]:
                    new = ranks.get(data[p : after[end]])
                    if new is not None:
                        if new in buckets:
                            buckets[new].append(p)
                        else:
                            put(new, [p])
                        low |= new < r
                if not edge[p]:
                    left = before[p]
                    new = ranks.get(data[left:end])
                    if new is not None:
                        if new in buckets:
                            buckets[new].append(left)
                        else:
                            put(new, [left])
                        low |= new < r
                if low:  # a lower rank comes first
                    if k + 1 < len(bucket):
                        put(r, bucket[k + 1 :])
                    break
        out, first, p = [], [], 0
        while p < n:
            if edge[p]:
                first.append(len(out))
            out.append(ranks[data[p : after[p]]])
            p = after[p]
        return np.array(out, np.int32), np.diff(np.array([*first, len(out)]))

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the tokens end to end, where each token's begin and, last, the end)."""
        flat, first, length = self.pieces
        if len(ids) and (ids.min() < 0 or ids.max() >= len(length) or length[ids].min() < 0):
            raise ValueError("an id that is no token's")
        n = length[ids]
        upto = np.concatenate([[0], np.cumsum(n)])
        return flat[np.repeat(first[ids] - upto[:-1], n) + np.arange(upto[-1])], upto


class Encoder:
    """Of one worker: encodes chunks of texts, and remembers pre-tokens."""

    def __init__(self, codec: Codec) -> None:
        self.codec = codec
        self._anew()

    def _anew(self) -> None:
        self.known: dict[int, int] = {}
        self.ids, self.first = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
        self.n_ids = 0

    def _remember(self, keys: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        k = len(self.known)
        while len(self.ids) < self.n_ids + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.first) < k + len(keys) + 1:
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.first[k + 1 : k + 1 + len(keys)] = self.n_ids + np.cumsum(count)
        self.n_ids += len(ids)
        self.known.update(zip(keys.tolist(), range(k, k + len(keys)), strict=True))

    def cuts(self, chars: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Which characters begin a pre-token; rows: those that begin a text."""
        kind = self.codec.kinds[chars]
        n = len(chars)
        head = np.zeros(n + 1, bool)
        head[rows] = head[n] = True
        run = head[:n].copy()
        run[1:] |= kind[1:] != kind[:-1]
        begins = run.copy()
        ends = np.append(run[1:], True)  # the last character of a run
        # the last white space before a text goes on: a space belongs to what follows, another stands alone
        last = np.flatnonzero((kind == _SPACE) & ends & ~head[1:])
        begins[last] = True
        begins[last[chars[last] == 32] + 1] = False
        mark = np.flatnonzero((chars == 39) & begins & ends & ~head[1:])
        mark = mark[kind[mark + 1] == _LETTER] if len(mark) else mark
        padded = np.concatenate([chars, np.zeros(2, chars.dtype)])
        for letters in CONTRACTIONS:
            hit = mark[padded[mark + 1] == ord(letters[0])]
            if len(letters) == 2:
                hit = hit[~head[hit + 2] & (padded[hit + 2] == ord(letters[1]))]
            begins[hit + 1] = False
            rest = hit + 1 + len(letters)
            begins[rest[rest < n]] = True
        return begins

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, first id of each row and one more) of texts in UTF-8."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        raw = data.tobytes()
        chars = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")
        place = np.zeros(len(chars) + 1, np.int64)
        np.cumsum(1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000), out=place[1:])
        full = offsets[:-1] < offsets[1:]
        starts = place[:-1][self.cuts(chars, np.searchsorted(place, offsets[:-1][full]))]
        ends = np.append(starts[1:], len(data))
        keys, where, inverse = np.unique(textcore.hash_spans(data, starts, ends, _EXACT), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._anew()
        new = np.array([k not in self.known for k in keys.tolist()])
        if new.any():
            some = where[new]
            size = ends[some] - starts[some]
            at = np.cumsum(size) - size
            self._remember(keys[new], *self.codec.merge(b"".join([raw[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]), at))
        entry = np.array([self.known[k] for k in keys.tolist()], np.int64)[inverse]
        count = self.first[entry + 1] - self.first[entry]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(self.first[entry] - upto[:-1], count) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(starts, offsets)]

    def encode_long(self, data: np.ndarray) -> np.ndarray:
        """Ids of one text, in pieces that end between a letter or digit and white space."""
        raw, out, first = data.tobytes(), [], 0
        while first < len(raw):
            cut = _CUT.search(raw, first + textcore.CHUNK_BYTES)
            last = cut.start() + 1 if cut else len(raw)
            out.append(self.encode(data[first:last], np.array([0, last - first]))[0])
            first = last
        return np.concatenate(out) if out else np.zeros(0, np.int32)


def load(path: str | None = None) -> Codec:
    """The codec of a file of lines (base64 of a token, rank); by default of the public multilingual one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    lines = (line.split() for line in Path(path).read_bytes().splitlines())
    ranks = {base64.b64decode(x[0]): int(x[1]) for x in lines if x}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a byte-level vocabulary has a token for each byte")
    return Codec(ranks)


def _valid(texts: pa.Array) -> pa.Array:
    """Texts with U+FFFD for what is no UTF-8."""
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        return pa.array([None if t is None else t.decode("utf-8", "replace") for t in texts.cast(pa.large_binary()).to_pylist()], pa.large_string())
    return texts


def _encode(shared: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value.encoder
        for batch in batches:
            for part in textcore.slices(batch, 1):
                for first, data, offsets in textcore.chunks(_valid(part.column(1))):
                    if len(offsets) == 2 and len(data) > textcore.CHUNK_BYTES:
                        ids = encoder.encode_long(data)
                        at = np.array([0, len(ids)])
                    else:
                        ids, at = encoder.encode(data, offsets)
                    packed = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * 4).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(first, len(at) - 1), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)), packed.cast(pa.binary())], ["id", "ids", "packed"])

    return run


def encode(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, packed) of every row: its ids as array<int>, and as little-endian unsigned 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = d.schema[0].dataType.simpleString()
    return d.mapInArrow(textcore.lean(_encode(shared)), f"id {kind}, ids array<int>, packed binary").withColumnRenamed("id", id_col)


def _decode(shared: object, at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 16):  # ids of a few rows at once
                part = batch.slice(k, 16)
                lists = [np.zeros(0, np.int64) if x.values is None else x.values.drop_null().to_numpy(zero_copy_only=False).astype(np.int64) for x in part.column(at)]
                back, upto = shared.value.decode(np.concatenate(lists))
                ends = upto[np.cumsum([0, *map(len, lists)])].tolist()
                data = back.tobytes()
                out = pa.array([data[a:b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([out if j == at else c for j, c in enumerate(part.columns)], ["bytes" if j == at else n for j, n in enumerate(part.schema.names)])

    return run


def decode(encoded: DataFrame, codec: Codec, ids_col: str = "ids") -> DataFrame:
    """Every row of encoded with `bytes`, what its ids stand for, in place of the ids. An id that no token has is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(codec)
    at = encoded.columns.index(ids_col)
    kinds = [f"`{'bytes' if j == at else f.name}` {'binary' if j == at else f.dataType.simpleString()}" for j, f in enumerate(encoded.schema)]
    return encoded.mapInArrow(textcore.lean(_decode(shared, at)), ", ".join(kinds))


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    codec = load(path)
    e = encode(table(spark, sf_dir, "documents"), codec)
    e = e.select("doc_id", (F.octet_length("packed") / 4).cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), "ids")
    return decode(e, codec).select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))
