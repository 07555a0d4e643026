"""Operator 6, SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces come from a public vocabulary file, whose path is a parameter; nothing is trained. The file's
scores are merge ranks and not log probabilities, so a piece's log score is by default Zipf's:
-ln(rank) - ln(sum of 1 / rank), in steps of 1 / 1024. `scores="file"` takes the file's as they stand.

No piece holds white space after another character, so the best segmentation of a text is that of its
segments (spaces and the word after them), which a worker encodes once and remembers. The distinct
new segments of a chunk go through the trie together: for each start position, one numpy step for
each byte of a piece. Very long segments and those with characters outside the vocabulary take the
same recursion one by one; such characters become byte pieces.

Defined results: a null or empty text has no pieces and decodes to an empty text; U+2581 in a text
is the white-space marker itself and decodes to a space; rows are independent, so repeats repeat;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import textcore
from loomgraph.llm.common import table

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Segments of up to so many bytes are encoded together.
TOGETHER = 64
#: Segments that a worker remembers before it starts anew.
REMEMBERED = 1 << 18
_EXACT = textcore._RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if key & 7 == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a model file; type 1 is normal, 6 a byte."""
    out = []
    for number, value in _fields(Path(path).read_bytes()):
        if number == 1:
            piece = dict(_fields(value))
            out.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, 1)))
    return out


def double_array(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value): child c of node s is t = base[s] + c where check[t] = s; value[t] is the
    id of the key that ends there, or -1. The root is 0."""
    tree: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for key, number in keys:
        node = 0
        for c in key:
            if c not in tree[node]:
                tree.append({})
                tree[node][c] = len(tree) - 1
            node = tree[node][c]
        ends[node] = number
    size = len(tree) * 2 + 1024
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0] = 0
    queue, begin = [(0, 0)], 1
    for node, slot in queue:
        codes = sorted(tree[node])
        if node in ends:
            value[slot] = ends[node]
        if not codes:
            continue
        at, taken, started = max(begin, codes[0] + 1), 0, begin
        while True:
            if at + 512 >= size:
                base, check, value = base + [0] * size, check + [-1] * size, value + [-1] * size
                size *= 2
            b = at - codes[0]
            if check[at] >= 0:
                taken += 1
            elif all(check[b + c] < 0 for c in codes):
                break
            at += 1
        if taken >= 0.9 * (at - started + 1):
            begin = at  # what lies before is nearly full, and is not searched again
        base[slot] = b
        for c in codes:
            check[b + c] = slot
            queue.append((tree[node][c], b + c))
    used = max(i for i in range(size) if check[i] >= 0) + 257
    pad = lambda x: np.array((x + [-1] * 257)[:used], np.int32)
    return pad(base), pad(check), pad(value)


@dataclass
class Codec:
    """Trie and tables of a vocabulary: about 2 MB, whatever the corpus."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    score: np.ndarray
    unknown: float
    byte_ids: np.ndarray
    text: list[bytes]
    alone: np.ndarray

    @cached_property
    def lists(self) -> tuple[list, list, list, list]:
        return self.base.tolist(), self.check.tolist(), self.value.tolist(), self.score.tolist()

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces' bytes end to end, where each begins, and its length."""
        n = np.array([len(t) for t in self.text])
        return np.frombuffer(b"".join(self.text), np.uint8), np.concatenate([[0], np.cumsum(n)[:-1]]), n

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("lists", "tables")}


def load(path: str = MODEL_FILE, scores: str = "zipf") -> Codec:
    pieces = read_pieces(path)
    normal = [i for i, p in enumerate(pieces) if p[2] == 1]
    if any(MARK in pieces[i][0].lstrip(MARK) for i in normal):
        raise ValueError("a piece holds white space after another character")
    alone = np.zeros(256, bool)  # control characters that no longer piece holds: a segment each
    alone[:32] = True
    alone[[ord(c) for i in normal if len(pieces[i][0]) > 1 for c in pieces[i][0] if c < " "]] = False
    if scores == "zipf":
        ranks = np.arange(1, len(normal) + 1)
        log = -np.log(ranks) - np.log((1 / ranks).sum())
    else:
        log = np.array([pieces[i][1] for i in normal], float)
    log = np.round(log * 1024) / 1024  # sums are exact, so equal segmentations tie whatever stands before them
    score = np.zeros(len(pieces))
    score[normal] = log
    byte_ids = np.full(256, -1, np.int32)
    for i, p in enumerate(pieces):
        if p[2] == 6:
            byte_ids[int(p[0][1:-1], 16)] = i
    text = [bytes([int(p[0][1:-1], 16)]) if p[2] == 6 else p[0].replace(MARK, " ").encode() if p[2] == 1 else b"" for p in pieces]
    base, check, value = double_array([(text[i], i) for i in normal])
    return Codec(base, check, value, score, float(log.min()) - UNKNOWN_PENALTY, byte_ids, text, alone)


def _char_length(first_byte: int) -> int:
    return 1 if first_byte < 0x80 else 2 if first_byte < 0xE0 else 3 if first_byte < 0xF0 else 4


def encode_one(codec: Codec, data: bytes) -> list[int]:
    """Ids of the best segmentation; of two equal ones that whose last pieces are longer."""
    base, check, value, score = codec.lists
    n = len(data)
    best, back, piece = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    at = 0
    while at < n:
        char, node, end, single = min(_char_length(data[at]), n - at), 0, at, False
        here = best[at]
        while end < n:
            t = base[node] + data[end]
            if check[t] != node or t == 0:
                break
            node, end = t, end + 1
            v = value[node]
            if v >= 0:
                single |= end - at == char
                if here + score[v] > best[end]:
                    best[end], back[end], piece[end] = here + score[v], at, v
        if not single and here + codec.unknown > best[at + char]:
            best[at + char], back[at + char], piece[at + char] = here + codec.unknown, at, -1
        at += char
    out: list[int] = []
    end = n
    while end:
        at = back[end]
        out += [piece[end]] if piece[end] >= 0 else codec.byte_ids[np.frombuffer(data[at:end], np.uint8)][::-1].tolist()
        end = at
    return out[::-1]


def encode_many(codec: Codec, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids end to end, how many of each segment, which segments hold an unknown character) for segments
    of up to TOGETHER bytes; all of them take each step of the recursion together."""
    n, width = len(starts), int(lengths.max(initial=0))
    best = np.full((n, width + 1), -np.inf)
    back, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
    best[:, 0] = 0
    unknown = np.zeros(n, bool)
    data = np.append(data, np.zeros(1, np.uint8))
    for s in range(width):
        rows = np.flatnonzero((lengths > s) & (best[:, s] > -np.inf))
        if not len(rows):
            continue
        first = data[starts[rows] + s]
        char = np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))
        single = np.zeros(n, bool)
        node, at, live = np.zeros(len(rows), np.int32), s, rows
        while len(live):
            t = codec.base[node] + data[starts[live] + at]
            ok = (codec.check[t] == node) & (t > 0)
            live, node, at = live[ok], t[ok], at + 1
            v = codec.value[node]
            hit = v >= 0
            r, v = live[hit], v[hit]
            new = best[r, s] + codec.score[v]
            better = new > best[r, at]
            r2, v2 = r[better], v[better]
            best[r2, at], back[r2, at], piece[r2, at] = new[better], s, v2
            single[r[at - s == _lengths_at(char, rows, r)]] = True
            go = lengths[live] > at
            live, node = live[go], node[go]
        lost = ~single[rows]
        unknown[rows[lost]] = True
    ids, places = [], []
    pos, rows = lengths.copy(), np.flatnonzero(~unknown & (lengths > 0))
    count = np.zeros(n, np.int64)
    while len(rows):
        ids.append(piece[rows, pos[rows]])
        places.append(rows)
        count[rows] += 1
        pos[rows] = back[rows, pos[rows]]
        rows = rows[pos[rows] > 0]
    if not ids:
        return np.zeros(0, np.int32), count, unknown
    flat, row = np.concatenate(ids), np.concatenate(places)
    order = np.lexsort((-np.arange(len(row)), row))  # the last pieces came first
    return flat[order], count, unknown


def _lengths_at(char: np.ndarray, rows: np.ndarray, some: np.ndarray) -> np.ndarray:
    return char[np.searchsorted(rows, some)]


class Encoder:
    """Of one task: encodes chunks, and remembers segments."""

    def __init__(self, codec: Codec) -> None:
        self.codec = codec
        self.known: dict[int, int] = {}
        self.ids, self.first = np.zeros(1 << 20, np.int32), np.zeros(1 << 16, np.int64)
        self.n_ids = 0

    def _remember(self, ids: np.ndarray, count: np.ndarray, keys: np.ndarray) -> None:
        while len(self.ids) < self.n_ids + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.first) < len(self.known) + len(keys) + 1:
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        k = len(self.known)
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.first[k + 1 : k + 1 + len(keys)] = self.n_ids + np.cumsum(count)
        self.n_ids += len(ids)
        self.known.update(zip(keys.tolist(), range(k, k + len(keys)), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, first id of each row and one more). Each row begins with a space, unless empty."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        space, control = data == 32, self.codec.alone[data]
        head = control | (space & np.concatenate([[True], ~space[:-1]]))
        head[1:] |= control[:-1]
        full = offsets[:-1] < offsets[1:]
        head[offsets[:-1][full]] = True
        starts = np.flatnonzero(head)
        ends = np.append(starts[1:], len(data))
        keys, where, inverse = np.unique(textcore.hash_spans(data, starts, ends, _EXACT), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.known, self.n_ids = {}, 0
        new = np.array([k not in self.known for k in keys.tolist()])
        for some in self._in_turn(where[new], ends - starts):
            key = inverse[some]
            length = (ends - starts)[some]
            if length[0] <= TOGETHER:
                ids, count, unknown = encode_many(self.codec, data, starts[some], length)
                self._remember(ids, count[~unknown], keys[key[~unknown]])
                some, key = some[unknown], key[unknown]
            for s, k in zip(some.tolist(), key.tolist(), strict=True):
                one = np.array(encode_one(self.codec, data[starts[s] : ends[s]].tobytes()), np.int32)
                self._remember(one, np.array([len(one)]), keys[[k]])
        entry = np.array([self.known[k] for k in keys.tolist()], np.int64)[inverse]
        count = self.first[entry + 1] - self.first[entry]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(self.first[entry] - upto[:-1], count) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(starts, offsets)]

    @staticmethod
    def _in_turn(segments: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
        """Segments of like length together."""
        n = lengths[segments]
        for low, high in ((0, 8), (8, 16), (16, 32), (32, TOGETHER), (TOGETHER, 1 << 62)):
            some = segments[(n > low) & (n <= high)]
            for k in range(0, len(some), 1 << 14):
                yield some[k : k + (1 << 14)]


def decode_bytes(codec: Codec, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the pieces end to end, where each piece's end)."""
    flat, first, length = codec.tables
    n = length[ids]
    upto = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat(first[ids] - upto[:-1], n) + np.arange(upto[-1])], upto


def _marked(texts: pa.Array) -> pa.Array:
    """Texts as they are segmented: marker characters as spaces, and a space before a text that isn't empty."""
    t = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), MARK, " ")
    spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), t, pa.scalar(" ", pa.large_string()))
    return pc.if_else(pc.equal(pc.binary_length(t), 0), t, spaced)


def _encode(shared: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for part in textcore.slices(batch, 1):
                texts = _marked(part.column(1))
                for first, data, offsets in textcore.chunks(texts):
                    ids, at = encoder.encode(data, offsets)
                    back, upto = decode_bytes(encoder.codec, ids)
                    whole = np.diff(upto[at]) == np.diff(offsets)
                    if len(back) == len(data):
                        wrong = np.concatenate([[0], np.cumsum(back != data)])
                        whole &= wrong[offsets[1:]] == wrong[offsets[:-1]]
                    n = len(offsets) - 1
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(first, n), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)), pa.array(whole)], ["id", "ids", "round_trip"])

    return run


def encode(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, round_trip) of every row; round_trip: whether decoding the ids gave the text again."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = d.schema[0].dataType.simpleString()
    return d.mapInArrow(textcore.lean(_encode(shared)), f"id {kind}, ids array<int>, round_trip boolean").withColumnRenamed("id", id_col)


def _decode(shared: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                back, _ = decode_bytes(shared.value, np.array([] if ids is None else [i for i in ids if i is not None], np.int64))
                texts.append(back.tobytes().removeprefix(b" ").decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return run


def decode(pieces: DataFrame, codec: Codec, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of (id, ids); bytes that are no UTF-8 become U+FFFD."""
    shared = pieces.sparkSession.sparkContext.broadcast(codec)
    d = pieces.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return d.mapInArrow(_decode(shared), f"id {d.schema[0].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str, model_file: str = MODEL_FILE) -> DataFrame:
    codec = load(model_file)
    low, high = int(codec.byte_ids.min()), int(codec.byte_ids.max())
    e = encode(table(spark, sf_dir, "documents"), codec)
    fallback = F.size(F.filter("ids", lambda i: (i >= low) & (i <= high)))
    return e.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), fallback.cast("long").alias("n_byte_pieces"), F.xxhash64("ids").alias("pieces_hash"), "round_trip")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, model_file: str = MODEL_FILE) -> DataFrame:
    """The ids of every document that is left, as often as it is left."""
    e = encode(docs, load(model_file))
    return e.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "round_trip")
