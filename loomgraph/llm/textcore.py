"""Vectorised word hashing over the UTF-8 buffer of an Arrow string column.

A word is a run of bytes other than 0x20 and 0x09-0x0D, after lower-casing A-Z. Its hash is a
polynomial over a random 64-bit value for each byte, taken from one running sum over the buffer,
so that the cost is a few numpy passes for each byte whatever the number of words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RANDOM = np.random.default_rng(20240229)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)[_LOWER] * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = int(_RANDOM.integers(1, 2**62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[int, np.ndarray] = {}

#: Bytes of text that are hashed at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64; kept, and doubled when too short."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1, 0 if have is None else 2 * len(have))
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the result depends on every bit of h."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def slices(batch: pa.RecordBatch, column: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about `most` bytes together; a longer text is one of its own, whole."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, first = np.cumsum(size), 0
    while first < batch.num_rows:
        before = upto[first - 1] if first else 0
        last = max(int(np.searchsorted(upto, before + most, "right")), first + 1)
        yield batch.slice(first, last - first)
        first = last


def lean(run: Callable) -> Callable:
    """run, a function over batches, which at its end gives freed Arrow memory back: a worker stays for other
    tasks, and beside it others need the room."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return out


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about CHUNK_BYTES; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + n + 1]
    buffer = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, buffer[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and one more) of the words of a chunk."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[inner] = word[inner]
    inner = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[inner] = word[inner]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray = _VALUE) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes, wherever they stand, hash alike."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    run = np.empty(len(data) + 1, np.uint64)
    run[0] = 0
    np.cumsum(value[data] * _power(_BASE, len(data)), out=run[1:])
    h = (run[ends] - run[starts]) * _power(_INVERSE, len(data))[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _STEP)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and one more)."""
    starts, ends, rows = spans(data, offsets)
    return hash_spans(data, starts, ends), rows


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 values have no meaning."""
    out = np.zeros(len(h), np.uint64)
    for j in range(min(k, len(h))):
        out[: len(h) - j] = out[: len(h) - j] * _STEP + h[j:]
    return mix(out ^ np.uint64(k))
