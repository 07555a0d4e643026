"""Operator 10, LM scoring: an interpolated modified Kneser-Ney n-gram model of order 2 or 3, counted in Spark.

Words are 64-bit hashes, and numbers once the vocabulary is known. Four counting steps, each a pass or a
shuffle of blocks (packed arrays of many counts in one row, about 6 bytes a trigram on the wire):

1. words: counts by hash range; a word's number is its place in the order of hashes;
2. n-grams (u, v, w), or (v, w) at order 2, dealt by the range of v, so that the counts of u v w, the
   totals of its context u v and the left words of v w all meet in one bucket; the few words v that make
   up over 1/4096 of all tokens are dealt by u too;
3. of those few, the left words of v w are added up once more;
4. left words of single words; with all totals they become one vocabulary file a bucket.

Every n-gram is padded with order - 1 begin marks. Counts of the highest order are raw, those below are
numbers of different left words, and the lowest level backs off to 1 / (V + 1). The number of buckets
follows the bytes of text, BUCKET_BYTES each, so that what one task holds does not grow with the input.

The model is sorted arrays in the shared folder. Scoring tasks memory-map them; a batch looks its distinct
n-grams up in sorted order, so that reads walk the files forward. What the driver holds are sums, a number
a bucket and the hot words (4097 at most). A bucket is four files, of which a worker keeps a bounded number mapped
(`shared_files.MOST_MAPS`); a file that is lost is an error and not a table without entries. An n-gram is known by its bucket and 40 bits of its hash: one
that was never seen is taken for a seen one in about 4 of a million lookups (a bucket's entries / 2**40).

Defined results: a null or empty text is the end token alone; a null id counts as training; repeated
rows count and score each; with no training text every token has the uniform probability 1 / (V + 1);
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import textcore
from loomgraph.llm.common import new_path, scope, stored, table
from loomgraph.llm.shared_files import mapped, write_arrays

ORDER = 3
BEGIN, END = np.uint64(0x5BD1E995_00000001), np.uint64(0x5BD1E995_00000003)
#: A word with over 1 / HOT of all tokens has its n-grams dealt by their other word too.
HOT = 4096
SPREAD = 64
#: Bytes of text a bucket, and tokens that a task gathers before it counts and sends them; three words
#: of so many tokens make one 64-bit number.
BUCKET_BYTES = 16 << 20
FLUSH = 2_000_000
#: Tokens that are scored together.
SCORED = 500_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@dataclass
class Model:
    """Where the arrays lie, and the sums that every score needs."""

    path: str
    order: int
    buckets: int
    tokens: int = 0
    words: int = 0
    #: Number of the first word of each bucket.
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    #: Discounts for counts 0, 1, 2, 3 or more, by order from 1.
    discounts: list[np.ndarray] = field(default_factory=list)
    pair_types: int = 0
    left_over: float = 1.0
    #: Number of the begin mark.
    begin: int = -1
    #: Of each kind of table which buckets have one; any other file that is not there is an error.
    wrote: dict[str, np.ndarray] = field(default_factory=dict)

    def file(self, kind: str, b: int) -> dict[str, np.ndarray] | None:
        """A bucket's arrays of a kind: words, vocabulary, grams or hot pairs."""
        return mapped(f"{self.path}/{kind}-{b}") if kind in self.wrote and self.wrote[kind][b] else None


def held_out(id_col: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def tokens_of(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, w, first token of each row and one more): each row's words and one end as w, with the two before."""
    n = len(rows) - 1
    at = rows + np.arange(n + 1)
    w = np.empty(len(h) + n, np.uint64)
    is_end = np.zeros(len(w), bool)
    is_end[at[1:] - 1] = True
    w[is_end] = END
    w[~is_end] = h
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[at[:-1]] = BEGIN
    u = np.empty_like(w)
    u[1:] = v[:-1]
    u[at[:-1]] = BEGIN
    return u, v, w, at


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hash, so that files in order hold sorted hashes."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def is_hot(model: Model, v: np.ndarray) -> np.ndarray:
    return model.hot[np.minimum(np.searchsorted(model.hot, v), len(model.hot) - 1)] == v if len(model.hot) else np.zeros(len(v), bool)


def dealt(model: Model, v: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Bucket of an n-gram by its word v, of a hot one by the other word's hash too."""
    b = bucket_of(v, model.buckets)
    hot = is_hot(model, v)
    b[hot] = (b[hot] + (textcore.mix(other[hot]) % np.uint64(SPREAD)).astype(np.int64)) % model.buckets
    return b


def key_of(*numbers: np.ndarray) -> np.ndarray:
    """40 bits for an n-gram of word numbers, as the upper bits."""
    h = np.zeros(len(numbers[0]), np.uint64)
    for x, m in zip(numbers, (_A, _B, _C), strict=False):
        h = textcore.mix(h * m + x.astype(np.uint64) + np.uint64(len(numbers)))
    return h & ~np.uint64((1 << 24) - 1)


def small(values: np.ndarray) -> np.ndarray:
    """In the narrowest unsigned type that holds them."""
    top = int(values.max()) if len(values) else 0
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def packed(values: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed: narrow and repeating ones cost little."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, 8 * n, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel().astype(np.int64)


def _runs(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, its rows) of rows sorted by bucket."""
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[a]), slice(int(a), int(b))


def in_order(columns: list[np.ndarray]) -> np.ndarray:
    """Places of rows of numbers in their order: by one 64-bit number where that holds them, as it does
    for the words of a bucket, else column by column."""
    code, room = None, 1
    for k, c in enumerate(columns):
        if k == 0 and len(columns) > 1:
            c = np.unique(c, return_inverse=True)[1].ravel()  # few words v a bucket
        low = int(c.min())
        span = int(c.max()) - low + 1
        room *= span
        if room >= 1 << 64:
            return np.lexsort(columns[::-1])
        c = (c - np.asarray(low, c.dtype)).astype(np.uint64)
        code = c if code is None else code * np.uint64(span) + c
    return np.argsort(code)


def grouped(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of numbers in order, with their counts added up."""
    if not len(counts):
        return columns, counts
    order = in_order(columns)
    columns = [c[order] for c in columns]
    new = np.ones(len(counts), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.add.reduceat(counts[order], first)


def profile(groups: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(total, ones, twos, more) of the counts of each group; rows are sorted by group, numbered from 0."""
    n = int(groups[-1]) + 1 if len(groups) else 0
    return np.stack([np.bincount(groups, x, n).astype(np.int64) for x in (counts, counts == 1, counts == 2, counts >= 3)], 1)


def shifted(places: np.ndarray, mark: int, u: np.ndarray, v: np.ndarray, find: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Places of u and v from those of w, of which they are the words before; where a text is cut the first are found anew."""
    vi = np.empty_like(places)
    vi[1:] = places[:-1]
    vi[:1] = find(v[:1])
    vi[v == BEGIN] = mark
    ui = np.empty_like(places)
    ui[1:] = vi[:-1]
    ui[:1] = find(u[:1])
    ui[u == BEGIN] = mark
    return ui, vi


def of_counts(counts: np.ndarray) -> np.ndarray:
    """How many things were seen once to four times."""
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].astype(np.int64)


def discounts(of: np.ndarray) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more from the numbers of things seen
    1 to 4 times; the usual fixed ones where those numbers give none."""
    n1, n2, n3, n4 = (float(x) for x in of)
    if min(n1, n2, n3, n4) <= 0:
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def _tokens_in(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """u, v, w of many chunks together, FLUSH tokens at most at once."""
    some: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        for _, data, offsets in textcore.chunks(batch.column(0)):
            found = tokens_of(*textcore.words(data, offsets))[:3]
            for k in range(0, len(found[0]), FLUSH):
                part = tuple(x[k : k + FLUSH] for x in found)
                if size + len(part[0]) > FLUSH:
                    yield [np.concatenate(x) for x in zip(*some, strict=True)]
                    some, size = [], 0
                some.append(part)
                size += len(part[0])
    if some:
        yield [np.concatenate(x) for x in zip(*some, strict=True)]


def _row(bucket: int, n: int, **arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([n], pa.int64()), *[pa.array([packed(a)], pa.binary()) for a in arrays.values()]], ["bucket", "n", *arrays])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(bucket, its columns) from rows (bucket, n, packed column, ...) in the order of buckets."""
    bucket, held = None, []
    for batch in batches:
        for b, n, *blobs in zip(*[batch.column(k).to_pylist() for k in range(batch.num_columns)], strict=True):
            if bucket is not None and b != bucket:
                yield bucket, [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            bucket = b
            held.append([unpacked(x, n) for x in blobs])
    if bucket is not None:
        yield bucket, [np.concatenate(x) for x in zip(*held, strict=True)]


def _by_bucket(d: DataFrame, buckets: int) -> DataFrame:
    """Each bucket whole in one task, which takes its buckets one after another."""
    return d.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")


# 1. words


def _word_blocks(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, w in _tokens_in(batches):
            h, c = np.unique(np.append(w, BEGIN), return_counts=True)
            c[np.searchsorted(h, BEGIN)] -= 1  # the begin mark has a number and no count
            for b, at in _runs(bucket_of(h, model.buckets)):
                yield _row(b, at.stop - at.start, h=h[at], c=c[at])

    return run


def _write_words(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (h, c) in _gathered(batches):
            (h,), c = grouped([h.view(np.uint64)], c)
            write_arrays(f"{model.path}/words-{b}", {"word": h, "count": small(c)})
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (b, len(h), int(c.sum()))], ["bucket", "types", "tokens"])

    return run


def _hot_words(model: Model) -> Callable:
    """(word) of more than 1 / HOT of all tokens: under HOT rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                words = model.file("words", b)
                if words is not None:
                    h = np.asarray(words["word"][np.flatnonzero(words["count"].astype(np.int64) * HOT > model.tokens)])
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return run


def numbers_of(model: Model, h: np.ndarray) -> np.ndarray:
    """Numbers of sorted hashes; -1 for unknown words."""
    out = np.full(len(h), -1, np.int64)
    for b, at in _runs(bucket_of(h, model.buckets)):
        held = model.file("words", b)
        if held is not None:
            words = held["word"]
            k = np.minimum(np.searchsorted(words, h[at]), len(words) - 1)
            out[at] = np.where(words[k] == h[at], model.first[b] + k, -1)
    return out


# 2. n-grams


def _gram_blocks(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, v, w in _tokens_in(batches):
            words, wi = np.unique(np.concatenate([w, [BEGIN], u[:1], v[:1]]), return_inverse=True)
            n = np.uint64(len(words))
            find = lambda x, words=words: np.searchsorted(words, x)
            wi = wi[: len(w)]
            ui, vi = shifted(wi, int(find(BEGIN)), u, v, find)
            ranks = [x.astype(np.uint64) for x in ((vi, ui, wi) if model.order == 3 else (vi, wi))]
            code = ranks[0]
            for r in ranks[1:]:
                code = code * n + r
            code, count = np.unique(code, return_counts=True)
            found = []
            for _ in ranks[1:]:
                found.append((code % n).astype(np.int64))
                code = code // n
            found.append(code.astype(np.int64))
            own = found[::-1]  # v, then u and w, or w
            bucket = dealt(model, words[own[0]], words[own[1]])
            order = np.argsort(bucket, kind="stable")
            number = numbers_of(model, words)
            columns = [number[x[order]] for x in own]
            count, bucket = count[order], bucket[order]
            for b, at in _runs(bucket):
                steps = np.diff(columns[0][at], prepend=0)  # v in order: small steps
                others = dict(zip(("u", "w"), columns[1:], strict=False)) if model.order == 3 else {"w": columns[1]}
                yield _row(b, at.stop - at.start, v=steps, **{k: x[at] for k, x in others.items()}, c=count[at])

    return run


def _gathered_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """As _gathered, with v summed up again in each row."""

    def summed() -> Iterator[tuple[int, list[np.ndarray]]]:
        for batch in batches:
            for b, n, v, *blobs in zip(*[batch.column(k).to_pylist() for k in range(batch.num_columns)], strict=True):
                yield b, [np.cumsum(unpacked(v, n)), *(unpacked(x, n) for x in blobs)]

    bucket, held = None, []
    for b, columns in summed():
        if bucket is not None and b != bucket:
            yield bucket, [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        bucket = b
        held.append(columns)
    if bucket is not None:
        yield bucket, [np.concatenate(x) for x in zip(*held, strict=True)]


def _table(name: str, key: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted 40-bit keys with a count each; counts from 255 on lie beside."""
    big = count >= 255
    order = np.argsort(key[big])
    whole = np.sort(key | np.minimum(count, 255).astype(np.uint64))
    out = {"bigkey": key[big][order], "bigcount": count[big][order], "high": (whole >> np.uint64(32)).astype(np.uint32)}
    out |= {"low": ((whole >> np.uint64(24)) & np.uint64(255)).astype(np.uint8), "count": (whole & np.uint64(255)).astype(np.uint8)}
    return {f"{name}-{k}": v for k, v in out.items()}


def _contexts(key: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted 40-bit keys with the place of their row among the distinct ones."""
    order = np.argsort(key)
    distinct, code = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
    key, code = key[order], code.ravel()[order]
    out = {"high": (key >> np.uint64(32)).astype(np.uint32), "low": ((key >> np.uint64(24)) & np.uint64(255)).astype(np.uint8)}
    return {f"context-{k}": v for k, v in (out | {"code": small(code), "rows": distinct.astype(np.int64)}).items()}


_STATS = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_STATS_TYPE = "kind string, bucket int, n long, a binary, b binary, c binary"


def _stat(kind: str, bucket: int, *columns: np.ndarray) -> dict:
    blobs = [packed(c) for c in columns]
    return {"kind": kind, "bucket": bucket, "n": len(columns[0]), **dict(zip("abc", blobs, strict=False))}


def _wrote(kind: str, bucket: int) -> dict:
    return {"kind": f"wrote {kind}", "bucket": bucket, "n": 0}


def _bucket_of_number(model: Model, numbers: np.ndarray) -> np.ndarray:
    return np.searchsorted(model.first, numbers, "right") - 1


def _spread(model: Model, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Bucket of pairs of numbers of which v is hot."""
    return (_bucket_of_number(model, v) + (textcore.mix(w.astype(np.uint64)) % np.uint64(SPREAD)).astype(np.int64)) % model.buckets


def _pairs(model: Model, v: np.ndarray, w: np.ndarray, count: np.ndarray, hot: np.ndarray) -> tuple[dict[str, np.ndarray], list[dict]]:
    """A bucket's pairs, distinct and sorted by v, as a table, and what the vocabulary needs of them."""
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    left, rows = v[new], profile(np.cumsum(new) - 1, count)
    # every pair of these left words is here
    arrays = _table("pair", key_of(v, w), count) | {"left": left[~hot[new]], "totals": rows[~hot[new]]}
    stats = [_stat("of2", 0, of_counts(count))]
    if hot[new].any():
        stats.append(_stat("hot", 0, left[hot[new]], rows[hot[new]].ravel()))
    seen, n = np.unique(w, return_counts=True)
    for to, at in _runs(_bucket_of_number(model, seen)):
        stats.append(_stat("left words", to, seen[at], n[at]))
    return arrays, stats


def _write_grams(model: Model) -> Callable:
    """A bucket's n-grams as tables; yields what the other steps gather."""
    hot_numbers = np.sort(numbers_of(model, model.hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, columns in _gathered_grams(batches):
            *words, count = columns
            words, count = grouped(words, count)
            out: list[dict] = [_wrote("grams", b)]
            arrays: dict[str, np.ndarray] = {}
            v = words[0]
            hot = np.isin(v, hot_numbers)
            if model.order == 3:
                u, w = words[1:]
                arrays |= _table("triple", key_of(u, v, w), count)
                out.append(_stat("of3", 0, of_counts(count)))
                new = np.ones(len(v), bool)
                new[1:] = (v[1:] != v[:-1]) | (u[1:] != u[:-1])
                rows = profile(np.cumsum(new) - 1, count)
                keep = (rows[:, 0] > 1) | (v[new] == model.begin)  # a context met once is known by its pair
                arrays |= _contexts(key_of(u[new], v[new])[keep], rows[keep])
                (v, w), count = grouped([v, w], np.ones(len(v), np.int64))
                hot = np.isin(v, hot_numbers)
                to = _spread(model, v[hot], w[hot])
                order = np.argsort(to, kind="stable")
                for k, at in _runs(to[order]):
                    out.append(_stat("pairs", k, *(x[hot][order][at] for x in (v, w, count))))
                v, w, count, hot = v[~hot], w[~hot], count[~hot], hot[~hot]
            else:
                w = words[1]
            pairs, stats = _pairs(model, v, w, count, hot)
            write_arrays(f"{model.path}/grams-{b}", arrays | pairs)
            out += stats
            yield pa.RecordBatch.from_pylist(out, _STATS)

    return run


def _write_hot_pairs(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (v, w, count) in _gathered(batches):
            (v, w), count = grouped([v, w], count)
            pairs, stats = _pairs(model, v, w, count, np.ones(len(v), bool))
            write_arrays(f"{model.path}/hot-{b}", pairs)
            yield pa.RecordBatch.from_pylist([_wrote("hot", b), *stats], _STATS)

    return run


def _write_vocabulary(model: Model, hot_totals: np.ndarray) -> Callable:
    """For each word of a bucket (count, left words seen before it, its totals as a context)."""
    hot_numbers = numbers_of(model, model.hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (seen, n) in _gathered(batches):
            words = model.file("words", b)
            if words is None:
                continue
            out = np.zeros((len(words["word"]), 6), np.int64)
            out[:, 0] = words["count"]
            np.add.at(out[:, 1], seen - model.first[b], n)
            grams = model.file("grams", b)
            if grams is not None:
                out[grams["left"] - model.first[b], 2:] = grams["totals"]
            here = (hot_numbers >= model.first[b]) & (hot_numbers < model.first[b] + len(out))
            out[hot_numbers[here] - model.first[b], 2:] = hot_totals[here]
            rows, code = np.unique(out, axis=0, return_inverse=True)
            write_arrays(f"{model.path}/vocabulary-{b}", {"rows": rows, "code": small(code.ravel())})
            left_words = out[:, 1]
            yield pa.RecordBatch.from_arrays([pa.array([of_counts(left_words).tobytes()]), pa.array([int((left_words >= 3).sum())], pa.int64()), pa.array([int(left_words.sum())], pa.int64())], ["of", "three", "total"])

    return run


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> Model:
    """Counts docs into a model of order 2 or 3 in the shared folder."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    with scope(docs.sparkSession):
        return _trained(docs.select(text_col), order)


def _trained(texts: DataFrame, order: int) -> Model:
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length(texts.columns[0]).cast("long"))).first()[0] or 0
    model = Model(new_path(spark, "lm", keep=True), order, 1 + size // BUCKET_BYTES)
    blocks = texts.mapInArrow(_word_blocks(model), "bucket int, n long, h binary, c binary")
    sums = _by_bucket(blocks, model.buckets).mapInArrow(_write_words(model), "bucket long, types long, tokens long").collect()  # a row a bucket
    types = np.zeros(model.buckets + 1, np.int64)
    for b, n, tokens in sums:
        types[b + 1] = n
        model.tokens += tokens
    model.first = np.cumsum(types)[:-1]
    model.wrote = {"words": types[1:] > 0, "vocabulary": types[1:] > 0, "grams": np.zeros(model.buckets, bool), "hot": np.zeros(model.buckets, bool)}
    model.words = max(int(types.sum()) - 1, 0)
    if not model.tokens:
        return model
    every = spark.range(model.buckets).select(F.col("id").cast("int").alias("bucket"))
    found = every.repartition(min(model.buckets, 64)).mapInArrow(_hot_words(model), "h long").collect()
    model.hot = np.unique(np.concatenate([np.array([r[0] for r in found], np.int64).view(np.uint64), [BEGIN]]).astype(np.uint64))
    model.begin = int(numbers_of(model, np.array([BEGIN]))[0])
    grams = texts.mapInArrow(_gram_blocks(model), f"bucket int, n long, v binary, {'u binary, ' if order == 3 else ''}w binary, c binary")
    stats = stored(_by_bucket(grams, model.buckets).mapInArrow(_write_grams(model), _STATS_TYPE), "lm-stats")
    if order == 3:
        pairs = _by_bucket(stats.where("kind = 'pairs'").select("bucket", "n", "a", "b", "c"), model.buckets)
        stats = stats.unionByName(stored(pairs.mapInArrow(_write_hot_pairs(model), _STATS_TYPE), "lm-hot-stats"))
    for kind, b in stats.where("kind like 'wrote %'").select("kind", "bucket").collect():  # two rows a bucket at most
        model.wrote[kind.removeprefix("wrote ")][b] = True
    hot_totals = np.zeros((len(model.hot), 4), np.int64)
    of = {"of2": np.zeros(4, np.int64), "of3": np.zeros(4, np.int64)}
    hot_numbers = numbers_of(model, model.hot)
    place = np.argsort(hot_numbers)
    for kind, n, a, b in stats.where("kind in ('of2', 'of3', 'hot')").select("kind", "n", "a", "b").toLocalIterator():  # rows a bucket, of hot words only
        if kind == "hot":
            at = place[np.searchsorted(hot_numbers[place], unpacked(a, n))]
            hot_totals[at] += unpacked(b, 4 * n).reshape(-1, 4)
        else:
            of[kind] += unpacked(a, n)
    # every bucket of words comes up, whether or not a word of it was sent
    empty = every.select("bucket", F.lit(0).cast("long").alias("n"), F.lit(packed(np.zeros(0, np.int64))).alias("a"), F.lit(packed(np.zeros(0, np.int64))).alias("b"))
    seen = stats.where("kind = 'left words'").select("bucket", "n", "a", "b").unionByName(empty)
    one, three, total = np.zeros(4, np.int64), 0, 0
    for o, t, s in _by_bucket(seen, model.buckets).mapInArrow(_write_vocabulary(model, hot_totals), "of binary, three long, total long").toLocalIterator():
        one, three, total = one + np.frombuffer(o, np.int64), three + t, total + s
    model.discounts = [np.array([0.0, *discounts(x)]) for x in (one, of["of2"], of["of3"])[:order]]
    d = model.discounts[0]
    model.left_over = float(d[1] * one[0] + d[2] * one[1] + d[3] * three) / total
    model.pair_types = total
    return model


# Scoring


def _vocabulary(model: Model, h: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Rows of the vocabulary for sorted hashes and their numbers; zeros for unknown words."""
    out = np.zeros((len(h), 6), np.int64)
    for b, at in _runs(bucket_of(h, model.buckets)):
        known = np.flatnonzero(number[at] >= 0) + at.start
        if len(known):
            held = model.file("vocabulary", b)
            out[known] = held["rows"][held["code"][number[known] - model.first[b]]]
    return out


def _positions(held: dict[str, np.ndarray], name: str, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each key stands in a bucket's table, where)."""
    high, low = held[f"{name}-high"], held[f"{name}-low"]
    hit, at = np.zeros(len(key), bool), np.zeros(len(key), np.int64)
    want, tail = (key >> np.uint64(32)).astype(np.uint32), ((key >> np.uint64(24)) & np.uint64(255)).astype(np.uint8)
    at = np.searchsorted(high, want)
    open_ = np.arange(len(key))
    k = at.copy()
    while len(open_):
        open_ = open_[k[open_] < len(high)]
        open_ = open_[high[k[open_]] == want[open_]]
        found = low[k[open_]] == tail[open_]
        hit[open_[found]] = True
        at[open_[found]] = k[open_[found]]
        open_ = open_[~found]
        k[open_] += 1
    return hit, at


def _looked_up(bucket: np.ndarray, key: np.ndarray, ask: Callable, width: int) -> np.ndarray:
    """Values of n-grams in any order: distinct ones are asked for bucket by bucket, in the order of keys."""
    out = np.zeros((len(key), width), np.int64)
    if not len(key):
        return out
    order = in_order([bucket, key >> np.uint64(24)])
    bucket, key = bucket[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
    first = np.flatnonzero(new)
    values = np.empty((len(first), width), np.int64)
    for b, at in _runs(bucket[first]):
        values[at] = ask(b, key[first[at]])
    out[order] = values[np.cumsum(new) - 1]
    return out


def _counts(model: Model, kind: str, name: str, b: int, key: np.ndarray) -> np.ndarray:
    n, held = np.zeros(len(key), np.int64), model.file(kind, b)
    if held is not None:
        hit, at = _positions(held, name, key)
        n[hit] = held[f"{name}-count"][at[hit]]
        big = np.flatnonzero(n == 255)
        if len(big):
            n[big] = held[f"{name}-bigcount"][np.searchsorted(held[f"{name}-bigkey"], key[big])]
    return n[:, None]


def _profiles(model: Model, b: int, key: np.ndarray) -> np.ndarray:
    out, held = np.zeros((len(key), 4), np.int64), model.file("grams", b)
    if held is not None:
        hit, at = _positions(held, "context", key)
        out[hit] = held["context-rows"][held["context-code"][at[hit]]]
    return out


def _interpolated(count: np.ndarray, rows: np.ndarray, d: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Discounted share of the context's total, and its freed mass times the lower order; lower where the context is new."""
    total = rows[:, 0]
    some = np.maximum(total, 1)
    return np.where(total > 0, np.maximum(count - d[np.minimum(count, 3)], 0) / some + (rows[:, 1:] @ d[1:]) / some * lower, lower)


def score_tokens(model: Model, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known, log10 of the base probability, log10 of the model's) of each token of whole texts."""
    if not model.tokens:
        flat = np.full(len(w), -np.log10(model.words + 1.0))
        return np.zeros(len(w), bool), flat, flat
    h, wi = np.unique(np.append(w, BEGIN), return_inverse=True)
    wi = wi[: len(w)]
    number = numbers_of(model, h)
    rows = _vocabulary(model, h, number)
    find = lambda x: np.searchsorted(h, x)
    ui, vi = shifted(wi, int(find(BEGIN)), u, v, find)
    un, vn, wn = number[ui], number[vi], number[wi]
    # the buckets of `dealt` and `_spread`, by distinct word
    home, spread = bucket_of(h, model.buckets)[vi], (textcore.mix(h) % np.uint64(SPREAD)).astype(np.int64)
    hot = is_hot(model, h)[vi]
    whole = home.copy()
    whole[hot] = (whole[hot] + spread[(ui if model.order == 3 else wi)[hot]]) % model.buckets
    d1 = model.discounts[0]
    left_words = rows[:, 1]
    one = np.maximum(left_words - d1[np.minimum(left_words, 3)], 0) / model.pair_types + model.left_over / (model.words + 1.0)
    base = np.log10((rows[:, 0] + 1.0) / (model.tokens + 1.0 * (model.words + 1)))
    pair = np.zeros(len(w), np.int64)
    known = (vn >= 0) & (wn >= 0)
    if model.order == 3:
        at = np.flatnonzero(known & hot)
        split = (home[at] + (textcore.mix(number.astype(np.uint64)) % np.uint64(SPREAD)).astype(np.int64)[wi[at]]) % model.buckets
        pair[at] = _looked_up(split, key_of(vn[at], wn[at]), lambda b, key: _counts(model, "hot", "pair", b, key), 1)[:, 0]
        known &= ~hot
    at = np.flatnonzero(known)
    pair[at] = _looked_up(whole[at], key_of(vn[at], wn[at]), lambda b, key: _counts(model, "grams", "pair", b, key), 1)[:, 0]
    p = _interpolated(pair, rows[vi, 2:], model.discounts[1], one[wi])
    if model.order == 3:
        at = np.flatnonzero((un >= 0) & (vn >= 0))
        context = np.zeros((len(w), 4), np.int64)
        context[at] = _looked_up(whole[at], key_of(un[at], vn[at]), lambda b, key: _profiles(model, b, key), 4)
        before = np.zeros(len(w), np.int64)
        before[1:] = pair[:-1]  # the pair (u, v) is that of the token before, in a text
        once = (context[:, 0] == 0) & (before > 0) & (v != BEGIN)
        context[once] = (1, 1, 0, 0)
        at = np.flatnonzero((context[:, 0] > 0) & (wn >= 0))
        triple = np.zeros(len(w), np.int64)
        triple[at] = _looked_up(whole[at], key_of(un[at], vn[at], wn[at]), lambda b, key: _counts(model, "grams", "triple", b, key), 1)[:, 0]
        p = _interpolated(triple, context, model.discounts[2], p)
    return rows[wi, 0] > 0, base[wi], np.log10(p)


def _scores(shared: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value

        def out(batch: pa.RecordBatch, first: int, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            u, v, w = (np.concatenate([p[k] for p in parts]) for k in range(3))
            n = np.concatenate([np.diff(p[3]) for p in parts])
            at = np.concatenate([[0], np.cumsum(n)[:-1]])
            sums = [np.add.reduceat(x, at) for x in score_tokens(model, u, v, w)]
            return pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(n)), batch.column(1).slice(first, len(n)), pa.array(n, pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

        for batch in batches:
            parts, since, size = [], 0, 0
            for first, data, offsets in textcore.chunks(batch.column(2)):
                if size >= SCORED:
                    yield out(batch, since, parts)
                    parts, since, size = [], first, 0
                parts.append(tokens_of(*textcore.words(data, offsets)))
                size += len(parts[-1][0])
            if parts:
                yield out(batch, since, parts)

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", out: Column | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    d = docs.select(F.col(id_col).alias("id"), (F.lit(False) if out is None else out).alias("held_out"), F.col(text_col).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = d.schema[0].dataType.simpleString()
    s = d.mapInArrow(_scores(shared), f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return s.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return score(docs, model, out=held_out())
