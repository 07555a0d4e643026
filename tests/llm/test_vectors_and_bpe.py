"""Operators 11 to 13 against plain versions and the tiktoken library, and their edge cases."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import byte_bpe, registry, textcore, vector_codes, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, key string"


def hard_vectors(dim=8, n=40):
    """Nulls, odd components and lengths, zero and repeated vectors and rows, equal ids, a column with a clashing name."""
    rng = random.Random(5)
    rows = [(k, [rng.choice((-1.0, 0.25, 0.5, rng.gauss(0, 1))) for _ in range(dim)], rng.choice((None, 1, 2)), "r") for k in range(n)]
    rows += [rows[3], rows[3], (3, rows[4][1], 1, "r"), (None, rows[5][1], None, "r"), (n, [0.0] * dim, 1, "r"), (n + 1, [-0.0] * dim, 1, "r")]
    odd = [None, [], [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [math.nan] * dim, [math.inf] + [0.0] * (dim - 1)]
    return rows, [(900 + k, v, 1, "r") for k, v in enumerate(odd)]


def grid(rows, scale):
    return np.floor(scale * np.array([np.array(r[1], np.float32) for r in rows], float)).astype(np.int64)


# 11


def plain_codes(rows, entries=256, parts=4, rounds=4):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, grid([r], 1024)[0].tolist()))
    x = grid(rows, 1024)
    width = x.shape[1] // parts
    books = [x[:entries, p * width : (p + 1) * width].copy() for p in range(parts)]

    def assign():
        at, error = [], 0
        for p in range(parts):
            d = ((x[:, None, p * width : (p + 1) * width] - books[p][None]) ** 2).sum(2)
            at.append(d.argmin(1))
            error = error + d.min(1)
        return at, error

    for _ in range(rounds):
        at, _ = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = x[at[p] == e, p * width : (p + 1) * width]
                if len(own):
                    books[p][e] = [int(s) // len(own) for s in own.sum(0)]
    at, error = assign()
    text = ",".join(str(int(c)) for b in books for e in b for c in e)
    codes = ["".join(f"{a[k]:02x}" for a in at) for k in range(len(x))]
    by_label = {lab: sum(int(e) for r, e in zip(rows, error) if r[2] == lab) for lab in {r[2] for r in rows}}
    want = sorted((repr(r[0]), codes[k], int(error[k]), by_label[r[2]]) for k, r in enumerate(rows))
    return want, hashlib.sha256(text.encode()).hexdigest()


def query_rows(spark, tmp_path, rows, name):
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    return registry.QUERIES[name](spark, str(tmp_path))


def test_codes_match_a_plain_version(spark, tmp_path):
    rows, odd = hard_vectors()
    want, sha = plain_codes(rows)
    d = query_rows(spark, tmp_path, rows + odd, "op11_vector_codes").collect()
    assert sorted((repr(r.vec_id), r.code, r.error, r.label_error) for r in d) == want
    assert {r.codebooks_sha256 for r in d} == {sha}


@pytest.mark.parametrize("nodes", [1, 3, 512])
def test_the_trie_finds_the_nearest_entry(nodes):
    rng = np.random.default_rng(2)
    for dim, values in ((1, 5), (4, 3), (6, 40)):
        parts = np.unique(rng.integers(-values, values, (200, dim)), axis=0)
        entries = rng.integers(-values, values, (17, dim))
        d = ((parts[:, None] - entries[None]) ** 2).sum(2)
        at, distance = vector_codes.nearest(parts, entries, nodes)
        assert at.tolist() == d.argmin(1).tolist() and distance.tolist() == d.min(1).tolist()
    assert [len(x) for x in vector_codes.nearest(np.zeros((0, 3), np.int64), entries[:, :3])] == [0, 0]


def test_codes_of_few_and_no_vectors(spark, tmp_path):
    rows = [(5, [1.0, 2.0, 3.0, 4.0], None, "r"), (2, [1.0, 2.0, 3.0, 4.0], 1, "r"), (7, [1e30, 0.0, -1e30, 0.5], 1, "r")]
    d = {r.vec_id: r for r in query_rows(spark, tmp_path, rows, "op11_vector_codes").collect()}
    assert d[2].code == d[5].code == "00000000" and d[7].code == "02020202" and {r.error for r in d.values()} == {0}
    none = query_rows(spark, tmp_path / "none", [(1, None, 1, "r"), (2, [1.0] * 6, 1, "r")], "op11_vector_codes")
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


# 12


def plain_whitening(rows):
    x = grid(rows, 256)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    c = fit - sums / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    return n, ((n * x - sums) ** 2).sum(1), (x - sums / n) @ vectors / np.sqrt(values), values / np.trace(c.T @ c / n)


@pytest.mark.parametrize("block_rows", [4, 1024])
def test_whitening_matches_a_plain_version(spark, tmp_path, monkeypatch, block_rows):
    monkeypatch.setattr(whitening.whiten, "__defaults__", (*whitening.whiten.__defaults__[:-1], block_rows))
    rows, odd = hard_vectors()
    n, deviation, want, share = plain_whitening(rows)
    d = query_rows(spark, tmp_path, rows + odd, "op12_whitening").collect()
    assert len(d) == 4 * len(rows) and {r.n for r in d} == {n} and {r.component for r in d} == {1, 2, 3, 4}
    assert max(r.identity_error for r in d) < 1e-10
    for j in range(4):
        got = sorted((repr(r.vec_id), r.deviation, round(r.whitened, 8) + 0.0) for r in d if r.component == j + 1)
        for sign in (1, -1):
            if got == sorted((repr(r[0]), int(deviation[k]), round(sign * want[k, j], 8) + 0.0) for k, r in enumerate(rows)):
                break
        else:
            raise AssertionError(f"component {j + 1}")
        assert all(abs(r.explained / share[j] - 1) < 1e-9 for r in d if r.component == j + 1)


def test_whitening_of_equal_flat_and_no_vectors(spark, tmp_path):
    one = query_rows(spark, tmp_path / "one", [(1, [0.5, 0.5], 1, "r"), (2, [0.5, 0.5], 1, "r")], "op12_whitening").collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one, key=lambda r: (r.vec_id, r.component))] == [(v, c, 1, 0, None, None, None) for v in (1, 2) for c in (1, 2)]
    flat = query_rows(spark, tmp_path / "flat", [(1, [0.0, 1.0, 0.0], 1, "r"), (2, [1.0, 1.0, 0.0], 1, "r")], "op12_whitening").collect()
    by = {(r.vec_id, r.component): r for r in flat}
    assert abs(by[1, 1].whitened) == pytest.approx(1) and by[1, 1].whitened == pytest.approx(-by[2, 1].whitened) and by[1, 1].explained == pytest.approx(1)
    assert by[2, 3].whitened is None and by[2, 3].explained == 0 and by[1, 1].identity_error < 1e-12 and by[1, 1].deviation == 256**2
    none = query_rows(spark, tmp_path / "none", [(1, None, 1, "r")], "op12_whitening")
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_beyond_a_long_are_null(spark, tmp_path):
    rows = [(1, [1e8, 0.0], 1, "r"), (2, [0.0, 0.0], 1, "r"), (3, [0.0, 1.0], 1, "r")]
    d = {r.vec_id: r.deviation for r in query_rows(spark, tmp_path, rows, "op12_whitening").collect()}
    x = [[int(np.float32(1e8)) * 256, 0], [0, 0], [0, 256]]
    exact = {k + 1: sum((3 * v - s) ** 2 for v, s in zip(r, (x[0][0], 256))) for k, r in enumerate(x)}
    assert d == {k: v if v < 1 << 63 else None for k, v in exact.items()} and None in d.values()


# 13


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.load()


@pytest.fixture(scope="module")
def library(codec):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def ids_of(codec, texts):
    out, encoder = [], byte_bpe.Encoder(codec)
    for _, data, offsets in textcore.chunks(pa.array(texts, pa.large_string())):
        ids, at = encoder.encode(data, offsets)
        out += [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    return out


def test_ids_match_the_library(codec, library):
    rng = random.Random(4)
    kinds = ["aab", "ab ", "éü ß", "1 2a", "\x1c\x1d \t\n\r\x85\xa0a", "漢字かな", "'s'll", "aAÀ١٢ⅷ² ​ ﻿", "🎉👍a", "'retvmdl s", " 'a\n", "<|endoftext|>"]
    texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["", "'", " '", "''s", "it's 'll' IT'S 're 'rex", "  \n x", "\n\n", "a" * 3000, "ab" * 2000, "日" * 500, " " * 400 + "x", "'l", "'r", "x'ree\U0001f600'd"]
    assert ids_of(codec, texts) == [library.encode_ordinary(t) for t in texts]


def test_merges_of_any_vocabulary(codec):
    """Ranks in which a merge makes a pair of a lower rank: the order of single merges still holds."""
    rng = random.Random(8)

    def plain(ranks, data):
        if data in ranks:
            return [ranks[data]]
        parts = [bytes([b]) for b in data]
        while True:
            found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    for _ in range(200):
        tokens = {bytes([b]) for b in range(256)} | {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(30)}
        order = list(tokens)
        rng.shuffle(order)
        own = byte_bpe.Codec({t: k for k, t in enumerate(order)})
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 25))) for _ in range(20)]
        starts = np.cumsum([0] + [len(w) for w in words[:-1]])
        ids, count = own.merge(b"".join(words), starts)
        cut = np.split(ids, np.cumsum(count)[:-1])
        assert [c.tolist() for c in cut] == [plain(own.ranks, w) for w in words]


def test_rank_queue():
    rng = random.Random(3)
    queue, plain = byte_bpe.RankQueue(70_000), {}
    for _ in range(3000):
        rank = rng.choice((rng.randrange(70_000), rng.randrange(300)))
        if rng.random() < 0.6:
            if rank in plain:
                queue.buckets[rank].append(rank % 7)
            else:
                queue.put(rank, [rank % 7])
            plain.setdefault(rank, []).append(rank % 7)
        else:
            assert queue.first() == min(plain, default=-1)
            if plain:
                low = min(plain)
                assert queue.take(low) == sorted(plain.pop(low))


def test_long_texts_go_in_pieces(codec, library, monkeypatch):
    monkeypatch.setattr(textcore, "CHUNK_BYTES", 50)
    text = "some words,  and 'more' of\nthem é日本 " * 40 + "x" * 300 + " end \n"
    assert byte_bpe.Encoder(codec).encode_long(np.frombuffer(text.encode(), np.uint8)).tolist() == library.encode_ordinary(text)


def test_bpe_of_hard_rows(spark, codec, library):
    rows = [(1, "it's  a\ttext"), (1, "it's  a\ttext"), (2, None), (3, ""), (None, "é" * 10), (4, "word " * 300_000 + "y" * 50_000), (5, "日本 \U0001f600\r\n")]
    d = byte_bpe.encode(spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "doc_id long, text string, ids string, bytes string"), codec)
    both = byte_bpe.decode(d, codec).select("doc_id", "bytes", "packed").collect()
    want = sorted((repr(k), np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for k, t in rows)
    assert sorted((repr(r.doc_id), bytes(r.packed), bytes(r.bytes)) for r in both) == want
    assert sorted(len(r.ids) for r in d.collect()) == sorted(len(w[1]) // 4 for w in want)
    assert byte_bpe.encode(d.select("doc_id", "packed").where("false").selectExpr("doc_id", "string(packed) AS text"), codec).count() == 0
    odd = byte_bpe.decode(spark.createDataFrame([(1, [100, None, 200]), (2, None), (3, [])], "doc_id long, ids array<int>"), codec)
    back = codec.decode(np.array([100, 200]))[0].tobytes()
    assert {r.doc_id: bytes(r.bytes) for r in odd.collect()} == {1: back, 2: b"", 3: b""}
    with pytest.raises(ValueError):
        codec.decode(np.array([60_000]))


def test_bpe_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    d = registry.QUERIES["op13_byte_bpe"](spark, SF).collect()
    assert len(d) == len(texts)
    for r in d:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
