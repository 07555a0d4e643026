"""Each operator against a brute-force version, an exact round trip or held-out labels, and its edge cases."""

import base64
import collections
import hashlib
import html
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import byte_bpe, chat_formatting, html_extraction, lm_scoring, mixing, nearest_neighbours, ngram_join, quality_rules, registry, sentencepiece_codec, textcore, toxicity, vector_codes, warc, whitening

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, row string"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
LONG = "word " * 30_000 + "x" * 50_000
# nulls, empty and very long texts, ties, repeated rows and a column with a clashing name
HARD = [
    (1, "a b c d e f g", "en", "s", 1, "r"),
    (1, "a b c d e f g", "en", "s", 1, "r"),
    (2, None, None, None, None, None),
    (3, "", "en", "s", 0, "r"),
    (4, " \n\t ", "en", "", 0, "r"),
    (None, "A b C d e f g", "en", "s", 1, "r"),
    (5, LONG, "en", "s2", 1, "r"),
    (6, "one two", "en", "s", 1, "r"),
    (7, "ONE\ttwo", "en", "s", 1, "r"),
    (8, "é 日本 \U0001f600 ▁x\r\nnew\x0bline", "fr", "s", 1, "r"),
]


def lower_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


# Words


def test_word_hashes_are_equal_just_for_equal_words():
    import pyarrow as pa

    texts = ["Ab ab\tAB", None, "", "x" * 3_000_000 + " ab", " é É "]
    seen = collections.defaultdict(set)
    for first, data, offsets in textcore.chunks(pa.array(texts)):
        h, rows = textcore.words(data, offsets)
        for d in range(len(offsets) - 1):
            words = lower_words(texts[first + d])
            assert rows[d + 1] - rows[d] == len(words)
            for w, x in zip(words, h[rows[d] : rows[d + 1]].tolist()):
                seen[w].add(x)
    assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)


# 1


def test_automaton_finds_what_edit_distance_finds():
    words, stems = ["idiot", "scum", "loser"], ["abc"]
    auto = toxicity.build_automaton(words, stems)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(5)
    tried = set(words) | {"abc", "abcx", "ab", "scums", "idio", "idiiot", "diiot", "1diot", "lsoer", ""}
    for w in words:
        for _ in range(300):
            t = list(w)
            for _ in range(r.randrange(3)):
                k = r.randrange(len(t) + 1)
                t[k : k + r.randrange(2)] = r.choice(["", "x", "i", "o"])
            tried.add("".join(t))
    for t in sorted(tried - {""}):
        points, offsets = toxicity._points([t])
        hit, state = toxicity.walk(auto, points, np.array([0]), np.array([len(t)]))
        kind = int(auto.kind[state[0]]) if len(hit) else 0
        want = 3 if t.startswith("abc") else 1 if t in words else 2 if any(len(w) >= 5 and distance(t, w) == 1 for w in words) else 0
        assert kind == want, (t, kind, want)


def test_automaton_takes_swaps_two_edits_and_misspelt_stems():
    auto = toxicity.build_automaton(["idiot", "moron", "worthless", "reeuxol"], ["reeux"], swaps=True)

    def kind(t):
        points, _ = toxicity._points([t])
        hit, state = toxicity.walk(auto, points, np.array([0]), np.array([len(t)]))
        return int(auto.kind[state[0]]) if len(hit) else 0

    want = {"idoit": 2, "mroon": 2, "moorn": 2, "idtoi": 0, "w0rthl3ss": 2, "wortlhes": 2, "w0r7hl3ss": 0, "reeuxen": 3, "reexuen": 4, "raeuxen": 4, "reuxen": 4, "reeuen": 0, "rxexuxen": 0, "raeuxol": 2, "reeuxol": 3}
    assert {t: kind(t) for t in want} == want


def test_windows_tell_quotation_from_abuse():
    auto = toxicity.build_automaton(["idiot"], [])
    got = toxicity.features(auto, ["you are an idiot", 'the word "idiot" was written', "an idi0t*** here", None, ""])
    assert got[:, 1].tolist() == [1, 1, 0, 0, 0] and got[:, 2].tolist() == [0, 0, 1, 0, 0]
    assert got[:, 4].tolist() == [0, 1, 0, 0, 0] and got[:, 5].tolist() == [1, 0, 0, 0, 0]
    assert got[:, 0].tolist() == [4, 5, 3, 0, 0]


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    scorer = toxicity.fit(d, labels)
    s = toxicity.score(d.join(labels.select("doc_id"), "doc_id", "left_semi"), scorer).join(labels, "doc_id").where(toxicity.held_out())
    t = {(r.predicted, r.toxic): r["count"] for r in s.groupBy("predicted", "toxic").count().collect()}
    hits, missed, wrong = t.get((1, 1), 0), t.get((0, 1), 0), t.get((1, 0), 0)
    assert hits / (hits + missed) > 0.9 and hits / (hits + wrong) > 0.9


def test_toxicity_query(spark):
    import zlib

    got = registry.QUERIES["op1_toxicity"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_batches_follow_bytes():
    import pyarrow as pa

    texts = ["a" * n for n in (10, 600_000, 600_000, 5_000_000, 3)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    assert [p.num_rows for p in textcore.slices(batch, 0)] == [2, 1, 1, 3]


def plain_features(words, stems, text):
    """Counts by a plain search: edit distances by dynamic programming, windows by slicing."""
    def osa(a, b):
        t = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    t[i][j] = min(t[i][j], t[i - 2][j - 2] + 1)
        return t[-1][-1]

    tokens = [x for x in (p.strip("".join(toxicity.EDGES)) for p in re.split("[" + re.escape(toxicity.SEPARATORS) + "]+", text.lower())) if x]
    out = [len(tokens), 0, 0, 0, 0, 0]
    for k, t in enumerate(tokens):
        kind = 3 if any(t.startswith(s) for s in stems) else 1 if t in words else 2 if any(len(w) >= 4 and osa(t, w) <= (2 if len(w) >= 7 else 1) for w in words) else 0
        if kind:
            near = set(tokens[max(0, k - toxicity.WINDOW) : k] + tokens[k + 1 : k + 1 + toxicity.WINDOW])
            out[kind] += 1
            out[4] += bool(near & toxicity.REPORTING)
            out[5] += bool(near & toxicity.SECOND_PERSON)
    return out


def test_features_match_a_plain_search():
    r = random.Random(6)
    words, stems = ["idiot", "scum", "worthless", "pathetic", "ass"], ["zzqx"]
    autos = toxicity.build_automata(words, stems)
    texts = []
    for _ in range(60):
        tokens = []
        for _ in range(r.randrange(1, 60)):
            w = r.choice([*words, "zzqxen", "you", "said", "tree", "house", "river", "stone"])
            for _ in range(r.choice([0, 0, 0, 1, 2])):
                at = r.randrange(len(w))
                w = r.choice([w[:at] + r.choice("abxyz") + w[at:], w[:at] + r.choice("abxyz") + w[at + 1 :], w[:at] + w[at + 1 :], w[:at] + w[at + 1 : at + 2] + w[at] + w[at + 2 :]]) or "q"
            tokens.append(w if not w.startswith("zz") or w.startswith("zzqx") else "zebra")
        texts.append(" ".join(tokens))
    got = toxicity.features(autos, texts)
    for row, text in zip(got, texts, strict=True):
        want = plain_features(words, [], text)
        stem_hits = sum(t.startswith("zzqx") for t in text.split())
        assert row[0] == want[0] and row[1] == want[1] and row[3] == stem_hits
        assert row[2] == want[2]


def test_toxicity_of_hard_rows(spark, hard, empty, labels):
    scorer = toxicity.fit(hard, labels.limit(0))
    rows = toxicity.score(hard, scorer).collect()
    assert len(rows) == len(HARD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty, scorer).count() == 0
    assert toxicity.score(spark.createDataFrame([(1, "you idiot", "", "", 1, "")], DOC), scorer).first().predicted == 1


# 2


def test_neighbours_match_brute_force(spark):
    r = np.random.default_rng(3)
    v = np.concatenate([r.standard_normal((1500, 16)), np.repeat(r.standard_normal((1, 16)), 500, 0)]).astype(np.float32)
    rows = [(i, x.tolist(), i) for i, x in enumerate(v)]
    rows += [(5000, None, 0), (5001, [0.0] * 16, 0), (5002, [float("nan")] + [1.0] * 15, 0), (5003, [1.0], 0), (5004, [None] + [1.0] * 15, 0), (None, [1.0] * 16, 0), (3, v[3].tolist(), 9)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, key int")
    got = collections.defaultdict(list)
    for x in nearest_neighbours.search(d, F.col("id") % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    found = total = 0
    w = v.astype(float)
    for q in range(0, 2000, 20):
        dist = np.sqrt(((w - w[q]) ** 2).sum(1))
        dist[q] = np.inf
        best = np.lexsort((np.arange(2000), dist))[:5]
        assert len(got[q]) == 5 and all(abs(dist[i] - s) < 1e-9 for i, s in got[q])
        found += len({i for i, _ in got[q]} & set(best.tolist()))
        total += 5
    assert found / total >= 0.95 and set(got) == set(range(0, 2000, 20))


def test_recall_over_many_cells(spark):
    """Cells and parts of 32 entries, so that nearly all neighbours lie in other cells than the query's."""
    r = np.random.default_rng(8)
    centres = r.standard_normal((40, 24)) * 2
    v = (centres[r.integers(0, 40, 4000)] + r.standard_normal((4000, 24))).astype(np.float32)
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(set)
    for x in nearest_neighbours.search(d, F.col("id") % 40 == 0, part_rows=32).collect():
        got[x.query_id].add(x.vec_id)
    w, found = v.astype(float), 0
    for q in range(0, 4000, 40):
        dist = ((w - w[q]) ** 2).sum(1)
        dist[q] = np.inf
        found += len(got[q] & set(np.lexsort((np.arange(4000), dist))[:10].tolist()))
    assert len(got) == 100 and all(len(x) == 10 for x in got.values()) and found >= 0.95 * 1000


def test_recall_on_the_given_vectors(spark):
    """The table of 2,000 vectors in about 60 cells."""
    d = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r.vec_id: r.embedding for r in d.collect()}
    ids = np.array(sorted(rows))
    w = np.array([rows[i] for i in ids], float)
    got = collections.defaultdict(set)
    for x in nearest_neighbours.search(d, F.col("id") % 20 == 0, part_rows=32).collect():
        got[x.query_id].add(x.vec_id)
    found = 0
    for q in np.flatnonzero(ids % 20 == 0):
        dist = ((w - w[q]) ** 2).sum(1)
        dist[q] = np.inf
        found += len(got[ids[q]] & set(ids[np.lexsort((ids, dist))[:10]].tolist()))
    assert len(got) == 100 and found >= 0.9 * 1000


def test_cells_tile_the_space():
    r = np.random.default_rng(5)
    p = r.standard_normal((3000, 8))
    p[:600] = p[0]
    tree, leaves = nearest_neighbours.kd_tree(p, 100, 4)
    cells = nearest_neighbours.Cells(np.eye(8), tree)
    home = cells.home(p)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(3000)) and all((home[a] == k).all() for k, a in enumerate(leaves))
    radius2 = np.full(50, 4.0)
    pairs = {(k, c): g for k, c, g in zip(*(x.tolist() for x in cells.within(p[:50], radius2)), strict=True)}
    assert max(pairs.values()) <= 4.0 and all(pairs[k, home[k]] == 0 for k in range(50))
    for k in range(50):
        near = np.flatnonzero(((p - p[k]) ** 2).sum(1) <= 4.0)
        assert {(k, c) for c in home[near].tolist()} <= set(pairs)


def test_neighbour_query(spark, tmp_path):
    r = np.random.default_rng(2)
    v = r.standard_normal((600, 12))
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    d.write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = registry.QUERIES["op2_nearest_neighbours"](spark, str(tmp_path)).collect()
    assert {x.query_id for x in rows} == set(range(0, 600, 100)) and len(rows) == 60
    for q in range(0, 600, 100):
        own = sorted((x["rank"], x.vec_id, x.score) for x in rows if x.query_id == q)
        dist = np.sqrt(((v - v[q]) ** 2).sum(1))
        assert [k for k, _, _ in own] == list(range(1, 11)) and all(abs(dist[i] - s) < 1e-12 for _, i, s in own)
        assert [(s, i) for _, i, s in own] == sorted((s, i) for _, i, s in own)


def test_few_and_no_neighbours(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in nearest_neighbours.search(d, F.col("id") == 0).collect()] == [(0, 1, 1, 1.0)]
    assert nearest_neighbours.search(d.limit(0), F.col("id") == 0).count() == 0


def test_chi_square_quantile():
    x = nearest_neighbours.chi_square_quantile(0.95, 8)
    assert abs(x - 15.507) < 1e-3


# 3


def test_pairs_of_large_and_negative_ids(spark):
    big = 2**60
    rows = [(i, 0, "user", f"t{i}") for i in (big, big + 1, big + 2, big + 3, -1, -2, 5)]
    d = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {(r.pair_id, r.chosen_id, r.rejected_id) for r in chat_formatting.pair_by_id(d).collect()}
    assert got == {(big // 2, big, big + 1), (big // 2 + 1, big + 2, big + 3), (-1, -2, -1), (2, None, 5)}


def test_preferences(spark):
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "good"), (1, 0, "user", "q"), (1, 1, "assistant", "bad"), (1, 2, "user", "why"), (2, 0, "user", None), (3, 0, "user", None), (4, 5, None, "x"), (None, 0, "user", "lost"), (7, 0, "user", "alone")]
    c = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, n int")
    pairs = spark.createDataFrame([(1, 0, 1), (2, 2, 3), (3, 4, 99)], "pair_id long, chosen_id long, rejected_id long")
    got = {r.pair_id: r for r in chat_formatting.format_preferences(pairs, c).collect()}
    assert got[1].prompt == "<|start|>user<|message|>q<|end|>\n" and got[1].n_prompt_turns == 1
    assert [tuple(x) for x in got[1].chosen] == [("<|start|>assistant<|message|>", 0), ("good<|end|>\n", 1)]
    assert [x.mask for x in got[1].rejected] == [0, 1, 0, 0]
    assert got[2].n_prompt_turns == 1 and got[2].chosen == [] and got[2].rejected == []
    assert got[3].prompt == "" and len(got[3].chosen) == 2 and got[3].rejected == []
    assert {r.pair_id: (r.chosen_id, r.rejected_id) for r in chat_formatting.pair_by_id(c).collect()} == {0: (0, 1), 1: (2, 3), 2: (4, None), 3: (None, 7)}
    assert chat_formatting.pair_by_id(c.limit(0)).count() == 0


# 4


def components(texts):
    sets = {i: ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w := lower_words(t)) >= 5 else {tuple(w)} if w else set()) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            c = len(sets[a] & sets[b])
            if c and 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed, n):
    r = random.Random(seed)
    out, k = {}, 0
    shared = [f"p{j}" for j in range(12)]
    while k < n:
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([3, 6, 20, 60]))]
        for _ in range(r.choice([1, 1, 2, 9, 25])):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            if r.random() < 0.4:
                w = shared + w if r.random() < 0.5 else w + shared
            out[k] = " ".join(w)
            k += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    texts = near_copies(seed, 220)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.cluster(d).collect()}
    assert got == components(texts)


def test_long_runs_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT_RUN", 2)
    texts = near_copies(9, 200)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.cluster(d).collect()} == components(texts)


def test_salted_hubs_and_every_group_by_tokens_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HUB_PAIRS", 2)
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", 1)
    texts = near_copies(4, 200)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.cluster(d).collect()} == components(texts)


def test_group_of_one_prefix_whose_texts_seldom_link(spark, monkeypatch):
    """40 texts of one rare head; their tails stand in many other texts, so all prefixes lie in the head. Only tails
    2k and 2k + 1 are near copies: their pairs alone are tried."""
    head = [f"h{k}" for k in range(40)]
    tails = []
    for k in range(20):
        tail = [f"t{k}x{j}" for j in range(60)]
        tails += [tail, [*tail[:-1], f"t{k}y"]]
    texts = {k: " ".join(head + t) for k, t in enumerate(tails)}
    rows = list(texts.items()) + [(100 + 64 * k + j, " ".join(head[-4:] + t)) for k, t in enumerate(tails) for j in range(64)]
    tried, inside = [], ngram_join.pairs_inside

    def counted(split, *rest):
        out = inside(split, *rest)
        tried.append((split.count(), split.select("grp").distinct().count(), out.count()))
        return out

    monkeypatch.setattr(ngram_join, "pairs_inside", counted)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.cluster(d).collect()}
    want = {k: (96, k - k % 2) for k in texts} | {100 + 64 * k + j: (60, 100 + 64 * (k - k % 2)) for k in range(40) for j in range(64)}
    assert got == want
    assert tried == [(40, 1, 19)]  # 780 pairs in all; the first text's pair was found in the first round


def test_components_of_hard_rows(spark, hard, empty):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.cluster(hard).collect())
    assert got[0] == (0, 3, 1) and got.count((1, 3, 1)) == 2
    assert {(2, 0, 2), (3, 0, 3), (4, 0, 4), (6, 1, 6), (7, 1, 6)} <= set(got)
    assert ngram_join.cluster(empty).count() == 0


def clusters_of_sets(texts):
    """As components(), by one product of incidence matrices."""
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w := lower_words(t)) >= 5 else {tuple(w)} for t in texts]
    column = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(sets), len(column)), np.float32)
    for k, x in enumerate(sets):
        m[k, [column[g] for g in x]] = 1
    both, n = m @ m.T, m.sum(1)
    link = 100 * both >= 75 * (n[:, None] + n[None, :] - both)
    root = np.arange(len(sets))
    while True:
        new = np.array([root[row].min() for row in link])
        if (new == root).all():
            return root
        root = new


def test_many_near_copies(spark):
    """A run of 2,000 near copies with strays that link with few or none of them."""
    r = random.Random(12)
    base = [f"w{k}" for k in range(90)]
    texts = []
    for k in range(2000):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3] if k % 50 else [3, 4, 5, 6])):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        texts.append(" ".join(w))
    want = clusters_of_sets(texts)
    assert len(set(want.tolist())) > 3
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in ngram_join.cluster(d).collect()}
    assert got == dict(enumerate(want.tolist()))


def test_rows_of_one_id_meet_once(spark):
    """Two near texts in thousands of rows of a null and of one repeated id: the work follows the rows."""
    words = [f"w{k}" for k in range(60)]
    near = " ".join([*words[:-1], "x"])
    for i in (None, 7):
        d = spark.createDataFrame([(i, " ".join(words)), (i, near)] * 6000 + [(9, "some other text of six words")], "doc_id long, text string")
        got = ngram_join.cluster(d)
        assert {tuple(r) for r in got.distinct().collect()} == {(i, 56, i), (9, 2, 9)} and got.count() == 12_001


def test_join_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in registry.QUERIES["op4_ngram_join"](spark, SF).collect()}
    assert got == components(texts)


# 5


def statistics(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    count = collections.Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if count[x] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_statistics_match_brute_force(spark, docs, hard):
    odd = ["a a a a a", "x y z x y z", "l\nl\n\n l\nl", "a b c d a b c", "a b", None, "#*$%&|<>"]
    d = docs.select("doc_id", "text").unionByName(hard.select("doc_id", "text")).unionByName(spark.createDataFrame([(-k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    for r in quality_rules.text_statistics(d).collect():
        assert tuple(r[c] for c in quality_rules.BASE) == statistics(r.row.text), r.row.text[:80]


def test_rules_reject_what_labels_call_bad(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.fit_rules(d, labels)
    assert rules and all(0 < len(r.tests) <= 4 for r in rules)
    got = quality_rules.apply_rules(d, rules).select("row.doc_id", "base_failed", "kept").join(labels, "doc_id").where(~F.col("base_failed"))
    t = {(r.kept, r.quality): r["count"] for r in got.groupBy("kept", "quality").count().collect()}
    assert t.get((False, 1), 0) <= 0.01 * t[(True, 1)] and t[(False, 0)] >= 5 * t.get((True, 0), 0)


def test_quality_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registry.QUERIES["op5_quality_rules"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)


def test_rule_learning_covers_and_prunes():
    r = np.random.default_rng(0)
    x = r.random((600, 2))
    bad = (x[:, 0] > 0.8) | ((x[:, 1] < 0.2) & (x[:, 0] < 0.3))
    rules = quality_rules.learn_rules(x, bad, ("a", "b"))
    hit = np.zeros(600, bool)
    for rule in rules:
        hit |= quality_rules._covers(x, [(("a", "b").index(f), least, cut) for f, least, cut in rule.tests])
    assert (hit == bad).mean() > 0.95 and len(rules) <= 6
    assert quality_rules.learn_rules(np.zeros((0, 2)), np.zeros(0, bool)) == []


def test_quality_of_hard_rows(hard, empty, labels):
    rows = quality_rules.apply_rules(hard, quality_rules.fit_rules(hard, labels.limit(0))).collect()
    assert len(rows) == len(HARD) and not any(r.kept for r in rows if r.row.doc_id != 5)
    assert quality_rules.apply_rules(empty, []).count() == 0


# 6


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.load()


def test_pieces_match_the_library(codec, docs):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(open(sentencepiece_codec.MODEL_FILE, "rb").read())
    m.trainer_spec.model_type = 1  # unigram, over the same pieces and scores
    for i, p in enumerate(m.pieces):
        p.score = codec.score[i] if p.type == 1 else p.score
    library = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    d = docs.select("doc_id", "text")
    texts = {r.doc_id: r.text for r in d.collect()}
    got = {r.doc_id: r.ids for r in sentencepiece_codec.encode(d, codec).collect()}
    differ = {i: library.encode(t) for i, t in texts.items() if got[i] != library.encode(t)}
    score = codec.score.astype(float)  # the library adds in single precision, which over long texts loses the best by a hair
    assert all(len(texts[i]) > 3000 and score[got[i]].sum() > score[ids].sum() for i, ids in differ.items()) and len(differ) <= 2


def test_codec_query(spark, codec):
    got = {r.doc_id: r for r in registry.QUERIES["op6_sentencepiece"](spark, SF).collect()}
    e = {r.doc_id: r.ids for r in sentencepiece_codec.encode(spark.read.parquet(f"{SF}/documents.parquet"), codec).collect()}
    assert got.keys() == e.keys() and all(r.round_trip and r.n_pieces == len(e[i]) and 0 <= r.n_byte_pieces <= r.n_pieces for i, r in got.items())


def test_round_trip(spark, codec, hard, empty):
    e = sentencepiece_codec.encode(hard, codec)
    assert all(r.round_trip for r in e.collect())
    got = sorted((r.doc_id or 0, r.text) for r in sentencepiece_codec.decode(e, codec).collect())
    assert got == sorted((i or 0, (t or "").replace("▁", " ")) for i, t, *_ in HARD)
    assert sentencepiece_codec.encode(empty, codec).count() == 0


def test_segments_alone_and_together_agree(codec):
    r = random.Random(4)
    import pyarrow as pa

    for _ in range(60):
        t = "".join(r.choice("abcdefé日 \n\r_'\"{);") for _ in range(r.randrange(1, 200)))
        marked = sentencepiece_codec._marked(pa.array([t]))
        for _, data, offsets in textcore.chunks(marked):
            ids, _ = sentencepiece_codec.Encoder(codec).encode(data, offsets)
            assert ids.tolist() == sentencepiece_codec.encode_one(codec, data.tobytes())


# 7


def mixed(rows):
    sizes, by = {}, collections.defaultdict(list)
    for i, t, s in rows:
        by[s].append((hashlib.md5(str(i if i is not None else "").encode()).hexdigest()[:12], len(WORD.findall(t or ""))))
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    sizes = {s: sum(n for _, n in by[s]) for s in order}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return sizes, target | {s: level * weight[s] for s in open_}, by
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full


def test_mix_meets_its_targets(spark, docs, hard):
    d = docs.select("doc_id", "text", "source").unionByName(hard.select("doc_id", "text", "source"))
    sizes, target, by = mixed([tuple(r) for r in d.collect()])
    taken = collections.Counter()
    for r in mixing.mix(d.withColumn("src", F.lit(1)), carry=True).collect():
        s = r.row.source
        assert r.source_size == sizes[s] and math.isclose(r.target, target[s], rel_tol=1e-9, abs_tol=1e-6) and 0 <= r.copies <= 2
        taken[s] += r["size"] * r.copies
    assert all(abs(taken[s] - target[s]) <= max(n for _, n in by[s]) for s in sizes)


def test_targets_of_equal_sources(spark):
    """Sources of one size and weight, capped ones, empty ones: the whole budget is shared."""
    r = random.Random(5)
    for sizes in ([100, 10, 10, 100], [0, 0, 0], [7], [r.choice((0, 3, 50, 50, 400, 9000)) for _ in range(60)]):
        names = [None] + [f"s{k:03d}" for k in range(len(sizes) - 1)]
        got = {x.src: x.target for x in mixing.targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "src string, n long")).collect()}
        _, want, _ = mixed([(k, "w " * n, s) for k, (s, n) in enumerate(zip(names, sizes, strict=True))])
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9) for s in want)
        assert math.isclose(sum(got.values()), 1.5 * sum(sizes))


def test_mix_sql_of_equal_sources(spark, tmp_path):
    import duckdb

    rows = [(k, "w " * (k % 7), s) for k, s in enumerate(x for s, n in (("a", 90), ("b", 9), ("c", 9), ("d", 90), (None, 40), ("é", 90), ("", 90)) for x in [s] * n)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    r = c.execute(mixing.SQL)
    names = [x[0] for x in r.description]
    want = sorted(tuple(x[names.index(k)] for k in sorted(names)) for x in r.fetchall())
    assert sorted(tuple(x[k] for k in sorted(names)) for x in mixing.query(spark, str(tmp_path)).collect()) == want


def test_mix_of_no_rows(empty):
    assert mixing.mix(empty).count() == 0


# 8


def test_archives_round_trip(spark, tmp_path):
    pages = [(1, "http://a/\r\nx", "same"), (2, "http://b", "same"), (3, None, None), (4, "u", ""), (5, "ü", "<p>é</p>" * 90_000), (6, "u", "one"), (6, "u", "one"), (None, "u", "lonely")]
    d = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload string")
    path = f"file://{tmp_path}/w"
    warc.write_archives(d, path)
    got = {(r.page_id, r.record_type): r for r in warc.read_archives(spark, path).collect()}
    for i, u, h in pages:
        raw = (h or "").encode()
        kind = "revisit" if i in (1, 3) else "response"
        r = got[i, kind]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert r.refers_to == {1: 2, 3: 4}.get(i) and (r.payload is None) == (kind == "revisit")
        assert kind == "revisit" or bytes(r.payload) == raw
    assert got[1, "revisit"].url == "http://a/%0D%0Ax" and got[3, "revisit"].url is None
    only = warc.read_archives(spark, path, payload=False).where("record_type = 'revisit' and page_id in (1, 2)")
    assert [(r.page_id, r.payload) for r in only.collect()] == [(1, None)]
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter\b", plan)  # the reader has taken both tests over


def test_small_payloads_are_all_responses(spark):
    d = spark.createDataFrame([(1, "u", "same"), (2, "u", "same")], "page_id long, url string, html string")
    assert {r.record_type for r in warc.with_revisits(d, 5).collect()} == {"response"}
    assert {r.record_type for r in warc.with_revisits(d, 4).collect()} == {"response", "revisit"}


def foreign(kind, uri, body, lower=False, http=True, folded=False):
    block = (b"HTTP/1.1 200 OK\r\ncontent-type: text/html\r\n\r\n" + body) if http else body
    head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:6ba7b810-9dad-11d1-80b4-00c04fd430c8>", f"WARC-Target-URI: <{uri}>"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(body).digest()).decode()}"] if http else []
    head += ["X-Long: a", " b" * 3000] if folded else []
    head += [f"Content-Type: {'application/http; msgtype=response' if http else 'application/warc-fields'}", f"Content-Length: {len(block)}"]
    text = "\r\n".join([head[0], *(h.lower() if lower and "URI" not in h and "Digest" not in h else h for h in head[1:])])
    return text.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    import gzip

    big = random.Random(4).randbytes(400_000)
    parts = [foreign("warcinfo", "", b"software: x\r\n", http=False), foreign("response", "http://a/1", b"<p>one</p>", lower=True), foreign("response", "http://a/2", big, folded=True), foreign("metadata", "http://a/2", b"k: v", http=False), foreign("resource", "http://a/3", b"", http=False)]
    (tmp_path / "w" / "deep").mkdir(parents=True)
    (tmp_path / "w" / "plain.warc").write_bytes(b"".join(parts))
    (tmp_path / "w" / "deep" / "zip.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (tmp_path / "w" / "notes.txt").write_text("no archive")
    path = f"file://{tmp_path}/w"
    rows = warc.read_archives(spark, path).collect()
    assert len(rows) == 10 and {r.page_id for r in rows} == {None}
    for kind, url, body in (("warcinfo", None, b"software: x\r\n"), ("response", "http://a/1", b"<p>one</p>"), ("response", "http://a/2", big), ("metadata", "http://a/2", b"k: v"), ("resource", "http://a/3", b"")):
        got = [r for r in rows if (r.record_type, r.url) == (kind, url)]
        assert len(got) == 2 and all(bytes(r.payload) == body and r.payload_bytes == len(body) for r in got)
    heads = warc.read_archives(spark, path, payload=False).where("record_type = 'response'").collect()
    assert sorted(r.payload_bytes for r in heads) == [10, 10, 400_000, 400_000] and {r.payload for r in heads} == {None}
    assert warc.read_archives(spark, f"{path}/plain.warc").count() == 5


def test_odd_records_are_rows_with_errors(spark, tmp_path):
    import gzip

    def rec(body, head="HTTP/1.1 200 OK\r\n\r\n", length=None, of=None, line="\r\n", url="http://a/"):
        block = head.encode() + body
        lines = ["WARC/1.0", "WARC-Type: response", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{warc.digest(body if of is None else of)}", "Content-Type: application/http", f"Content-Length: {len(block) if length is None else length}"]
        return line.join(lines).encode() + (line * 2).encode() + block + b"\r\n\r\n"

    chunks = b"5\r\nhello\r\n6;x=y\r\n world\r\n0\r\n\r\n"
    chunked = "HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    odd = [rec(b"good"), rec(b"feeds", head="HTTP/1.1 200 OK\nA: b\n\n", line="\n"), rec(chunks, head=chunked, of=b"hello world"), rec(chunks, head=chunked), rec(b"bad", of=b"other"), rec(b"length", length="abc"), rec(b"last")]
    want = [(b"good", None), (b"feeds", None), (b"hello world", None), (b"hello world", None), (b"bad", "payload and digest differ"), (None, "Content-Length is 'abc'"), (b"last", None)]
    (tmp_path / "w").mkdir()
    files = {"a.warc": b"".join(odd), "b.warc.gz": b"".join(map(gzip.compress, odd)), "c.warc.gz": b"".join(map(warc.member, odd))}
    for name, data in files.items():
        (tmp_path / "w" / name).write_bytes(data)
        rows = warc.read_archives(spark, f"file://{tmp_path}/w/{name}").collect()
        assert [(None if r.payload is None else bytes(r.payload), r.error and r.error.split(": ", 1)[1]) for r in rows] == want, name
        with pytest.raises(Exception, match="payload and digest differ"):
            warc.read_archives(spark, f"file://{tmp_path}/w/{name}", strict=True).collect()
        heads = warc.read_archives(spark, f"file://{tmp_path}/w/{name}", payload=False).where("record_type = 'response'").collect()
        assert len(heads) == 7 and sum(r.error is not None for r in heads) == 1
    # cut off at every byte: what is whole before comes through, and no read fails
    for name, data in files.items():
        whole = len(list(warc.records(pa_file(data), len(data), [], True)))
        for n in range(0, len(data), 7):
            got = list(warc.records(pa_file(data[:n]), n, [], True))
            assert len(got) <= whole and sum(r["error"] is not None for r in got) <= 3
            assert all(r.get("payload") == want[k][0] for k, r in enumerate(got[:-1])), (name, n)
    garbage = b"junk\x00 and more" + odd[0] + b"junk" + gzip.compress(odd[1])[:-30] + gzip.compress(odd[0]) + b"\x1f\x8b\x08\x00broken"
    got = list(warc.records(pa_file(garbage), len(garbage), [], True))
    assert sum(r.get("payload") == b"good" for r in got) >= 1 and any(r["error"] for r in got)


def pa_file(data):
    import io

    return io.BytesIO(data)


def test_failed_writes_leave_nothing(spark, tmp_path):
    d = spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string").repartition(2)
    warc.write_archives(d, f"file://{tmp_path}/w")
    writer = warc.WarcWriter(f"file://{tmp_path}/w", "2024-01-01T00:00:00Z", 1 << 20)
    (tmp_path / "w" / f"_{writer.job}-x.part").write_text("left over")
    (tmp_path / "w" / "_other-x.part").write_text("of another job")
    writer.abort([])
    assert sorted(f.name for f in (tmp_path / "w").iterdir() if not f.name.endswith(".gz")) == ["_other-x.part"]


def test_archive_query(spark, tmp_path, monkeypatch):
    rows = [(k, f"u{k}", ("same" * 3 if k % 3 else "") if k < 60 else f"own {k}") for k in range(90)] + [(200, None, None)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    d.write.parquet(f"{tmp_path}/pages.parquet")
    for most in (100_000, 0):  # digests broadcast, and dealt with salt
        monkeypatch.setattr(warc, "BROADCAST_DIGESTS", most)
        got = {r.page_id: r for r in registry.QUERIES["op8_warc"](spark, str(tmp_path)).collect()}
        assert len(got) == len(rows)
        last = {}
        for k, _, h in rows:
            last[h or ""] = max(k, last.get(h or "", -1))
        for k, _, h in rows:
            raw, top = (h or "").encode(), last[h or ""]
            assert (got[k].payload_bytes, got[k].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
            assert (got[k].record_type, got[k].refers_to) == (("response", None) if k == top else ("revisit", top))


def test_no_archives(spark, tmp_path):
    d = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(d, f"file://{tmp_path}/none")
    (tmp_path / "none").mkdir(exist_ok=True)
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0


# 9


def test_articles_come_out_whole(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_extraction.extract(rows).collect()}
    for r in rows.collect():
        inside = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        want = " ".join(" ".join(html.unescape(x).split()) for x in re.sub(r"<[^>]+>", "\n", inside).split("\n") if x.strip())
        assert got[r.page_id] == want


def page(k, body, top="Welcome to our site"):
    return f"<html><head><title>t</title></head><body><div class=x1><p>{top}</p></div><div class=y{k}><h1>Title {k}</h1>{body}</div><div class=z>About us</div></body></html>"


def test_wrappers_find_template_without_names(spark):
    rows = [(k, f"http://h.com/{k}", page(k, f"<p>Text {k} &amp; more<p>second\n part {k}")) for k in range(8)]
    rows += [(20, "http://h.com/n", page(20, "<nav>menu</nav><p>x</p><form>f</form><div class='comment-list'>c</div><aside>s</aside><script>var p='<p>no</p>'</script>"))]
    rows += [(30, None, None), (31, "bad url", ""), (32, "http://one.com", "<p>only <b>page</b><li>a<li>b<!-- cut <p>"), (32, "http://one.com", "<p>only <b>page</b><li>a<li>b<!-- cut <p>"), (33, "http://two.com", "x" * 100_000 + "<div>" * 300)]
    d = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    got = collections.defaultdict(list)
    for r in html_extraction.extract(d).collect():
        got[r.page_id].append(r.text)
    assert got[3] == ["Title 3 Text 3 & more second part 3"] and got[20] == ["Title 20 x"]
    assert got[30] == [""] and got[31] == [""] and got[32] == ["only page a b"] * 2 and got[33] == ["x" * 100_000]
    assert html_extraction.extract(d.limit(0)).count() == 0


def test_every_layout_has_its_template(spark):
    body = lambda *blocks: "<html><body>" + "".join(f"<div class={c}>{t}</div>" for c, t in blocks) + "</body></html>"
    rows = [(0, "http://h.com/0", None), (1, "http://h.com/1", "")]
    rows += [(10 + k, f"http://h.com/a{k}", body(("top", "Our shop"), ("a", f"First {k}"))) for k in range(4)]
    rows += [(20 + k, f"http://h.com/b{k}", body(("a", f"Second {k}"), ("left", "All offers"), ("low", "Made here"))) for k in range(4)]
    rows += [(30 + k, f"http://s.com/{k}", body(("a", "Sold out" if k < 5 else f"Only here {k}"), ("b", f"Text {k}"))) for k in range(8)]
    rows += [(40 + k, f"http://two.com/{k}", body(("top", "Two pages"), ("a", f"Page {k}"))) for k in range(2)]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == got[1] == ""
    assert [got[10 + k] for k in range(4)] == [f"First {k}" for k in range(4)]
    assert [got[20 + k] for k in range(4)] == [f"Second {k}" for k in range(4)]
    assert [got[30 + k] for k in range(8)] == [f"Text {k}" if k < 5 else f"Only here {k} Text {k}" for k in range(8)]
    assert [got[40 + k] for k in range(2)] == ["Page 0", "Page 1"]


def test_tree_matching_counts_the_most_nodes():
    read = lambda t: html_extraction.read_shape(t)[0]
    most, pairs = html_extraction.align(read("r(a(x()y())b()c())"), read("r(a(y())c()b())"))
    assert most == len(pairs) == 4
    r = random.Random(3)

    def tree(depth):
        return f"{r.choice('ab')}({''.join(tree(depth - 1) for _ in range(r.randrange(4)))})" if depth else ""

    def plain(a, b):
        if a.label != b.label:
            return 0
        table = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
        for i, x in enumerate(a.children):
            for j, y in enumerate(b.children):
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + plain(x, y))
        return table[-1][-1] + 1

    for _ in range(60):
        x, y = read(f"r({tree(4)})"), read(f"r({tree(4)})")
        most, pairs = html_extraction.align(x, y)
        assert most == len(pairs) == plain(x, y)
        assert html_extraction.written(x) == html_extraction.written(html_extraction.read_shape(html_extraction.written(x))[0])


def off(monkeypatch):
    """No element says of itself what it is: only wrappers decide. Wrappers are drawn on the driver's side here."""
    for name in ("BOILERPLATE_TAGS", "BOILERPLATE_WORDS", "BOILERPLATE_ROLES", "CONTENT_TAGS"):
        monkeypatch.setattr(html_extraction, name, frozenset())


def test_regions_without_names(monkeypatch):
    off(monkeypatch)
    text = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    shell = "<body><div>{0} <a href=x>m{0}</a></div><section><h1>T{0}</h1><p>{1}</p><p>{1} again</p></section><div>low {0}</div></body>"
    beside = "<body><div>menu {0}</div><h1>T{0}</h1><div><p>{1}</p></div></body>"
    for layout, kept in ((shell, "section"), (beside, "body")):
        wrapper, plain = None, collections.Counter()
        for k in range(4):
            page = html_extraction.fold(html_extraction.parse(layout.format(k, text(k, 60))))
            if wrapper is None:
                wrapper = page
            else:
                html_extraction.merge(wrapper, page)
        slots = html_extraction.read_shape(html_extraction.written(wrapper))
        for k in range(4):
            page = html_extraction.fold(html_extraction.parse(layout.format(k, text(k, 60))))
            for slot, w in html_extraction.align(page, slots[0])[1]:
                plain[w.number] += sum(len(p[1]) - p[2] for n in slot.nodes for p in n.parts)
        first, last = html_extraction.region(slots, plain)
        assert slots[first].label == kept and last >= first


def test_what_an_article_holds_stays_whole(spark):
    parts = '<article><div class="article-header"><h1>Title</h1></div><h2 id="search-engines">On search</h2><p class="related-work">super<wbr>cali x<img src=a>y</p><div class="notice-of-intent">Intent</div><p>so <math><mi>a</mi></math> is</p><div class="comments"><p>first!</p></div><div class=ad>Buy</div></article>'
    deep = "<div>" * 20_000 + "deep text" + "</div>" * 20_000
    rows = [(1, "http://a.org/1", f"<body><nav>m</nav>{parts}<footer>f</footer></body>"), (2, "http://b.org/1", deep), (3, "http://b.org/2", "<ul>" + "<li>x" * 3000), (4, "http://b.org/3", "<a " * 50_000)]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Title On search supercali xy Intent so a is"
    assert got[2] == "deep text" and got[3] == " ".join("x" * 3000) and got[4].startswith("<a <a")


def test_extraction_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = registry.QUERIES["op9_html_extraction"](spark, SF).collect()
    assert len(got) == len(pages)
    assert all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in got)


# 10


def kneser_ney(train, order):
    """p(context, word) of a plain interpolated modified Kneser-Ney model over lists of words."""
    grams = collections.Counter()
    unigrams = collections.Counter()
    for t in train:
        w = [*lower_words(t), "</s>"]
        unigrams.update(w)
        w = ["<s>"] * (order - 1) + w
        grams.update(tuple(w[k : k + order]) for k in range(len(w) - order + 1))
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])
    d = {k: lm_scoring.discounts([sum(v == n for v in c.values()) for n in (1, 2, 3, 4)]) for k, c in levels.items()}
    after = {k: collections.defaultdict(list) for k in levels}
    for k, c in levels.items():
        for g, n in c.items():
            after[k][g[:-1]].append(n)
    v = len(unigrams)

    def p(context, b):
        k = len(context) + 1
        lower = p(context[1:], b) if k > 1 else 1 / (v + 1)
        if context not in after[k]:
            return lower
        cut = lambda n: d[k][min(n, 3) - 1] if n else 0
        t, c = sum(after[k][context]), levels[k][(*context, b)]
        return max(c - cut(c), 0) / t + sum(map(cut, after[k][context])) / t * lower

    return p, unigrams, sum(unigrams.values()), v


@pytest.mark.parametrize("order", [2, 3])
def test_scores_match_a_plain_model(spark, docs, hard, monkeypatch, order):
    monkeypatch.setattr(lm_scoring, "BUCKET_BYTES", 20_000)  # several buckets
    d = docs.select("doc_id", "text").limit(60).unionByName(hard.where("doc_id > 1 and doc_id <> 5").select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    rows = d.collect()
    held = {r.doc_id: r.h for r in d.select("doc_id", lm_scoring.held_out().alias("h")).collect()}
    p, unigrams, n, v = kneser_ney([r.text for r in rows if not held[r.doc_id]], order)
    some = ("<s>",) * (order - 2) + ("the",)
    assert abs(sum(p(some, w) for w in unigrams) + p(some, "never seen") - 1) < 1e-9
    model = lm_scoring.train(d.where(~lm_scoring.held_out()), order=order)
    assert model.buckets > 3
    got = {r.doc_id: r for r in lm_scoring.score(d, model, out=lm_scoring.held_out()).collect()}
    for r in rows:
        w = [*lower_words(r.text), "</s>"]
        g = got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens, g.held_out) == (len(w), sum(x in unigrams for x in w), n, held[r.doc_id])
        assert math.isclose(g.base_score, sum(math.log10((unigrams[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        padded = ["<s>"] * (order - 1) + w
        want = sum(math.log10(p(tuple(padded[k : k + order - 1]), padded[k + order - 1])) for k in range(len(w)))
        assert math.isclose(g.score, want, rel_tol=1e-9)


def test_scoring_query(spark):
    import zlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    n = sum(len(lower_words(t)) + 1 for t in train)
    got = registry.QUERIES["op10_lm_scoring"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.held_out, r.n_tokens, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2, len(lower_words(texts[r.doc_id])) + 1, n)
        assert r.held_out or r.n_known == r.n_tokens
        assert r.score < 0 and r.base_score < 0


def test_longer_context_scores_better(spark, docs):
    d = docs.where("doc_id % 10 < 8")
    sums = [lm_scoring.score(d, lm_scoring.train(d, order=k)).agg(F.sum("score")).first()[0] for k in (2, 3)]
    assert sums[1] > sums[0]


@pytest.mark.parametrize("order", [2, 3])
def test_scores_of_hard_rows(spark, hard, empty, order):
    model = lm_scoring.train(hard, order=order)
    assert lm_scoring.score(hard, model).count() == len(HARD) and lm_scoring.score(empty, model).count() == 0
    none = lm_scoring.train(empty, order=order)
    assert {r.score for r in lm_scoring.score(hard.where("doc_id = 3"), none).collect()} == {0.0}
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    p, *_ = kneser_ney(["a b"], order)
    padded = ["<s>"] * (order - 1) + ["a", "b", "</s>"]
    want = sum(math.log10(p(tuple(padded[k : k + order - 1]), padded[k + order - 1])) for k in range(3))
    assert math.isclose(lm_scoring.score(one, lm_scoring.train(one, order=order)).first().score, want, rel_tol=1e-9)


# Registered queries and the pipeline


def test_registered_sql(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in registry.ORACLES.items():
        d = registry.QUERIES[name](spark, SF)
        r = c.execute(sql)
        names = [x[0] for x in r.description]
        want = sorted(repr(tuple(x[names.index(k)] for k in sorted(names))) for x in r.fetchall())
        assert sorted(repr(tuple(x[k] for k in sorted(d.columns))) for x in d.collect()) == want, name


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_stages_take_hard_rows(spark, hard, empty, tmp_path):
    import corpus_pipeline

    hard.sparkSession.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    counts = {name: stage(spark, hard, str(tmp_path)).count() for name, stage in corpus_pipeline.STAGES}
    assert counts["toxicity"] == counts["sentencepiece"] == len(HARD) and counts["quality_rules"] == 0  # the long text repeats itself
    assert counts["ngram_join"] == len(HARD) - 1 and counts["mixing"] > 0
    assert all(stage(spark, empty, str(tmp_path)).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_pipeline(spark, docs):
    import corpus_pipeline

    kept = {}
    d = docs
    for name, stage in corpus_pipeline.STAGES:
        before = d.count()
        d = stage(spark, d, SF).cache()
        kept[name] = d.count()
        if name in ("quality_rules", "toxicity", "ngram_join"):
            assert kept[name] <= before and d.columns == docs.columns
        if name == "quality_rules":
            assert all(statistics(r.text)[0] >= 50 for r in d.collect())
        if name == "ngram_join":
            assert all(c == i for i, (_, c) in components({r.doc_id: r.text for r in d.collect()}).items())
        if name == "mixing":
            assert max(r["count"] for r in d.groupBy("doc_id").count().collect()) <= 2
    assert kept["sentencepiece"] == kept["mixing"] > 0 and d.where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == kept["sentencepiece"]


def test_models_of_many_buckets_need_few_descriptors(spark, docs, monkeypatch):
    """200 buckets under a limit of 256 descriptors in the scoring process; a lost file is an error."""
    import os
    import resource

    from loomgraph.llm import shared_files

    monkeypatch.setattr(lm_scoring, "BUCKET_BYTES", 1 + sum(len((r.text or "").encode()) for r in docs.collect()) // 200)
    model = lm_scoring.train(docs)
    assert model.buckets >= 200 and model.wrote["grams"].sum() > 150
    shared_files._maps.clear()
    soft, hard_limit = resource.getrlimit(resource.RLIMIT_NOFILE)
    texts = [r.text or "" for r in docs.limit(40).collect()]

    def scored():
        import pyarrow as pa

        out = []
        for _, data, offsets in textcore.chunks(pa.array(texts)):
            u, v, w, _ = lm_scoring.tokens_of(*textcore.words(data, offsets))
            out.append(lm_scoring.score_tokens(model, u, v, w)[2])
        return np.concatenate(out)

    most = len(os.listdir("/proc/self/fd")) + 200
    try:
        resource.setrlimit(resource.RLIMIT_NOFILE, (min(most, soft), hard_limit))
        got = scored()
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard_limit))
    assert len(shared_files._maps) <= most // 2 < 4 * 150 and np.isfinite(got).all()
    shared_files._maps.clear()
    os.remove(f"{model.path.removeprefix('file://')}/grams-{int(np.flatnonzero(model.wrote['grams'])[0])}")
    with pytest.raises(FileNotFoundError):
        scored()


def test_arrays_of_a_file(tmp_path):
    from loomgraph.llm import shared_files

    arrays = {"a": np.arange(5, dtype=np.uint8), "none": np.zeros((0, 4), np.int64), "two": np.arange(6.0).reshape(2, 3)}
    shared_files.write_arrays(f"file://{tmp_path}/x", arrays)
    got = shared_files.mapped(f"file://{tmp_path}/x")
    assert got.keys() == arrays.keys() and all(np.array_equal(got[k], v) and got[k].dtype == v.dtype for k, v in arrays.items())


def blocks_of(html):
    out, todo = [], [html_extraction.parse(html)]
    for n in todo:
        out += [(order, text, n.boilerplate) for order, text, _ in n.parts]
        todo += n.children
    return [(text, bad) for _, text, bad in sorted(out)]


def test_markup_that_pages_have():
    kept = lambda html: [t for t, bad in blocks_of(html) if not bad]
    assert kept("<p data-x=don't>Hello it's me</p><p>it's fine</p>") == ["Hello it's me", "it's fine"]
    assert kept("<p title=\"a > b\" data-y = '>'>one</p><p a='>two</p>") == ["one", "two"]
    assert kept("<hgroup>a</hgroup><fieldset><legend>b</legend>c</fieldset>") == ["a", "b", "c"]
    assert kept('<div class="share-prices">a</div><div class="menu-recipes">b</div><div id="ad-hoc">c</div><div class="login-article">d</div>') == ["a", "b", "c", "d"]
    assert kept('<div class="ad-slot">a</div><div class="site-header_2">b</div><div class="cookie-banner">c</div><div class="sidebar">d</div>') == []
    assert kept("<p>a<svg>b<p>c<svg>x</svg>d") == ["ad"] and kept("<p>a<svg> b<p>c<select>") == ["a b", "c"]


def test_long_and_unclosed_pages_are_quick():
    import time

    def shape(n, every=0):
        return html_extraction.fold(html_extraction.parse("".join(f"<h2>a</h2><p>b</p>{'<ul><li>x</ul>' if every and k % every == 0 else ''}" for k in range(n))))

    began = time.process_time()
    count, pairs = html_extraction.align(shape(5000), shape(5000))
    assert count == len(pairs) == 10_001
    count, pairs = html_extraction.align(shape(1500, 7), shape(1400, 5))
    assert count == len(pairs) >= 2801
    assert sum(len(t) for t, _ in blocks_of("<svg><p>a" * 100_000)) == 100_000
    assert time.process_time() - began < 60


def test_alignments_weigh_most(monkeypatch):
    """Lists, arrays and halves against the plain recursion."""
    rng = random.Random(6)

    def plain(a, b, weight):
        rows = [[0] * (len(b) + 1)]
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(max(rows[-1][j + 1], row[j], rows[-1][j] + weight(x, y)))
            rows.append(row)
        return rows[-1][-1]

    for few, held in ((1 << 10, 1 << 26), (0, 1 << 26), (0, 6)):
        monkeypatch.setattr(html_extraction, "FEW_CELLS", few)
        monkeypatch.setattr(html_extraction, "HELD_CELLS", held)
        for _ in range(100):
            a, b = ([rng.randrange(6) for _ in range(rng.randrange(14))] for _ in range(2))
            table = {(x, y): (x + 1 if x == y else rng.choice((0, 0, 1))) for x in range(6) for y in range(6)}
            weight = lambda x, y: table[x, y]  # noqa: B023, E731
            total, places = html_extraction.best_alignment(a, b, weight)
            assert total == plain(a, b, weight) == sum(table[a[i], b[j]] for i, j in places)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(places, places[1:])) and all(table[a[i], b[j]] for i, j in places)
