"""Operator 1, toxicity: a lexicon trie intersected with Levenshtein automata, and context windows.

The lexicon is a fixed list of insults plus words and word stems learned from labelled documents.
Trie and automata are intersected once, by subset construction, into transition tables; all words
of a batch then walk a table together, a numpy gather for each letter. Words of four letters or
more match within one edit (insertion, deletion, substitution or transposition), of seven or more
within two, and stems of four or more with one edit before their last letter; shorter ones exactly.
Every hit is looked at in its window: inside quotation marks or near a word of reporting it counts
as quoted, near a second-person word as directed. A logistic regression over the counts, fitted on a
bounded sample of labelled rows, gives the score.

Defined results: a null or empty text has no hits and the score of such a text; null labels and null
ids teach nothing; with no usable labels the fixed lexicon and fixed weights score; repeated rows
score alike; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import textcore
from loomgraph.llm.common import stored, table

#: Labelled rows that the learner may see: those of smallest md5(doc_id).
SAMPLE_ROWS = 20_000
#: Entries of one table at most, half as many where they allow two edits; a lexicon has as many tables as it needs.
TABLE_TERMS = 64
STEM_LENGTHS = (4, 5, 6, 7)
WINDOW = 8  # words on either side of a hit
THRESHOLD = 0.3

# Insults that the lexicon always holds.
INSULTS = "idiot stupid moron scum trash loser clown pathetic worthless disgusting imbecile bastard dimwit scumbag idiota imbecil estupido idiote stupide dummkopf arschloch".split()
# Words of reporting, and of the second person.
REPORTING = frozenset("said says wrote writes called calls quote quoted quoting quotes term word words reported reportedly allegedly sagte schrieb nannte zitat dit écrit cité dijo escribió citado".split())
SECOND_PERSON = frozenset("you your you're youre u yourself du dich dir dein ihr euch tu toi te ton vous votre tú ti usted eres sos vosotros".split())
SEPARATORS = " \t\n\x0b\x0c\r,.;:?()[]{}<>\"“”„«»|/\\-_=+~^`–—…"
EDGES = "*@$!#%&'’‘"
OPENING, CLOSING, STRAIGHT = "“„«", "”»", '"'

_KIND = np.full(0x10000, 2, np.uint8)  # 0 separator, 1 stripped at the ends of a word, 2 other
_KIND[[ord(c) for c in SEPARATORS]] = 0
_KIND[0x2000:0x200B] = 0
_KIND[0xA0] = _KIND[0x85] = _KIND[0x3000] = 0
_KIND[[ord(c) for c in EDGES]] = 1
FEATURES = ("exact", "stems", "fuzzy", "quoted", "directed", "distinct", "density", "excess", "near")


@dataclass
class Automaton:
    """Transitions[state, letter class]; state 0 is dead, 1 the start. kind and term speak at a word's end."""

    letters: np.ndarray  # letter class of each code point below 0x10000
    moves: np.ndarray
    kind: np.ndarray  # 0 nothing, 1 a word, 2 a word with edits, 3 a stem, 4 a stem with an edit
    term: np.ndarray
    terms: list[str]


def build_automaton(words: list[str], stems: list[str], fuzzy_from: int = 5, twice_from: int = 7, swaps: bool = False) -> Automaton:
    """The trie of all entries intersected with the automata of their lengths: a state of the table is
    the set of (trie node, edits so far, letter that completes a swap) that the letters read can be at.
    A stem is met where its last letter is, whatever follows; with swaps, a transposition is one edit."""
    terms = sorted(set(words)) + sorted(set(stems))
    n_words = len(set(words))
    children: list[dict[str, int]] = [{}, {}, {}]  # roots by the edits that their entries allow
    budget = [0, 1, 2]
    ends: dict[int, int] = {}
    heads: dict[int, int] = {}
    for t, term in enumerate(terms):
        node = 0 if len(term) < fuzzy_from else 2 if t < n_words and len(term) >= twice_from else 1
        for c in term:
            if c not in children[node]:
                children.append({})
                budget.append(budget[node])
                children[node][c] = len(children) - 1
            node = children[node][c]
        (ends if t < n_words else heads).setdefault(node, t)
    alphabet = sorted({c for t in terms for c in t})
    met = -1  # the node of states that have met a stem with an edit

    def closed(states: set[tuple[int, int, str]]) -> frozenset:
        """Adds letters that the text leaves out, and keeps the fewest edits of each node."""
        best: dict[tuple[int, str], int] = {}
        todo = sorted(states, key=lambda s: s[1])
        for node, edits, swap in todo:  # grows while it is read, by states of more edits
            if best.get((node, swap), 3) <= edits:
                continue
            best[node, swap] = edits
            if node != met and not swap and edits < budget[node]:
                todo += [(x, edits + 1, "") for x in children[node].values()]
        return frozenset((n, e, w) for (n, w), e in best.items())

    def step(state: frozenset, c: str) -> tuple[frozenset, int | None]:
        """What the letter leads to, and the stem that it ends without an edit."""
        nxt: set[tuple[int, int, str]] = set()
        read = []
        for node, edits, swap in state:
            if node == met:
                nxt.add((met, edits, ""))
            elif swap:
                if swap == c:
                    read.append((node, edits))
            else:
                if c in children[node]:
                    read.append((children[node][c], edits))
                if edits < budget[node]:
                    nxt.add((node, edits + 1, ""))
                    for a, x in children[node].items():
                        nxt.add((x, edits + 1, ""))
                        if swaps and a != c and c in children[x]:
                            nxt.add((children[x][c], edits + 1, a))
        for node, edits in read:
            nxt.add((node, edits, ""))
            if edits and node in heads:
                nxt.add((met, 0, ""))
        return closed(nxt), min((heads[n] for n, e in read if e == 0 and n in heads), default=None)

    start = closed({(0, 0, ""), (1, 0, ""), (2, 0, "")})
    index: dict = {frozenset(): 0, start: 1}
    moves, kinds, out = [[0] * (len(alphabet) + 1)], [0, 0], [-1, -1]
    queue = [start]
    for state in queue:  # grows while it is read
        row = []
        if isinstance(state, int):  # a stem was read: whatever follows
            moves.append([index[state]] * (len(alphabet) + 1))
            continue
        for c in ["", *alphabet]:
            key, stem = step(state, c)
            if stem is not None:
                key = stem
            if key not in index:
                index[key] = len(index)
                queue.append(key)
                exact = near = None
                if stem is None:
                    exact = min((ends[n] for n, e, w in key if e == 0 and not w and n in ends), default=None)
                    near = min((ends[n] for n, e, w in key if e and not w and n in ends), default=None)
                like = stem is None and (met, 0, "") in key
                kinds.append(3 if stem is not None else 1 if exact is not None else 2 if near is not None else 4 if like else 0)
                out.append(next((t for t in (stem, exact, near) if t is not None), len(terms) if like else -1))
            row.append(index[key])
        moves.append(row)
    letters = np.zeros(0x10000, np.int32)
    for k, c in enumerate(alphabet, 1):
        if ord(c) < 0x10000:
            letters[ord(c)] = k
    return Automaton(letters, np.array(moves, np.int32), np.array(kinds, np.int8), np.array(out, np.int32), terms)


def word_spans(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of words in code points of texts laid end to end: runs of other than separators,
    without the signs at their ends. offsets: where each text begins, and the end."""
    kind = _KIND[np.minimum(points, 0xFFFF)]
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    run = kind > 0
    head, tail = run.copy(), run.copy()
    head[1:] &= ~run[:-1]
    tail[:-1] &= ~run[1:]
    full = offsets[:-1] < offsets[1:]
    head[offsets[:-1][full]] = run[offsets[:-1][full]]
    tail[offsets[1:][full] - 1] = run[offsets[1:][full] - 1]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail)
    solid = np.flatnonzero(kind == 2)
    if not len(solid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = np.searchsorted(solid, starts)
    b = np.searchsorted(solid, ends, "right") - 1
    ok = (a < len(solid)) & (b >= a)
    return solid[np.minimum(a, len(solid) - 1)[ok]], solid[b[ok]] + 1


def walk(auto: Automaton, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of each word that ends in a speaking state, that state): all words step together."""
    letters = auto.letters[np.minimum(points, 0xFFFF)]
    alive, state, at = np.arange(len(starts)), np.ones(len(starts), np.int32), starts.copy()
    hits, states = [], []
    while len(alive):
        state = auto.moves[state, letters[at]]
        at = at + 1
        done = at == ends[alive]
        speaks = done & (auto.kind[state] > 0)
        hits.append(alive[speaks])
        states.append(state[speaks])
        go = ~done & (state > 0)
        alive, state, at = alive[go], state[go], at[go]
    if not hits:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    hit, st = np.concatenate(hits), np.concatenate(states)
    order = np.argsort(hit, kind="stable")
    return hit[order], st[order]


def build_automata(words: list[str], stems: list[str]) -> list[Automaton]:
    """Tables of at most TABLE_TERMS entries each: one of all would have too many states."""
    long, short = ([w for w in sorted(set(words)) if (len(w) >= 7) == big] for big in (True, False))
    stems = sorted(set(stems))
    parts = [(some[k : k + n], []) for some, n in ((long, TABLE_TERMS // 2), (short, TABLE_TERMS)) for k in range(0, len(some), n)]
    parts += [([], stems[k : k + TABLE_TERMS]) for k in range(0, len(stems), TABLE_TERMS)]
    return [build_automaton(w, s, fuzzy_from=4, swaps=True) for w, s in parts]


def distinct_words(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one of each word's copies, which of these each word is), by 64-bit hashes."""
    h = np.zeros(len(starts), np.uint64)
    alive, at = np.arange(len(starts)), starts.copy()
    while len(alive):
        h[alive] = (h[alive] ^ (points[at].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        h[alive] ^= h[alive] >> np.uint64(29)
        at = at + 1
        go = at < ends[alive]
        alive, at = alive[go], at[go]
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    return first, inverse


def hits_of(autos: list[Automaton], points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, kind, term) of each word that some table knows: a stem before a word before what is near one."""
    first, inverse = distinct_words(points, starts, ends)
    kinds, terms, base = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), 0
    rank = np.array([0, 3, 2, 4, 1])
    for auto in autos:
        hit, state = walk(auto, points, starts[first], ends[first])
        better = rank[auto.kind[state]] > rank[kinds[hit]]
        kinds[hit[better]], terms[hit[better]] = auto.kind[state[better]], base + auto.term[state[better]]
        base += len(auto.terms) + 1
    hit = np.flatnonzero(kinds[inverse])
    return hit, kinds[inverse][hit], terms[inverse][hit]


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    low = [(t or "").lower() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
    return np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def features(auto: Automaton | list[Automaton], texts: list[str]) -> np.ndarray:
    """Counts for each text: words, exact, fuzzy and stem hits, quoted and directed ones, distinct terms, fuzzy stems."""
    points, offsets = _points(texts)
    starts, ends = word_spans(points, offsets)
    of_text = np.searchsorted(offsets, starts, "right") - 1
    out = np.zeros((len(texts), 8))
    out[:, 0] = np.bincount(of_text, minlength=len(texts))
    hit, kinds, found = hits_of([auto] if isinstance(auto, Automaton) else auto, points, starts, ends)
    if not len(hit):
        return out
    is_in = lambda chars: np.isin(points, [ord(c) for c in chars])
    straight = np.concatenate([[0], np.cumsum(is_in(STRAIGHT))])
    curly = np.concatenate([[0], np.cumsum(is_in(OPENING).astype(np.int64) - is_in(CLOSING))])
    first_word = np.searchsorted(of_text, np.arange(len(texts) + 1))
    word = lambda w: points[starts[w] : ends[w]].tobytes().decode("utf-32-le", "surrogatepass")
    seen: dict[int, set[int]] = {}
    for w, kind, term in zip(hit.tolist(), kinds.tolist(), found.tolist(), strict=True):
        d = int(of_text[w])
        a, b = max(first_word[d], w - WINDOW), min(first_word[d + 1], w + WINDOW + 1)
        near = {word(x) for x in range(a, b) if x != w}
        at, begin = starts[w], offsets[d]
        in_marks = (straight[at] - straight[begin]) % 2 == 1 or curly[at] - curly[begin] > 0
        out[d, 7 if kind == 4 else kind] += 1
        out[d, 4] += bool(in_marks or near & REPORTING)
        out[d, 5] += bool(near & SECOND_PERSON)
        seen.setdefault(d, set()).add(term)
    for d, terms in seen.items():
        out[d, 6] = len(terms)
    return out


@dataclass
class Scorer:
    auto: list[Automaton]
    rate: float  # stem hits a word in clean texts
    weights: np.ndarray  # of the inputs, the bias last
    near_rate: float = 0.0  # hits of stems with an edit a word in clean texts

    def inputs(self, counts: np.ndarray) -> np.ndarray:
        n, exact, fuzzy, stems, quoted, directed, distinct, near = counts.T
        excess = lambda k, expected: np.clip((k - expected) / np.sqrt(expected + 0.25), -3, 12)
        return np.stack([np.log1p(exact), np.log1p(stems), np.log1p(fuzzy), np.log1p(quoted), np.log1p(directed), np.log1p(distinct), 100 * (exact + stems) / (n + 50), excess(stems, self.rate * n), excess(near, self.near_rate * n)], 1)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        z = self.inputs(counts) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Without labels: an exact word of the list decides, unless it stands quoted.
FIXED_WEIGHTS = np.array([4.0, 1.0, 0.3, -3.0, 1.0, 0.5, 0.5, 0.0, 0.0, -3.0])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; columns are scaled inside."""
    scale = np.maximum(x.std(0), 1e-6)
    a = np.concatenate([x / scale, np.ones((len(x), 1))], 1)
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return np.append(w[:-1] / scale, w[-1])


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of at most `rows` labelled documents outside the held-out fold; their ids are few
    enough (bounded by `rows`) to be broadcast."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    d = docs.select(F.col("doc_id"), F.col("text")).where(F.col("text").isNotNull())
    got = d.join(F.broadcast(ids), "doc_id").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)  # repeated ids can't pass the bound
    return stored(got.select("text", (F.col("toxic") == 1).alias("toxic")).repartition(max(4, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "toxic-sample")


def _terms_of(text: str) -> tuple[set[str], set[str]]:
    points, offsets = _points([text])
    starts, ends = word_spans(points, offsets)
    low = text.lower()
    words = {low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b - a > 2}
    return words, {w[:n] for w in words for n in STEM_LENGTHS if len(w) >= n + 1}


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, stem, bad, clean): how many toxic and how many clean texts hold each term."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words, stems = _terms_of(text)
            counts[not toxic].update([(w, False) for w in words] + [(s, True) for s in stems])
    keys = list(counts[0] | counts[1])
    for k in range(0, len(keys), 50_000):
        part = keys[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.string()), pa.array([x[1] for x in part], pa.bool_()), *[pa.array([c[x] for x in part], pa.int64()) for c in counts]], ["term", "stem", "bad", "clean"])


def learn_lexicon(sample: DataFrame) -> tuple[list[str], list[str]]:
    """(words, stems) that mark toxic texts, by the odds of a term in toxic and clean ones. A stem goes in
    if several words carry it and no shorter stem already does; a word that a stem covers goes in
    if it is long enough to be met with an edit."""
    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    bad, clean = sizes.get(True, 0), sizes.get(False, 0)
    if bad < 20 or clean < 20:
        return [], []
    least = max(5, bad // 250)
    terms = sample.select("text", "toxic").mapInArrow(_count_terms, "term string, stem boolean, bad long, clean long")
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    terms = stored(terms.groupBy("term", "stem").agg(F.sum("bad").alias("bad"), F.sum("clean").alias("clean")).where(F.col("bad") >= least).withColumn("odds", odds), "toxic-terms")
    starts = F.explode(F.array_distinct(F.array(*[F.substring("term", 1, n) for n in STEM_LENGTHS])))
    below = terms.where("not stem").select(starts.alias("term"), "bad").groupBy("term").agg(F.max("bad").alias("below"))
    strong = terms.where("stem and odds >= 2").join(below, "term", "left").where(F.coalesce("below", F.lit(0)) < 0.6 * F.col("bad"))
    stems: list[str] = []
    for term in sorted((r[0] for r in strong.select("term").collect()), key=lambda t: (len(t), t)):
        if not any(term.startswith(s) for s in stems):
            stems.append(term)
    words = [r[0] for r in terms.where("not stem and odds >= 3").orderBy(F.desc("bad"), "term").select("term").collect()]
    return [w for w in words if len(w) >= 5 or not any(w.startswith(s) for s in stems)], stems


def _count_features(auto: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textcore.slices(batch, 0):
                counts = features(auto.value, part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(list(counts), pa.list_(pa.float64()))], ["toxic", "counts"])

    return run


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Scorer:
    """Lexicon and weights from a bounded sample; what the driver holds of it are counts."""
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, rows)
    words, stems = learn_lexicon(sample)
    auto = build_automata([*INSULTS, *words], stems)
    got = sample.mapInArrow(_count_features(spark.sparkContext.broadcast(auto)), "toxic boolean, counts array<double>").collect()
    y = np.array([r[0] for r in got], float)
    if not len(y) or y.sum() < 20 or (1 - y).sum() < 20:
        return Scorer(auto, 0.0, FIXED_WEIGHTS)
    x = np.array([r[1] for r in got])
    order = np.lexsort((*x.T, y))  # rows come in any order; the fit must not depend on it
    x, y = x[order], y[order]
    clean = x[y == 0]
    rate = lambda k: float(clean[:, k].sum() / max(clean[:, 0].sum(), 1))
    scorer = Scorer(auto, rate(3), FIXED_WEIGHTS, rate(7))
    scorer.weights = fit_logistic(scorer.inputs(x), y)
    return scorer


def _score(scorer: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textcore.slices(batch, batch.num_columns - 1):
                counts = features(scorer.value.auto, part.column(part.num_columns - 1).to_pylist())
                score = scorer.value.scores(counts)
                counts[:, 2] += counts[:, 7]
                more = [pa.array(counts[:, j].astype(np.int64)) for j in (1, 3, 2, 4, 5)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score), *more], [*part.schema.names[:-1], "score", *NAMES])

    return run


NAMES = ("n_exact", "n_stems", "n_fuzzy", "n_quoted", "n_directed")


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, hit counts) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    s = d.mapInArrow(textcore.lean(_score(shared)), f"id {d.schema[0].dataType.simpleString()}, score double, " + ", ".join(f"{n} long" for n in NAMES))
    return s.select(F.col("id").alias(id_col), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *NAMES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    s = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return s.select("doc_id", held_out().alias("held_out"), "score", "predicted", *NAMES)


def _rejects(scorer: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.schema.get_field_index("text")
            for part in textcore.slices(batch, text):
                keep = scorer.value.scores(features(scorer.value.auto, part.column(text).to_pylist())) < THRESHOLD
                yield part.filter(pa.array(keep))

    return run


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score THRESHOLD or more go; rows pass the scorer whole, so no join is needed."""
    scorer = spark.sparkContext.broadcast(fit(docs, table(spark, sf_dir, "labels")))
    return docs.mapInArrow(textcore.lean(_rejects(scorer)), docs.schema)
