"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A word's input is the sum of its own vector, if training knew it, and the sum of
the vectors of all its character n-grams over the root of their number. Overlapping windows of words run through a
gated recurrent unit in either direction; attention pools their states to one
logit. A document's score is calibrated from its highest window. Training is numpy
on the driver, on a bounded sample; scoring is numpy in the tasks, over all
windows of whole texts."""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fresh

#: Words of a window, and from one window's start to the next.
WINDOW, STEP = 16, 8
HIDDEN, DIM, GRAMS = 8, 16, 1 << 16
#: Lengths of a word's n-grams, in bytes; longer words are cut into pieces.
SIZES, PIECE, OVERLAP = (3, 4, 5), 24, 12
#: The most labelled documents of each class that are drawn to the driver.
MAX_TOXIC, MAX_CLEAN = 2_000, 4_000
#: Longer texts are not drawn for training (they are scored like all others).
MAX_TRAIN_CHARS = 20_000
THRESHOLD = 0.3
#: Rounds of choosing windows anew; steps in all at least; clean windows looked
#: through for the worst.
ROUNDS, MIN_STEPS, MINED = 4, 480, 40_000
BATCH, RATE, SEED = 256, 0.05, 11
_STRIP = b".,;:!?\"'()[]{}<>*#-_"
_EMPTY_LOGIT = -20.0


def grams(words: list[bytes], lot: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, where each word's begin): one bucket for each n-gram of SIZES bytes
    of the whole word, with a mark before and behind it. The empty word has one
    n-gram, number 0, whose vector stays zero."""
    parts = [_grams(words[k : k + lot]) for k in range(0, len(words), lot)] or [_grams([])]
    shifts = np.cumsum([0, *(len(buckets) for buckets, _ in parts[:-1])])
    return np.concatenate([buckets for buckets, _ in parts]), np.concatenate([begin + shift for (_, begin), shift in zip(parts, shifts)])


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(b"<%s>" % w for w in words), np.uint8).astype(np.uint64)
    ends = np.cumsum([len(w) + 2 for w in words]) if words else np.zeros(0, np.int64)
    left = np.repeat(ends, [len(w) + 2 for w in words]) - np.arange(len(flat)) if words else ends
    filled = np.array([len(w) > 0 for w in words], bool)
    inside = np.repeat(filled, [len(w) + 2 for w in words]) if words else filled
    owners, buckets = [np.flatnonzero(~filled)], [np.zeros(int((~filled).sum()), np.int32)]
    word_at = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words]) if words else ends
    with np.errstate(over="ignore"):
        h = np.full(len(flat), 0xCBF29CE484222325, np.uint64)
        for n in range(1, max(SIZES) + 1):
            # The hash of the n bytes from each place on.
            h = (h[: len(flat) - n + 1] ^ flat[n - 1 :]) * np.uint64(0x100000001B3)
            if n in SIZES:
                at = np.flatnonzero((left[: len(h)] >= n) & inside[: len(h)])
                x = (h[at] ^ h[at] >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
                owners.append(word_at[at])
                buckets.append((1 + x % np.uint64(GRAMS - 1)).astype(np.int32))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(buckets)[order], np.searchsorted(owner[order], np.arange(len(words)))


def split(text: bytes | None) -> list[bytes]:
    """Words of a text, lower-cased (A-Z), without the punctuation around them. One
    of more than PIECE bytes counts as so many overlapping pieces: each has its own
    place in the windows, and what it holds does not drown in the rest."""
    words = [w.strip(_STRIP) for w in (text or b"").lower().split()]
    if all(len(w) <= PIECE for w in words):
        return words
    return [p for w in words for p in ([w] if len(w) <= PIECE else [w[k : k + PIECE] for k in range(0, len(w) - OVERLAP, PIECE - OVERLAP)])]


@dataclass
class Inputs:
    """Words as numbers (0 if unknown) and n-grams: buckets in a row, and where each
    word's begin; no word has none."""

    known: np.ndarray
    buckets: np.ndarray
    begin: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.begin, append=len(self.buckets))

    @property
    def root(self) -> np.ndarray:
        return np.sqrt(self.count).astype(np.float32)[:, None]

    def take(self, rows: np.ndarray) -> Inputs:
        n = self.count[rows]
        begin = np.cumsum(n) - n
        flat = np.repeat(self.begin[rows] - begin, n) + np.arange(n.sum())
        return Inputs(self.known[rows], self.buckets[flat], begin)


@dataclass
class Model:
    vocab: dict[bytes, int]
    word: np.ndarray
    gram: np.ndarray
    gates: list  # of either direction: W (DIM, 3H), U (H, 3H), b (3H)
    attend: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    calibration: tuple[float, float, float] = (1.0, 0.0, 0.0)

    def inputs(self, words: list[bytes]) -> Inputs:
        """Of each word: its number (0 if unknown) and its n-grams."""
        known = np.array([self.vocab.get(w, 0) for w in words], np.int64)
        return Inputs(known, *grams(words))

    def vectors(self, x: Inputs) -> np.ndarray:
        out = np.empty((len(x.known), DIM), np.result_type(self.word, self.gram))
        for at in range(0, len(x.known), 10_000):
            some = x.take(np.arange(at, min(at + 10_000, len(x.known))))
            sums = np.add.reduceat(self.gram[some.buckets], some.begin, axis=0)
            out[at : at + 10_000] = self.word[some.known] + sums / some.root
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _scan(projected: np.ndarray, index: np.ndarray, u: np.ndarray, back: bool, keep: list | None = None) -> np.ndarray:
    """States (windows, WINDOW, HIDDEN) of one direction. projected: the input's
    share of the gates for each word."""
    n, h = len(index), np.zeros((len(index), HIDDEN), np.float32)
    out = np.empty((n, WINDOW, HIDDEN), np.float32)
    for t in range(WINDOW - 1, -1, -1) if back else range(WINDOW):
        x = projected[index[:, t]]
        zr = _sigmoid(x[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(x[:, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
        new = h + z * (c - h)
        if keep is not None:
            keep.append((t, h, z, r, c))
        h = out[:, t] = new
    return out


def logits(m: Model, vectors: np.ndarray, index: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """A logit per window. index: numbers of the words of each window, 0 for none."""
    tapes = [[], []] if keep is not None else [None, None]
    states = [_scan(vectors @ w + b, index, u, d == 1, tapes[d]) for d, (w, u, b) in enumerate(m.gates)]
    both = np.concatenate(states, axis=2)
    e = np.where(index > 0, both @ m.attend, -1e9)
    a = np.exp(e - e.max(axis=1, keepdims=True))
    a /= a.sum(axis=1, keepdims=True)
    pooled = (a[:, None, :] @ both)[:, 0]
    if keep is not None:
        keep |= {"tapes": tapes, "both": both, "a": a, "pooled": pooled}
    return pooled @ m.out + m.bias[0]


def _sums(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of values by their number, 0 to n - 1."""
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
    out = np.zeros((n, values.shape[1]), np.float32)
    out[at[order][first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def _gradients(m: Model, vectors, index, labels) -> tuple[list, np.ndarray]:
    """Gradients of the mean logistic loss: by parameter, and by word vector."""
    keep: dict = {}
    p = _sigmoid(logits(m, vectors, index, keep))
    d = ((p - labels) / len(index)).astype(np.float32)
    both, a = keep["both"], keep["a"]
    d_out, d_bias = keep["pooled"].T @ d, np.array([d.sum()], np.float32)
    d_pooled = d[:, None] * m.out
    d_a = (both @ d_pooled[:, :, None])[:, :, 0]
    d_e = a * (d_a - (a * d_a).sum(axis=1, keepdims=True))
    d_both = a[:, :, None] * d_pooled[:, None, :] + d_e[:, :, None] * m.attend
    d_attend = np.einsum("nt,nth->h", d_e, both)
    d_vectors, d_gates = np.zeros_like(vectors), []
    for k, (w, u, b) in enumerate(m.gates):
        d_states = d_both[:, :, k * HIDDEN : (k + 1) * HIDDEN]
        d_u, d_at, dh = np.zeros_like(u), np.empty((*index.shape, 3 * HIDDEN), np.float32), np.zeros((len(index), HIDDEN), np.float32)
        for t, h, z, r, c in reversed(keep["tapes"][k]):
            dh = dh + d_states[:, t]
            dc = dh * z * (1 - c * c)
            d_rh = dc @ u[:, 2 * HIDDEN :].T
            dzr = np.concatenate([dh * (c - h) * z * (1 - z), d_rh * h * r * (1 - r)], axis=1)
            d_u[:, : 2 * HIDDEN] += h.T @ dzr
            d_u[:, 2 * HIDDEN :] += (r * h).T @ dc
            d_at[:, t, : 2 * HIDDEN], d_at[:, t, 2 * HIDDEN :] = dzr, dc
            dh = dh * (1 - z) + d_rh * r + dzr @ u[:, : 2 * HIDDEN].T
        d_in = _sums(d_at.reshape(-1, 3 * HIDDEN), index.ravel(), len(vectors))
        d_vectors += d_in @ w.T
        d_gates += [vectors.T @ d_in, d_u, d_in.sum(axis=0)]
    return [*d_gates, d_attend, d_out, d_bias], d_vectors


def _windows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(index (windows, WINDOW), document of each window) of documents of word
    numbers; 0 fills up."""
    starts = [np.arange(0, max(1, len(d) - WINDOW + STEP), STEP) if len(d) else np.zeros(0, np.int64) for d in docs]
    owner = np.repeat(np.arange(len(docs)), [len(s) for s in starts])
    base = np.cumsum([0, *(len(d) for d in docs)])
    flat = np.concatenate([*docs, np.zeros(1, np.int64)]) if docs else np.zeros(1, np.int64)
    if not len(owner):
        return np.zeros((0, WINDOW), np.int64), owner
    at = np.concatenate(starts)
    index = np.zeros((len(owner), WINDOW), np.int32)
    size, first = np.diff(base)[owner], base[owner]
    for k in range(WINDOW):
        inside = at + k < size
        index[inside, k] = flat[(at + k + first)[inside]]
    return index, owner


def _score_windows(m: Model, vectors: np.ndarray, index: np.ndarray, lot: int = 4096) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.float32), *(logits(m, vectors, index[i : i + lot]) for i in range(0, len(index), lot))])


def _best(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The highest value of each of n documents; _EMPTY_LOGIT without windows."""
    best = np.full(n, _EMPTY_LOGIT)
    np.maximum.at(best, owner, values)
    return best


def train(texts: list[bytes], labels: list[int], seed: int = SEED) -> Model | None:
    """A model of documents and their labels, or None unless both labels occur.

    Only documents are labelled, not windows. So a toxic document teaches its most
    suspicious window: at first that with the highest log odds of a word or n-gram
    over the documents, then as the network itself says. A clean one
    teaches that all its windows are clean: some at random, and its worst. A
    sixth of the documents is left out to calibrate scores."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    number: dict[bytes, int] = {b"": 0}
    docs = [np.array([number.setdefault(w, len(number)) for w in split(t)], np.int32) for t in texts]
    words = list(number)
    seen = np.zeros((len(words), 2))
    for d, label in zip(docs, labels):
        seen[np.unique(d), int(label)] += 1
    total = np.array([(y == 0).sum(), (y == 1).sum()])
    vocab = {words[k]: j for j, k in enumerate(np.flatnonzero(seen.sum(axis=1) >= 3), 1) if k}
    odds = _log_odds(words, seen, total)

    weight = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    gates = [(weight(DIM, 3 * HIDDEN), weight(HIDDEN, 3 * HIDDEN), np.zeros(3 * HIDDEN, np.float32)) for _ in "fb"]
    # Vectors begin at nothing: what training never met stays without effect.
    gram = np.zeros((GRAMS, DIM), np.float32)
    m = Model(vocab, np.zeros((len(vocab) + 2, DIM), np.float32), gram, gates, weight(2 * HIDDEN), weight(2 * HIDDEN), np.zeros(1, np.float32))
    x = m.inputs(words)
    index, owner = _windows(docs)
    held = np.arange(len(docs)) % 6 == 5
    if y[held].min(initial=1) == y[held].max(initial=0) or y[~held].min(initial=1) == y[~held].max(initial=0):
        held[:] = False
    toxic, clean = np.flatnonzero(~held[owner] & (y[owner] == 1)), np.flatnonzero(~held[owner] & (y[owner] == 0))
    guess, squares, steps = odds[index].max(axis=1), None, 0
    for part in range(ROUNDS):
        chosen = toxic[_top(guess[toxic], owner[toxic])]
        seen_clean = rng.choice(clean, min(len(clean), MINED), replace=False)
        if part:
            guess[seen_clean] = _score_windows(m, m.vectors(x), index[seen_clean])
        worst = seen_clean[np.argsort(-guess[seen_clean], kind="stable")[: 3 * len(chosen) + 200]]
        while steps < MIN_STEPS * (part + 1) // ROUNDS:
            some = rng.choice(clean, min(len(clean), 6 * len(chosen) + 2000), replace=False)
            pick = np.concatenate([chosen, worst, some])
            target = (np.arange(len(pick)) < len(chosen)).astype(np.float32)
            order = rng.permutation(len(pick))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                local, where = np.unique(index[pick[rows]], return_inverse=True)
                if local[0] != 0:
                    local, where = np.concatenate([[0], local]), where + 1
                some_words = x.take(local)
                flat, by_word = _gradients(m, m.vectors(some_words), where.reshape(-1, WINDOW), target[rows])
                squares = _step(m, flat, by_word, some_words, squares)
                steps += 1
        guess[toxic] = _score_windows(m, m.vectors(x), index[toxic])
    used = held if held.any() else ~held
    rows = np.flatnonzero(used[owner])
    best = _best(_score_windows(m, m.vectors(x), index[rows]), owner[rows], len(docs))
    m.calibration = _calibrate(best[used], np.log1p([len(d) for d, k in zip(docs, used) if k]), y[used])
    return m


def _log_odds(words: list[bytes], seen: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Of each word the highest log odds of itself and of its n-grams."""
    score = lambda s: np.log((s[..., 1] + 0.2) / (total[1] + 1)) - np.log((s[..., 0] + 0.2) / (total[0] + 1))
    out = score(seen)
    buckets, begin = grams(words)
    owner = np.repeat(np.arange(len(words)), np.diff(begin, append=len(buckets)))
    sums = np.stack([np.bincount(buckets, seen[owner, k], GRAMS) for k in range(2)], axis=1)
    out = np.maximum(out, np.maximum.reduceat(score(sums)[buckets], begin))
    out[0] = -1e9
    return out


def _top(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The place of each document's highest value."""
    order = np.lexsort((-values, owner))
    return order[np.r_[True, np.diff(owner[order]) > 0]] if len(order) else order


def _step(m: Model, flat: list, by_word: np.ndarray, x: Inputs, squares: list | None) -> list:
    """One step of Adagrad."""
    dense = [p for g in m.gates for p in g] + [m.attend, m.out, m.bias]
    if squares is None:
        squares = [np.full(p.shape, 1e-3, np.float32) for p in [*dense, m.word, m.gram]]
    for p, g, s in zip(dense, flat, squares):
        s += g * g
        p -= RATE * g / np.sqrt(s)
    for p, s, at, g in ((m.word, squares[-2], x.known, by_word), (m.gram, squares[-1], x.buckets, np.repeat(by_word / x.root, x.count, axis=0))):
        rows, where = np.unique(at, return_inverse=True)
        d = _sums(g, where, len(rows))
        d[rows == 0] = 0
        s[rows] += d * d
        p[rows] -= RATE * d / np.sqrt(s[rows])
    return squares


def _calibrate(best: np.ndarray, size: np.ndarray, y: np.ndarray, steps: int = 500) -> tuple[float, float, float]:
    """Logistic regression of labels on the highest logit and the log of the length."""
    x = np.stack([np.clip(best, -20, 20) / 5, size / 5, np.ones_like(size)], axis=1)
    w = np.array([3.0, 0.0, 0.0])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(3)
        step = np.linalg.solve(h, x.T @ (p - y) + 0.02 * (w - np.array([3.0, 0.0, 0.0])))
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0] / 5), float(w[1] / 5), float(w[2])


def scores(m: Model | None, texts: list[bytes | None]) -> np.ndarray:
    """A score for each text."""
    if m is None:
        return np.zeros(len(texts))
    number: dict[bytes, int] = {b"": 0}
    docs = [np.array([number.setdefault(w, len(number)) for w in split(t)], np.int64) for t in texts]
    vectors = m.vectors(m.inputs(list(number))).astype(np.float32)
    index, owner = _windows(docs)
    best = _best(_score_windows(m, vectors, index), owner, len(docs))
    a, b, c = m.calibration
    return _sigmoid(a * np.clip(best, -20, 20) + b * np.log1p([len(d) for d in docs]) + c)


def sample(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", most_toxic: int = MAX_TOXIC, most_clean: int = MAX_CLEAN, seed: int = SEED) -> tuple[list[bytes], list[int]]:
    """Texts and labels to train on: about most_toxic and most_clean at most, drawn
    by a seeded hash of the id; never those whose crc32 of the id is 2 mod 4."""
    known = labels.select(col(labels, id_col).cast("long").alias("id"), col(labels, label_col).cast("int").alias("label"))
    known = known.filter("id IS NOT NULL AND label IN (0, 1)").filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("label") == 1, min(1.0, most_toxic / max(1, n.get(1, 0)))).otherwise(min(1.0, most_clean / max(1, n.get(0, 0))))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) < share * 1_000_000
    text = docs.select(col(docs, id_col).cast("long").alias("id"), col(docs, text_col).alias("text")).filter(F.length("text") <= MAX_TRAIN_CHARS)
    rows = text.join(F.broadcast(known.filter(drawn)), "id").select("id", F.col("text").cast("binary").alias("text"), "label").toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
    first = np.flatnonzero(np.r_[True, np.diff(rows["id"].to_numpy()) != 0]) if rows.num_rows else []
    rows = rows.take(pa.array(first, pa.int64()))
    return rows["text"].to_pylist(), rows["label"].to_pylist()


def held_out(id_):
    return F.crc32(id_.cast("string").cast("binary")) % 4 == 2


def score_documents(docs: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a column score_col in [0, 1]: higher is likelier toxic.

    All windows of the whole text count. Null and empty texts get the score of no
    window, near 0; without a model all scores are 0. Each task scores its batches
    in lots of bounded size; nothing is shuffled. Rows, their order of columns,
    repeats and nulls stay; no rows give none."""
    name, = fresh(docs, score_col)
    text_at = docs.columns.index(text_col)
    # Its fields only: an instance would be pickled by the name of its class.
    shared = docs.sparkSession.sparkContext.broadcast(model and [getattr(model, f.name) for f in fields(model)])
    schema = docs.limit(0).withColumn(name, F.lit(0.0)).schema

    def run(batches):
        m = shared.value and Model(*shared.value)
        for b in batches:
            lot, size, out = [], 0, []
            for t in b.column(text_at).cast(pa.binary()):
                lot.append(t.as_py())
                size += len(lot[-1] or b"")
                if size > 1 << 20:
                    out.append(scores(m, lot))
                    lot, size = [], 0
            out.append(scores(m, lot))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out), pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", threshold: float = THRESHOLD, **how) -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted. The model learns from
    the labels that are not held out; a null id is not held out."""
    model = train(*sample(docs, labels, id_col, text_col, label_col, **how))
    slim = docs.select(col(docs, id_col).alias("id"), col(docs, text_col).alias("text"))
    x = score_documents(slim, model)
    return x.select("id", F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
