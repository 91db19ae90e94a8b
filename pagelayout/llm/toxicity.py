"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed words and word beginnings. A term that the machine
knows has a linear weight and a short vector; the score adds the weights and the
products of the vectors of every two terms present, so that a pair can count where
neither term does. Texts of any length are one pass.

Most terms tell nothing, and a machine over all of them learns its sample by heart.
So it knows the terms with evidence of one of two kinds: the term's presence goes
with the label beyond chance; or a pair does, beyond what is known already. Pairs
are looked for by a machine over every term of some support, whatever it tells by
itself, fitted to what the first one leaves open: terms that interact get long
vectors there, and pairs of the longest are then tested one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .annotate import annotate, free_name
from .folds import thinned
from .store import Scratch
from .textops import ALNUM_WORDS, LOWER, blocks, mix, text_buffers, word_bounds, words

TERM_BITS = 20
TERMS = 1 << TERM_BITS
#: Bytes of a longer word's beginning that are terms too, so that inflected forms share one.
STEM_BYTES = (4, 6)
#: Labelled texts that the model is fitted on, about: toxic ones, and others.
SAMPLE_TOXIC = 4_000
SAMPLE_OTHER = 8_000
#: Bytes of terms that the sample may have; beyond it fewer texts are drawn.
SAMPLE_BYTES = 256 << 20
#: Squared z score of a term's presence from which it is known by itself, and texts it needs.
LEAST_CHI2 = 12.0
LEAST_TEXTS = 3
#: Texts that a term needs in the search for pairs, the terms whose pairs are then tested, and the chance of a false pair.
PAIR_TEXTS = 20
PAIR_TERMS = 2_000
PAIR_ALPHA = 0.05
PAIR_EPOCHS = 8
FACTORS = 8
EPOCHS, BATCH, RATE, L2_WEIGHT, L2_FACTOR = 60, 256, 0.03, 1e-5, 2e-2

FIELDS = T.StructType([T.StructField("score", T.DoubleType(), False)])
_TERMS = T.StructType([T.StructField("terms", T.BinaryType(), False)])


def _hashed(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - TERM_BITS)).astype(np.int32)


def text_terms(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct hashed words, and beginnings of longer ones, of each text; none for null or empty texts."""
    raw, offsets = text_buffers(column)
    out = []
    for i, j in blocks(offsets):
        bounds = offsets[i : j + 1] - offsets[i]
        part = raw[offsets[i] : offsets[j]]
        h, s, e = words(part, bounds, ALNUM_WORDS)
        kinds = [(_hashed(h), word_bounds(s, bounds))]
        for n in STEM_BYTES:
            long = s[e - s > n]
            code = np.full(len(long), n, dtype=np.uint64)
            for x in range(n):
                code = (code << np.uint64(8)) | LOWER[part[long + x]].astype(np.uint64)
            kinds.append((_hashed(mix(code)), word_bounds(long, bounds)))
        out += [np.unique(np.concatenate([term[at[r] : at[r + 1]] for term, at in kinds])) for r in range(j - i)]
    return out


@dataclass
class Model:
    place: np.ndarray  # term -> its row, or -1
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def rows(self, terms: np.ndarray) -> np.ndarray:
        at = self.place[terms]
        return at[at >= 0]

    def score(self, terms: np.ndarray) -> float:
        at = self.rows(terms)
        v = self.factors[at]
        total = v.sum(axis=0)
        z = self.bias + self.weights[at].sum() + 0.5 * float(total @ total - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _support(texts: list[np.ndarray]) -> np.ndarray:
    n = np.zeros(TERMS, dtype=np.int64)
    for terms in texts:
        n[terms] += 1
    return n


def telling_terms(texts: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Terms whose presence differs between labels beyond chance."""
    n = [_support([t for t, label in zip(texts, y, strict=True) if label == k]) for k in (0, 1)]
    size = np.bincount(y, minlength=2)
    both = n[0] + n[1]
    expected = both * (size[1] / size.sum())
    spread = expected * (size[0] / size.sum()) * (1 - both / size.sum())
    chi2 = (np.abs(n[1] - expected) - 0.5).clip(0) ** 2 / np.maximum(spread, 1e-9)
    return np.flatnonzero((chi2 >= LEAST_CHI2) & (both >= LEAST_TEXTS))


def _places(texts: list[np.ndarray], known: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    place = np.full(TERMS, -1, dtype=np.int32)
    place[known] = np.arange(len(known))
    rows = [place[t] for t in texts]
    return place, [r[r >= 0] for r in rows]


def _logits(rows: list[np.ndarray], params: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(logit without bias, sum of vectors, column, row of each entry) of some texts."""
    count = np.array([len(r) for r in rows])
    cols = np.concatenate(rows) if len(rows) else np.zeros(0, dtype=np.int32)
    sums = np.zeros((len(rows), params.shape[1] + 1), dtype=np.float32)
    if len(cols):
        own = params[cols]
        own = np.concatenate([own, (own[:, 1:] ** 2).sum(axis=1, keepdims=True)], axis=1)
        filled = count > 0
        sums[filled] = np.add.reduceat(own, (np.cumsum(count) - count)[filled], axis=0)
    s = sums[:, 1:-1]
    return sums[:, 0] + 0.5 * ((s * s).sum(axis=1) - sums[:, -1]), s, cols, np.repeat(np.arange(len(rows)), count)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _machine(rows: list[np.ndarray], y: np.ndarray, k: int, w0: float, epochs: int, offset: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """(bias, weight and vector of each of k terms), by Adam on batches of texts; `offset` adds to the logits."""
    rng = np.random.default_rng(11)
    params = np.concatenate([np.zeros((k, 1)), rng.normal(0, 0.05, (k, FACTORS))], axis=1).astype(np.float32)
    shrink = np.array([L2_WEIGHT] + [L2_FACTOR] * FACTORS, dtype=np.float32)
    m, v, m0, v0, t = np.zeros_like(params), np.zeros_like(params), 0.0, 0.0, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), BATCH):
            own = order[a : a + BATCH]
            t += 1
            z, s, cols, of = _logits([rows[i] for i in own], params)
            z = z + w0 + (0 if offset is None else offset[own])
            e = ((_sigmoid(z) - y[own]) / len(own)).astype(np.float32)
            each = e[of]
            total = np.bincount(cols, each, minlength=k).astype(np.float32)
            g = shrink * params
            g[:, 0] += total
            for f in range(FACTORS):
                g[:, 1 + f] += np.bincount(cols, each * s[of, f], minlength=k) - total * params[:, 1 + f]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            params -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            e0 = float(e.sum())
            m0, v0 = 0.9 * m0 + 0.1 * e0, 0.999 * v0 + 0.001 * e0 * e0
            w0 -= RATE * (m0 / (1 - 0.9**t)) / (np.sqrt(v0 / (1 - 0.999**t)) + 1e-8)
    return w0, params


def paired_terms(texts: list[np.ndarray], y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Terms of pairs that go with the label beyond chance where the logits `z` are known.

    A pair passes if as many labels in texts that hold both have a chance, by
    Chernoff's bound, below PAIR_ALPHA shared among all pairs tested.
    """
    support = _support(texts)
    wide = np.flatnonzero(support >= PAIR_TEXTS)
    if len(wide) < 2:
        return np.zeros(0, dtype=np.int64)
    _, rows = _places(texts, wide)
    # few texts need more rounds
    epochs = max(PAIR_EPOCHS, -(-200 * BATCH // len(y)))
    _, params = _machine(rows, y, len(wide), 0.0, epochs, z)
    weight = support[wide] * (params[:, 1:] ** 2).sum(axis=1)
    few = np.sort(np.argsort(-weight, kind="stable")[:PAIR_TERMS])
    _, rows = _places(texts, wide[few])
    k, p = len(few), _sigmoid(z).astype(np.float32)
    n, seen, due = (np.zeros((k, k), dtype=np.float32) for _ in range(3))
    for a in range(0, len(rows), 1024):
        x = np.zeros((len(rows[a : a + 1024]), k), dtype=np.float32)
        for i, r in enumerate(rows[a : a + 1024]):
            x[i, r] = 1
        own = slice(a, a + 1024)
        n += x.T @ x
        seen += x.T @ (x * y[own, None].astype(np.float32))
        due += x.T @ (x * p[own, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        q, r = seen / n, np.clip(due / n, 1e-6, 1 - 1e-6)
        far = n * (np.where(q > 0, q * np.log(q / r), 0) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - r)), 0))
    np.fill_diagonal(far, 0)
    passed = np.where(n > 0, far, 0) >= np.log(max(1, k * (k - 1) / 2) / PAIR_ALPHA)
    return wide[few[passed.any(axis=1)]]


def fit(texts: list[np.ndarray], y: np.ndarray, share: float) -> Model:
    """Fit on labelled term sets; `share` is the label's share among all labelled texts.

    Without both labels every score is `share` (0.5 where nothing is labelled).
    """
    size = np.bincount(y, minlength=2)
    logit = lambda p: float(np.log(p / (1 - p)))
    if not size[0] or not size[1]:
        return Model(np.full(TERMS, -1, dtype=np.int32), logit(min(max(share, 1e-3), 1 - 1e-3)), np.zeros(0), np.zeros((0, FACTORS)))
    epochs = max(EPOCHS, -(-400 * BATCH // len(y)))
    start = logit(size[1] / size.sum())
    known = telling_terms(texts, y)
    place, rows = _places(texts, known)
    w0, params = _machine(rows, y, len(known), start, epochs)
    more = np.setdiff1d(paired_terms(texts, y, w0 + _logits(rows, params)[0]), known)
    if len(more):
        known = np.union1d(known, more)
        place, rows = _places(texts, known)
        w0, params = _machine(rows, y, len(known), start, epochs)
    # the sample holds the labels in other shares than the corpus
    return Model(place, w0 + logit(min(max(share, 1e-6), 1 - 1e-6)) - start, params[:, 0].astype(float), params[:, 1:].astype(float))


def train(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", most_toxic: int = SAMPLE_TOXIC, most_other: int = SAMPLE_OTHER, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on the labelled documents where `learn` (over the key) holds.

    `labels` has columns `key` and `label` (1 or 0; others, and nulls, are ignored; a
    key with both counts as 1). About `most_toxic` and `most_other` documents are
    used, chosen by a hash of the key, and fewer where their terms are more than
    `most_bytes`; only their terms reach the driver. Rows that repeat a key count as
    often as they come. Without documents, or labels, there is nothing to learn from.
    """
    known = labels.where(learn & F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("_y"))
    size = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    share = size.get(1, 0) / max(1, sum(size.values()))
    part = F.when(F.col("_y") == 1, min(1.0, most_toxic / max(1, size.get(1, 0)))).otherwise(min(1.0, most_other / max(1, size.get(0, 0))))
    # about most_toxic + most_other keys: small enough to be sent to every executor
    chosen = F.broadcast(thinned(known, key, part))

    def make():
        def work(column: pa.Array) -> pa.StructArray:
            return pa.StructArray.from_arrays([pa.array([x.tobytes() for x in text_terms(column)], pa.binary())], names=["terms"])

        return work

    few = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(chosen.withColumnRenamed(key, "_key"), "_key").select("_key", "_y", "_text")
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.save(annotate(few, "_text", make, _TERMS, "_found").select("_key", "_y", F.col("_found.terms").alias("terms")), "sample")
    total = sample.agg(F.sum(F.length("terms"))).first()[0] or 0
    if total > most_bytes:
        sample = sample.where(F.pmod(F.xxhash64(F.lit("fewer"), "_key"), F.lit(1 << 30)) < F.lit(most_bytes / total * (1 << 30)))
    rows = sample.select("_y", "terms").collect()
    scratch.drop("sample")
    rows.sort(key=lambda r: (r["_y"], bytes(r["terms"])))
    y = np.array([r["_y"] for r in rows], dtype=np.int64)
    return fit([np.frombuffer(r["terms"], dtype=np.int32) for r in rows], y, share if size else 0.5)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity") -> DataFrame:
    """`docs` with a struct `name`: score, 0 to 1.

    Null and empty texts have no terms, so they get the bias alone. Texts are read
    whole. Rows are judged one by one: repeated ones alike, and an empty table gives
    no rows; columns of `docs` stay and `name` gives way to one of the same name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def work(column: pa.Array) -> pa.StructArray:
            return pa.StructArray.from_arrays([pa.array([model.score(x) for x in text_terms(column)], pa.float64())], names=FIELDS.names)

        return work

    return annotate(docs, text, make, FIELDS, free_name(docs, name))
