"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the letters (case-folded, runs of anything else one
space) are hashed into buckets. Document frequencies come from every learning
document; the weights from a bounded sample of them, by follow-the-regularised-
leader (proximal, with per-coordinate rates and an elastic net, so most weights
are exactly zero); a temperature is then fitted on sampled documents that the
weights haven't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .annotate import annotate, free_name
from .folds import thinned
from .store import prepare, released
from .vectors import sum_vectors

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
ORDERS = (1, 2, 3)
#: Learning documents per language in the sample that weights are fitted on, and in all.
SAMPLE_PER_LANGUAGE = 400
SAMPLE_TOTAL = 20_000
#: Languages at most: the learner holds BUCKETS numbers of 8 bytes twice for each. More of them are an error.
MOST_LANGUAGES = 200
#: Characters handled at once in a long text.
CHUNK_CHARS = 1 << 19
#: Of the learners: rate, its offset, L1 and L2 strengths, passes.
ALPHA, BETA, L1, L2, EPOCHS = 0.8, 1.0, 0.002, 0.02, 4

FIELDS = T.StructType([T.StructField("lang", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])

_LETTER = regex.compile(r"\p{L}")
_fold: list[np.ndarray] = []


def _folding() -> np.ndarray:
    """Code point -> its lower case, or a space unless it is a letter."""
    if not _fold:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x20000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        table[0x20000:0x32000] = np.arange(0x20000, 0x32000)
        _fold.append(table)
    return _fold[0]


def _folded(text: str) -> Iterator[np.ndarray]:
    """The text's letters, lower-cased, with single spaces for whatever is between, before and after: a portion at a time."""
    space, last = np.array([32], dtype=np.uint64), 0
    for a in range(0, max(1, len(text)), CHUNK_CHARS):
        code = _folding()[np.frombuffer(text[a : a + CHUNK_CHARS].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].astype(np.uint64)
        code = np.concatenate([[] if a else space, code, space if a + CHUNK_CHARS >= len(text) else []]).astype(np.uint64)
        code = code[(code != 32) | (np.concatenate([[last], code[:-1]]) != 32)]
        if len(code):
            last = int(code[-1])
            yield code


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the text's n-grams. Long texts are read in portions; the codes before an edge go along, so each n-gram counts once."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    before = np.zeros(0, dtype=np.uint64)
    for fresh in _folded(text):
        code = np.concatenate([before, fresh])
        found = []
        g = np.zeros(len(code), dtype=np.uint64)
        for n in range(1, max(ORDERS) + 1):
            size = len(code) - n + 1
            if size <= 0:
                break
            g = g[:size] * np.uint64(0x9E3779B97F4A7C15) + (code[n - 1 :] + np.uint64(n << 24))
            if n in ORDERS:
                # what ends within `before` was counted with it
                own = g[max(0, len(before) - n + 1) :]
                found.append(((own ^ (own >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        total += np.bincount(np.concatenate(found), minlength=BUCKETS)
        before = code[-(max(ORDERS) - 1) :]
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    place: np.ndarray  # bucket -> its row of weights; the last row is zeros, for all the others
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    @staticmethod
    def sparse(languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> Model:
        used = np.flatnonzero(weights.any(axis=1))
        place = np.full(len(weights), len(used), dtype=np.int32)
        place[used] = np.arange(len(used))
        return Model(languages, idf, place, np.concatenate([weights[used], np.zeros((1, weights.shape[1]))]), bias)

    def vector(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        v = (1 + np.log(count)) * self.idf[at]
        return v / max(float(np.sqrt(v @ v)), 1e-12)

    def logits(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.vector(at, count) @ self.weights[self.place[at]] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0
        p = softmax(self.logits(*gram_counts(text)) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """FTRL-proximal for one weight column per class; weights are derived from (z, n) when read."""

    def __init__(self, buckets: int, classes: int):
        self.z = np.zeros((buckets, classes))
        self.n = np.zeros((buckets, classes))

    def weights(self, at=slice(None), l1: float = L1) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at, w: np.ndarray, g: np.ndarray) -> None:
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit_weights(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) from (class, buckets, values); rows are taken in a fixed shuffled order."""
    learner, bias = Ftrl(buckets, classes), Ftrl(1, classes)
    share = 1 / np.maximum(1, np.bincount([c for c, _, _ in rows], minlength=classes))
    share *= len(rows) / classes
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for r in rng.permutation(len(rows)):
            c, at, v = rows[r]
            w, b = learner.weights(at), bias.weights(l1=0.0)
            g = softmax(v @ w + b[0])
            g[c] -= 1
            g *= min(share[c], 10.0)
            learner.update(at, w, np.outer(v, g))
            bias.update(slice(None), b, g[None, :])
    return learner.weights(), bias.weights(l1=0.0)[0]


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(softmax(z / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean())

    a, b, r = np.log(0.05), np.log(5.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _frequencies(learn: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """(documents, documents per bucket) over every learning document."""

    def run(batches):
        total = np.zeros(BUCKETS + 1, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total[gram_counts(x)[0]] += 1
                total[BUCKETS] += 1
        yield total

    total = sum_vectors(learn.select(F.col(text).cast("string")), run, BUCKETS + 1)
    return int(total[-1]), total[:-1]


def _sample(learn: DataFrame, key: str, text: str, lang: str, share: Column) -> list[tuple[str, np.ndarray, np.ndarray]]:
    def run(batches):
        for batch in batches:
            grams = [gram_counts(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.astype(np.uint16).tobytes() for a, _ in grams], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in grams], pa.binary())], names=["lang", "at", "count"])

    some = thinned(learn, key, share).select(F.col(lang).cast("string"), F.col(text).cast("string"))
    rows = some.mapInArrow(released(run), "lang string, at binary, count binary").collect()
    rows.sort(key=lambda r: (r.lang, bytes(r.at), bytes(r["count"])))
    return [(r.lang, np.frombuffer(r.at, np.uint16).astype(np.int64), np.frombuffer(r["count"], np.uint32)) for r in rows]


def train(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, most: int = SAMPLE_TOTAL, most_languages: int = MOST_LANGUAGES) -> Model:
    """Fit on the rows where `learn` holds and text and lang are given.

    Rows without a letter teach nothing. Weights and temperature come from about
    `per_language` documents of each language (about `most` in all), chosen by a
    hash of the key; document frequencies from all. No rows: a model that says `und`.
    More than `most_languages` languages are an error, none is left out. Repeated rows
    count as often as they come.
    """
    prepare(docs.sparkSession)
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(text).rlike(r"\p{L}"))
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang).cast("string")).agg(F.count("*")).limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not sizes:
        return Model.sparse([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0))
    languages = sorted(sizes)
    each = min(per_language, max(1, most // len(languages)))
    few = F.create_map(*[x for c in languages for x in (F.lit(c), F.lit(min(1.0, each / sizes[c])))])
    n, df = _frequencies(rows, text)
    idf = np.log((1 + n) / (1 + df)) + 1
    sample = _sample(rows, key, text, lang, few[F.col(lang).cast("string")])
    model = Model.sparse(languages, idf, np.zeros((BUCKETS, 0)), np.zeros(0))
    number = {c: i for i, c in enumerate(languages)}
    rows_ = [(number[c], at, count) for c, at, count in sample]
    later = rows_[4::5]
    weights, bias = fit_weights([(c, at, model.vector(at, count)) for i, (c, at, count) in enumerate(rows_) if i % 5 != 4], len(languages))
    model = Model.sparse(languages, idf, weights, bias)
    if later:
        model.temperature = fit_temperature(np.array([model.logits(at, count) for _, at, count in later]), np.array([c for c, _, _ in later]))
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", name: str = "language") -> DataFrame:
    """`docs` with a struct `name`: lang and score (its calibrated probability).

    A null or empty text, or one without a letter, is `und` with score 0. Languages
    that score alike go by name. Long texts are read whole, in portions of
    `CHUNK_CHARS`, with the same result. Rows are judged one by one: repeated ones
    alike, and an empty table gives no rows; columns of `docs` stay and `name` gives
    way to one of the same name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def work(column: pa.Array) -> pa.StructArray:
            found = [model.predict(x) for x in column.to_pylist()]
            return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=FIELDS.names)

        return work

    return annotate(docs, text, make, FIELDS, free_name(docs, name))
