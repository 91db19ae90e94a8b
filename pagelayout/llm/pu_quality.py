"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text, no negatives. A text is described
by ratios of characters, words and lines, each cut into quantile bins; the
score is a logistic model that adds one weight per bin. Its weights minimise
the non-negative unbiased risk: pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)),
with the class prior pi estimated by the best bin: the least ratio, over
score thresholds, of the unlabelled to the positive share above it.
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
from .textops import SPACE_WORDS, blocks, byte_class, grams, text_buffers, word_bounds, words

#: Trusted positives and unlabelled texts that the model is fitted on, about.
SAMPLE_POSITIVE = 5_000
SAMPLE_UNLABELLED = 10_000
BINS = 12
STEPS, RATE, DECAY = 400, 0.05, 1e-4

FIELDS = T.StructType([T.StructField("score", T.DoubleType(), False)])
_VECTOR = T.StructType([T.StructField("x", T.BinaryType(), False)])

_LINES = byte_class(b"\n")
_CLASSES = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": bytes(range(48, 58)),
    "space": bytes([32, 9, 10, 11, 12, 13]),
    "markup": b"#*$%&|<>",
    "stress": b"!?",
    "stop": b".,;:",
    "bracket": b"()[]{}\"'",
    "symbol": b"+-/=@\\^_`~",
    "high": bytes(range(128, 256)),
    "control": bytes([*range(0, 9), *range(14, 32), 127]),
}
NAMES = [*_CLASSES, "words", "word_bytes", "distinct", "repeated", "same_lines", "line_words", "short_words", "long_words"]


def features(column: pa.Array) -> np.ndarray:
    """A row of numbers for each text; null and empty texts have zeros."""
    raw, offsets = text_buffers(column)
    tables = []
    for members in _CLASSES.values():
        t = np.zeros(256, dtype=np.int64)
        t[list(members)] = 1
        tables.append(t)
    out = np.zeros((len(offsets) - 1, len(NAMES)))
    for i, j in blocks(offsets):
        part, bounds = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        h, s, e = words(part, bounds, SPACE_WORDS)
        line, ls, _ = words(part, bounds, _LINES, lower=False)
        at, line_at = word_bounds(s, bounds), word_bounds(ls, bounds)
        size = e - s
        for r in range(i, j):
            a, b = bounds[r - i], bounds[r - i + 1]
            own, long = h[at[r - i] : at[r - i + 1]], size[at[r - i] : at[r - i + 1]]
            lines = line[line_at[r - i] : line_at[r - i + 1]]
            n = len(own)
            if not n:
                continue
            count = np.bincount(part[a:b], minlength=256)
            row = out[r]
            row[: len(tables)] = [count @ t / (b - a) for t in tables]
            g = grams(own, 3)
            row[len(tables) :] = (
                np.log1p(n),
                long.mean(),
                len(np.unique(own)) / n**0.8,
                1 - len(np.unique(g)) / len(g) if len(g) else 0.0,
                1 - len(np.unique(lines)) / max(1, len(lines)),
                np.log1p(n / max(1, len(lines))),
                (long <= 3).mean(),
                (long > 15).mean(),
            )
    return out


@dataclass
class Model:
    cuts: np.ndarray  # (features, bins - 1), ascending
    weights: np.ndarray  # (features, bins)
    bias: float
    prior: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1) if len(x) else np.zeros((0, len(self.cuts)), dtype=np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[np.arange(len(self.cuts)), self.bins(x)].sum(axis=1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, chance: float = 0.1) -> float:
    """Share of positives among the unlabelled, from held-out scores: the best bin of half the positives or more.

    The share is lowered by the deviation that chance allows (Dvoretzky, Kiefer and
    Wolfowitz): a prior too high makes the negatives' risk vanish before they are learnt.
    """
    if not len(positive) or not len(unlabelled):
        return 0.5
    p, u = np.sort(positive), np.sort(unlabelled)
    at = np.unique(p)
    share_p = 1 - np.searchsorted(p, at, side="left") / len(p)
    share_u = 1 - np.searchsorted(u, at, side="left") / len(u)
    best = np.min((share_u / share_p)[share_p >= 0.5])
    return float(np.clip(best - np.sqrt(np.log(4 / chance) / 2 / len(u)), 0.05, 0.99))


def _one_hot(bins: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(bins), bins.shape[1] * width), dtype=np.float32)
    out[np.arange(len(bins))[:, None], np.arange(bins.shape[1]) * width + bins] = 1
    return out


def _descend(gradient, size: int) -> np.ndarray:
    """Adam over all rows, from zero."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, STEPS + 1):
        g = gradient(w) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _separate(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Weights that tell positives from unlabelled texts, both counted alike."""

    def gradient(w):
        return -(1 - _sigmoid(p @ w)) @ p / len(p) + _sigmoid(u @ w) @ u / len(u)

    return _descend(gradient, p.shape[1])


def nn_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Where to step from weights `w`, for the non-negative risk under the logistic loss."""
    zp, zu = p @ w, u @ w
    up = -(1 - _sigmoid(zp)) @ p / len(p)
    down_p, down_u = _sigmoid(zp) @ p / len(p), _sigmoid(zu) @ u / len(u)
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    # where the negatives' risk falls below zero it has overfitted: that part alone is taken back
    return prior * up + down_u - prior * down_p if negative >= 0 else prior * down_p - down_u


def _nn_risk(p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Weights of least non-negative risk."""
    return _descend(lambda w: nn_gradient(w, p, u, prior), p.shape[1])


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """The model from feature rows. Without positives or unlabelled rows every score is 0.5."""
    width = len(NAMES)
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros((width, BINS - 1)), np.zeros((width, BINS)), 0.0, 0.5)
    both = np.concatenate([positive, unlabelled])
    # half of the cuts by the quantiles of either side, so that rare values still get bins of their own
    q = np.linspace(0, 1, BINS // 2 + 2)[1:-1]
    cuts = np.sort(np.concatenate([np.quantile(positive, [*q, 0.999][: BINS // 2], axis=0), np.quantile(both, [0.01, 0.05, *np.linspace(0.5, 0.99, BINS - 3 - BINS // 2)], axis=0)]), axis=0).T
    model = Model(cuts, np.zeros((width, cuts.shape[1] + 1)), 0.0, 0.5)
    ones = lambda x: np.hstack([_one_hot(model.bins(x), cuts.shape[1] + 1), np.ones((len(x), 1), dtype=np.float32)])
    p, u = ones(positive), ones(unlabelled)
    w = _separate(p[::2], u[::2])
    model.prior = estimate_prior(p[1::2] @ w, u[1::2] @ w) if len(p) > 1 and len(u) > 1 else 0.5
    w = _nn_risk(p, u, model.prior)
    model.weights, model.bias = w[:-1].reshape(width, -1), float(w[-1])
    return model


def _vectors(rows: DataFrame, text: str) -> np.ndarray:
    def make():
        def work(column: pa.Array) -> pa.StructArray:
            return pa.StructArray.from_arrays([pa.array([x.tobytes() for x in features(column)], pa.binary())], names=["x"])

        return work

    found = annotate(rows.select(F.col(text).alias("text")), "text", make, _VECTOR, "v").select("v.x").collect()
    return np.frombuffer(b"".join(sorted(bytes(r.x) for r in found)), dtype=np.float64).reshape(-1, len(NAMES))


def train(docs: DataFrame, positives: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", most_positive: int = SAMPLE_POSITIVE, most_unlabelled: int = SAMPLE_UNLABELLED) -> Model:
    """Fit on documents where `learn` holds.

    `positives` has a column `key`: the trusted documents. About `most_positive` of
    them and about `most_unlabelled` documents of any kind are used, chosen by a
    hash of the key; only their features reach the driver.
    """
    trusted = positives.select(key).where(F.col(key).isNotNull()).distinct()
    rows = docs.where(learn & F.col(key).isNotNull()).select(key, text)
    n_trusted, n_rows = trusted.count(), rows.count()
    chosen = thinned(trusted, key, F.lit(min(1.0, most_positive / max(1, n_trusted))))
    # about most_positive keys: small enough to be sent to every executor
    p = _vectors(rows.join(F.broadcast(chosen), key, "left_semi"), text)
    u = _vectors(thinned(rows, key, F.lit(min(1.0, most_unlabelled / max(1, n_rows)))), text)
    return fit(p, u)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "quality") -> DataFrame:
    """`docs` with a struct `name`: score, 0 to 1.

    Null and empty texts are scored as texts without words: all features 0. Texts are
    read whole, some of them at a time. Rows are judged one by one: repeated ones
    alike, and an empty table gives no rows; columns of `docs` stay and `name` gives
    way to one of the same name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def work(column: pa.Array) -> pa.StructArray:
            return pa.StructArray.from_arrays([pa.array(model.score(features(column)), pa.float64())], names=FIELDS.names)

        return work

    return annotate(docs, text, make, FIELDS, free_name(docs, name))
