"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled good texts; unlabelled web text is a mixture of good and bad ones in an
unknown proportion. Rows labelled bad are never used. Two steps:

1. Class prior: a scorer is fitted to tell positives from unlabelled texts on one half of the sample;
   on the other half, for every threshold t, share of unlabelled above t / share of positives above t
   bounds the prior from above, and the best bin (smallest upper confidence bound) estimates it
   (Garg et al., "Mixture Proportion Estimation and PU Learning", 2021).
2. Classifier: a small network that minimises the non-negative unbiased risk (Kiryo et al., 2017)
   prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with logistic loss; where the second part falls
   below zero the gradient steps back instead, so the network can't fit the unlabelled texts as negatives.

Features are statistics of the text's surface only (classes of characters, repeats, shapes of words and
lines). Fitting uses a bounded sample: the ``sample`` texts of either kind with the smallest hash of
their text, so it does not depend on the order of rows; the sample reaches the driver as features.
Scoring reads every whole text where it is, without shuffle.

Null and empty texts have all features zero and get a score like any other text. Repeated rows keep a
row each. With no positives at all, or nothing unlabelled, every score is 0.5.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_HIGH = _BYTES >= 128
_SPACE = (_BYTES == 32) | (_BYTES >= 9) & (_BYTES <= 13)
_STOP = np.isin(_BYTES, np.frombuffer(b".,;:?", np.uint8))
_OTHER = ~(_UPPER | _LOWER | _DIGIT | _HIGH | _SPACE | _STOP)
_RUN = re.compile(rb"([^\w\s])\1+")
N_FEATURES = 24


def features(text: str | None) -> np.ndarray:
    """Surface statistics of a whole text; shares lie between 0 and 1."""
    out = np.zeros(N_FEATURES)
    data = (text or "").encode()
    words = data.split()
    if not words:
        return out
    n, m = len(data), len(words)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    of = lambda mask: float(count[mask].sum()) / n
    lines = [x for x in data.split(b"\n") if x.strip()]
    distinct = len(set(words))
    repeats = sum(a == b for a, b in zip(words, words[1:])) / max(m - 1, 1)
    sizes = np.fromiter(map(len, words), np.int64, m)
    lone = sum(len(w) == 1 and not w.isalnum() for w in words) / m
    marked = sum(not (w[-1:].isalnum() or w[-1] >= 128 or w[-1:] in b".,;:?") for w in words) / m
    full = [x for x in lines if x.rstrip()[-1:] in b".?!\"')"]
    p = count[count > 0] / n
    pairs = len(set(zip(words, words[1:]))) / max(m - 1, 1)
    out[:] = (
        of(_UPPER), of(_LOWER), of(_DIGIT), of(_HIGH), of(_SPACE), of(_STOP), of(_OTHER), float(count[124]) / n,
        min(math.log1p(m) / 10, 1), min(math.log1p(len(lines)) / 8, 1), distinct / m, distinct / m * math.log1p(m) / 5, pairs, repeats,
        min(sizes.mean() / 12, 2), min(sizes.std() / 10, 2), lone, marked, len(full) / len(lines), len(set(lines)) / len(lines),
        sum(w.isupper() for w in words) / m, min(len(_RUN.findall(data)) / m, 1), float(-(p * np.log2(p)).sum()) / 8, max(map(len, lines)) / n,
    )
    return out


def feature_rows(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts]).reshape(len(texts), N_FEATURES)


class Network:
    """One hidden layer; Adam on full batches; deterministic for a seed."""

    def __init__(self, width: int, n: int = N_FEATURES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, 1 / math.sqrt(n), (n, width)), np.zeros(width), rng.normal(0, 1 / math.sqrt(width), width), np.zeros(1)]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(x @ self.p[0] + self.p[1])
        return hidden @ self.p[2] + self.p[3][0], hidden

    def backward(self, x: np.ndarray, hidden: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        inner = np.outer(d, self.p[2]) * (1 - hidden**2)
        return [x.T @ inner, inner.sum(0), hidden.T @ d, np.array([d.sum()])]

    def fit(self, gradient, steps: int, rate: float, decay: float = 1e-4) -> None:
        m = [np.zeros_like(p) for p in self.p]
        v = [np.zeros_like(p) for p in self.p]
        for t in range(1, steps + 1):
            for i, g in enumerate(gradient(self)):
                g = g + decay * self.p[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                self.p[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def class_prior(pos: np.ndarray, unl: np.ndarray, width: int, steps: int, confidence: float = 0.1) -> float:
    """Best-bin estimate of the share of positives among the unlabelled: the smaller of two folds', as
    each is an upper bound."""
    return min(_best_bin(pos[i::2], unl[i::2], pos[1 - i :: 2], unl[1 - i :: 2], width, steps, confidence) for i in (0, 1))


def _best_bin(fit_p: np.ndarray, fit_u: np.ndarray, p: np.ndarray, u: np.ndarray, width: int, steps: int, confidence: float) -> float:
    if not (len(fit_p) and len(fit_u) and len(p) and len(u)):
        return 0.5

    def gradient(net):
        out = []
        for x, y in ((fit_p, 1.0), (fit_u, 0.0)):
            score, hidden = net.forward(x)
            out.append(net.backward(x, hidden, (sigmoid(score) - y) / len(x)))
        return [a + b for a, b in zip(*out)]

    net = Network(width, fit_p.shape[1])
    net.fit(gradient, steps, 0.01)
    sp, su = (np.sort(net.forward(x)[0]) for x in (p, u))
    slack = sum(math.sqrt(math.log(4 / confidence) / (2 * len(x))) for x in (p, u))
    above_p = 1 - np.searchsorted(sp, sp) / len(sp)
    above_u = 1 - np.searchsorted(su, sp) / len(su)
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def pu_risk(net: Network, pos: np.ndarray, unl: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the non-negative unbiased risk: of positives, and of negatives (counts as 0 below 0)."""
    sp, su = net.forward(pos)[0], net.forward(unl)[0]
    return float(prior * np.logaddexp(0, -sp).mean()), float(np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean())


def pu_gradient(net: Network, pos: np.ndarray, unl: np.ndarray, prior: float) -> list[np.ndarray]:
    """Gradient of the sum of both parts; where the second is below 0, the gradient that raises it again."""
    sp, hp = net.forward(pos)
    su, hu = net.forward(unl)
    plus = net.backward(pos, hp, -prior * sigmoid(-sp) / len(pos))  # of prior * R_p(+)
    u = net.backward(unl, hu, sigmoid(su) / len(unl))
    p = net.backward(pos, hp, prior * sigmoid(sp) / len(pos))
    if pu_risk(net, pos, unl, prior)[1] < 0:
        return [b - a for a, b in zip(u, p)]
    return [x + a - b for x, a, b in zip(plus, u, p)]


def fit(pos: np.ndarray, unl: np.ndarray, *, width: int = 16, steps: int = 600, rate: float = 0.01) -> dict:
    """The model: scaling, prior and network. Rows of features."""
    if not (len(pos) and len(unl)):
        return {"p": None, "prior": None}
    mean, scale = unl.mean(0), unl.std(0) + 1e-3
    pos, unl = (np.clip((x - mean) / scale, -8, 8) for x in (pos, unl))
    prior = class_prior(pos, unl, width, steps // 2)
    net = Network(width, pos.shape[1], seed=11)
    net.fit(lambda n: pu_gradient(n, pos, unl, prior), steps, rate)
    return {"mean": mean, "scale": scale, "prior": prior, "p": net.p}


def predict(model: dict, rows: np.ndarray) -> np.ndarray:
    if model["p"] is None:
        return np.full(len(rows), 0.5)
    net = Network.__new__(Network)
    net.p = model["p"]
    return sigmoid(net.forward(np.clip((rows - model["mean"]) / model["scale"], -8, 8))[0])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = feature_rows(batch.column("text").to_pylist())
        yield pa.record_batch([batch.column("h"), pa.array(list(rows), pa.list_(pa.float64()))], names=["h", "x"])


def _sample(texts: DataFrame, n: int) -> np.ndarray:
    """Features of the n distinct texts with the smallest hashes. Hashes meet first, eight bytes each and
    n of a task at most; then texts are read for the chosen ones only."""
    hashed = texts.select("text", F.xxhash64("text", F.lit("sample")).alias("h"))
    last = hashed.select("h").distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]
    if last is None:
        return np.zeros((0, N_FEATURES))
    chosen = hashed.where(F.col("h") <= last).mapInArrow(common.lean(_features), "h long, x array<double>").dropDuplicates(["h"]).collect()
    return np.array([r.x for r in sorted(chosen, key=lambda r: r.h)]).reshape(-1, N_FEATURES)


def train(docs: DataFrame, positives: DataFrame, *, text_col: str = "text", sample: int = 4000, id_col: str = "doc_id", **options) -> dict:
    """Fit on ``sample`` texts at most of the labelled positives (rows of ids) and of all texts. The
    positives are those with the smallest hashes of their ids; so few ids may be broadcast, and texts
    are read where they are."""
    kind = docs.schema[id_col].dataType.simpleString()
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    good = positives.select(F.col(id_col).cast(kind).alias("id")).where("id is not null").distinct()
    good = good.orderBy(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), "id").limit(sample)
    return fit(_sample(known.join(F.broadcast(good), "id", "left_semi"), sample), _sample(known, sample), **options)


def _scored(model: dict, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch, "text", chunk_bytes):
                score = predict(model, feature_rows(part.column("text").to_pylist()))
                names = [n for n in part.schema.names if n != "text"]
                yield pa.record_batch([*(part.column(n) for n in names), pa.array(score)], names=[*names, "score"])

    return run


def score(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 8 << 20) -> DataFrame:
    """(id, score) of every text."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(common.lean(_scored(model, chunk_bytes)), f"id {kind}, score double")


def trusted(labels: DataFrame, keep: Column, *, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Rows of labels that count as trusted positives: label 1, and ``keep`` holds."""
    return labels.where((F.col(label_col) == 1) & keep).select(id_col)
