"""Language identification by hierarchical discrimination.

Two levels. The family of a text's language is decided first, by one linear support vector machine a family
against the rest. Within the family that wins, closely related languages are told apart by one-versus-one machines, a
vote for each pair; more votes win, then the larger sum of calibrated probabilities, then the smaller name. The
score is the calibrated probability of the family times that of the language in it (the mean over its pairs,
scaled so that the languages of a family sum to 1).

Features are shares of letter n-grams (one to three letters, word ends included) in hashed bins: letters are
what ``str.isalpha`` says, lower-cased; everything else ends a word. Shares are divided by the root of their mean over
the sample, which is folded into the weights, so a text's decision is the mean weight of its n-grams, and scoring is a
lookup for each letter, over whole texts, without shuffle. Machines minimise the squared hinge loss with an L2 penalty
by dual coordinate descent; a sigmoid fitted on two held-out folds maps decisions to probabilities.

Learning uses a bounded sample: of each language the ``sample`` distinct texts with the smallest hashes. They are
found by distinct counts (a sketch of fixed size a language), hashes below the share that leaves some four times
``sample``, and a limit on these; copies of a text count once, and no group of rows meets in one task.

A text that is null or has no letter is ``und`` with score 0; so is every text where nothing was learned. Rows with null
or letterless text, or null language, teach nothing. A text under two languages teaches both. With one
language, every other text has it. Repeated rows keep a row each.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Families of language codes; fixed facts. Other codes are one more family.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "celtic": ("br", "cy", "ga", "gd"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("ar", "he", "mt"),
}
OTHER = "other"
UNKNOWN = "und"
#: Bins of hashed n-grams.
BITS = 13
BINS = 1 << BITS
#: Characters of a text that are taken at once.
PIECE = 1 << 20
#: Odd multipliers of the hash of an n-gram of each length.
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def family_of(lang: str) -> str:
    head = lang.lower().split("-")[0].split("_")[0]
    return next((f for f, codes in FAMILIES.items() if head in codes), OTHER)


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(texts: list[str], tail: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, bin) of every n-gram of the texts, each of which ends a word: letters, and pairs and triples of what
    stands before with a letter or a word's end; all that is no letter counts as one end. ``tail`` holds the two codes before
    the first text; its successor is returned. Not ``last``: the texts are one piece that goes on."""
    lowered = [t.lower() + ("\n" if last else "") for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(lowered)), [len(t) for t in lowered])
    letter = _letters()[codes]
    keep = letter | np.concatenate([tail[1:] > 0, letter[:-1]])  # of each run of others the first stays
    codes, owner = np.where(letter, codes, 0)[keep].astype(np.uint64), owner[keep]
    padded = np.concatenate([tail, codes])
    before = padded[1:-1] > 0
    found_o, found_b = [], []
    for n, full in ((1, codes > 0), (2, (codes > 0) | before), (3, before)):
        key = np.zeros(len(codes), np.uint64)
        with np.errstate(over="ignore"):
            for back in range(n):
                key = key * np.uint64(0x100000001B3) + padded[2 - back : len(padded) - back] + np.uint64(1)
            bins = (key * np.uint64(_MULTIPLIERS[n - 1])) >> np.uint64(64 - BITS)
        found_o.append(owner[full])
        found_b.append(bins[full].astype(np.int64))
    return np.concatenate(found_o), np.concatenate(found_b), padded[-2:]


_START = np.zeros(2, np.uint64)


def counts(text: str | None) -> np.ndarray:
    """How often each bin occurs in a whole text, taken in pieces."""
    text, tail, out = text or "", _START, np.zeros(BINS)
    for at in range(0, len(text), PIECE):
        _, bins, tail = grams([text[at : at + PIECE]], tail, at + PIECE >= len(text))
        out += np.bincount(bins, minlength=BINS)
    return out


def shares(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(bins, their shares) of a whole text; none without letters."""
    count = counts(text)
    at = np.flatnonzero(count)
    return at.astype(np.int32), count[at] / max(count.sum(), 1)


def occurrences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, bin, times): every n-gram of short texts once, the bins of long ones with their counts."""
    long = [i for i, t in enumerate(texts) if t and len(t) > PIECE]
    owner, bins, _ = grams(["" if t is None or len(t) > PIECE else t for t in texts], _START, True)
    parts = [(owner, bins, np.ones(len(bins)))]
    for i in long:
        count = counts(texts[i])
        at = np.flatnonzero(count)
        parts.append((np.full(len(at), i), at, count[at]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def svm(rows: np.ndarray, signs: np.ndarray, cost: float = 1.0, epochs: int = 30, seed: int = 5) -> np.ndarray:
    """Weights (the last one is the bias) of a linear machine with squared hinge loss: dual coordinate descent
    (Hsieh et al., 2008). Classes weigh the same in sum."""
    rows = np.hstack([rows, np.ones((len(rows), 1), rows.dtype)])
    size = np.where(signs > 0, (signs > 0).sum(), (signs < 0).sum())
    diagonal = size * 2 / (2 * cost * len(rows))
    square = (rows.astype(np.float64) ** 2).sum(1) + diagonal
    alpha, w, rng = np.zeros(len(rows)), np.zeros(rows.shape[1]), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            step = max(alpha[i] - (signs[i] * (rows[i] @ w) - 1 + diagonal[i] * alpha[i]) / square[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * signs[i] * rows[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def platt(decision: np.ndarray, signs: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(a, b) such that sigmoid(a * decision + b) is the probability of a positive sign; smoothed targets, damped Newton."""
    up, down = (signs > 0).sum(), (signs < 0).sum()
    target = np.where(signs > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([decision, np.ones(len(decision))], 1)
    p = np.array([1.0, 0.0])
    for _ in range(steps):
        q = sigmoid(x @ p)
        gradient = x.T @ (q - target)
        hessian = (x * (q * (1 - q))[:, None]).T @ x + np.eye(2) * 1e-3
        step = np.linalg.solve(hessian, gradient)
        p = p - step / max(1.0, float(np.abs(step).max()))
        if np.abs(gradient).max() < 1e-6:
            break
    return float(max(p[0], 0.0)), float(p[1])


@dataclass
class Machine:
    """A linear decision, sum of weights over n-grams plus bias, and its sigmoid."""

    weights: np.ndarray
    bias: float
    a: float
    b: float


def machine(rows: np.ndarray, signs: np.ndarray) -> Machine:
    """Fitted on all rows; the sigmoid on decisions of machines that have not seen the row."""
    out = np.zeros(len(rows))
    for fold in (0, 1):
        seen = np.arange(len(rows)) % 2 != fold
        if len(set(signs[seen])) == 2 and (~seen).any():
            w = svm(rows[seen], signs[seen])
            out[~seen] = rows[~seen] @ w[:-1] + w[-1]
    w = svm(rows, signs)
    return Machine(w[:-1], float(w[-1]), *platt(out, signs))


@dataclass
class Model:
    """Languages by family, one machine a family (none where there is one only), one a pair of languages."""

    families: dict[str, list[str]] = field(default_factory=dict)
    of_family: dict[str, Machine] = field(default_factory=dict)
    of_pair: dict[tuple[str, str], Machine] = field(default_factory=dict)


def fit(sample: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """sample: (language, bins, shares), in an order that doesn't depend on the run."""
    model = Model()
    for lang in sorted({s[0] for s in sample}):
        model.families.setdefault(family_of(lang), []).append(lang)
    if not sample:
        return model
    scale = np.full(BINS, 1.0 / len(sample) / 1000)
    for _, at, share in sample:
        scale[at] += share / len(sample)
    scale = 1 / np.sqrt(scale)

    def dense(chosen: list[tuple[str, np.ndarray, np.ndarray]]) -> np.ndarray:
        rows = np.zeros((len(chosen), BINS), np.float32)
        for row, (_, at, share) in zip(rows, chosen):
            row[at] = share * scale[at]
        return rows

    def scaled(m: Machine) -> Machine:
        return Machine((m.weights * scale).astype(np.float32), m.bias, m.a, m.b)

    if len(model.families) > 1:
        kinds = np.array([family_of(s[0]) for s in sample])
        rows = dense(sample)
        for name in model.families:
            model.of_family[name] = scaled(machine(rows, np.where(kinds == name, 1.0, -1.0)))
        del rows
    for langs in model.families.values():
        for a, b in combinations(langs, 2):
            both = [s for s in sample if s[0] in (a, b)]
            model.of_pair[a, b] = scaled(machine(dense(both), np.array([1.0 if s[0] == a else -1.0 for s in both])))
    return model


def decide(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """(language, score) of each whole text."""
    n = len(texts)
    owner, bins, times = occurrences(texts)
    total = np.bincount(owner, times, minlength=n)
    names, score = np.full(n, UNKNOWN, object), np.zeros(n)

    def probability(m: Machine) -> tuple[np.ndarray, np.ndarray]:
        value = np.bincount(owner, m.weights[bins] * times, minlength=n) / np.maximum(total, 1) + m.bias
        return value, sigmoid(m.a * value + m.b)

    full = total > 0
    if not model.families or not full.any():
        return names.tolist(), score
    families = sorted(model.families)
    if len(families) > 1:
        each = np.stack([probability(model.of_family[f])[1] for f in families])
        share = each / np.maximum(each.sum(0), 1e-12)
        chosen, sure = share.argmax(0), share.max(0)
    else:
        chosen, sure = np.zeros(n, int), np.ones(n)
    for k, name in enumerate(families):
        mine, langs = full & (chosen == k), model.families[name]
        if not mine.any():
            continue
        votes, sums = np.zeros((len(langs), n)), np.zeros((len(langs), n))
        for a, b in combinations(range(len(langs)), 2):
            value, p = probability(model.of_pair[langs[a], langs[b]])
            votes[a] += value > 0
            votes[b] += value <= 0
            sums[a] += p
            sums[b] += 1 - p
        pairs = max(len(langs) * (len(langs) - 1) / 2, 1)
        best = (votes + sums / (2 * pairs)).argmax(0)
        own = np.ones(n) if len(langs) == 1 else sums[best, np.arange(n)] / pairs
        names[mine] = np.array(langs, object)[best[mine]]
        score[mine] = (sure * own)[mine]
    return names.tolist(), np.clip(score, 0, 1)


def _featured(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch, "text", chunk_bytes):
                rows = [shares(t) for t in part.column("text").to_pylist()]
                yield pa.record_batch(
                    [part.column("lang"), part.column("h"), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["lang", "h", "at", "share"]
                )

    return run


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", sample: int = 500, chunk_bytes: int = 1 << 20) -> Model:
    """The model of the languages in ``docs``, from ``sample`` distinct texts of each at most."""
    lang = F.col(lang_col).cast("string")
    rows = docs.select(lang.alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = rows.withColumn("h", F.xxhash64("text", F.lit("language")))
    counts = hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()  # a row a language
    if not counts:
        return Model()
    span = F.shiftrightunsigned("h", 33) / float(1 << 31)  # the hash as a number from 0 to 1
    few = _by_lang({r.lang: min(1.0, 4.0 * sample / max(r.n, 1)) for r in counts})
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 33), "h"))
    firsts = hashed.where(span <= few).select("lang", "h").distinct().withColumn("place", place).where(F.col("place") <= sample)
    last = _by_lang({r.lang: r.last for r in firsts.groupBy("lang").agg(F.max(span).alias("last")).collect()})
    chosen = hashed.where(span <= last).mapInArrow(common.lean(_featured(chunk_bytes)), "lang string, h long, at array<int>, share array<double>").dropDuplicates(["lang", "h"])
    found = sorted(chosen.collect(), key=lambda r: (r.h, r.lang))
    return fit([(r.lang, np.array(r.at, np.int32), np.array(r.share)) for r in found if r.at])


def _by_lang(values: dict[str, float]):
    """The number of the row's language; there are as few entries as languages."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))]), F.col("lang"))


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 1 << 20) -> DataFrame:
    """(id, lang_pred, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch, "text", chunk_bytes):
                names, score = decide(model, part.column("text").to_pylist())
                yield pa.record_batch([part.column("id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(common.lean(run), f"id {kind}, lang_pred string, score double")
