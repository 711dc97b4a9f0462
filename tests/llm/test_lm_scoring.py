"""LM scoring against brute force: the model of whole n-gram counts, text by text."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, lm_scoring


def words(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def brute(rows, order, train_of=lambda r: not held(r[0])):
    tokens = [[*words(r[1]), b" "] for r in rows]
    train = [i for i, r in enumerate(rows) if train_of(r)]
    counts = [Counter() for _ in range(order + 1)]  # by length of the history; the start mark is None
    for i in train:
        for j, t in enumerate(tokens[i]):
            before = (None, *tokens[i][:j])
            for k in range(order):
                if k <= j + 1:
                    counts[k][(*before[len(before) - k :], t)] += 1
    c = {k[0]: n for k, n in counts[0].items()}
    seen_as = Counter()
    for k in range(1, order):
        for gram, n in counts[k].items():
            seen_as[gram[:-1]] += n
    total, vocab = sum(c.values()), len(c)
    n1, n2 = (sum(v == x for v in c.values()) for x in (1, 2))
    d = min(max(n1 / max(n1 + 2 * n2, 1), 0.05), 0.95)
    new, seen = Counter(), Counter()
    for k in range(1, order):
        for gram, n in counts[k].items():
            at = k, int(math.log2(seen_as[gram[:-1]]))
            new[at] += n == 1
            seen[at] += n

    def p(history, t):
        if not history:
            return (c[t] - d) / total if t in c else (d * vocab / total if total else 1.0)
        low = p(history[1:], t)
        n = seen_as[history]
        if not n:
            return low
        at = len(history), int(math.log2(n))
        e = min(max(new[at] / seen[at], 1e-3), 0.999)
        return (1 - e) * counts[len(history)][(*history, t)] / n + e * low

    out = []
    for i, r in enumerate(rows):
        base = score = 0.0
        for j, t in enumerate(tokens[i]):
            before = (None, *tokens[i][:j])
            base += math.log10((c.get(t, 0) + 0.5) / (total + 0.5 * (vocab + 1)))
            k = min(order - 1, len(before))
            score += math.log10(p(before[len(before) - k :], t))
        out.append((r[0], not train_of(r), len(tokens[i]), sum(t in c for t in tokens[i]), total, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


def shown(found):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocab = ["the", "Of", "and", "naïve", "x"] + ["".join(rng.choice("abcdé") for _ in range(rng.randint(2, 7))) for _ in range(150)]
    texts = [" ".join(rng.choice(vocab[: rng.choice((8, 155))]) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    texts += texts[:20] + [t + " tail" for t in texts[20:40]] + [None, "", "  \t\n", "one", "two words", "word other " * 3000, "\x1cA\x85B é  z ", "a\x0bb"]
    made = list(enumerate(texts))
    return [*made, made[0], (None, "the and x"), (None, None)]


@pytest.mark.parametrize(("order", "block_bytes"), [(1, 1 << 20), (2, 2000), (3, 2000), (3, 1 << 20), (4, 1 << 20)])
def test_lm_scoring(spark, rows, order, block_bytes):
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, text string, block string, score double").repartition(5)
    got = lm_scoring.score_texts(df, common.remainder(F.col("doc_id"), 5) != 1, order=order, block_bytes=block_bytes, shard_bytes=1000)
    assert shown(got) == brute(rows, order)


def test_lanes_do_not_change_the_traversal():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abcdefgh"), int(n))) for n in rng.integers(0, 90, 40)]
    data = lm_scoring.Block.make(pa.table({"id": list(range(40)), "text": texts, "train": [i % 4 > 0 for i in range(40)]}))
    block = lm_scoring.Block(data, 3, 48)
    automaton = lm_scoring.BackoffAutomaton(block.grams, block.grams.counts(block.train), 900, 9, 0.5, 30, np.full((2, 64), 0.3))
    whole = automaton.traverse(block.grams.codes, block.lens, 1000)
    for lane in (1, 2, 3, 7, 64):
        assert np.array_equal(automaton.traverse(block.grams.codes, block.lens, lane), whole)


def test_every_state_sums_to_one():
    texts = ["a b a c", "a b b", "c a b a", "", "b c a a b", "zzz"]
    data = lm_scoring.Block.make(pa.table({"id": list(range(6)), "text": texts, "train": [True] * 5 + [False]}))
    block = lm_scoring.Block(data, 3, 48)
    counts = block.grams.counts(block.train)
    automaton = lm_scoring.BackoffAutomaton(block.grams, counts, int(counts[0].sum()), int((counts[0] > 0).sum()), 0.5, 5, np.full((2, 64), 0.4))
    outcomes = np.arange(len(counts[0]))  # the known words and the unknown one
    assert (counts[0] == 0).sum() == 1 and len(automaton.fail) > 8
    for state in range(len(automaton.fail)):
        after, weight = automaton.read(np.full(len(outcomes), state), outcomes)
        assert np.isclose((10**weight).sum(), 1) and after.max() < len(automaton.fail)


def test_empty_and_untrained(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm_scoring.score_texts(empty, F.lit(True)).count() == 0
    row = lm_scoring.score_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(False)).first()
    assert (row.train_tokens, row.n_known, row.score, row.base_score) == (0, 0, 0.0, 0.0)
    few = [(i, t) for i, t in enumerate(["rare word follows", "rare word follows", "other text here"])]
    got = lm_scoring.score_texts(spark.createDataFrame(few, "doc_id long, text string"), common.remainder(F.col("doc_id"), 5) != 1)
    assert shown(got) == brute(few, 3)


def test_packed_arrays():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    arrays = [(keys, True), (np.arange(5, dtype=np.int32), False), (np.zeros(0, np.uint64), True), (np.array([2**60, 3], np.int64), False)]
    assert all(np.array_equal(a, b) and a.dtype == b.dtype for (a, _), b in zip(arrays, lm_scoring.unpack(lm_scoring.pack(arrays))))
