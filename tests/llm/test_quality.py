"""The quality classifier: its risk against sums by hand, its prior, held-out rows and edge cases."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, quality, queries

DATA = "/root/testdata/sf0.1"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@needs_data
def test_held_out_rows(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    found = queries.op9_quality(spark, DATA).where("held_out").join(labels, "doc_id").toPandas()
    good, bad = found[found.quality == 1], found[found.quality == 0]
    assert len(good) > 600 and len(bad) > 100
    assert good.predicted.mean() > 0.99 and bad.predicted.mean() < 0.02


def test_risk_and_gradient():
    rng = np.random.default_rng(1)
    pos, unl = rng.normal(1, 1, (30, 4)), rng.normal(0, 1, (50, 4))
    for prior, spread in ((0.4, 1.0), (0.9, 3.0)):
        net = quality.Network(3, 4, seed=5)
        if prior == 0.9:  # a net that tells them apart too well: the second part falls below 0
            net.p[0][:], net.p[2][:] = 0.5, spread

        def score(x):
            hidden = [math.tanh(sum(x[i] * net.p[0][i, j] for i in range(4)) + net.p[1][j]) for j in range(3)]
            return sum(h * w for h, w in zip(hidden, net.p[2])) + net.p[3][0]

        def parts():
            plus = sum(math.log1p(math.exp(-score(x))) for x in pos) / 30
            return prior * plus, sum(math.log1p(math.exp(score(x))) for x in unl) / 50 - prior * sum(math.log1p(math.exp(score(x))) for x in pos) / 30

        assert np.allclose(quality.pu_risk(net, pos, unl, prior), parts())
        below = parts()[1] < 0
        assert below == (prior == 0.9)
        got = quality.pu_gradient(net, pos, unl, prior)
        for k, p in enumerate(net.p):
            for at in np.ndindex(p.shape):
                kept = p[at]
                sides = []
                for step in (1e-5, -1e-5):
                    p[at] = kept + step
                    plus, negative = parts()
                    sides.append(-negative if below else plus + negative)
                p[at] = kept
                assert got[k][at] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=1e-6)


def test_query_equals_brute_force(spark):
    """Sampling, scaling and scores of the distributed job against the same steps over lists."""
    rows = [(i, ("Good words stand here, in a line. " if i % 3 else "@@ ## 1 22 333 !! ") * (1 + i % 7) + str(i)) for i in range(150)]
    rows += [(500, None), (501, ""), (None, "Null ids are scored. "), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, 0.5, "clash") for r in rows], "doc_id long, text string, score double, h string").repartition(3)
    good = spark.createDataFrame([(i,) for i in range(150) if i % 3 == 1] + [(None,)], "doc_id long")
    model = quality.train(df, good, steps=60)
    hashed = {r.text: r.h for r in df.select("text", F.xxhash64("text", F.lit("sample")).alias("h")).collect()}

    def order(texts):
        return quality.feature_rows(sorted(set(texts), key=hashed.get))

    own = quality.fit(order(t for i, t in rows if i is not None and i % 3 == 1 and i < 150), order(t for _, t in rows), steps=60)
    assert model["prior"] == pytest.approx(own["prior"])
    got = sorted(((r.id, round(r.score, 9)) for r in quality.score(df, model).collect()), key=str)
    assert got == sorted(((i, round(float(quality.predict(own, quality.feature_rows([t]))[0]), 9)) for i, t in rows), key=str)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 50_000), (None, "a")], "doc_id long, text string")
    model = quality.train(docs, docs.select("doc_id").limit(0))
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}
    empty = docs.limit(0)
    assert quality.score(empty, quality.train(empty, empty.select("doc_id"))).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    assert [r.doc_id for r in quality.trusted(labels, common.remainder(F.col("doc_id"), 5) != 9).collect()] == [1, None]


def test_prior_estimate():
    rng = np.random.default_rng(3)
    pos = rng.normal(1, 1, (1500, 4))
    unl = np.concatenate([rng.normal(1, 1, (900, 4)), rng.normal(-3, 1, (600, 4))])
    assert abs(quality.class_prior(pos, unl, 8, 200) - 0.6) < 0.08
