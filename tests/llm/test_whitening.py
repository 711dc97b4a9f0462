"""Whitening against numpy over whole numbers and doubles, merging in any order, and vectors without variance."""

import numpy as np
import pytest

from tidemark.llm import whitening
from tidemark.llm.queries import op12_whitening


def correlated(n, d, seed, offset=0.0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + offset


@pytest.mark.parametrize("whole", [False, True])
def test_states_merge_in_any_order(whole):
    rows = correlated(500, 6, 1, 1e6)
    rows = np.floor(rows * 64).astype(np.int64) if whole else rows
    cuts = [0, 1, 2, 90, 91, 400, 500]
    parts = [whitening.state_of(rows[a:b]) for a, b in zip(cuts, cuts[1:])]
    left, right = parts[0], parts[-1]
    for p in parts[1:]:
        left = left.merge(p)
    for p in parts[-2::-1]:
        right = p.merge(right)
    exact = rows.astype(object if whole else np.longdouble)
    centred = np.array(exact - exact.sum(0) / len(rows), np.float64)
    want = centred.T @ centred
    for s in (left, right):
        assert s.n == 500 and np.allclose(s.scatter, want, rtol=1e-9, atol=1e-9 * np.abs(want).max())
        if whole:
            assert s.sums == [int(x) for x in rows.sum(0)]


def brute(rows, k):
    centred = rows - rows.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(rows))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return centred @ vectors / np.sqrt(values), values


def test_whiten(spark):
    rows = correlated(700, 8, 2)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<double>").repartition(7)
    model = whitening.fit(df, components=5)
    assert model.identity_error < 1e-9 and model.n == 700
    got = {r.id: r.whitened for r in whitening.transform(df, model).collect()}
    want, values = brute(rows, 5)
    found = np.array([got[i] for i in range(700)])
    found *= np.sign((found * want).sum(0))
    assert np.allclose(found, want, atol=1e-8)
    assert np.allclose(model.explained, values / np.trace(np.cov(rows.T, bias=True)), rtol=1e-9)


def test_other_lengths_nulls_and_constants(spark):
    rows = [(1, [1.0, 2.0, 5.0]), (2, [1.0, 2.0, 7.0]), (3, [1.0, 2.0, 9.0]), (4, [1.0]), (5, None), (6, [1.0, 2.0, 9.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    model = whitening.fit(df, "v", 32)
    got = {r.id: r.whitened for r in whitening.transform(df, model, id_col="id", vector_col="v").collect()}
    assert model.n == 4 and len(got) == 6 and got[4] is None and got[5] is None
    assert got[1][1:] == [None, None] and abs(abs(got[1][0]) - 2.5 / np.sqrt(2.75)) < 1e-12 and got[3] == got[6]
    assert model.identity_error < 1e-12 and model.explained == [1.0, 0.0, 0.0]
    one = whitening.fit(df.where("id = 1"), "v", 2)
    assert one.n == 1 and one.identity_error == 0.0 and whitening.transform(df.where("id = 1"), one, id_col="id", vector_col="v").first().whitened == [None, None]
    none = whitening.fit(df.where("id = 5"), "v", 2)
    assert none.n == 0 and whitening.transform(df.where("id < 0"), none, id_col="id", vector_col="v").count() == 0


def test_query(spark, tmp_path):
    """op12 on nulls, holes, infinities, repeated rows, clashing names: all against plain Python integers."""
    rng = np.random.default_rng(3)
    vectors = [(i, [float(np.float32(x)) for x in v], "c") for i, v in enumerate(rng.normal(size=(60, 4)) / 2)]
    bad = [(100, None, "c"), (101, [1.0, None, 1.0, 1.0], "c"), (102, [1.0, float("nan"), 1.0, 1.0], "c"), (103, [1.0, float("-inf"), 1.0, 1.0], "c"), (104, [], None)]
    rows = [*vectors, *bad, vectors[0], (None, vectors[1][1], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = op12_whitening(spark, str(tmp_path)).collect()
    kept = [r for r in rows if r[1] is not None and len(r[1]) == 4 and all(x is not None and np.isfinite(x) for x in r[1])]
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in r[1]] for r in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    want, values = brute(np.array(x, float) - 1_000_000, 4)
    deviation = {(r[0], sum((n * a - s) ** 2 for a, s in zip(v, sums))) for r, v in zip(kept, x)}
    assert len(found) == n * 4 and {(r.vec_id, r.deviation) for r in found} == deviation and {r.n for r in found} == {n}
    assert {r.component for r in found} == {1, 2, 3, 4} and found[0].identity_error < 1e-10
    by_id = {}
    for r in found:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    signs = np.sign([sum(by_id[i][k + 1].whitened * want[i][k] for i in range(60)) for k in range(4)])
    for i in range(60):
        assert all(abs(by_id[i][k + 1].whitened * signs[k] - want[i][k]) < 1e-9 for k in range(4))
    assert all(abs(by_id[0][k + 1].explained - values[k] / values.sum()) < 1e-12 for k in range(4))


def test_query_without_rows(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert op12_whitening(spark, str(tmp_path)).count() == 0


def test_deviation_beyond_a_long_is_null(spark, tmp_path):
    rows = [(1, [1e14, 0.0]), (2, [-1e14, 0.0]), (3, [0.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert all(r.deviation is None for r in op12_whitening(spark, str(tmp_path)).where("vec_id < 3").collect())
