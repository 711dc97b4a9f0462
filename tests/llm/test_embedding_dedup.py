"""Embedding near-duplicates against brute force, and recall with the parameters of the query."""

from collections import Counter

import numpy as np

from tidemark.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<double>, label int"


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 16))
    hot = base[0] + rng.normal(scale=0.05, size=(150, 16))
    vectors = [*base, *(base[:20] * 2), *(base[20:40] + rng.normal(scale=0.03, size=(20, 16))), *hot]
    rows = [(i, [float(x) for x in v], i % 2 if i < 100 else 0) for i, v in enumerate(vectors)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, rows[0][1], None), (904, [1.0, 2.0], 0), (905, [None] * 16, 0), (906, [], 0), (907, rows[0][1], 0)]
    schema = "vec_id long, embedding array<double>, label int"
    ok = {r[0]: np.array(r[1]) for r in rows if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])}
    label = {r[0]: r[2] for r in rows}
    cos = lambda a, b: float(ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]))
    links = {(a, b) for a in ok for b in ok if a != b and label[a] == label[b] and len(ok[a]) == len(ok[b]) and cos(a, b) >= 0.93}
    for options in ({}, {"tile": 16}):
        got = {r.id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, schema), per_pivot=4, **options).collect()}
        assert len(got) == len(rows)
        want = Counter(a for a, _ in links)
        assert sum(got[i].n_links for i in got) >= 0.99 * len(links) and all(got[i].n_links <= want[i] for i in got)
        assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 904, 905, 906))
        assert got[907].component_id == 0 and not got[907].kept
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_embeddings_that_are_all_close(spark):
    rng = np.random.default_rng(7)
    group = rng.normal(size=16) + rng.normal(scale=0.05, size=(300, 16))  # pivots: one
    common_part = 2 * np.eye(24)[0] + rng.normal(scale=0.16, size=(100, 24))
    common_part[50:] = common_part[:50] + rng.normal(scale=0.01, size=(50, 24))
    pair = rng.normal(size=8) + rng.normal(scale=0.01, size=(2, 8))
    vectors = [*group, *common_part, *pair]
    df = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    want = Counter()
    for start, part in ((0, group), (300, common_part), (400, pair)):
        u = part / np.linalg.norm(part, axis=1)[:, None]
        want.update({start + i: int(n) for i, n in enumerate((u @ u.T >= 0.93).sum(1) - 1)})
    assert want[0] > 100 and want[300] >= 1 and want[401] == 1
    for options in ({}, {"tile": 64}):
        assert {r.id: r.n_links for r in embedding_dedup.near_duplicates(df, **options).collect()} == dict(want)


def test_recall_with_the_parameters_of_the_query(spark):
    """Pairs at cosines of 0.93 to 0.96 among unrelated vectors: the default parameters, as op7 uses them."""
    rng = np.random.default_rng(0)
    n, d = 3000, 64
    base = rng.normal(size=(n, d))
    base /= np.linalg.norm(base, axis=1)[:, None]
    c, other = rng.uniform(0.93, 0.96, n)[:, None], rng.normal(size=(n, d))
    other -= (other * base).sum(1)[:, None] * base
    other /= np.linalg.norm(other, axis=1)[:, None]
    vectors = np.concatenate([base, c * base + np.sqrt(1 - c**2) * other]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    u = vectors.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = (u @ u.T >= 0.93).sum(1) - 1
    got = {r.id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    assert want.sum() > 5900 and all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.99 * want.sum()
    whole = {r.id: r.n_links for r in embedding_dedup.near_duplicates(df.where("vec_id % 3000 < 400"), exact=True, tile=256).collect()}
    assert whole == {i: int(want[i]) for i in whole}


def test_scale_of_vectors_does_not_matter(spark):
    rows = [(0, [1e200, 1e200], 0), (1, [2e200, 2e200], 0), (2, [1e-200, 1e-200], 0), (3, [3.0, 3.0], 0), (4, [5e-324, 5e-324], 0), (5, [1.0, -1.0], 0), (None, [2.0, 2.0], 0), (None, None, 0), (6, [9.0, 9.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1, True) for r in rows], SCHEMA + ", node string, n_links int, kept boolean")
    got = [(r.id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([*((i, 5, 0) for i in (0, 1, 2, 3, 4, None)), (5, 0, 5), (6, 0, 6), (None, 0, None)], key=str)
