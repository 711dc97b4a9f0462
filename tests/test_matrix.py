"""Percentiles of the evaluation matrix over many different latencies, against a sorted list."""

import random

from tidemark.operators import evaluate


def test_matrix_percentiles_are_exact(spark):
    rng = random.Random(3)
    runs = [(rng.choice("ab"), rng.choice(("d", None)), rng.sample(("x", "y"), rng.randint(0, 2)), rng.random() < 0.5, None, rng.choice((None, *[rng.lognormvariate(5, 2)] * 9))) for _ in range(30000)]
    found = evaluate.matrix(spark.createDataFrame(runs, "variant string, domain string, tags array<string>, hit boolean, wrong boolean, latency_ms double")).collect()
    want = []
    cells = {}
    for variant, domain, tags, *_, latency in runs:
        for key in [(0, variant, domain, None), (1, variant, None, None), (2, None, domain, None), (3, None, None, None)] + [k for t in tags for k in ((4, variant, domain, t), (5, variant, None, t), (6, None, None, t))]:
            cells.setdefault(key, []).append(latency)
    for (_, *key), latencies in cells.items():
        known = sorted(x for x in latencies if x is not None)
        want.append((*key, len(latencies), known[-(-len(known) // 2) - 1], known[-(-len(known) * 95 // 100) - 1]))
    assert sorted([(r.variant, r.domain, r.tag, r.runs, r.latency_p50, r.latency_p95) for r in found], key=str) == sorted(want, key=str)
    assert all(r.wrong_rate is None for r in found)
