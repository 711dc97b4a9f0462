"""Plans of many events against a walk of each by itself."""

import random

import pytest

from tidemark.operators import invalidation


def walk(roots, edges, points, depth, max_points, max_edges):
    seen, found, used, frontier, from_roots = set(roots), {}, 0, set(roots), {r: {r} for r in roots}
    for at in range(depth + 1):
        level = {(d, s) for d, s in edges if s in frontier}
        if len(level) > max_points - len(found):
            return "points", len(found), used, {}
        new = {d for d, _ in level} - seen
        if new - points:
            return "missing", len(found), used, {}
        if used + len(level) > max_edges:
            return "edges", len(found), used, {}
        used += len(level)
        if at == depth and new:
            return "depth", len(found), used, {}
        for d in new:
            from_roots[d] = set().union(*(from_roots[s] for e, s in level if e == d))
            found[d] = at + 1
        seen |= new
        frontier = new
    return None, len(found), used, {d: (n, tuple(sorted(from_roots[d]))) for d, n in found.items()}


@pytest.mark.parametrize("seed,bounds", [(1, (3, 12, 14)), (2, (8, 4096, 8192)), (3, (2, 30, 9)), (4, (0, 5, 5))])
def test_random_graphs(spark, seed, bounds):
    rng = random.Random(seed)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(100)] + [(200 + i, 199 + i) for i in range(1, 12)] + [(5, 5), (300, 299), (299, 300)]
    points = {i for i in range(400) if i not in (17, 44)}
    roots = {f"e{i}": {rng.choice([rng.randrange(90), 200, 299, 380]) for _ in range(rng.choice((1, 1, 2, 5)))} for i in range(25)}
    want = {e: walk(r, set(edges), points, *bounds) for e, r in roots.items()}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    depth, max_points, max_edges = bounds
    status, changes = invalidation.plan(
        frame([(e, i) for e, r in roots.items() for i in r] + [("e0", None)], "event string, id int"), frame(edges + edges[:9] + [(None, 1), (1, None)], "dependent int, source int"),
        frame([(i,) for i in points], "id int"), depth=depth, max_points=max_points, max_edges=max_edges,
    )
    assert {r.event: (r.error, r.points, r.edges) for r in status.collect()} == {e: w[:3] for e, w in want.items()}
    got = {}
    for r in changes.collect():
        got.setdefault((r.event, r.id), [set(), set()])[0].add(r.depth)
        got[r.event, r.id][1].add(r.root)
    assert {k: (min(d), tuple(sorted(r))) for k, (d, r) in got.items()} == {(e, i): v for e, w in want.items() for i, v in w[3].items()}


def test_patches_by_hand(spark):
    dependents = spark.createDataFrame([("e", 1, 1, 9), ("e", 1, 1, 8), ("f", 1, 2, 7), ("e", 2, 1, 9), ("e", 3, 1, 9)], "event string, id int, depth int, root int")
    full = [f"x{i}" for i in range(32)]
    points = spark.createDataFrame([(1, "active", ["e", "e"]), (2, "stale", full), (3, None, None)], "id int, fact_status string, causes array<string>")
    got = {(r.event, r.id): (r.roots, r.fact_status, r.causes, r.truncated) for r in invalidation.patches(dependents, points).collect()}
    assert got == {("e", 1): ([8, 9], "review_required", ["e"], False), ("f", 1): ([7], "review_required", ["e", "f"], False), ("e", 2): ([9], "stale", full, True), ("e", 3): ([9], "review_required", ["e"], False)}
    with pytest.raises(ValueError):
        invalidation.plan(dependents, dependents, dependents, depth=17)


def test_edges_and_points_are_read_once(spark):
    """However many levels a plan has, what tasks read of the edges and points is one pass of each."""
    seen = {name: spark.sparkContext.accumulator(0) for name in ("edges", "points")}

    def counted(df, name):
        def each(rows):
            for row in rows:
                seen[name].add(1)
                yield row

        return spark.createDataFrame(df.rdd.mapPartitions(each), df.schema)

    edges = counted(spark.createDataFrame([(i + 1, i) for i in range(20)], "dependent int, source int"), "edges")
    points = counted(spark.createDataFrame([(i,) for i in range(30)], "id int"), "points")
    status, changes = invalidation.plan(spark.createDataFrame([("e", 0)], "event string, id int"), edges, points, depth=6)
    assert [tuple(r)[1:3] for r in status.collect()] == [(False, "depth")] and changes.count() == 0
    assert {name: n.value for name, n in seen.items()} == {"edges": 20, "points": 30}
