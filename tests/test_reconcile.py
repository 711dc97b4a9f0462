"""Plans by digests of ranges, applies that refuse or repeat, and bounded merges in any order."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import jsonwalk, secrets
from tidemark.operators import evaluate, origin, reconcile


def test_plan_and_apply(spark):
    rng = random.Random(2)
    old = {i: f"d{rng.randint(0, 3)}" for i in range(500)}
    new = {i: (d if rng.random() < 0.97 else d + "x") for i, d in old.items() if rng.random() < 0.98} | {1000 + i: "n" for i in range(4)}
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "id long, digest string")
    planned, snapshot, own = reconcile.plan(frame(old), frame(new), 64)
    want = {i: "new" if i not in old else "retired" if i not in new else "changed" for i in old.keys() | new.keys() if old.get(i) != new.get(i)}
    assert {r.id: r.action for r in planned.collect()} == want
    ranges = reconcile.differing(reconcile.digest_tree(frame(old), 64), reconcile.digest_tree(frame(new), 64))
    assert 0 < len(ranges) < 64
    assert reconcile.plan(frame(old), frame(old))[0].count() == 0 and reconcile.plan(frame({}), frame({}))[1] == "0:0"
    state = frame(old).withColumn("status", F.lit("active"))
    once = reconcile.apply(state, planned, snapshot=snapshot, plan_digest=own, applied=set(), ranges=64)
    rows = {r.id: (r.digest, r.status) for r in once.collect()}
    assert rows == {i: (new.get(i, old.get(i)), "active" if i in new else "superseded") for i in old.keys() | new.keys()}
    assert {r.id: (r.digest, r.status) for r in reconcile.apply(once, planned, snapshot=snapshot, plan_digest=own, applied={own}, ranges=64).collect()} == rows
    with pytest.raises(ValueError, match="changed since"):
        reconcile.apply(state.where("id != 7"), planned, snapshot=snapshot, plan_digest=own, applied=set(), ranges=64)


def test_origin_merge_random(spark):
    """Against dropping one citation after the other; any partitioning gives the same."""
    rng = random.Random(5)
    rows = [(p, rng.randint(0, 6), i, f"k{rng.randint(0, 25)}", "q" * rng.choice((5, 300)) if rng.random() < 0.4 else None, "b" * rng.choice((50, 900)), rng.random() < 0.95) for p in range(25) for i in range(rng.choice((1, 3, 12, 30)))]
    want = {}
    for p in {r[0] for r in rows}:
        own, seen = [], set()
        for r in sorted((r for r in rows if r[0] == p), key=lambda r: (r[1], r[2], r[3])):
            if r[3] not in seen:
                seen.add(r[3])
                own.append([r[3], r[4], len(r[5])])
        quoted = [c for c in own if c[1] is not None]
        for c in quoted[origin.MAX_QUOTED :]:
            c[1] = None
        total = len(own)
        while len(own) > 1 and (len(own) > origin.MAX_CITATIONS or sum(c[2] + len(c[1] or "") for c in own) > origin.MAX_BYTES):
            own.pop(next((i for i in range(1, len(own)) if own[i][1] is None), 1))
        ok = all(r[6] for r in rows if r[0] == p)
        want[p] = [(c[0], c[1], total - len(own), max(len(quoted) - origin.MAX_QUOTED, 0), ok) for c in own]
    df = spark.createDataFrame(rows, "point int, captured_at int, nth int, key string, quote string, body string, resolved boolean")
    for parts in (1, 5):
        got = {}
        for r in origin.merge(df.repartition(parts)).orderBy("point", "place").collect():
            got.setdefault(r.point, []).append((r.key, r.quote, r.dropped, r.quotes_dropped, r.verified))
        assert got == want


def test_json_by_hand(spark):
    cases = {
        '{"a": [1, {"password": {"x": [1, 2, {"y": "z"}]}, "b": true}], "Token" : 5, "c": null}': '{"a":[1,{"password":"<x>","b":true}],"Token":"<x>","c":null}',
        '{"secret_bearing": true, "contains_secret_text": "yes", "n": -1.5e3}': '{"secret_bearing":true,"contains_secret_text":"<x>","n":-1.5e3}',
        '["the Bearer said", "plain \\"quoted\\" {not: a, key}", ""]': '["<x>","plain \\"quoted\\" {not: a, key}",""]',
        "[]": "[]", "{}": "{}", None: None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "j string")
    got = {r.j: r.out for r in df.select("j", jsonwalk.redact(F.col("j")).alias("out")).collect()}
    assert got == {k: None if v is None else v.replace("<x>", secrets.MARKER) for k, v in cases.items()}
    bad = spark.createDataFrame([('{"k": {"deep": [["password: hunter2222"]]}}', True), ('{"api_key = abcdef12345": 1}', True), ('{"k": "fine"}', False), (None, False), ("", False)], "j string, bad boolean")
    assert all(r.found == r.bad for r in bad.select("bad", jsonwalk.any_secret(F.col("j")).alias("found")).collect())
    long = spark.createDataFrame([('{"t": "' + "x\\n" * 200_000 + '"}',)], "j string")
    assert not long.select(jsonwalk.any_secret(F.col("j")).alias("s")).first().s


def test_grid_equals_direct_counts(spark):
    rng = random.Random(7)
    questions = [(q, rng.choice("ab")) for q in range(40)] + [(99, "c")]
    rows = [(q, i, round(rng.random(), 2), rng.randint(1, 400), rng.random() < 0.2) for q in range(40) for i in range(rng.randint(0, 12))]
    floors = [0.0, 0.3, 0.31, 0.9]
    want = {}
    for s in "abc":
        for f in floors:
            hits = full = entries = chars = 0
            for q in (q for q, own in questions if own == s):
                used, given = 0, []
                for r in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1])):
                    used += r[3]
                    if used <= 900 and r[2] >= f:
                        given.append(r)
                hits, full, entries, chars = hits + any(r[4] for r in given), full + bool(given), entries + len(given), chars + sum(r[3] for r in given)
            want[s, f] = (sum(own == s for _, own in questions), hits, full, entries, chars)
    got = evaluate.threshold_grid(spark.createDataFrame(questions, "question int, set string"), spark.createDataFrame(rows, "question int, item int, score double, chars long, answers boolean"), floors, 900)
    assert {(r.set, r.floor): (r.questions, r.hits, r.nonempty, r.entries, r.chars) for r in got.collect()} == want
