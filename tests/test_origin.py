"""Citations whose messages moved: looked up between their ends, as at every place."""

import random

from pyspark.sql import functions as F

from tidemark.operators import origin


def test_check_between_ends_as_anywhere(spark):
    rng = random.Random(7)
    was = [("s", i * 10, f"u{i}", i * 10, "user", f"text {i}") for i in range(60)] + [("t", i * 10, f"v{i}", i * 10, "user", f"text {i}") for i in range(20)]
    now = []
    for session, i, uid, ts, role, text in was:
        kind = rng.random()
        if kind < 0.15:
            continue  # gone
        if kind < 0.35:
            session, i = "c", i + 1000  # moved to what continues the session
        elif kind < 0.45:
            now.append(("d", i + 5000, uid, ts + rng.choice((-25, 0, 35)), role, text + " copy"))
        elif kind < 0.5:
            text += "!"
        now.append((session, i, uid, ts, role, text))
    now += [("c", 3000, "u3", 35, "user", "text 3"), ("s", 7000, "", None, "user", "no uid or time")]
    names = "session_id string, id long, uid string, ts long, role string, content string"
    old, new = spark.createDataFrame(was, names), spark.createDataFrame(now, names)
    spans = [(n, "s", a * 10, (a + rng.choice((0, 0, 1, 2, 5, 30))) * 10) for n, a in enumerate(rng.choices(range(60), k=120))] + [(500, "t", 0, 190), (501, "gone", 0, 5)]
    wanted = spark.createDataFrame(spans, "citation long, session_id string, first_msg_id long, last_msg_id long")
    sessions = spark.createDataFrame([("s", None), ("t", None), ("c", "s"), ("d", "c")], "session_id string, parent string")
    cited = origin.cite(wanted, old).checkpoint()
    found = {r["citation"]: r["status"] for r in origin.check(cited, new, sessions).collect()}
    plain = {r["citation"]: r["status"] for r in origin.check(cited.drop("first_uid", "last_uid"), new, sessions).collect()}
    assert found == plain
    assert set(found.values()) >= {"verified", "drifted", "verified_via_uid", "partially_missing"}
    ends = {r["citation"]: (r["first_uid"], r["last_uid"]) for r in cited.where(F.col("citation") == 500).collect()}
    assert ends == {500: ("v0", "v19")}
