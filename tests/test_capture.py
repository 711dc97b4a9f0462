"""Capture: rules by hand; a stream that is stopped, and killed within a batch, gives what the table gives."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.streaming import capture

COLUMNS = "key string, session_id string, msg_id long, ts timestamp, uid string, role string, content string, sender string, chat_type string"


def at(days):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=days)


def test_rules_by_hand(spark):
    said = "I prefer tea in cups"
    rows = [
        (1, 0, "u1", said, None, "dm"), (2, 1, "u2", "i PREFER  tea in cups!", None, "dm"), (3, 2, "u1", said, None, ""), (4, 3, "u4", said, "bot", "dm"), (5, 4, "u5", "never", None, "dm"), (6, 5, "u6", "hello you there", None, "dm"),
        (7, 6, "u7", "remember password: hunter2222 ok", None, "dm"), (8, 7, "u8", "always " + "x" * 300 + " a b", None, "dm"), (9, 8, "u9", None, None, "dm"), (10, 21, "u10", said, " ANA ", "group"), (11, 50, "u11", "never do it again", None, "dm"),
    ]
    df = spark.createDataFrame([("k", "s", i, at(d), u, "user", c, s, t) for i, d, u, c, s, t in rows] + [("k", "s", 12, at(51), "u", "assistant", said, None, "dm"), ("k", "s", None, at(1), "u", "user", said, None, "dm")], COLUMNS)
    judged = capture.judge(df, ("ana",))
    got = {r.msg_id: (r.route, r.reason) for r in capture.route(judged).where("route != 'expired'").collect()}
    assert got == {
        1: ("review", None), 2: ("merge_queued", None), 3: ("drop", "compaction_clone"), 4: ("drop", "not_owner"), 5: ("drop", "too_short"), 6: ("drop", "not_detected"), 7: ("drop", "possible_secret"), 8: ("drop", "too_long"),
        9: ("drop", "not_detected"), 10: ("review", None), 11: ("review", None), None: ("drop", "unreadable"),
    }
    known = judged.where("msg_id = 11").select("candidate_id")
    again = {r.msg_id: (r.route, r.reason) for r in capture.route(capture.judge(df, ("ana",), stored=known)).where("route != 'expired'").collect()}
    assert again == got | {11: ("drop", "already_stored")}


def test_stream_equals_table(spark, tmp_path):
    rng = random.Random(3)
    things = ["never do this", "i prefer that one", "remember my cat", "nothing to see", "Never do this!"]
    rows = [(f"k{rng.randint(0, 2)}", "s", i, at(i * 0.7), f"u{rng.randint(0, 40)}", "user", rng.choice(things), None, "dm") for i in range(90)]
    df = spark.createDataFrame(rows, COLUMNS)
    folder = f"file://{tmp_path}"

    def log(a, b):
        df.where(f"msg_id >= {a} AND msg_id < {b}").coalesce(1).write.mode("append").parquet(f"{folder}/log")

    def run(boom=False):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
        judged = capture.judge(stream, ("ana",))
        if boom:  # a task fails after the state of this batch was changed
            judged = judged.withColumn("uid", F.when(F.col("msg_id") == 59, F.raise_error(F.lit("lost"))).otherwise(F.col("uid")))
        query = capture.start(judged, f"{folder}/out", f"{folder}/state")
        try:
            query.awaitTermination()
        except Exception:
            return False
        return True

    log(0, 30)
    assert run()
    log(30, 45)
    log(45, 60)
    assert not run(boom=True)
    assert run()
    log(50, 75)  # some come twice
    log(75, 90)
    assert run()
    cut = lambda f: sorted((r.key, r.msg_id, r.candidate_id, r.route, r.reason or "", r.into or "") for r in f.where("route NOT IN ('expired') AND coalesce(reason, '') != 'not_detected'").collect())
    table = capture.route(capture.judge(df, ("ana",)))
    found = spark.read.parquet(f"{folder}/out")
    assert cut(found) == cut(table) and len(cut(found)) > 40
    reviews = {r.candidate_id: r.msg_id for r in table.where("route = 'review'").collect()}
    expired = [r.candidate_id for r in found.where("route = 'expired'").collect()]
    assert len(expired) == len(set(expired)) and set(expired) >= {c for c, i in reviews.items() if (89 - i) * 0.7 > 22} and all((89 - reviews[c]) * 0.7 >= 21 for c in expired)
