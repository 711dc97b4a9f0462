"""Texts that share most words with each of many queries, against a plain loop."""

import random

from pyspark.sql import functions as F

from tidemark.operators import retrieve
from tidemark.plans import memory_queries


def test_most_shared_words_of_many_queries(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(50)] + ["ñandú", "日本"]
    texts = {f"{i}/{i % 3}": rng.sample(vocabulary, rng.randint(0, 12)) for i in range(300)}
    queries = {i: rng.sample(vocabulary, rng.randint(0, 6)) + [f"other{i}"] for i in range(40)} | {41: [], 42: ["nowhere"]}
    frame = spark.createDataFrame([(k, v) for k, v in texts.items()] + [("none", None)], "id string, words array<string>").repartition(5)
    asked = spark.createDataFrame(list(queries.items()), "query_id long, words array<string>")
    for fetch in (4, 1000):
        found = retrieve.shared_words(frame, asked, fetch=fetch, block=7, chunk=40)
        want = {}
        for q, words in queries.items():
            hits = sorted((-len(set(words) & set(t)), i) for i, t in texts.items())
            want |= {(q, i): -n for n, i in hits[:fetch] if n}
        assert {(r.query_id, r.id): r.score for r in found.collect()} == want


def test_queries_are_not_joined_by_word(spark):
    """What is exchanged for the pairs is cut to ``fetch`` rows a query first: no join has a word as its key."""
    texts = spark.range(30).select(F.col("id").cast("string").alias("id"), F.array(F.lit("same")).alias("words"))
    plan = retrieve.shared_words(texts, texts.select(F.col("id").alias("query_id"), "words"), fetch=3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "WindowGroupLimit" in plan and "HashJoin" not in plan and "SortMergeJoin" not in plan


def test_recall_asks_with_every_line(spark, tmp_path):
    """Each line of a conversation of the set is a query, not only the first."""
    rows = [(100, 0, "user", "nothing here recurs"), (100, 1, "assistant", "migrating databases yesterday"), (7, 0, "user", "the databases were migrating"), (8, 3, "user", "elsewhere")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {(r.query_id, r.id) for r in memory_queries.session_recall(spark, str(tmp_path)).collect()}
    assert found == {("100/0", "100/0"), ("100/1", "100/0"), ("100/1", "7/0")}
