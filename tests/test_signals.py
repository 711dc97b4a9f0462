"""Hand-checked cases of the rules that read messages, and of capped counts."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import signals as sg
from tidemark.sources import tables
from tidemark.streaming import events


def of(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", column.alias("x")).orderBy("i")
    return [r.x for r in rows.collect()]


def test_rules_fired(spark):
    texts = ["No, I prefer it always", "I'd rather not. It is out of scope", "`always` https://x/never\n > never", "nevermore", None, "", "JAMÁS", "debería"]
    found = [(x.kind, x.rules) for x in of(spark, texts, sg.rules_fired(F.col("text")))]
    assert found == [("correction", ["initial_no", "never_always", "prefer"]), ("preference", ["prefer", "scope"]), (None, []), (None, []), (None, []), (None, []), ("invariant", ["never_always"]), (None, [])]


@pytest.mark.parametrize(
    "user, assistant, probe",
    [("say exactly BLUE", "Blue!", True), ("say BLUE", "BLUE", False), ("say exactly BLUE", "BLUE it is", False), ("exactly", "", False), (None, None, False), ("exactly " + "x" * 500, "x", False), ("literally '" + "y" * 90 + "'", "y" * 81, False)],
)
def test_echo_probe(spark, user, assistant, probe):
    row = spark.createDataFrame([(user, assistant)], "u string, a string").select(sg.echo_probe(F.col("u"), F.col("a")).alias("x")).first()
    assert row.x is probe


def test_turn_sides(spark):
    found = of(spark, ["User: a\nAssistant: b\nAssistant: c", "User: a", None], sg.turn_sides(F.col("text")))
    assert [(x.user, x.assistant) for x in found] == [("a", "b\nAssistant: c"), ("User: a", ""), ("", "")]


def test_tags(spark):
    texts = ["---\ntags: [b, '#a', ]\n---\n#c/d x#e", "---\ntags:\n  - z\nother:\n- no\n---\n", "---\ntags: solo\n---", "tags: none #Z #a #a", None, ""]
    assert of(spark, texts, sg.tags(F.col("text"))) == [["a", "b", "c/d"], ["z"], ["solo"], ["Z", "a"], [], []]


def test_terms_present(spark):
    assert of(spark, ["The Cat", None], sg.terms_present(["cat", "", "x", "THE"], F.col("text"))) == [["cat", "THE"], []]
    assert of(spark, ["a"], sg.terms_present([], F.col("text"))) == [[]]


def test_capped_ids(spark):
    rows = [("a", i % 50) for i in range(500)] + [("b", 7), ("b", 7), ("b", None), (None, 1)]
    found = {r.k: (r.n, r.n_ids, r.ids, r.truncated) for r in events.capped_ids(spark.createDataFrame(rows, "k string, id long"), by="k", cap=3, salts=4).collect()}
    assert found == {"a": (500, 50, [0, 1, 2], True), "b": (3, 1, [7], False), None: (1, 1, [1], False)}
    assert events.capped_ids(spark.createDataFrame([], "k string, id long"), by="k").collect() == []


def test_count_on_day_and_delete_where(spark):
    rows = spark.createDataFrame([("2024-01-01 23:59:59", "x"), ("2024-01-02 00:00:00", "x"), (None, "x"), ("2024-01-01 01:00:00", None)], "at string, k string").withColumn("at", F.col("at").cast("timestamp"))
    assert events.count_on_day(rows, day="2024-01-01", at="at", where=F.col("k") == "x").first().n == 1
    assert tables.delete_where(rows, F.col("k") == "x").count() == 1
