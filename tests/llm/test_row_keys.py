"""Rows told apart: ids that are null, empty or hold the separator; many equal rows; columns named as keys are."""

import corpus_pipeline
from tidemark.llm import common, mixing


def test_ids_that_look_alike(spark):
    rows = [(None, "a b c", "s"), ("", "a b c", "s"), ("x|y", "z w v", "s"), ("x", "y|z w v", "s"), ("x|y", "z w v", "s"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string")
    plan = mixing.plan(df)
    assert plan.count() == len(rows)
    taken = {}
    for r in plan.collect():
        taken[r.id] = taken.get(r.id, 0) + r.taken
    words = {}
    for r in mixing.copies(df).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len((r.text or "").split())
    assert all(abs(words.get(i, 0) - n) < 3 for i, n in taken.items())  # whole documents: the last one may end later


def test_many_equal_rows(spark):
    df = spark.range(20_000).selectExpr("7 AS doc_id", "'one two' AS text", "'s' AS source")
    plan = mixing.plan(df)
    row = plan.selectExpr("count(*) AS n", "count(DISTINCT start) AS starts", "max(start) AS last", "sum(taken) AS taken").first()
    assert (row.n, row.starts, row.last, row.taken) == (20_000, 20_000, 39_998, 60_000)


def test_key_names(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "_row int, __ROW string")
    keyed, key = common.keyed(df, "key-names")
    assert key == "___row" and keyed.columns == ["_row", "__ROW", key] and keyed.select(key).distinct().count() == 2


def test_stage_with_a_column_named_as_the_key(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d", "en", "s", 7, "x"), (2, "a b c d", "en", "s", 7, "y"), (3, "other words here now", "en", "s", 9, "z")], "doc_id long, text string, lang string, source string, n_chars long, _row string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {(r.doc_id, r._row) for r in kept.collect()} == {(1, "x"), (3, "z")}
