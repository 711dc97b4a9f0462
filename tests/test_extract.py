"""Hand-checked cases of what lines, chunks and tool calls hold."""

import hashlib
import json

from pyspark.sql import functions as F

from tidemark.operators import extract


def test_line_signals(spark):
    text = "Decision: keep Parquet.\r\nplain\nPossible decision: maybe\nActually use tabs instead\nactually it rained\n  Tool quirk - slow start \ndecision: my email is hidden\nInvariant:   \nDecided: token=sk-abcdefghijklmnop123"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "\n".join(f"decision: n{i}" for i in range(12)))], "id int, text string")
    found = extract.line_signals(rows).collect()
    assert sorted((r.line, r.candidate_type, r.memory_kind, r.text, r.confidence) for r in found if r.id == 1) == [
        (1, "memory_candidate", "decision", "Decision: keep Parquet.", 0.88), (4, "preference_candidate", "user_preference", "User preference/correction: use tabs instead.", 0.9),
        (6, "memory_candidate", "tool_quirk", "Tool quirk: slow start.", 0.86),
    ]
    assert sorted(r.line for r in found if r.id == 4) == list(range(1, 9)) and {r.id for r in found} == {1, 4}
    low = extract.line_signals(rows, floor=0.0).where("id = 1 and line = 3").first()
    assert (low.memory_kind, low.text, low.confidence) == ("decision", "Decision: maybe.", 0.5)


def test_line_signals_work(spark):
    """Folded letters and fences count as in the rules; a line is cleaned once, and what it states once more."""
    rows = spark.createDataFrame([(1, "quir\u212a - slow\n```memory decision: no```decision: yes\nno decision: here\n```x``` decision: no\nDeci\u017fion ```memory a```: c")], "id int, text string")
    found = extract.line_signals(rows)
    assert sorted((r.line, r.text) for r in found.collect()) == [(1, "Tool quirk: slow."), (2, "Decision: yes."), (5, "Decision: c.")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 2


def test_graph_markers(spark):
    text = "Graph entity: tool: Spark 4\nx\ngraph edge: tool:Spark -[USES]-> lib : Arrow\nGraph entity: nothing"
    found = extract.graph_markers(spark.createDataFrame([(1, text), (2, None)], "id int, text string")).orderBy("line").collect()
    assert [tuple(r) for r in found] == [(1, 1, "entity", "tool", "Spark 4", None, None, None), (1, 3, "edge", "tool", "Spark", "USES", "lib", "Arrow")]


def test_locate(spark):
    source = "one two\nthree  four\nfive one two"
    cases = [("three", 0, (2, 2, 13)), ("one two", 1, (3, 3, 32)), ("two\nthree", 20, (1, 2, 13)), ("three four", 0, (2, 2, 19)), ("four five", 0, (2, 3, 24)), ("absent", 4, (None, None, 4)), ("  ", 2, (None, None, 2)), ("a\\Eb", 0, (None, None, 0))]
    rows = spark.createDataFrame([(i, source, c, s) for i, (c, s, _) in enumerate(cases)], "i int, t string, c string, s int")
    found = rows.select("i", extract.locate(F.col("t"), F.col("c"), F.col("s")).alias("x")).orderBy("i").collect()
    assert [tuple(r.x) for r in found] == [x for _, _, x in cases]


def test_memory_calls(spark):
    args = json.dumps({"action": "add", "content": "c", "target": "user"})
    calls = [
        {"id": "a", "function": {"name": "memory", "arguments": args}}, {"name": "other", "arguments": "{}"}, 5,
        {"call_id": "b", "name": "memory", "arguments": {"operations": [{"action": "replace", "old_text": "o", "new_text": "n"}, {"action": "remove"}], "target": "t"}},
        {"id": "c", "function": {"name": "memory", "arguments": "not json"}}, {"id": "d", "function": {"name": "memory", "arguments": ""}},
    ]
    rows = spark.createDataFrame([(1, json.dumps(calls)), (2, "nonsense"), (3, None), (4, "{}")], "id int, tool_calls string")
    found = extract.memory_calls(rows).orderBy("id", "call", "op").collect()
    assert [(r.id, r.call, r.call_id, r.shape, r.batch, r.op, r.action, r.target, r.content, r.old_text) for r in found] == [
        (1, 1, "a", "action+content+target", False, 1, "add", "user", "c", ""), (1, 4, "b", "operations+target", True, 1, "replace", "t", "n", "o"), (1, 4, "b", "operations+target", True, 2, "remove", "t", "", ""),
        (1, 5, "c", "<unparseable>", False, 1, "", "memory", "", ""), (1, 6, "d", "<empty>", False, 1, "", "memory", "", ""),
    ]
    assert found[0].digest == hashlib.sha256(f"a\x1f{args}".encode()).hexdigest() and found[1].digest is None
