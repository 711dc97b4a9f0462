"""Hand-checked values of scalar rules, and invariants of list and window operators."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import jsonwalk, scoring, secrets
from tidemark.functions import text as tx
from tidemark.functions import vector
from tidemark.operators import components, consolidation, evaluate, graph, search, windows
from tidemark.sources import files, tables
from tidemark.streaming import events, window_index


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scores(spark):
    pool = spark.createDataFrame([(0.3,), (0.3,)], "s double")
    assert [r.x for r in pool.select(scoring.minmax(F.col("s")).alias("x")).collect()] == [1.0, 1.0]
    assert one(spark, scoring.final_score(F.lit(0.8), F.lit(5), F.lit(1.0))) == pytest.approx(0.4)
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert one(spark, scoring.recency(at, at + F.expr("INTERVAL 1000 HOURS"))) == pytest.approx(0.36787944)
    assert one(spark, scoring.recency(F.lit(None).cast("timestamp"), at)) == 1.0
    assert one(spark, scoring.derivation_factor(F.lit(30))) == 0.5
    assert one(spark, scoring.zoom_efficiency(F.lit(2), F.lit(4000))) == 0.5
    row = spark.createDataFrame([(True, False, None, True, "s", "k")], "stale boolean, requires_review boolean, fact_status string, canonical boolean, source string, fact_key string")
    assert row.select(scoring.provenance_factor().alias("x")).first().x == pytest.approx(0.648)
    assert row.select(scoring.provenance_factor(history=True).alias("x")).first().x == pytest.approx(1.08)


def test_vectors(spark):
    assert one(spark, vector.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.70710678)
    assert one(spark, vector.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    pooled = one(spark, vector.pool(F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))), F.array(F.lit(3.0), F.lit(4.0))))
    assert pooled == pytest.approx([0.6, 0.8])


def test_text_rules(spark):
    assert one(spark, tx.jaccard(F.split(F.lit("a b c d"), " "), F.split(F.lit("a b c e"), " "))) == pytest.approx(0.6)
    assert one(spark, tx.fingerprint(F.lit(" The  Cat, (sat)! -- "))) == "the cat sat"
    assert one(spark, tx.snippet(F.lit("abc   def ghi"), 6)) == "abc d…"
    assert one(spark, tx.strong_signal(F.lit("what became of OPS-77 last week")))
    assert not one(spark, tx.strong_signal(F.lit("where did the boats go?")))
    path = tx.path_parts(F.lit("/srv/books/shop/v2/orders.txt"))
    assert not one(spark, tx.aligned(tx.path_parts(F.lit("/shop/v2/order")), path))
    assert one(spark, tx.aligned(tx.path_parts(F.lit("/shop/v2/orders")), path))
    secret = "key sk-abcdefghijklmnop end"
    assert one(spark, tx.has_secret(F.lit(secret))) and not one(spark, tx.has_secret(F.lit("task-abcdefghijklmnop")))
    assert one(spark, tx.redact(F.lit(secret))) == "key [REDACTED] end"
    assert one(spark, tx.slug(F.lit("Hello, World!"))) == "hello-world"
    assert one(spark, tx.word_chars(F.lit("año ok"))) == 5


def test_fusion_and_packing(spark):
    lists = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "b"), (2, 2, "c")], "list int, rank int, id string")
    fused = {r.id: (r.rank, r.fused) for r in search.rrf(lists).collect()}
    assert [k for k, _ in sorted(fused.items(), key=lambda x: x[1][0])] == ["b", "a", "c"]
    assert fused["b"][1] == pytest.approx(1 / 62 + 1 / 61)
    items = spark.createDataFrame([(0, 0, 6), (0, 1, 5), (0, 2, 4)], "g int, o int, size int")
    packed = search.budget_greedy(items, 10, group="g", order="o", size="size", id_col="o").collect()
    assert sorted(r.o for r in packed) == [0, 2] and packed[0].used == 10
    shares = search.even_share(items, 10, group="g", order="o", size="size").orderBy("o").collect()
    assert [r.kept_chars for r in shares] == [3, 3, 4]


def test_window_starts(spark):
    assert one(spark, windows.window_starts(F.lit(2000), 1000, 128)) == [0, 872, 1744]
    assert one(spark, windows.window_starts(F.lit(10), 1000, 128)) == [0]


def test_increments_equal_rebuild(spark):
    rng = random.Random(5)
    rows = [(c, t, "user", "".join(rng.choice("abc \n") for _ in range(rng.randint(0, 90)))) for c in range(12) for t in range(rng.randint(1, 40))]
    schema = "conv_id long, turn long, role string, text string"
    whole = spark.createDataFrame(rows, schema)
    for edit in (False, True):
        first = [r for r in rows if r[1] < 3 + 2 * r[0]]
        if edit:  # a rewritten prefix in one session
            first = [(c, t, r, "other" if (c, t) == (3, 1) else x) for c, t, r, x in first]
        old = spark.createDataFrame(first, schema)
        index = windows.char_windows(windows.serialise(old), 100, 16)
        got = window_index.advance(index, window_index.cursor(old), whole, 100, 16)
        want = windows.char_windows(windows.serialise(whole), 100, 16)
        key = lambda df: sorted(map(tuple, df.select("conv_id", "char_start", "first_turn", "last_turn", "text").collect()))
        assert key(got) == key(want)


def test_event_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, i * 7 % 10, i, f"s{i % 4}") for i in range(40)], "k int, at int, seq int, kind string")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    states = []

    def sink(df, epoch):
        states.append([tuple(r) for r in df.collect()])

    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    events.fold_stream(stream, sink, key="k", at="at", seq="seq", kind="kind", checkpoint=str(tmp_path / "cp")).start().awaitTermination()
    schema = "k int, at int, seq int, kind string, n_events long"
    state = spark.createDataFrame(states[0], schema)
    for more in states[1:]:
        state = events.merge_states(state, spark.createDataFrame(more, schema), key="k", at="at", seq="seq", kind="kind")
    want = events.fold(rows, key="k", at="at", seq="seq", kind="kind")
    assert sorted((r.k, r.kind, r.n_events) for r in state.collect()) == sorted((r.k, r.status, r.n_events) for r in want.collect())


def test_components_and_greedy(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (7, 9, 0.9), (3, 4, 0.9)], "a long, b long, jaccard double")
    assert {r.node: r.component for r in components.components(pairs).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 9: 7}
    taken = consolidation.greedy_star(pairs).collect()
    assert sorted((r.seed, r.id) for r in taken) == [(1, 2), (3, 4), (7, 9)]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "a"), ("c", "a"), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {r.id: r.depth for r in graph.expand(seeds, edges, depth=2).collect()} == {"a": 0, "b": 1, "c": 2}
    depends = edges.select(F.col("dst").alias("dependent"), F.col("src").alias("source"))
    found, whole = graph.closure(seeds, depends)
    assert whole and {r.id for r in found.collect()} == {"a", "b", "c", "d"}
    assert not graph.closure(seeds, depends, depth=1)[1]
    parents = spark.createDataFrame([(3, 2), (2, 1), (1, 3)], "id int, parent int")
    assert {(r.id, r.ancestor): r.distance for r in graph.chain(parents).collect()}[(3, 1)] == 2


def test_chunks_and_jsonl(spark, tmp_path):
    text = "# A\n\n# B\nx\n\n" + "y" * 30 + "\n\nz"
    assert files.chunk_markdown(text, 20) == [("B", "x"), ("B", "y" * 20), ("B", "y" * 10 + "\n\nz")]
    (tmp_path / "a.jsonl").write_text('{"case_id": "1"}\n\n# note\nbroken\n')
    rows = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "case_id string").collect()
    assert sorted((r.case_id or "") for r in rows) == ["", "1"]


def test_writes(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    changed = tables.upsert(rows, spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"))
    assert sorted(map(tuple, changed.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    digests = tables.row_digest(rows)
    assert tables.verify_backup(digests).count() == 0


@pytest.mark.parametrize(
    "text, clean",
    [
        ("pw: password=swordfish; next", "pw: password=<x>; next"),
        ("secret = '***'", "secret = '***'"),
        ('token: "(empty)".', 'token: "(empty)".'),
        ("my_token: a", "my_token: <x>"),
        ("thetoken: abcdefgh", "thetoken: abcdefgh"),
        ("the token bucket holds 12345678", "the token bucket holds 12345678"),
        ("use token zz11yy22xx", "use token <x>"),
        ("the secret ingredient is salt", "the secret ingredient is salt"),
        ("api key, then api_key q1w2e3r4", "api key, then api_key <x>"),
        ("-----BEGIN RSA PRIVATE KEY-----\nAAAA\n-----END RSA PRIVATE KEY----- bye", "<x><x> bye"),
        ("-----BEGIN PRIVATE KEY-----\ncut off", "<x><x>"),
        ("password =\nsecond line", "password =\nsecond line"),
        ("", ""),
        (None, None),
    ],
)
def test_secret_spans(spark, text, clean):
    """``<x>`` stands for the marker; spans that overlap, as of a private key and its first line, give one each."""
    row = spark.createDataFrame([(text,)], "t string").select(secrets.has_secret(F.col("t")).alias("found"), secrets.redact(F.col("t")).alias("clean")).first()
    assert row.found == (text != clean)
    assert row.clean == (None if clean is None else clean.replace("<x>", secrets.MARKER))


def test_json_redaction_reads_tokens_once(spark):
    """What a token says is worked out once for keys and once for strings; malformed tokens stay."""
    document = '{"to\\u006ben" : [1, {"a": "b"}], "secret_bearing": true, "x": "Bearer", "y": ["my to\u212aen: abc", "plain", "\\q"], "n": null}'
    found = spark.createDataFrame([(document,), (None,)], "d string").select(jsonwalk.redact(F.col("d"), "#").alias("d"))
    assert [r.d for r in found.collect()] == ['{"to\\u006ben":"#","secret_bearing":true,"x":"#","y":["#","plain","\\q"],"n":null}', None]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 2


@pytest.mark.parametrize("text", ["xsk-", "gho_", "AKIA", "eyJ", "PRIVATE KEY", "a://b", "API_KEY", "ap\u0131-\u212aey", "Pas\u017fw", "\u017fecret", "TO\u212aEN", "AuthorIzation", "bearer", "CREDENT\u0130AL", "private-key"])
def test_secret_hint(spark, text):
    assert one(spark, F.lit(f"so {text} it").rlike(secrets.HINT)) and not one(spark, F.lit(f"so {text[:2]} {text[3:]} it").rlike(secrets.HINT))


def test_gate_fails_closed(spark):
    columns = "variant string, errored boolean, hit_at_k boolean, source_hit_at_k boolean, exact_identifier_hit boolean, wrong_memory boolean, latency_ms double, latency_budget_met boolean"
    good = [("new", False, True, True, True, False, 10.0, True)] * 10 + [("old", False, True, True, None, False, 10.0, True)] * 10
    checks = {r.check_name: r for r in evaluate.gate(evaluate.summarise(spark.createDataFrame(good, columns)), "new", ["old"]).collect()}
    assert [name for name, r in checks.items() if not r.passed] == ["exact_id_drop"] and checks["exact_id_drop"].actual is None and len(checks) == 12
    bad = [(*r[:1], True, *r[2:]) if i == 0 else r for i, r in enumerate(good)]
    checks = {r.check_name: r for r in evaluate.gate(evaluate.summarise(spark.createDataFrame(bad, columns)), "new", ["old"]).collect()}
    assert [name for name, r in checks.items() if not r.passed] == ["scored_count", "errored_count", "exact_id_drop"]
    only = evaluate.gate(evaluate.summarise(spark.createDataFrame(good, columns)), "other", ["old"]).collect()
    assert [(r.check_name, r.passed) for r in only] == [("candidate_present", False)]
    assert [r.check_name for r in evaluate.gate(evaluate.summarise(spark.createDataFrame([], columns)), "new", ["old"]).collect()] == ["candidate_present"]
