"""Payload rules, merged retrieval, duplicates and trees against cases by hand and brute force."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark.functions import payload as pl
from tidemark.functions import text as tx
from tidemark.operators import consolidation, graph, retrieve, tree


def test_importance_by_hand(spark):
    cases = {
        "Okay.": (1, 1), " thank you ": (1, 1), "short": (3, 5), "short but never mind": (5, 9), "a text that is long enough to stay where it starts": (5, 7),
        "an unimportant text that has a keyword as a part": (7, 9), "": (3, 5), None: (3, 5), "one two three four five six seven eight nine": (5, 7), "no. way": (3, 5),
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    got = {r.text: (r.a, r.b) for r in df.select("text", tx.importance(F.col("text"), F.lit(False)).alias("a"), tx.importance(F.col("text"), F.lit(True)).alias("b")).collect()}
    assert got == cases


def test_headings_by_hand(spark):
    cases = {"# Project Falcon": False, "## Notas": True, "Notas": True, "Project Falcon": None, "# one two three four five": None, "# Is it so?": None, "#Tareas": True, "#" + "x" * 90: None, "": None, "##": False, "# # Next   handoff:": True}
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    got = {r.text: r.known for r in consolidation.heading_noise(df).collect()}
    assert got == {t: k for t, k in cases.items() if k is not None}


def test_signal_tokens_in_order(spark):
    texts = [
        "see OPS-77 at /srv/app/v2 and pkg.mod.Thing then Ns::Part raised KeyError: bad_key HTTP 503 over user_id", "naïve café_x señor_y", "the and of", None, "",
        "0123456789abcdef0123456789abcdef 01234567-89ab-cdef-0123-456789abcdef (`quoted_name`)", " ".join(f"name{i}x" for i in range(100)),
    ]

    def brute(text):
        out = []
        for p in (*tx.TOKENS, tx.IDENTIFIER):
            for m in re.finditer(p, text or ""):
                t = m.group(0).strip().strip("`'\".,;:()[]{}<>")
                if t and t not in out and not (p == tx.IDENTIFIER and t.lower() in tx.STOP_WORDS):
                    out.append(t)
        return out[:64]

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", tx.signal_tokens(F.col("text")).alias("t")).collect()
    assert {r.i: r.t or [] for r in rows} == {i: brute(t) for i, t in enumerate(texts)}


def test_greedy_seeds_with_copies(spark):
    rng = random.Random(5)
    for _ in range(3):
        n = 40
        near = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(45)}
        copies = {i: sorted(rng.sample(range(1000, 1400), rng.randint(1, 3))) for i in rng.sample(range(n), 12)}
        flat = [x for xs in copies.values() for x in xs]
        copies = {i: [x for x in xs if flat.count(x) == 1] for i, xs in copies.items()}
        rep = {x: i for i, xs in copies.items() for x in xs} | {i: i for i in range(n)}
        same = lambda a, b: rep[a] == rep[b] or tuple(sorted((rep[a], rep[b]))) in near
        used, want = set(), set()
        for a in sorted(rep):
            if a in used:
                continue
            group = [b for b in rep if b != a and b not in used and same(a, b)]
            if group:
                used |= {a, *group}
                want |= {(a, b) for b in group}
        pairs = spark.createDataFrame([(a, b, 0.95) for a, b in near] + [(i, x, 1.0) for i, xs in copies.items() for x in xs], "a long, b long, jaccard double")
        assert {(r.seed, r.id) for r in consolidation.greedy_star(pairs).collect()} == want


def test_collapse_of_windows(spark):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(80)) for _ in range(6)]
    texts = [*base, *(b[len(b) // 8 :] + " tail" for b in base[:3]), base[4], " ".join(reversed(base[5].split())), "", None]
    rows = [(1, f"id{i}", t, float(rng.randint(1, 5)), float(i)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "query_id long, id string, text string, score double, start_ts double")
    got = {r.id: set(r.members) for r in retrieve.collapse_duplicates(df, keep=50).collect()}
    assert sorted(x for m in got.values() for x in m) == sorted(r[1] for r in rows)
    groups = {frozenset(m) for m in got.values()}
    assert all(any({f"id{i}", f"id{j}"} <= g for g in groups) for i, j in ((0, 6), (1, 7), (2, 8), (4, 9), (11, 12)))
    assert not any({"id5", "id10"} <= g for g in groups) and len(groups) == 8
    for r in retrieve.collapse_duplicates(df, keep=3, near=False).collect():
        assert r.place <= 3


def run_rule(a: list[str], b: list[str]) -> bool:
    """Three quarters of the shorter text's words are one run of the longer, and as much of its set of words is in the other's."""
    if not a or not b or len(set(a) & set(b)) < 0.75 * min(len(set(a)), len(set(b))):
        return False
    return SequenceMatcher(None, a, b, autojunk=False).find_longest_match(0, len(a), 0, len(b)).size >= 0.75 * min(len(a), len(b))


def cuts(rng: random.Random, n: int, words: int) -> list[list[str]]:
    """Texts of few distinct words, many of them cut from each other."""
    out = []
    for _ in range(n):
        if out and rng.random() < 0.7:
            base = list(rng.choice(out))
            base = base[rng.randint(0, max(len(base) // 3, 1)) :] + [f"w{rng.randint(0, words)}" for _ in range(rng.randint(0, 3))]
            if base and rng.random() < 0.3:
                base[rng.randrange(len(base))] = "other"
        else:
            base = [f"w{rng.randint(0, words)}" for _ in range(rng.choice((0, 1, 2, 3, 4, 5, 7, 9, 15, 30, 60)))]
        out.append(base)
    return out


def test_near_texts_random(spark):
    rng = random.Random(8)
    rows = [(q, i, w) for q in range(6) for i, w in enumerate(cuts(rng, 40, rng.choice((3, 40))))]
    found = {tuple(r) for r in retrieve.near_texts(spark.createDataFrame(rows, "q int, idx int, words array<string>"), "q").collect()}
    assert found == {(q, i, j) for q, i, a in rows for r, j, b in rows if q == r and i != j and run_rule(a, b)} and len(found) > 50


def test_collapse_random(spark):
    """Groups, places and representatives against the rule applied one text after the other."""
    rng = random.Random(9)
    rows = [(q, i, "  ".join(w) if w else None, float(rng.randint(1, 4)), float(rng.randint(1, 3))) for q in range(5) for i, w in enumerate(cuts(rng, 40, 30))]
    df = spark.createDataFrame(rows, "query_id int, id int, text string, score double, start_ts double")
    for keep, near in ((6, True), (100, True), (9, False)):
        want = set()
        for q in range(5):
            exact = {}
            for r in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[1]))[:35]:
                exact.setdefault(tuple((r[2] or "").split()), []).append(r)
            pool = []
            for words, members in exact.items():
                if len(pool) >= keep:
                    break
                top = max(members, key=lambda r: (r[3], r[4]))
                host = next((g for g in pool if near and run_rule(list(words), list(g[0]))), None)
                if host is None:
                    pool.append([words, top, members])
                else:
                    host[2] = host[2] + members
                    if (top[3], top[4]) > (host[1][3], host[1][4]):
                        host[:2] = [words, top]
            want |= {(q, k + 1, g[1][1], tuple(sorted(m[1] for m in g[2]))) for k, g in enumerate(pool)}
        got = {(r.query_id, r.place, r.id, tuple(r.members)) for r in retrieve.collapse_duplicates(df, keep=keep, fetch=35, near=near).collect()}
        assert got == want


def test_merged_candidates_by_hand(spark):
    dense = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.7)], "id long, dense_score double")
    sparse = spark.createDataFrame(
        [(2, 3.0, 2, False, False, False), (3, 9.0, 4, True, True, False), (4, 2.0, 0, True, False, False), (5, 0.0, 0, False, False, False), (6, 1.0, 0, False, False, False), (7, 0.0, 0, False, False, True)],
        "id long, sparse_score double, matched int, literal boolean, quarantined boolean, secret boolean",
    )
    got = {r.id: (r.dense_rank, round(r.combined, 6), r.blocked) for r in retrieve.merge_candidates(dense, sparse).collect()}
    assert got == {1: (1, 0.9, False), 2: (2, 2.3, False), 3: (3, 0.0, True), 4: (None, 1.0, False), 7: (None, 0.0, True)}
    pool = spark.createDataFrame([(i, i) for i in range(1, 6)], "id long, rank int")
    none = spark.createDataFrame([], "id long, rerank_score double")
    assert [r.id for r in retrieve.rerank_order(pool, none, top_k=3, floor=1.0).orderBy("place").collect()] == [1, 2, 3]
    some = spark.createDataFrame([(4, 2.0), (2, 5.0), (1, 0.5)], "id long, rerank_score double")
    assert [r.id for r in retrieve.rerank_order(pool, some, top_k=3, floor=1.0).orderBy("place").collect()] == [2, 4]


def test_clean_texts(spark):
    cases = {
        "a\n# Relevant Long-Term Memory\nold\n## sub\n# New\nb": "a\n# New\nb", "# past learnings\nx\n  # Past Learnings\ny": "", "a\n\n\n\nb": "a\n\nb",
        "x ```memory\nz``` y": "x  y", "  plain ": "plain", None: "", "a\r\nb": "a\nb",
    }
    got = {r.text: r.c for r in spark.createDataFrame([(t,) for t in cases], "text string").select("text", pl.clean(F.col("text")).alias("c")).collect()}
    assert got == cases


def test_small_payload_rules(spark):
    row = spark.range(1).select(
        pl.mean(F.array(F.lit(0.5), F.lit(1.0))).alias("mean"), pl.mean(F.array().cast("array<double>")).alias("none"),
        pl.entity_refs([F.lit("entity-1"), F.lit(None).cast("string"), F.lit("bad id")], F.array(F.lit("entity-2"), F.lit("entity-1")), r"^entity-\d+$").alias("refs"),
        pl.observed_at(F.lit("soon"), F.lit(None).cast("string"), F.lit("2024-02-01T00:00:00")).cast("string").alias("at"),
        pl.bucket_key(F.lit(" "), F.lit(None).cast("string"), F.lit(""), F.lit(""), F.lit("  A  Heading "), F.lit("x")).alias("heading"),
        pl.bucket_key(*[F.lit(None).cast("string")] * 5, F.lit("To be the First one"), ("the",)).alias("word"), pl.bucket_key(*[F.lit("")] * 6).alias("default"),
        pl.point_id(F.lit("sk-abcdefghijklmnop")).alias("secret"), pl.point_id(F.lit("a/b")).alias("path"), pl.truthy(F.lit(None).cast("string")).alias("null"),
    ).first()
    assert row.mean == 0.75 and row.none == 0.0 and row.refs == ["entity-1", "entity-2"] and row.at == "2024-02-01 00:00:00"
    assert (row.heading, row.word, row.default) == ("heading:a heading", "tokens:first", "default") and row.secret is None and row.path is None and row.null is False


def test_tree_search_statuses_and_budget(spark):
    nodes = spark.createDataFrame([("a", [1, 2], "x" * 60, []), ("b", [], "y", []), ("c", [1], "z" * 50, ["stale"]), ("d", [1, 9], "w", []), ("e", [3], "v", []), ("f", [2], "u" * 50, []), ("g", [2], "t", [])], "node_id string, children array<long>, text string, reasons array<string>")
    leaves = spark.createDataFrame([(1, False, False, False), (2, False, False, False), (3, True, False, False)], "id long, consolidation_quarantined boolean, stale boolean, requires_review boolean")
    got = {r.node_id: (r.status, len(r.text), r.kept) for r in tree.search(nodes, leaves, budget=100).collect()}
    assert got == {"a": ("active", 60, True), "b": ("excluded", 0, True), "c": ("review_required", 0, True), "d": ("stale", 0, True), "e": ("excluded", 0, True), "f": ("active", 50, False), "g": ("active", 1, False)}


def test_graph_sides_and_entities(spark):
    edges = spark.createDataFrame([("a", "b", "r"), ("a", "c", "r"), ("a", "d", "r"), ("e", "a", "q"), ("a", "a", "r"), ("a", "b", "r")], "src string, dst string, relation string")
    got = {(r.id, r.other, r.side) for r in graph.neighbours_both(edges, 2).collect()}
    assert got == {("a", "b", "source"), ("a", "c", "source"), ("e", "a", "source"), ("a", "e", "target"), ("b", "a", "target"), ("c", "a", "target"), ("d", "a", "target")}
    entities = spark.createDataFrame([("x", [1, 1, 7]), ("y", [8, 9]), ("z", None)], "entity_id string, source_point_ids array<long>")
    found = {(r.entity_id, r.point_id, r.is_entity) for r in graph.entity_memories(entities, spark.createDataFrame([(1,), (2,)], "id long")).collect()}
    assert found == {("x", "1", False), ("y", "y", True), ("z", "z", True)}


GATE_CASES = (
    ({"text": " "}, "empty_text"), ({"text": None}, "empty_text"), ({"text": "password: hunter2222"}, "possible_secret"), ({"metadata": '{"a": [{"b": "password: hunter2222"}]}'}, "possible_secret"),
    ({"metadata": '{"a": {"token = abcdef12345": 1}}'}, "possible_secret"), ({"derived_from": '[{"id": "api_key: abcdef12345"}]'}, "possible_secret"), ({"source_uri": "https://me:pw@host/"}, "possible_secret"),
    ({"duplicate": True}, "duplicate_candidate"), ({"importance": 1, "metadata": '{"importance": 9}'}, "low_information"), ({"importance": 2}, "low_information"), ({"importance": 2, "metadata": '{"importance": "3"}'}, "storeable"),
    ({"importance": 2, "metadata": '{"importance": 11}'}, "low_information"), ({"derivation_type": " Draft", "source_uri": ""}, "missing_provenance"), ({"derivation_type": "draft", "source_uri": None, "derived_from": "[1]"}, "missing_provenance"),
    ({"derivation_type": "draft", "source_uri": None, "derived_from": '[{"id": "p"}]'}, "storeable"), ({"source_type": "Proposal ", "confidence": 0.6}, "low_confidence_derived_write"), ({"source_type": "proposal", "confidence": None}, "storeable"),
    ({"promote": True, "metadata": '{"importance": 8}', "confidence": 0.85}, "skill_candidate"), ({"promote": True}, "weak_skill_candidate"), ({"target": " LEARNINGS "}, "learning_candidate"), ({"source_type": "learning"}, "learning_candidate"), ({}, "storeable"),
)


def test_write_gate_rules(spark):
    base = {"text": "t", "duplicate": False, "importance": 5, "metadata": None, "target": "memory", "source_type": "conversation", "derivation_type": None, "source_uri": "memory://x", "derived_from": None, "confidence": 0.9, "promote": False}
    rows = [(i, *(base | bad).values()) for i, (bad, _) in enumerate(GATE_CASES)]
    df = spark.createDataFrame(rows, "n int, text string, duplicate boolean, importance int, metadata string, target string, source_type string, derivation_type string, source_uri string, derived_from string, confidence double, promote boolean")
    assert {r.n: r.reason for r in retrieve.write_gate(df).collect()} == {i: why for i, (_, why) in enumerate(GATE_CASES)}


def test_status_updates_by_hand(spark):
    cases = {
        1: ((True, "active", "k", 0.9, None, None, None), "stale"), 2: ((True, "stale", "k", 0.9, "p", None, None), "superseded"), 3: ((False, "superseded", "k", 0.9, "p", "q", None), "disputed"), 4: ((False, "disputed", "k", 0.9, None, "q", "2024-01-01"), "stale"),
        5: ((False, "superseded", "k", 0.9, None, None, "2024-01-01"), None), 6: ((False, None, "k", 0.9, " ", "", "2024-01-01"), "stale"), 7: ((False, "active", "k", 0.9, None, None, "2025-01-01"), None), 8: ((True, "active", " ", 0.9, None, None, None), None),
        9: ((True, "active", "k", 0.5, None, None, None), None), 10: ((True, "active", "k", None, None, None, None), "stale"), 11: ((True, None, "k", 0.9, None, None, None), None), 12: ((None, "stale", "k", 0.9, None, None, "2024-01-01"), None),
    }
    df = spark.createDataFrame([(i, *row) for i, (row, _) in cases.items()], "id int, stale boolean, fact_status string, fact_key string, confidence double, superseded_by string, invalidated_by string, valid_until string")
    df = df.withColumn("valid_until", F.col("valid_until").cast("timestamp"))
    got = {r.id: r.new_status for r in consolidation.status_updates(df, "2024-06-01 00:00:00").collect()}
    assert got == {i: want for i, (_, want) in cases.items() if want}
