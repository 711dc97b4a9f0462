"""Fingerprints and proposals about equal and near texts, against plain loops."""

import random
import re

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import consolidation


def plain_fingerprint(text):
    words = re.sub(r"[ \t\n\x0b\f\r]+", " ", text or "").strip(" ").lower().split(" ")
    return " ".join(w for w in (re.sub(r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+\Z", "", w) for w in words) if w)


def test_fingerprint(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(" \t\n  abA,.!-_~") for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["end! ", "a,,b", "-- ..x..", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").select("id", tx.fingerprint(F.col("text")).alias("fp"))
    assert {r.id: r.fp for r in rows.collect()} == {i: plain_fingerprint(t) for i, t in enumerate(texts)}


def test_reconsolidations_digest_a_text_once(spark):
    rows = [(1, "f", "One text.", 1, 0.9), (2, "f", "one  TEXT", 5, 0.9), (3, "f", "other", 5, 0.7), (4, "f", "...", 9, 0.1), (5, "g", "same", 1, 0.9), (6, "g", "Same!", 1, 0.9), (7, "g", "--", 1, 0.9), (8, "", "x", 1, 1.0)]
    points = spark.createDataFrame(rows, "id long, fact_key string, text string, importance int, confidence double").withColumn("created_at", F.timestamp_seconds("id"))
    found = consolidation.reconsolidations(points)
    assert [tuple(r) for r in found.collect()] == [("f", 2, 3, 2)]
    assert found._jdf.queryExecution().executedPlan().toString().count("lower(") <= 4  # the texts' pass, in both forms of an adaptive plan


def test_exact_duplicates_name_every_member(spark):
    rows = [(1, "One text.", 1), (2, "one  TEXT", 5), (3, "other", 5), (4, "one text!", 5), (5, "x", 1), (6, "X", 1)]
    points = spark.createDataFrame(rows, "id long, text string, importance int").withColumns({"confidence": F.lit(0.5), "created_at": F.timestamp_seconds("id")})
    found = {r.id: (r.canonical_id, r.n, r.proposal_id) for r in consolidation.exact_duplicates(points).collect()}
    assert {i: x[:2] for i, x in found.items()} == {1: (4, 3), 2: (4, 3), 4: (4, 3), 5: (6, 2), 6: (6, 2)}
    assert len({x[2] for x in found.values()}) == 2 and found[1][2] == found[2][2]


def test_jaccard_prefixes_of_frequent_and_rare_words(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [rng.sample(vocabulary, rng.randint(1, 40)) for _ in range(60)]
    texts += [[w for w in t if rng.random() < 0.95] + ([f"new{i}"] if rng.random() < 0.5 else []) for i, t in enumerate(texts)]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string")
    sets = {i: set(t) for i, t in enumerate(texts) if t}
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    for frequent in (0, 7, 1000):
        monkeypatch.setattr(consolidation, "FREQUENT", frequent)
        found = {(r.a, r.b): r.jaccard for r in consolidation.jaccard_pairs(rows, 0.8).collect() if r.jaccard < 1}
        assert found == {p: x for p, x in share.items() if 0.8 <= x < 1}


def test_pairs_are_found_once_for_clusters(spark):
    rows = spark.createDataFrame([(i, f"a b c d e f g h i j k l m n o{i % 3} {'p' * (i % 2)}") for i in range(12)], "id long, text string")
    pairs = consolidation.jaccard_pairs(rows, 0.8)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "bit_count" in plan(pairs)  # sets that differ in too many words are left out before their words are moved
    assert "array_intersect" not in plan(consolidation.greedy_star(pairs))


def test_report_reads_texts_for_rules_and_for_words_only(spark):
    read = spark.sparkContext.accumulator(0)

    def each(rows):
        for row in rows:
            read.add(1)
            yield row

    rows = spark.createDataFrame([(i, f"some text of number {i % 5}", f"f{i % 2}", i % 3 == 0) for i in range(20)], "id long, text string, fact_key string, learning boolean")
    none = F.lit(None).cast("string")
    rows = rows.withColumns({
        "importance": F.lit(5), "confidence": F.lit(0.9), "access_count": F.lit(0), "created_at": F.timestamp_seconds("id"), "stale": F.lit(False), "fact_status": none, "consolidation_quarantined": F.lit(False),
        "promote": F.lit(False), "promoted": F.lit(False), "superseded_by": none, "invalidated_by": none, "valid_until": F.lit(None).cast("timestamp"),
    })
    rows = spark.createDataFrame(rows.rdd.mapPartitions(each), rows.schema)
    kinds = {r.proposal_type for r in consolidation.report(rows, "1970-01-02 00:00:00").collect()}
    assert kinds == {"duplicate_cluster", "fact_conflict_candidate", "fact_supersession_candidate", "reconsolidation_candidate"}
    assert read.value == 40

def test_sets_of_many_pairs_are_moved_once(spark, monkeypatch):
    """Pairs that meet in tiles, in parts of tiles and without a cell, against a plain loop; a pair carries no words."""
    rng = random.Random(11)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(120)] for _ in range(4)]
    texts = [[w if rng.random() < 0.98 else f"x{rng.randint(0, 9)}" for w in base[i % 4]] + [f"u{i}"] for i in range(160)]
    rows = spark.createDataFrame([(f"p{i:03}", " ".join(t)) for i, t in enumerate(texts)], "id string, text string").repartition(3)
    sets = {f"p{i:03}": frozenset(t) for i, t in enumerate(texts)}
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert sum(0.9 <= x < 1 for x in share.values()) > 1000
    for tile, mixers in ((8, consolidation.MIXERS), (1024, (1,))):
        monkeypatch.setattr(consolidation, "TILE", tile)
        monkeypatch.setattr(consolidation, "MIXERS", mixers)
        pairs = consolidation.jaccard_pairs(rows, 0.9)
        assert {(r.a, r.b): r.jaccard for r in pairs.collect() if r.jaccard < 1} == {p: x for p, x in share.items() if 0.9 <= x < 1}
        assert "FlatMapCoGroupsInArrow" in pairs._jdf.queryExecution().executedPlan().toString()


def test_every_pair_of_copies_and_of_their_neighbours(spark):
    near = " ".join(f"w{i}" for i in range(20))
    texts = {1: near, 2: f"{near} x", 3: near.upper(), 4: f"x {near}", 5: near, 6: "other", 7: "", 8: f"{near} y", 9: "OTHER"}
    rows = spark.createDataFrame(list(texts.items()), "id long, text string")
    sets = {i: set(t.lower().split()) for i, t in texts.items()}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] and sets[b]}
    found = consolidation.expand_pairs(consolidation.jaccard_pairs(rows, 0.92)).collect()
    assert {(r.a, r.b): r.jaccard for r in found} == {p: x for p, x in want.items() if x >= 0.92} and len(found) == 14


def test_report_moves_sets_not_pairs_of_sets(spark, monkeypatch):
    """The report's clusters too come from pairs that carry no words: the sets of a tile meet once."""
    plans, star = [], consolidation.greedy_star

    def kept(pairs):
        plans.append(pairs._jdf.queryExecution().executedPlan().toString())
        return star(pairs)

    monkeypatch.setattr(consolidation, "greedy_star", kept)
    base, none = " ".join(f"w{i}" for i in range(60)), F.lit(None).cast("string")
    rows = spark.createDataFrame([(i, f"{base} u{i}", i % 3 == 0) for i in range(12)], "id long, text string, learning boolean").withColumns({
        "importance": F.lit(5), "confidence": F.lit(0.9), "access_count": F.lit(0), "created_at": F.timestamp_seconds("id"), "stale": F.lit(False), "fact_status": none,
        "consolidation_quarantined": F.lit(False), "promote": F.lit(False), "promoted": F.lit(False), "superseded_by": none, "invalidated_by": none, "valid_until": F.lit(None).cast("timestamp"),
    })
    found = consolidation.report(rows, "1970-01-02 00:00:00", facts=False).collect()
    assert [(r.proposal_type, r.key) for r in found] == [("duplicate_cluster", "1"), ("duplicate_cluster", "0")]
    assert len(plans) == 1 and "FlatMapCoGroupsInArrow" in plans[0]
