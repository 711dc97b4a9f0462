"""Blocks of text against packing one item after the other, and packets by hand."""

import random

from tidemark.operators import packet

MARK = "… [truncated]"


def fit(block, lead, text, cap):
    """The block with one more item, and whether it was cut; None where it does not fit."""
    room = cap - len(block) - len(lead)
    if len(text) <= room:
        return block + lead + text, False
    if room - len(MARK) >= 80:
        return block + lead + text[: room - len(MARK)].rstrip() + MARK, True
    return None


def test_prompt_blocks_random(spark):
    rng = random.Random(11)
    rows = []
    for q in range(30):
        for rank in range(rng.choice((1, 3, 12))):
            text = rng.choice([None, "", "a  b\n c", "wörd " * rng.choice((5, 30, 90, 400)), "x" * rng.choice((100, 700, 3000))])
            rows.append((q, rank, text, None, rng.choice([None, 7]), rng.random(), rng.choice([None, "note"]), rng.choice([None, "", "fact"]), None, rng.choice([None, "a/b.md"]), rng.choice([None, "Top"])))
    want = {}
    for q in range(30):
        block, shown, cut = packet.HEADER, 0, False
        for _, _, text, _, importance, score, source, kind, _, path, heading in sorted((r for r in rows if r[0] == q), key=lambda r: r[1]):
            facts = ["", f"importance={importance or '?'}", f"score={score:.3f}", *([f"kind={kind}"] if kind else [])]
            origin = [source or "unknown", *([path] if path else []), *([f"heading={heading}"] if heading else [])]
            more = None if cut else fit(block, f"\n\n{shown + 1}. [{' | '.join(facts)} | source={' | '.join(origin)}]\n   ", " ".join((text or "").split()), 800)
            if more:
                block, cut, shown = *more, shown + 1
        want[q] = (block.rstrip() if shown else "", shown, cut)
    df = spark.createDataFrame(rows, "query int, rank int, text string, created_at timestamp, importance int, score double, source_type string, memory_kind string, fact_status string, file_path string, heading string")
    got = {r.query: (r.block, r.shown, r.cut) for r in packet.prompt_block(df, display_tokens=100).collect()}
    assert got == want
    assert all(len(b) <= 800 for b, _, _ in got.values()) and {c for _, _, c in got.values()} == {True, False}


def test_section_blocks_random(spark):
    rng = random.Random(12)
    lanes = [lane for lane, _ in packet.HEADINGS]
    rows = [(q, rng.choice([*lanes, "other", None]), rank, rng.choice([None, " ", "short text", "password: hunter2222", "word " * 60, "y" * 900])) for q in range(40) for rank in range(rng.choice((1, 4, 9)))]
    want = {}
    for q in range(40):
        safe = [r for r in rows if r[0] == q and r[1] in lanes and (r[3] or "").strip() and "password" not in r[3]]
        block, shown, cut, last = packet.HEADER, 0, False, None
        for _, lane, _, text in sorted(safe, key=lambda r: (lanes.index(r[1]), r[2])):
            lead = "\n- " if lane == last else f"\n\n## {dict(packet.HEADINGS)[lane]}\n\n- "
            more = None if cut else fit(block, lead, " ".join(text.split()), 800)
            if more:
                block, cut, shown, last = *more, shown + 1, lane
        if safe:
            want[q] = (block.rstrip() if shown else "", shown, cut)
    got = packet.section_block(spark.createDataFrame(rows, "query int, lane string, rank int, text string"), display_tokens=1)
    assert {r.query: (r.block, r.shown, r.cut) for r in got.collect()} == want


def test_packet_by_hand(spark):
    schema = "packet string, rank int, point_id string, text string, claim_text string, memory_kind string, source_type string, derivation_type string, source_uri string, source string, fact_status string, stale boolean, requires_review boolean, superseded_by array<string>, invalidated_by array<string>"
    none = [None] * 5
    rows = [
        ("a", 3, "p1", "t1", None, None, None, None, None, "https://x/1", " Stale ", None, None, None, None),
        ("a", 1, "p2", "t2", "said", None, None, None, " u://2 ", None, None, False, True, None, ["", "p9"]),
        ("a", 2, "p1", None, None, "SUMMARY", None, None, None, "plain", None, None, None, [" "], []),
        ("b", 1, None, "t", None, *none, "superseded", None, None, None, None),
    ]
    entries = packet.context_entries(spark.createDataFrame(rows, schema))
    got = {r.packet: r for r in packet.context_packets(entries).collect()}
    a, b = got["a"], got["b"]
    assert (a.n_results, a.point_ids, a.source_uris) == (3, ["p2", "p1"], ["u://2", "memory://point/p1", "https://x/1"])
    assert (a.stale, a.review_required, a.disputed, a.superseded) == (True, True, True, False)
    assert a.warnings == [packet.WARNINGS[i] for i in (0, 1, 2, 3)]
    assert [(e.point_id, e.text) for e in a.sections.extracted_assertion] == [("p2", "said")]
    assert [e.place for e in a.sections.generated_summary] == [2] and [e.text for e in a.sections.source_text] == ["t1"]
    assert (b.point_ids, b.source_uris, b.superseded, b.warnings) == ([], [], True, [packet.WARNINGS[0], packet.WARNINGS[4]])
    assert packet.context_packets(entries.limit(0)).collect() == []
