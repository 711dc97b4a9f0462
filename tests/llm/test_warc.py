"""WARC archives: round trips, ids of any text, ties, and streams that are cut."""

import gzip
import hashlib
import io

import pytest

from tidemark.llm import warc


def test_warc(spark):
    big = "x" * 1500
    pages = [(1, "http://a/", big), (2, "http://b/", big), (3, None, "small"), (4, "http://d/\r\n", "small"), (5, "", None), (None, "u", big), (7, "u", "é" * 700)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    members, folder = warc.archive(df)
    got = {r.rid: r for r in warc.read_archives(members, folder).collect()}
    assert len(got) == 7 and {k for k, r in got.items() if r.record_type == "revisit"} == {"1", None}
    assert got["1"].refers_to == "2" and got["1"].payload_bytes == 1500 and got["7"].payload.decode() == "é" * 700
    for i, _, html in pages:
        assert got[None if i is None else str(i)].payload_digest == hashlib.sha1((html or "").encode()).hexdigest()
    assert warc.read_archives(*warc.archive(df.limit(0))).count() == 0


def test_warc_normaliser_index():
    records = [warc.record(str(i), "u", b"p\r\n\r\nWARC/" * i, hashlib.sha1(b"p\r\n\r\nWARC/" * i).hexdigest(), 10 * i, None) for i in range(50)]
    for source in (gzip.compress(b"".join(records)), b"".join(gzip.compress(r) for r in records)):
        target = io.BytesIO()
        index = warc.normalise(io.BytesIO(source), target)
        assert [gzip.decompress(target.getvalue()[a : a + n]) for a, n in index] == records
    with pytest.raises(ValueError):
        warc.normalise(io.BytesIO(gzip.compress(records[3][:-9])), io.BytesIO())


def test_a_cut_stream_is_an_error():
    records = [warc.record(str(i), "u", b"x" * 900, hashlib.sha1(b"x" * 900).hexdigest(), 900, None) for i in range(20)]
    data = gzip.compress(b"".join(records), 0)  # stored: cuts can lie between records
    assert len(warc.normalise(io.BytesIO(data), io.BytesIO())) == 20 and len(warc.normalise(io.BytesIO(data + bytes(512)), io.BytesIO())) == 20
    for cut in (len(data) - 1, len(data) - 8, *range(len(records[0]), len(data) - 8, len(records[0]) // 2), 5):
        with pytest.raises(ValueError, match="ends within"):
            warc.normalise(io.BytesIO(data[:cut]), io.BytesIO())
    whole = b"".join(gzip.compress(r) for r in records)
    assert len(warc.normalise(io.BytesIO(whole), io.BytesIO())) == 20
    assert warc.normalise(io.BytesIO(b""), io.BytesIO()) == []


def test_small_buffers_inflate_the_same():
    data = gzip.compress(bytes(range(256)) * 300) + gzip.compress(b"z" * 100_000)
    for buffer in (7, 1000, 1 << 20):
        assert b"".join(warc.inflate(io.BytesIO(data), buffer)) == bytes(range(256)) * 300 + b"z" * 100_000


def test_ids_of_any_text_and_ties(spark):
    big = "y" * 2_000_000
    rows = [(" a>", "u", "small"), ("", "u", "p" * 1000), ("x\r\nWARC-Type: revisit", None, big), ("é%20", "u", big), ("é%20", "u", big), (None, "u", None), ("z", "u", "q" * 999), ("y", "u", "q" * 999)]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "page_id string, url string, html string, rid string, size int").repartition(3)
    got = [(r.rid, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(*warc.archive(df)).collect()]
    want = [(" a>", "response", None, 5), ("", "response", None, 1000), ("x\r\nWARC-Type: revisit", "revisit", "é%20", len(big)), *[("é%20", "response", None, len(big))] * 2, (None, "response", None, 0), ("z", "response", None, 999), ("y", "response", None, 999)]
    assert sorted(got, key=str) == sorted(want, key=str)
