"""MPEG audio: round trips, an independent reader of the stored streams, damage, CRCs of all layers."""

import hashlib
import zlib

import numpy as np
import pytest

from tidemark.llm import mpeg_audio

from test_operators import corpus


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows + [rows[0]], spark.createDataFrame([r[:5] for r in rows + [rows[0]]], "doc_id long, text string, media string, n_bytes string, id long").repartition(5)


def test_mpeg_round_trip(spark, docs):
    rows, df = docs
    got = {r.id: r for r in mpeg_audio.digests(mpeg_audio.media_column(df)).collect()}
    for i, t, *_ in rows:
        data = (t or "").encode()
        payload = mpeg_audio.padded(data)
        assert len(payload) % 64 == 0 and payload
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert "crc_errors=0;skipped=0" in r.feature


def test_mpeg_resynchronises_and_checks():
    stream = mpeg_audio.build(bytes(range(256)) * 20)
    whole = mpeg_audio.probe(stream)
    assert whole.vbr_frames == len(whole.offsets) and whole.samples == 1152 * len(whole.offsets) and len(whole.toc) == 100
    junk = stream[: whole.offsets[1]] + b"\xff\xfb junk \xff" + stream[whole.offsets[1] :]
    hurt = mpeg_audio.probe(junk + b"TAG" + b"title".ljust(30, b"\0") + bytes(95))
    assert len(hurt.offsets) in (len(whole.offsets), len(whole.offsets) - 1) and hurt.skipped > 0 and hurt.tags["title"] == "title"
    flipped = bytearray(stream)
    flipped[whole.offsets[0] + 8] ^= 1
    assert mpeg_audio.probe(bytes(flipped)).crc_errors == 1
    assert mpeg_audio.probe(b"").offsets == [] and mpeg_audio.probe(b"\xff" * 50).offsets == []
    assert mpeg_audio.header(bytes([0xFF, 0xFB, 0x90, 0x00])).size == 417  # 128 kbit/s at 44.1 kHz


def test_mpeg_payload_like_a_tag(spark):
    for size in (100, 128, 900, 937, 2000):
        for at in range(size - 2):
            payload = mpeg_audio.padded(b"x" * at + b"TAG" + b"y" * (size - at - 3))
            stream = mpeg_audio.build(payload)
            found = mpeg_audio.probe(stream)
            assert mpeg_audio.payload_of(stream, found) == payload and found.vbr_frames == len(found.offsets)
    cut = spark.createDataFrame([(1, 3, bytearray(mpeg_audio.build(bytes(2000))[:700]))], "id long, n_bytes long, media binary")
    with pytest.raises(Exception, match="shorter than its tagged length"):
        mpeg_audio.digests(cut).collect()


def crc_of(bits):
    """CRC-16 of a text of bits, by long division."""
    register = [1] * 16
    for b in bits:
        out = register.pop(0) ^ int(b)
        register.append(0)
        for place in (0, 13, 15):  # x^15, x^2, 1
            register[place] ^= out
    return int("".join(map(str, register)), 2)


def read(stream):
    """What a player would find: ID3v2 size, then frames one after another; only what our streams use."""
    at = 10 + int("".join(f"{b:07b}" for b in stream[6:10]), 2)
    offsets, payload, bad = [], b"", 0
    while at < len(stream):
        head = "".join(f"{b:08b}" for b in stream[at : at + 4])
        assert head[:16] == "1111111111111010" and head[20:22] == "01"  # MPEG-1 layer III with a CRC, 48 kHz
        size = 144 * [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320][int(head[16:20], 2)] * 1000 // 48000
        side = stream[at + 6 : at + 23]
        bad += crc_of(head[16:] + "".join(f"{b:08b}" for b in side)) != int.from_bytes(stream[at + 4 : at + 6], "big")
        offsets.append(at)
        payload += stream[at + 23 : at + size]
        at += size
    assert at == len(stream)
    return offsets, payload[192 - 23 :], bad  # the first frame is the table


def test_stored_streams_by_an_independent_reader(spark, docs):
    rows, df = docs
    media = {r.id: r.media for r in mpeg_audio.media_column(df).collect()}
    for r in mpeg_audio.digests(mpeg_audio.media_column(df)).collect():
        stream = bytes(media[r.id])
        offsets, payload, bad = read(stream)
        text = (dict((x[0], x[1]) for x in rows)[r.id] or "").encode()
        assert payload[: r.payload_bytes] == text + bytes(r.payload_bytes - len(text)) and not payload[r.payload_bytes :].strip(b"\0") and not bad
        assert (r.media_bytes, r.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest())
        assert r.frame_offsets == offsets[1:] and r.samples == 1152 * len(offsets[1:]) and r.rate == 48000 and r.seconds == r.samples / 48000
        assert f"frames={len(offsets) - 1};samples={r.samples};rate=48000;" in r.feature and f"vbr_frames={len(offsets) - 1};vbr_bytes={len(stream) - offsets[0]};crc_checked={len(offsets)};crc_errors=0;skipped=0;" in r.feature
        assert r.feature.endswith(f"seek_crc32={zlib.crc32(np.array(offsets[1:], '<u8').tobytes())}")


def frame(layer, mode, ext, allocation, bands, index, lsf=False, rate=1):
    """A protected frame with all allocations equal to ``allocation``; bits that the CRC covers by the standard's text."""
    version = 2 if lsf else 3
    head = bytes([0xFF, 0xE0 | version << 3 | 4 - layer << 1, index << 4 | rate << 2, mode << 6 | ext << 4])
    channels, n = (1, len(bands)) if mode == 3 else (2, len(bands))
    bound = 4 * (ext + 1) if mode == 1 else n
    bits = "".join(f"{allocation:0{b}b}" * (channels if i < bound else 1) for i, b in enumerate(bands))
    if layer == 2 and allocation:
        bits += "10" * (n * channels)
    crc = crc_of("".join(f"{b:08b}" for b in head[2:]) + bits)
    body = int(bits.ljust(-(-len(bits) // 8) * 8, "1"), 2).to_bytes(-(-len(bits) // 8), "big")
    return (head + crc.to_bytes(2, "big") + body).ljust(mpeg_audio.header(head).size, b"\xaa")


@pytest.mark.parametrize(
    "args",
    [
        (1, 0, 0, 3, [4] * 32, 8), (1, 3, 0, 0, [4] * 32, 8), (1, 1, 1, 5, [4] * 32, 8), (2, 3, 0, 1, [4] * 11 + [3] * 12 + [2] * 4, 8), (2, 0, 0, 1, [4] * 2 + [3] * 6, 5),
        (2, 1, 0, 1, [4] * 11 + [3] * 12 + [2] * 4, 10), (2, 0, 0, 0, [4] * 11 + [3] * 12 + [2] * 4, 10), (2, 0, 0, 1, [4] * 4 + [3] * 7 + [2] * 19, 8, True), (2, 3, 0, 1, [4] * 2 + [3] * 10, 2, False, 2),
        (2, 3, 0, 1, [4] * 11 + [3] * 12 + [2] * 7, 10, False, 0),
    ],
)
def test_crc_of_layers_one_and_two(args):
    one = frame(*args)
    found = mpeg_audio.probe(one * 3)
    assert (len(found.offsets), found.checked, found.crc_errors) == (3, 3, 0)
    hurt = bytearray(one * 3)
    hurt[len(one) + 7] ^= 0x10
    assert mpeg_audio.probe(bytes(hurt)).crc_errors == 1


def test_null_and_odd_streams(spark):
    rows = [(1, 0, None), (2, 0, bytearray()), (3, 0, bytearray(b"no audio")), (None, 0, bytearray(mpeg_audio.build(mpeg_audio.padded(b""))))]
    df = spark.createDataFrame(rows, "id long, n_bytes long, media binary")
    got = {r.id: (r.payload_bytes, r.samples, r.seconds, r.frame_offsets == []) for r in mpeg_audio.digests(df).collect()}
    assert got[1] == got[2] == got[3] == (0, 0, None, True) and got[None][0] == 64
    facts = {r.id: r.seconds for r in mpeg_audio.probe_column(df).collect()}
    assert facts[1] is None and facts[None] == 2 * 1152 / 48000
    assert mpeg_audio.digests(mpeg_audio.media_column(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
