"""Media columns: MPEG audio streams.

``probe`` reads a stream as a media table needs it: skip and parse tags (ID3v2 in front, ID3v1 behind),
find frame headers and resynchronise after damage, check each frame's CRC-16 where it is protected,
read the Xing/Info table of variable-bitrate streams, and give exact durations (in samples) and the
byte offset of every frame. ``build`` stores a payload losslessly in a stream of its own: MPEG-1
Layer III, mono, 48 kHz, protected frames whose side information says that no Huffman data follows, so
that the rest of each frame is ancillary data and any player hears silence. All frames but the last
have the largest bitrate, the last has the smallest that holds the rest; a Xing frame leads them and
an ID3v2 tag holds the payload's length.

Tables: a media column is written as Parquet in the shared folder and read back by another job. Each
row is handled by itself, memory is bounded by a chunk of rows and the longest one. Null texts are
empty; repeated rows keep a row each; a null or unreadable stream has no frames, no payload and a null
duration. An empty table gives no rows; columns besides id and text are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (version is 1, layer) and index, Hz by version.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
CRC_POLYNOMIAL = 0x8005

#: Bits of bit allocation of the subbands, by runs (subbands, bits): layer II at high, middle and low rates of a
#: channel (the last two lists: 44.1 or 48 kHz, 32 kHz), then the lower sampling rates.
ALLOCATION = {"high": ((11, 4), (12, 3), (7, 2)), "middle": ((11, 4), (12, 3), (4, 2)), "low": ((2, 4), (6, 3)), "low32": ((2, 4), (10, 3)), "lsf": ((4, 4), (7, 3), (19, 2))}

LEAD = 4 + 2 + 17  # header, CRC and side information of a protected mono MPEG-1 Layer III frame


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, (table << 1) ^ CRC_POLYNOMIAL, table << 1) & 0xFFFF
    return table


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 of each row of bytes (initial value all ones)."""
    crc = np.full(len(rows), 0xFFFF, np.uint32)
    for column in rows.T:
        crc = ((crc << 8) & 0xFFFF) ^ _CRC[(crc >> 8) ^ column]
    return crc


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    bitrate: int  # bit/s
    rate: int
    size: int  # bytes
    samples: int
    mono: bool
    joint: int = -1  # mode extension of joint stereo

    @property
    def side(self) -> int:
        """Bytes of side information."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


_SEEN: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None."""
    if four not in _SEEN:
        if len(_SEEN) > 4096:
            _SEEN.clear()
        _SEEN[four] = _header(four)
    return _SEEN[four]


def _header(four: bytes) -> Header | None:
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    index, rate = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3 or four[3] & 3 == 2:
        return None
    bits, hz, pad = BITRATES[version == 3, layer][index] * 1000, RATES[version][rate], four[2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    size = (samples // 32 * bits // hz + pad) * 4 if layer == 1 else samples // 8 * bits // hz + pad
    return Header(version, layer, not four[1] & 1, bits, hz, size, samples, four[3] >> 6 == 3, four[3] >> 4 & 3 if four[3] >> 6 == 1 else -1)


def protected_bits(h: Header, frame: bytes) -> int:
    """Bits after the CRC that it covers: side information in layer III, bit allocation in I, that and the scale
    factor selection in II. -1 if the frame is too short."""
    if h.layer == 3:
        return 8 * h.side
    channels = 1 if h.mono else 2
    if h.layer == 1:
        bands = [4] * 32
    else:
        each = h.bitrate // 1000 // channels
        kind = "lsf" if h.version != 3 else ("low32" if h.rate == 32000 else "low") if each <= 48 else "middle" if each <= 80 or h.rate == 48000 else "high"
        bands = [bits for n, bits in ALLOCATION[kind] for _ in range(n)]
    apart = len(bands) if h.joint < 0 else min(4 * (h.joint + 1), len(bands))  # joint stereo: one allocation for both above
    total = sum(bands[:apart]) * channels + sum(bands[apart:])
    if h.layer == 1:
        return total
    data, at, used = int.from_bytes(frame[6:70].ljust(64, b"\0"), "big"), 0, 0
    for i, bits in enumerate(bands):
        for _ in range(channels if i < apart else 1):
            at += bits
            if data >> 512 - at & (1 << bits) - 1:
                used += 1 if i < apart else channels
    return total + 2 * used


def crc16_bits(data: bytes, bits: int) -> int:
    """CRC-16 of the first ``bits`` bits of ``data``."""
    crc = 0xFFFF
    for i in range(bits):
        top = (crc >> 15) ^ (data[i >> 3] >> (7 - (i & 7)) & 1)
        crc = (crc << 1 & 0xFFFF) ^ (CRC_POLYNOMIAL if top else 0)
    return crc


def _syncsafe(data: bytes) -> int:
    return data[0] << 21 | data[1] << 14 | data[2] << 7 | data[3]


def tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """Text frames of ID3v2 (and ID3v1 fields), and where the audio begins and ends."""
    found, start, end = {}, 0, len(data)
    if data[:3] == b"ID3" and len(data) >= 10 and max(data[6:10]) < 0x80:
        start = 10 + _syncsafe(data[6:10])
        at, wide = 10, data[3] >= 4
        while at + 10 <= min(start, len(data)) and data[at]:
            name, size = data[at : at + 4].decode("latin-1"), data[at + 4 : at + 8]
            size = _syncsafe(size) if wide else int.from_bytes(size, "big")
            body = data[at + 10 : at + 10 + size]
            if name[0] == "T" and body:
                text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
                key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
                found[f"TXXX:{key}" if name == "TXXX" else key] = value.rstrip("\0")
            at += 10 + size
    if len(data) - start >= 128 and data[-128:-125] == b"TAG":
        end -= 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if value := data[end + a : end + b].rstrip(b"\0 ").decode("latin-1"):
                found.setdefault(name, value)
    return found, min(start, end), end


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    skipped: int = 0  # bytes between frames, where the reader had to resynchronise
    checked: int = 0
    crc_errors: int = 0
    vbr_frames: int | None = None  # as the Xing/Info table says
    vbr_bytes: int | None = None
    toc: bytes = b""

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def rate(self) -> int:
        return self.headers[0].rate if self.headers else 0


def probe(data: bytes) -> Stream:
    """Read a stream. A header counts where the stream ends after its frame or another header of the
    same version, layer and sampling rate follows it; anything else is skipped byte by byte. A first
    frame with a Xing or Info table is read as such and is no audio."""
    out = Stream()
    out.tags, at, end = tags(data)
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h and at + h.size <= end:
            after = header(data[at + h.size : at + h.size + 4])
            if at + h.size == end or after and (after.version, after.layer, after.rate) == (h.version, h.layer, h.rate):
                out.offsets.append(at)
                out.headers.append(h)
                at += h.size
                continue
        nearest = data.find(b"\xff", at + 1, end)
        nearest = nearest if nearest >= 0 else end
        out.skipped += nearest - at
        at = nearest
    _check(data, out)
    if out.headers:
        h, at = out.headers[0], out.offsets[0]
        table = at + 4 + h.side
        for table in (table, table + 2):
            if data[table : table + 4] in (b"Xing", b"Info"):
                flags, p = int.from_bytes(data[table + 4 : table + 8], "big"), table + 8
                if flags & 1:
                    out.vbr_frames, p = int.from_bytes(data[p : p + 4], "big"), p + 4
                if flags & 2:
                    out.vbr_bytes, p = int.from_bytes(data[p : p + 4], "big"), p + 4
                if flags & 4:
                    out.toc = data[p : p + 100]
                del out.headers[0], out.offsets[0]
                break
    return out


def _check(data: bytes, out: Stream) -> None:
    """CRC of protected frames: over the last half of the header and what :func:`protected_bits` says."""
    rows = np.frombuffer(data, np.uint8)
    kinds: dict[int, list[int]] = {}
    for at, h in zip(out.offsets, out.headers):
        if h.protected and h.layer == 3 and h.size >= 6 + h.side:
            kinds.setdefault(h.side, []).append(at)
        elif h.protected:
            frame = data[at : at + h.size]
            bits = protected_bits(h, frame)
            out.checked += 1
            out.crc_errors += 6 + -(-bits // 8) > len(frame) or crc16_bits(frame[2:4] + frame[6:], 16 + bits) != int.from_bytes(frame[4:6], "big")
    for side, where in kinds.items():
        at = np.array(where)[:, None]
        want = rows[at + np.array([4, 5])].astype(np.uint32)
        got = crc16(rows[at + np.array([2, 3, *range(6, 6 + side)])])
        out.checked += len(where)
        out.crc_errors += int((got != want[:, 0] << 8 | want[:, 1]).sum())


def _lead(kbit: int) -> np.ndarray:
    """Header, CRC and empty side information of one of our frames."""
    head = bytes([0xFF, 0xFA, BITRATES[True, 3].index(kbit) << 4 | 1 << 2, 0xC4])
    crc = int(crc16(np.frombuffer(head[2:] + bytes(17), np.uint8)[None])[0])
    return np.frombuffer(head + crc.to_bytes(2, "big") + bytes(17), np.uint8)


_LEADS = {kbit: _lead(kbit) for kbit in BITRATES[True, 3][1:]}


def _id3(text: dict[str, str]) -> bytes:
    def safe(n: int) -> bytes:
        return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])

    body = b""
    for key, value in text.items():
        content = b"\3" + key.encode() + b"\0" + value.encode()
        body += b"TXXX" + safe(len(content)) + b"\0\0" + content
    return b"ID3\4\0\0" + safe(len(body)) + body


#: The empty frame that ends every stream of :func:`build`: no payload byte lies where an ID3v1 tag would.
_TRAILER = _LEADS[64].tobytes().ljust(3 * 64, b"\0")


def build(payload: bytes) -> bytes:
    """A stream that holds ``payload`` in the ancillary data of its frames."""
    largest = BITRATES[True, 3][-1]
    room = 3 * largest - LEAD  # a frame of k kbit/s at 48 kHz has 3 k bytes
    full, rest = divmod(len(payload), room)
    frames = np.empty((full, 3 * largest), np.uint8)
    frames[:, :LEAD] = _LEADS[largest]
    frames[:, LEAD:] = np.frombuffer(payload, np.uint8, full * room).reshape(full, room)
    last = b""
    if rest:
        kbit = next(k for k in BITRATES[True, 3][1:] if 3 * k - LEAD >= rest)
        last = (_LEADS[kbit].tobytes() + payload[full * room :]).ljust(3 * kbit, b"\0")
    body = frames.tobytes() + last + _TRAILER
    n, lead = full + bool(rest) + 1, _LEADS[64].tobytes()
    total = 3 * 64 + len(body)
    toc = bytes(min(255, 256 * (3 * 64 + min(i * n // 100, full) * 3 * largest + len(last) * (i * n // 100 > full)) // total) for i in range(100))
    table = b"Xing" + struct.pack(">III", 7, n, total) + toc
    return _id3({"payload_bytes": str(len(payload))}) + (lead + table).ljust(3 * 64, b"\0") + body


def payload_of(data: bytes, stream: Stream) -> bytes:
    """What :func:`build` stored."""
    parts = [data[at + LEAD : at + h.size] for at, h in zip(stream.offsets, stream.headers)]
    return b"".join(parts)[: int(stream.tags.get("TXXX:payload_bytes", "0"))]


def padded(text: bytes, unit: int = 64) -> bytes:
    return text + bytes(unit - len(text) % unit if len(text) % unit or not text else 0)


def _build(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch, "text", chunk_bytes):
                texts = [x.encode() if x else b"" for x in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("id"), pa.array(list(map(len, texts)), pa.int64()), pa.array([build(padded(x)) for x in texts], pa.binary())], names=["id", "n_bytes", "media"])

    return run


def media_column(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 8 << 20) -> DataFrame:
    """(id, n_bytes, media): every text as a stream, written to the shared folder and read back."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return common.materialise(rows.mapInArrow(common.lean(_build(chunk_bytes)), f"id {kind}, n_bytes long, media binary"), "mpeg")


def feature(stream: Stream) -> str:
    offsets = np.array(stream.offsets, "<u8")
    rates = sorted({h.bitrate // 1000 for h in stream.headers})
    return (
        f"frames={len(stream.offsets)};samples={stream.samples};rate={stream.rate};kbit={'/'.join(map(str, rates))};vbr_frames={stream.vbr_frames};"
        f"vbr_bytes={stream.vbr_bytes};crc_checked={stream.checked};crc_errors={stream.crc_errors};skipped={stream.skipped};seek_crc32={crc32(offsets.tobytes())}"
    )


def _digests(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch, "media", chunk_bytes):
                out = []
                for data in part.column("media"):
                    data = data.as_buffer().to_pybytes() if data.is_valid else b""
                    stream = probe(data)
                    payload = payload_of(data, stream)
                    if len(payload) < int(stream.tags.get("TXXX:payload_bytes", "0")):
                        raise ValueError("the payload read back is shorter than its tagged length")
                    seconds = stream.samples / stream.rate if stream.rate else None
                    out.append((len(payload), sha256(payload).hexdigest(), crc32(payload[-64:]), len(data), sha256(data).hexdigest(), feature(stream), stream.samples, stream.rate, seconds, stream.offsets))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int64()))
                made = [pa.array(x, t) for x, t in zip(zip(*out), kinds)]
                yield pa.record_batch([part.column("id"), part.column("n_bytes"), *made], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "samples", "rate", "seconds", "frame_offsets"])

    return run


def digests(media: DataFrame, *, chunk_bytes: int = 8 << 20) -> DataFrame:
    """Per stream of :func:`media_column`: lengths and digests of the payload read back and of the stream, its
    features as text, its exact duration (samples, their rate, seconds) and the seek offset of every frame."""
    kind = media.schema["id"].dataType.simpleString()
    return media.mapInArrow(common.lean(_digests(chunk_bytes)), f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, samples long, rate int, seconds double, frame_offsets array<long>")


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.chunks(batch, "media", 8 << 20):
            streams = [probe(x or b"") for x in part.column("media").to_pylist()]
            yield pa.record_batch(
                [
                    part.column("id"), pa.array([s.samples for s in streams], pa.int64()), pa.array([s.rate for s in streams], pa.int32()),
                    pa.array([s.samples / s.rate if s.rate else None for s in streams], pa.float64()), pa.array([s.offsets for s in streams], pa.list_(pa.int64())),
                    pa.array([s.crc_errors for s in streams], pa.int64()), pa.array([s.skipped for s in streams], pa.int64()), pa.array([s.vbr_frames for s in streams], pa.int64()),
                    pa.array([list(s.tags.items()) for s in streams], pa.map_(pa.string(), pa.string())),
                ],
                names=["id", "samples", "rate", "seconds", "frame_offsets", "crc_errors", "skipped_bytes", "vbr_frames", "tags"],
            )


def probe_column(media: DataFrame, *, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """Facts of any column of MPEG audio streams, with the offset of every frame."""
    kind = media.schema[id_col].dataType.simpleString()
    return media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(common.lean(_facts), f"id {kind}, samples long, rate int, seconds double, frame_offsets array<long>, crc_errors long, skipped_bytes long, vbr_frames long, tags map<string,string>")
