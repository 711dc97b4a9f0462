"""WARC archives and a normaliser for monolithic gzip streams.

An archive compressed as one gzip stream can't be read from the middle. The normaliser inflates such a
file once from front to back, cuts the stream into records by their headers and lengths as it goes,
writes every record as a gzip member of its own, and writes a sidecar index with the offset and length
of each member, so that any record can be read by one ranged read.

Archives are files in the shared folder (``spark.checkpoint.dir``), written and read on the executors
through Arrow's file systems. A task writes under a name of its own attempt and reports it only when
the file is closed; what a lost attempt leaves behind is never read. One archive is a task's records;
memory is bounded by one record and a buffer.

Records: ``response`` with the HTTP header and payload, or ``revisit`` with the header only, for payloads
of ``min_revisit`` bytes or more that equal that of a row with a larger id; the row with the largest id
is the response (rows that share it all are), and revisits refer to it. Null payloads are empty, null ids
sort lowest and are read back as null; ids of any text come back as they were. The reader recomputes each
response's digest and fails where it differs from its header; a stream that is cut, or holds another number
of records than were written, is an error at whatever step finds it. Columns besides id, URL and HTML are
ignored; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha1
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

URN = "urn:tidemark:record:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def urn(rid: str | None) -> str:
    """The record id of a row's id, percent-encoded, so that any text comes back; rows without one are ``null``."""
    return f"<{URN}null>" if rid is None else f"<{URN}id:{quote(rid, safe='')}>"


def id_of(value: str) -> str | None:
    name = value.strip().removeprefix("<").removesuffix(">").removeprefix(URN)
    return unquote(name.removeprefix("id:")) if name.startswith("id:") else None


def record(rid: str | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; without the payload where ``refers_to`` says which record has it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = "".join(c for c in (url or "") if c not in "\r\n")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(rid)}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream of WARC data."""
    held = bytearray()
    need = None
    for data in stream:
        held += data
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                if not held.startswith(b"WARC/"):
                    raise ValueError("not a WARC record")
                need = end + 4 + int(headers(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError(f"the stream ends within a record ({len(held)} bytes are left)")


def inflate(file, buffer: int = 1 << 20) -> Iterator[bytes]:
    """The contents of a gzip file, member after member, in pieces of ``buffer`` bytes at most. A file that
    ends within a member is an error, wherever the cut lies; zeros after a member are padding."""
    engine = None
    while data := file.read(buffer):
        while data:
            if engine is None:
                data = data.lstrip(b"\0")
                if not data:
                    break
                engine = zlib.decompressobj(31)
            while (out := engine.decompress(data, buffer)) or engine.unconsumed_tail:
                yield out
                if engine.eof:
                    break
                data = engine.unconsumed_tail
            data = engine.unused_data
            if engine.eof:
                engine = None
    if engine is not None:
        raise ValueError("the file ends within a gzip member")


def normalise(source, target) -> list[tuple[int, int]]:
    """Rewrite every record of a gzip file as a member of its own; (offset, length) of each member."""
    index, at = [], 0
    for data in records(inflate(source)):
        engine = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = engine.compress(data) + engine.flush()
        target.write(member)
        index.append((at, len(member)))
        at += len(member)
    return index


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _write(folder: str, chunk_bytes: int):
    """Rows to monolithic archives: one gzip stream for a task's records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        name, n = f"{uuid.uuid4().hex}.warc.gz", 0
        engine = zlib.compressobj(6, zlib.DEFLATED, 31)
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:
            for batch in batches:
                for part in common.chunks(batch, "html", chunk_bytes):
                    for row in part.to_pylist():
                        payload = (row["html"] or "").encode()
                        out.write(engine.compress(record(row["rid"], row["url"], payload, row["digest"], row["size"], row["refers_to"])))
                        n += 1
            out.write(engine.flush())
        if n:
            yield pa.record_batch([pa.array([name]), pa.array([n], pa.int64())], names=["file", "n"])

    return run


def _normalise(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        for batch in batches:
            for name, written in zip(batch.column("file").to_pylist(), batch.column("n").to_pylist()):
                made = f"{uuid.uuid4().hex}.members.warc.gz"
                with store.open_input_stream(f"{base}/{name}", compression=None) as source, store.open_output_stream(f"{base}/{made}", compression=None) as target:
                    index = normalise(source, target)
                if len(index) != written:
                    raise ValueError(f"{name} holds {len(index)} records, {written} were written")
                with store.open_output_stream(f"{base}/{made}.idx", compression=None) as sidecar:
                    sidecar.write("".join(f"{a}\t{n}\n" for a, n in index).encode())
                yield pa.record_batch([pa.array([name]), pa.array([made]), pa.array([len(index)], pa.int64())], names=["file", "members", "n"])

    return run


def read_member(data: bytes) -> dict[str, object]:
    """A record from its own gzip member, its payload checked against its digest."""
    text = zlib.decompress(data, 31)
    end = text.index(b"\r\n\r\n")
    head = headers(text[:end])
    block = text[end + 4 : end + 4 + int(head["content-length"])]
    cut = block.index(b"\r\n\r\n")
    payload, digest = block[cut + 4 :], head["warc-payload-digest"].removeprefix("sha1:")
    kind = head["warc-type"]
    if kind == "response" and sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
    return {
        "rid": id_of(head["warc-record-id"]), "url": head["warc-target-uri"], "record_type": kind, "payload_digest": digest,
        "payload_bytes": int(headers(block[:cut])["content-length"]), "refers_to": id_of(head["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def _read(folder: str, payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        names = ["rid", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"][: None if payload else -1]
        kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        for batch in batches:
            for file, written in zip(batch.column("members").to_pylist(), batch.column("n").to_pylist()):
                with store.open_input_stream(f"{base}/{file}.idx", compression=None) as sidecar:
                    index = [tuple(map(int, x.split(b"\t"))) for x in sidecar.read().splitlines()]
                if len(index) != written:
                    raise ValueError(f"the index of {file} names {len(index)} records, {written} were written")
                with store.open_input_file(f"{base}/{file}") as source:
                    for at in range(0, len(index), 256):
                        rows = []
                        for offset, n in index[at : at + 256]:
                            source.seek(offset)
                            rows.append(read_member(source.read(n)))
                        yield pa.record_batch([pa.array([r[k] for r in rows], kinds.get(k, pa.string())) for k in names], names=names)

    return run


def with_revisits(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 1000) -> DataFrame:
    """(rid, url, html, digest, size, refers_to); html is null for revisits."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    many = rows.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.max("id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    many = common.materialise(many, "warc-repeats")  # its size is known then: Spark broadcasts it or merges
    revisit = F.col("owner").isNotNull() & F.coalesce(F.col("id") < F.col("owner"), F.lit(True))
    joined = rows.join(many, "digest", "left")
    return joined.select(
        F.col("id").cast("string").alias("rid"), "url", F.when(~revisit, F.col("html")).alias("html"), "digest", "size",
        F.when(revisit, F.col("owner").cast("string")).alias("refers_to"),
    )


def archive(pages: DataFrame, *, chunk_bytes: int = 8 << 20, **options) -> tuple[DataFrame, str]:
    """Write all rows as monolithic archives and normalise them: (file, members, n) and the folder."""
    spark = pages.sparkSession
    folder = common.scratch_path(spark, "warc-archives")
    written = common.materialise(with_revisits(pages, **options).mapInArrow(common.lean(_write(folder, chunk_bytes)), "file string, n long"), "warc-files")
    n = max(1, min(written.count(), 10_000))
    return common.materialise(written.repartition(n, "file").mapInArrow(common.lean(_normalise(folder)), "file string, members string, n long"), "warc-members"), folder


def read_archives(members: DataFrame, folder: str, *, payload: bool = True) -> DataFrame:
    """Every record of normalised archives, read member by member through the sidecar index."""
    schema = "rid string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string" + ", payload binary" * payload
    n = max(1, min(members.count(), 10_000))
    return members.select("members", "n").repartition(n, "members").mapInArrow(common.lean(_read(folder, payload)), schema)
