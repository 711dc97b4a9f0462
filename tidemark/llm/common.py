"""Plumbing shared by the corpus operators: scratch tables, held-out rows, words, packed arrays.

Nothing here keeps data on the driver or in a machine-local folder. Intermediate results that are
read more than once are written as Parquet under ``spark.checkpoint.dir``, which all executors
share, so a lost executor costs a re-read and never a recomputation of the whole lineage.
"""

from __future__ import annotations

import ctypes
import functools
import json
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Words of a text: runs of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh path in the shared folder, named with its file system; Hadoop removes it when the driver's
    JVM ends, unless it is to be kept."""
    path = f"{shared_folder(spark)}/tidemark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if not keep:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a scratch table once nothing reads it any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialise(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives executors."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory of this process to the machine: a Python worker is kept between tasks, and what its
    allocators hold on to counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a function for mapInArrow, that leaves a small worker behind."""

    @functools.wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return own


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keyed(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` with one more column, a unique text key of each row, and that column's name, which no other column
    has. The key is the same for every reader: of rows of files the file and the place in it; any others are
    written with a number first."""
    key = fresh(df, "_row")
    try:
        return df.select("*", F.concat_ws(":", "_metadata.file_path", F.col("_metadata.row_index").cast("string")).alias(key)), key
    except AnalysisException:  # the rows don't come from files that number them
        return materialise(df.withColumn(key, F.monotonically_increasing_id().cast("string")), name), key


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text (remainder 0)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def chunks(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose ``column`` holds about ``limit`` bytes each, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.take(pa.array(np.arange(a, b)))  # a copy: some string kernels of Arrow misread slices


def words_of(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array]:
    """All words of ``texts`` (A-Z lower-cased) in order and, for each text, its number of words."""
    if texts.offset:  # see chunks()
        texts = texts.take(pa.array(np.arange(len(texts))))
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    counts, values = np.diff(split.offsets.to_numpy()), split.flatten()
    full = pc.greater(pc.binary_length(values), 0)
    if len(values) and not pc.all(full).as_py():  # white space at either end leaves an empty piece
        owner = np.repeat(np.arange(len(counts)), counts)[full.to_numpy(zero_copy_only=False)]
        counts, values = np.bincount(owner, minlength=len(counts)), values.filter(full)
    return counts.astype(np.int64), values


def pack(**arrays: np.ndarray) -> bytes:
    """Named one-dimensional arrays as one compressed value."""
    head = json.dumps([[k, a.dtype.str, len(a)] for k, a in arrays.items()]).encode()
    body = b"".join([struct.pack("<I", len(head)), head, *(np.ascontiguousarray(a).tobytes() for a in arrays.values())])
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(data)
    at = 4 + struct.unpack_from("<I", body)[0]
    out = {}
    for name, kind, n in json.loads(body[4:at]):
        out[name] = np.frombuffer(body, kind, n, at)
        at += out[name].nbytes
    return out


def ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def from_ipc(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def mix64(a: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public SplitMix64 constants)."""
    a = a.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        a ^= a >> np.uint64(30)
        a *= np.uint64(0xBF58476D1CE4E5B9)
        a ^= a >> np.uint64(27)
        a *= np.uint64(0x94D049BB133111EB)
        a ^= a >> np.uint64(31)
    return a
