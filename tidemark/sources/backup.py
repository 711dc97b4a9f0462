"""Backups of points as JSONL files with checksums, behind a Spark data source.

A backup is a folder: a manifest, and below it one folder of parts, each written by one task as it streams. A part is a header line,
a line for each point (its digest and the point as JSON, columns by name) and a tail line with the number of points and a
checksum of all lines before it. Points are put into JSON, and their digests taken, by Spark's own functions; the data source moves bytes. The
manifest lists the parts with their checksums. It is moved into place when all tasks have ended, so a backup is there whole or not
at all: what a failed or repeated task leaves behind is in no manifest, and is removed by the commit or the abort of the job.

Readers take a part a task and stop at the first damage, told apart as ``missing`` (no such file), ``header``, ``record`` (with its
line), ``count`` (whole lines lost, repeated or moved) and ``tail`` (cut off, or another file than the manifest names). On a cluster the
folder must be on a file system that Spark and Arrow both open on all executors.

Refused at export: ids that are null or repeated, vectors of another length (null and empty ones pass), numbers that are not finite,
a backup id that is taken or no plain name. An empty table gives a backup without parts.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from ..session import shared_folder

FORMAT = "tidemark_backup"
VERSION = 1
MANIFEST = "_manifest.json"
#: Names that a backup may have.
BACKUP_ID = r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$"
# Times keep their microseconds.
JSON_OPTIONS = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_RECORD = re.compile(rb'\{"point_sha256":"([0-9a-f]{64})","point":(.*)\}\n', re.DOTALL)
#: Bytes of records that a reader hands over at once.
BATCH_BYTES = 4 << 20


class BackupError(ValueError):
    """A backup that can't be written or trusted."""


class Damage(BackupError):
    def __init__(self, kind: str, file: str, line: int) -> None:
        super().__init__(f"backup damaged ({kind}) at {file}:{line}")
        self.kind, self.line = kind, line


def _line(value: dict) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode() + b"\n"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _exists(store: pafs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type != pafs.FileType.NotFound


def manifest(path: str) -> dict:
    """The manifest of the backup in a folder; its own digest must fit."""
    store, base = _open(path)
    if not _exists(store, f"{base}/{MANIFEST}"):
        raise BackupError(f"no backup at {path}")
    try:
        with store.open_input_stream(f"{base}/{MANIFEST}") as source:
            found = json.loads(source.read())
        own = found.pop("manifest_sha256")
    except (ValueError, KeyError, AttributeError) as error:
        raise BackupError(f"backup manifest is invalid: {path}") from error
    if own != hashlib.sha256(_line(found)).hexdigest():
        raise BackupError(f"backup manifest was changed: {path}")
    if found["head"]["schema_version"] != VERSION:
        raise BackupError(f"backup version is unsupported: {path}")
    return found


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    records: int = 0
    size: int = 0
    sha256: str = ""


class Writer(DataSourceArrowWriter):
    """Rows (point_sha256, point) to parts; visible once committed."""

    def __init__(self, path: str, head: dict, overwrite: bool) -> None:
        self.path, self.head, self.overwrite, self.folder = path, head, overwrite, f"parts-{uuid.uuid4().hex}"
        self._refuse_taken()

    def _refuse_taken(self) -> None:
        store, base = _open(self.path)
        if not self.overwrite and _exists(store, f"{base}/{MANIFEST}"):
            raise BackupError(f"backup already exists: {self.path}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        rows = (pair for batch in iterator for pair in zip(batch.column("point_sha256"), batch.column("point")))
        first = next(rows, None)
        if first is None:
            return Written(None)
        store, base = _open(self.path)
        store.create_dir(f"{base}/{self.folder}", recursive=True)
        file, seen, size, n = f"{self.folder}/{uuid.uuid4().hex}.jsonl", hashlib.sha256(), 0, 0
        with store.open_output_stream(f"{base}/{file}", compression=None) as raw, io.BufferedWriter(raw, 1 << 20) as out:

            def put(line: bytes) -> None:
                nonlocal size
                seen.update(line)
                size += out.write(line)

            put(_line(self.head))
            while first is not None:
                digest, point = (v.as_py() for v in first)
                put(b'{"point_sha256":"%s","point":%s}\n' % (digest.encode(), point.encode()))
                n, first = n + 1, next(rows, None)
            put(_line({"records": n, "sha256": seen.hexdigest()}))
        return Written(file, n, size, seen.hexdigest())

    def commit(self, messages: list[Written | None]) -> None:
        self._refuse_taken()
        store, base = _open(self.path)
        parts = [{"file": m.file, "records": m.records, "size": m.size, "sha256": m.sha256} for m in messages if m and m.file]
        made = {"head": self.head, "records": sum(p["records"] for p in parts), "parts": parts}
        made["manifest_sha256"] = hashlib.sha256(_line(made)).hexdigest()
        store.create_dir(base, recursive=True)
        waiting = f"{base}/_waiting-{uuid.uuid4().hex}"
        with store.open_output_stream(waiting, compression=None) as out:
            out.write(_line(made))
        store.move(waiting, f"{base}/{MANIFEST}")
        self._sweep(store, base, {p["file"].split("/")[1] for p in parts})

    def _sweep(self, store: pafs.FileSystem, base: str, kept: set[str]) -> None:
        """Remove parts that the manifest does not list: of tasks that ran twice, and of the backup it replaces."""
        for info in store.get_file_info(pafs.FileSelector(base)):
            if info.type == pafs.FileType.Directory and info.base_name != self.folder:
                store.delete_dir(info.path)
        if kept:
            for info in store.get_file_info(pafs.FileSelector(f"{base}/{self.folder}")):
                if info.base_name not in kept:
                    store.delete_file(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, base = _open(self.path)
        if _exists(store, f"{base}/{self.folder}"):
            store.delete_dir(f"{base}/{self.folder}")


@dataclass
class Part(InputPartition):
    number: int
    part: dict


class Reader(DataSourceReader):
    """Points of the parts in the manifest; or, to verify, one row a part with what is wrong with it."""

    def __init__(self, path: str, verify: bool) -> None:
        self.path, self.verify = path, verify
        self.manifest = manifest(path)

    def partitions(self) -> list[Part]:
        parts = self.manifest["parts"] or [None]  # Spark asks for one partition at least
        return [Part(i, p) for i, p in enumerate(parts)]

    def _records(self, part: dict) -> Iterator[tuple[int, str, bytes]]:
        """(line, digest, point) of one part, each checked before it is handed out; Damage where it ends early."""
        store, base = _open(self.path)
        if not _exists(store, f"{base}/{part['file']}"):
            raise Damage("missing", part["file"], 0)
        seen, at, tail = hashlib.sha256(), 0, None
        with store.open_input_stream(f"{base}/{part['file']}", compression=None) as raw:
            for at, line in enumerate(io.BufferedReader(raw, 1 << 20), 1):
                if at == 1:
                    if line != _line(self.manifest["head"]):
                        raise Damage("header", part["file"], 1)
                elif tail is not None or not line.endswith(b"\n"):  # lines after the tail, or a line that was cut
                    raise Damage("tail", part["file"], at)
                elif line.startswith(b'{"records":'):
                    tail = line
                    if line != _line({"records": part["records"], "sha256": seen.hexdigest()}):
                        raise Damage("count", part["file"], at)
                else:
                    found = _RECORD.fullmatch(line)
                    if not found or hashlib.sha256(found[2]).hexdigest().encode() != found[1]:
                        raise Damage("record", part["file"], at)
                    yield at, found[1].decode(), found[2]
                seen.update(line)
        if at == 0:
            raise Damage("header", part["file"], 1)
        if tail is None or seen.hexdigest() != part["sha256"]:
            raise Damage("tail", part["file"], at)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.part is None:
            return
        if self.verify:
            good, damage, line = 0, None, None
            try:
                for _ in self._records(partition.part):
                    good += 1
            except Damage as found:
                damage, line = found.kind, found.line
            row = {"part": pa.array([partition.number], pa.int32()), "file": [partition.part["file"]], "records": pa.array([partition.part["records"]], pa.int64()), "good": pa.array([good], pa.int64()), "damage": pa.array([damage], pa.string()), "line": pa.array([line], pa.int64())}
            yield pa.RecordBatch.from_pydict(row)
            return
        held: list[tuple[int, str, bytes]] = []
        size = 0
        for record in self._records(partition.part):
            held.append(record)
            size += len(record[2])
            if size >= BATCH_BYTES:
                yield self._batch(partition.number, held)
                held, size = [], 0
        if held:
            yield self._batch(partition.number, held)

    @staticmethod
    def _batch(number: int, held: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
        line, digest, point = zip(*held)
        return pa.RecordBatch.from_pydict({"part": pa.array([number] * len(held), pa.int32()), "line": pa.array(line, pa.int64()), "point_sha256": digest, "point": pa.array(point, pa.binary()).cast(pa.string())})


class BackupSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _verify(self) -> bool:
        return self.options.get("verify", "false") == "true"

    def schema(self) -> str:
        return "part int, file string, records long, good long, damage string, line long" if self._verify() else "part int, line long, point_sha256 string, point string"

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self._verify())

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], json.loads(self.options["head"]), overwrite)


def _unfinite(value: Column, kind: DataType) -> Column | None:
    """Whether a value holds a number that JSON has no form for; None for types that can't."""
    if isinstance(kind, (FloatType, DoubleType)):
        return F.isnan(value) | value.isin(float("inf"), float("-inf"))
    if isinstance(kind, ArrayType):
        return None if _unfinite(value, kind.elementType) is None else F.exists(value, lambda x: F.coalesce(_unfinite(x, kind.elementType), F.lit(False)))
    if isinstance(kind, MapType):
        return _unfinite(F.map_values(value), ArrayType(kind.valueType))
    if isinstance(kind, StructType):
        inner = [c for c in (_unfinite(value[f.name], f.dataType) for f in kind.fields) if c is not None]
        return F.array_contains(F.transform(F.array(*inner), lambda c: F.coalesce(c, F.lit(False))), True) if inner else None
    return None


def canonical(df: DataFrame) -> Column:
    """A row as JSON, columns by name, nulls written; a number that is not finite ends the job."""
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), JSON_OPTIONS)
    checks = [c for c in (_unfinite(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields) if c is not None]
    if not checks:
        return body
    bad = F.exists(F.array(*checks), lambda c: F.coalesce(c, F.lit(False)))
    return F.when(bad, F.raise_error(F.lit("a number of a point is not finite"))).otherwise(body)


def digest(df: DataFrame) -> Column:
    return F.sha2(canonical(df).cast("binary"), 256)


def _whole(spark: SparkSession, path: str) -> str:
    """The path with its file system, the same one for Hadoop and for Arrow."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return re.sub(r"^file:/+", "file:///", whole)


def export(points: DataFrame, root: str, *, backup_id: str, created_at: str, scope: str = "memory", collection: str = "own", vector: str | None = None, vector_size: int | None = None, overwrite: bool = False) -> str:
    """Write ``points`` (a column ``id`` among others) as the backup ``backup_id`` below ``root``; returns its folder. Ids are read once more
    beforehand, to find repeated ones."""
    if not re.match(BACKUP_ID, backup_id):
        raise BackupError("invalid backup_id")
    spark = points.sparkSession
    path = f"{_whole(spark, root)}/{backup_id}"
    twice = points.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").select("id").first()
    if twice is not None:
        raise BackupError("a point has no id" if twice.id is None else f"repeated id: {twice.id}")
    body = canonical(points)
    if vector and vector_size is not None:
        fits = F.col(vector).isNull() | F.size(vector).isin(0, vector_size)
        body = F.when(~fits, F.raise_error(F.concat(F.lit("vector size mismatch for id "), F.col("id").cast("string")))).otherwise(body)
    head = {"schema_version": VERSION, "artifact_type": "points_backup", "backup_id": backup_id, "scope": scope, "collection": collection, "created_at": created_at, "vector": vector, "vector_size": vector_size, "columns": json.loads(points.schema.json())}
    spark.dataSource.register(BackupSource)
    rows = points.select(body.alias("point")).select(F.sha2(F.col("point").cast("binary"), 256).alias("point_sha256"), "point")
    rows.write.format(FORMAT).option("head", json.dumps(head)).mode("overwrite" if overwrite else "append").save(path)
    return path


def load(spark: SparkSession, path: str) -> DataFrame:
    """The points of a backup, columns as exported and ``point_sha256``; a damaged part ends the job that reads it."""
    path = _whole(spark, path)
    schema = StructType.fromJson(manifest(path)["head"]["columns"])
    spark.dataSource.register(BackupSource)
    rows = spark.read.format(FORMAT).load(path)
    return rows.select(F.from_json("point", schema, JSON_OPTIONS | {"mode": "FAILFAST"}).alias("p"), "point_sha256").select("p.*", "point_sha256")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(part, file, records, good, damage, line): points that a part should have, those read before any damage, and the damage."""
    spark.dataSource.register(BackupSource)
    return spark.read.format(FORMAT).option("verify", "true").load(_whole(spark, path))


def outcomes(backup: DataFrame, current: DataFrame, protected: Column | None = None) -> DataFrame:
    """(id, action) of each point of a backup (as :func:`load` gives it) against what is there: ``same``, ``changed``, ``missing``, or ``refused``: it
    would overwrite a row that is ``protected`` (a condition on the current row). Only ids and digests are joined."""
    guard = F.lit(False) if protected is None else F.coalesce(protected, F.lit(False))
    now = current.select("id", digest(current).alias("_now"), guard.alias("_guard"))
    both = backup.select("id", "point_sha256").join(now, "id", "left")
    action = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") == F.col("point_sha256"), "same").when(F.col("_guard"), "refused").otherwise("changed")
    return both.select("id", action.alias("action"))


def restore(backup: DataFrame, current: DataFrame, *, protected: Column | None = None, live: tuple[str, ...] = ()) -> DataFrame:
    """What is there after the backup is restored: changed and missing points as they were, all others untouched. Columns in ``live`` keep the value
    that the current row has, if any. Refused as a whole if a single point is; restoring twice changes nothing more."""
    action = outcomes(backup, current, protected)
    if protected is not None:
        shared_folder(backup.sparkSession)
        action = action.checkpoint()
        refused = action.where("action = 'refused'").first()
        if refused is not None:
            raise BackupError(f"protected point would be overwritten: {refused.id}")
    back = backup.drop("point_sha256").join(action.where("action IN ('changed', 'missing')").select("id"), "id", "left_semi")
    if live:
        own = current.select("id", *[F.col(c).alias(f"_live_{c}") for c in live])
        back = back.join(own, "id", "left").select(*[F.coalesce(f"_live_{c}", c).alias(c) if c in live else F.col(c) for c in current.columns])
    return current.join(back.select("id"), "id", "left_anti").unionByName(back)
