"""Backups written, read, damaged and restored."""

import datetime
import json
import random

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.plans import registry
from tidemark.sources import backup

DATA = "/root/testdata/sf0.001"
SCHEMA = "id long, text string, vector array<float>, at timestamp, tags map<string,double>, inner struct<a:int,b:array<string>>, raw binary, price decimal(20,6)"


def rows_of(n):
    rng = random.Random(3)
    out = []
    for i in range(n):
        text = rng.choice([None, "", "line\nbreak \"quoted\" \\   é", "x" * 300_000 if i == 5 else "short"])
        vector = rng.choice([None, [], [rng.uniform(-1, 1) for _ in range(4)]])
        out.append((i, text, vector, datetime.datetime(2024, 1, 2, 3, 4, 5, rng.randint(0, 999999)), {"a": 0.1 * i}, (i, ["p", None]), bytes([i % 256]), None))
    return out


def made(spark, folder, n=40, parts=4, **more):
    df = spark.createDataFrame(rows_of(n), SCHEMA).repartition(parts)
    return df, backup.export(df, str(folder), backup_id="b1", created_at="2024-03-01T00:00:00Z", vector="vector", vector_size=4, **more)


def local(path):
    import pathlib

    return pathlib.Path(path.removeprefix("file://"))


def test_round_trip(spark, tmp_path):
    df, path = made(spark, tmp_path)
    back = backup.load(spark, path)
    assert back.columns == [*df.columns, "point_sha256"]
    assert sorted(map(str, back.drop("point_sha256").collect())) == sorted(map(str, df.collect()))
    assert back.where(F.col("point_sha256") != backup.digest(back.drop("point_sha256"))).count() == 0
    assert {(r.damage, r.good == r.records) for r in backup.verify(spark, path).collect()} == {(None, True)}
    head = backup.manifest(path)
    assert head["records"] == 40 and sum(p["records"] for p in head["parts"]) == 40
    with pytest.raises(PySparkException, match="already exists"):
        made(spark, tmp_path)
    made(spark, tmp_path, n=7, overwrite=True)
    assert backup.load(spark, path).count() == 7
    assert len(list(local(path).glob("parts-*"))) == 1


def test_empty_table(spark, tmp_path):
    df, path = made(spark, tmp_path, n=0)
    assert backup.load(spark, path).collect() == [] and backup.verify(spark, path).collect() == []
    assert backup.restore(backup.load(spark, path), df).count() == 0


def test_failing_task_leaves_nothing(spark, tmp_path):
    df = spark.range(100).repartition(4)
    with pytest.raises(PySparkException, match="boom"):
        backup.export(df.withColumn("x", F.when(F.col("id") == 77, F.raise_error(F.lit("boom"))).otherwise(F.lit("ok"))), str(tmp_path), backup_id="b1", created_at="")
    assert not list((tmp_path / "b1").glob("parts-*")) if (tmp_path / "b1").exists() else True
    with pytest.raises(backup.BackupError, match="no backup"):
        backup.load(spark, f"{tmp_path}/b1")


@pytest.mark.parametrize("rows,schema,match", [
    ([(1, "a"), (1, "b")], "id long, t string", "repeated id"), ([(None, "a")], "id long, t string", "no id"),
    ([(1, float("nan"))], "id long, x double", "not finite"), ([(1, [1.0, float("inf")])], "id long, x array<float>", "not finite"),
    ([(1, ([{"k": float("nan")}],))], "id long, x struct<l:array<map<string,double>>>", "not finite"),
    ([(1, [1.0])], "id long, vector array<float>", "size mismatch"),
])
def test_refused(spark, tmp_path, rows, schema, match):
    df = spark.createDataFrame(rows, schema)
    with pytest.raises((backup.BackupError, PySparkException), match=match):
        backup.export(df, str(tmp_path), backup_id="b1", created_at="", vector="vector" if "vector" in df.columns else None, vector_size=4)
    with pytest.raises(backup.BackupError, match="invalid"):
        backup.export(df, str(tmp_path), backup_id="../b1", created_at="")


def broken(data: bytes, how: str) -> bytes:
    lines = data.splitlines(keepends=True)
    if how == "header":
        return lines[0].replace(b'"own"', b'"oWn"') + b"".join(lines[1:])
    if how == "record":
        lines[3] = lines[3].replace(b'"id":', b'"id":1', 1)
    if how == "count":
        del lines[2]
    if how == "cut":
        return data[: len(data) - len(lines[-1]) - 9]
    if how == "tail":
        del lines[-1]
    if how == "empty":
        return b""
    if how == "more":
        lines.append(lines[-1])
    return b"".join(lines)


@pytest.mark.parametrize("how,want", [("header", ("header", 1)), ("record", ("record", 4)), ("count", ("count", None)), ("cut", ("tail", None)), ("tail", ("tail", None)), ("empty", ("header", 1)), ("more", ("tail", None)), ("missing", ("missing", 0))])
def test_damage(spark, tmp_path, how, want):
    _, path = made(spark, tmp_path)
    file = sorted(local(path).glob("parts-*/*.jsonl"))[0]
    if how == "missing":
        file.unlink()
    else:
        file.write_bytes(broken(file.read_bytes(), how))
    found = [r for r in backup.verify(spark, path).collect() if r.damage]
    assert [(r.damage, r.line if want[1] is not None else None) for r in found] == [want] and found[0].file.endswith(file.name)
    with pytest.raises(PySparkException, match=rf"damaged \({want[0]}\)"):
        backup.load(spark, path).count()


def test_changed_manifest(spark, tmp_path):
    _, path = made(spark, tmp_path)
    file = local(path) / backup.MANIFEST
    whole = json.loads(file.read_text())
    whole["parts"].pop()
    file.write_text(json.dumps(whole))
    with pytest.raises(backup.BackupError, match="changed"):
        backup.load(spark, path)


def test_restore(spark):
    was = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "c", "old")], "id long, text string, origin string")
    stored = was.withColumn("point_sha256", backup.digest(was))
    now = spark.createDataFrame([(1, "a", None), (2, "x", "live"), (9, "z", None)], "id long, text string, origin string")
    assert {r.id: r.action for r in backup.outcomes(stored, now).collect()} == {1: "same", 2: "changed", 3: "missing"}
    once = backup.restore(stored, now, live=("origin",))
    want = [(1, "a", None), (2, "b", "live"), (3, "c", "old"), (9, "z", None)]
    assert sorted(map(tuple, once.collect()), key=str) == want
    assert sorted(map(tuple, backup.restore(stored, once, live=("origin",)).collect()), key=str) == want
    with pytest.raises(backup.BackupError, match="protected"):
        backup.restore(stored, now, protected=F.col("text") == "x")
    assert backup.restore(stored, now, protected=F.col("text") == "a").count() == 4  # it is the same


def test_query_equals_the_table(spark):
    got = {r.id: (r.source, r.created_us, r.text_md5, r.n_dims) for r in registry.QUERIES["backup_file"](spark, DATA).collect()}
    rows = duckdb.sql(f"""SELECT d.doc_id, d.source, (1704067200 + d.doc_id * 3600) * 1000000, md5(d.text), len(e.embedding)
      FROM '{DATA}/documents.parquet' d LEFT JOIN '{DATA}/embeddings.parquet' e ON e.vec_id = d.doc_id""").fetchall()
    assert got == {r[0]: r[1:] for r in rows}
