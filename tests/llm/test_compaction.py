"""Compaction: packing against plain first-fit, files against a plain computation of the whole contract."""

import datetime as dt
import hashlib
import math
import os
import random
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.llm import common, compaction


def first_fit(sizes, capacity):
    groups, held = [], []
    for i, n in enumerate(sizes):
        for k, h in enumerate(held):
            if h + n <= capacity:
                groups[k].append(i)
                held[k] += n
                break
        else:
            groups.append([i])
            held.append(n)
    return groups


@given(st.lists(st.integers(1, 60), max_size=80), st.integers(1, 90))
def test_pack(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    assert compaction.pack(sizes, capacity) == first_fit(sizes, capacity)


def test_pack_many():
    rng = random.Random(4)
    sizes = sorted((rng.randint(1, 500) for _ in range(3000)), reverse=True)
    assert compaction.pack(sizes, 1000) == first_fit(sizes, 1000)
    assert compaction.pack([1] * 20000, 7)[:2] == [list(range(7)), list(range(7, 14))]


def expected(rows):
    """(day, lot, piece) of the first source to n_rows, ids in file order, cents, sources, rewritten."""
    total, days = len(rows), defaultdict(list)
    share = lambda x: 1 + total // x
    epoch = dt.datetime(1970, 1, 1)
    for r in rows:
        days[None if r["arrived_at"] is None else (r["arrived_at"] - epoch).days].append(r)
    out = {}
    for day, own in days.items():
        files = defaultdict(list)
        for r in own:
            h = zlib.crc32(("" if r["click_id"] is None else str(r["click_id"])).encode())
            files[h // 16 % (1 + len(own) // share(150)), min(h % 4, h // 4 % 4)].append(r)
        for f in files.values():
            f.sort(key=lambda r: (r["arrived_at"] is not None, r["arrived_at"] or epoch, r["click_id"] is not None, r["click_id"] or 0))
        small = sorted((k for k in files if len(files[k]) < share(600)), key=lambda k: (-len(files[k]), k))
        groups = [[k] for k in files if len(files[k]) >= share(600)]
        groups += [[small[i] for i in g] for g in first_fit([len(files[k]) for k in small], share(500))]
        for g in groups:
            whole = [r for k in g for r in files[k]]
            cents = sum(0 if r["value"] is None else math.floor(100 * r["value"] + 0.5) for r in whole)
            out[day, *g[0]] = (len(whole), [r["click_id"] for r in whole], cents, ",".join(f"{a}-{b}" for a, b in g), len(g) > 1)
    return out


def compare(spark, table, rows):
    folder = common.scratch_path(spark, "compact-test", keep=True)
    layout, planned = compaction.compact(table, folder)
    found = compaction.final_files(spark, layout, folder, planned).collect()
    want = expected(rows)
    assert {(r.day, r.lot, r.piece) for r in found} == set(want) and len(found) == len(want)
    for r in found:
        n, ids, cents, sources, rewritten = want[r.day, r.lot, r.piece]
        text = ",".join("" if i is None else str(i) for i in ids)
        known = [i for i in ids if i is not None]
        assert (r.n_rows, r.cents, r.sources, r.rewritten) == (n, cents, sources, rewritten)
        assert r.ids_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.min_id, r.max_id) == (min(known, default=None), max(known, default=None))
        local = pq.ParquetFile(r.path.removeprefix("file://").removeprefix("file:"))
        assert local.schema_arrow.names == table.columns and r.columns == ",".join(table.columns)
        assert local.read().column("click_id").to_pylist() == ids
    place = folder.removeprefix("file://")
    kept = {os.path.join(d, f) for d, _, names in os.walk(place) for f in names if f.endswith(".parquet")}
    assert kept == {r.path.removeprefix("file://").removeprefix("file:") for r in found}
    return layout, folder, planned


SCHEMA = "click_id long, arrived_at timestamp_ntz, value double, day string, file string"


def made(n, seed):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        at = start + dt.timedelta(days=0 if rng.random() < 0.35 else rng.randint(-1, 5), seconds=rng.randint(0, 3000))
        rows.append({"click_id": i, "arrived_at": at, "value": rng.choice([None, 1.005, -2.5, 7.125, 0.0]), "day": "x", "file": str(i % 3)})
    rows += rng.sample(rows, n // 20)  # repeated rows
    rows += [{"click_id": None, "arrived_at": None, "value": None, "day": None, "file": None}, {"click_id": 5, "arrived_at": None, "value": 1.0, "day": None, "file": None}]
    return rows


def test_compact(spark):
    rows = made(4000, 1)
    compare(spark, spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA), rows)


def test_small_and_empty(spark):
    rows = made(40, 2)
    compare(spark, spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA), rows)
    compare(spark, spark.createDataFrame([], SCHEMA), [])


def test_untouched_files_and_resume(spark):
    """Files outside groups keep their bytes; a second run of the plan changes nothing; a plan that doesn't fit refuses."""
    rows = made(3000, 3)
    table = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    layout, folder, planned = compare(spark, table, rows)
    place = folder.removeprefix("file://")
    state = lambda: {p: (os.stat(p).st_mtime_ns, os.stat(p).st_size) for d, _, names in os.walk(place) for f in names if (p := os.path.join(d, f)).endswith(".parquet")}
    before = state()
    alone = [r.path.removeprefix("file://").removeprefix("file:") for r in planned.where("members = 1").collect()]
    assert alone and set(alone) <= set(before)
    compaction.execute(spark, layout, folder, planned, again=True)
    assert state() == before
    wrong = planned.selectExpr("* except (n_rows)", "n_rows + 1 AS n_rows")
    with pytest.raises(RuntimeError, match="no source was deleted"):
        compaction.execute(spark, layout, folder, wrong, again=True)
    assert state() == before
