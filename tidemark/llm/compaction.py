"""Executed compaction: small files are packed into groups, and each group is rewritten as one file.

Packing is first-fit decreasing, a group at a time. First-fit hands each file to the earliest group with
room; the files of the first group are therefore those that a single pass takes greedily, those of the second
what a pass over the rest takes, and so on. A pass doesn't walk over all files: sizes descend, so the next
file that fits what is left of the group is found by bisection, and a union-find forest over the places skips
files that are taken. A group of m files costs m bisections.

Execution:

* :func:`write_files` deals rows out by file and sorts them in the task that writes the file (Spark's own
  external sort), so a file is whole whatever its size; a folder of the layout names partition, lot and piece;
* :func:`plan` packs the files of each partition in a task of that partition's own: it gets one row a file,
  never rows of the table;
* :func:`execute` reads the files that are to be merged, deals their rows out by group, sorts them by place in
  the group and place in the file, and appends one file a group to the folder. Spark's commit makes those
  files visible when all are whole. Their row counts are compared with the plan before any source is deleted, so
  a run that fails, or loses executors, before that point leaves every row where it was. The driver then
  deletes the sources one path at a time, as Spark's own committer renames them; nothing else reaches it.

Readers that list the folder between the append and the last deletion see merged rows twice;
after a lost driver, ``execute(..., again=True)`` on the same plan goes on where that one stopped.

Nulls: rows without arrival are a partition of their own, last in order; null ids hash as the empty text. No
rows: no files. Repeated rows are kept, next to each other. Columns may have any names.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def pack(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Groups of places in ``sizes`` (descending), as first-fit in that order makes them: each file joins the
    earliest group that holds at most ``capacity`` with it. A file above the capacity is a group alone."""
    rising = [-x for x in sizes]
    left = list(range(len(sizes) + 1))  # union-find: the first place from i on that is not taken

    def free(i: int) -> int:
        while left[i] != i:
            left[i] = i = left[left[i]]
        return i

    groups, first = [], free(0)
    while first < len(sizes):
        group, room, at = [], capacity, first
        while at < len(sizes):
            group.append(at)
            left[at] = at + 1
            room -= sizes[at]
            at = free(max(at + 1, bisect.bisect_left(rising, -room)))
        groups.append(group)
        first = free(first)
    return groups


class Layout:
    """Columns of the table, and the name of the one folder level, which clashes with none of them. A folder's name
    is day, lot and piece of its file, joined by underscores: opening folders takes longer than writing small files,
    and one level is half the work of three."""

    def __init__(self, table: DataFrame, name: str = "file"):
        self.columns, self.schema, self.level = table.columns, table.schema, common.fresh(table, name)

    def label(self, day: Column, lot: Column, piece: Column) -> Column:
        return F.concat_ws("_", F.coalesce(day.cast("string"), F.lit("null")), lot.cast("string"), piece.cast("string")).alias(self.level)

    def parts(self) -> list[Column]:
        """day, lot and piece of a row's file."""
        cut = F.split(F.col(f"`{self.level}`"), "_")
        return [F.nullif(cut[0], F.lit("null")).cast("long").alias("day"), cut[1].cast("long").alias("lot"), cut[2].cast("long").alias("piece")]


def write_files(rows: DataFrame, layout: Layout, order: Sequence[Column], folder: str, files: int, n_rows: int) -> None:
    """One Parquet file for each label that occurs in ``rows``, a table with the level column, in ``order``, with the
    columns of the table as they stand. ``files`` and ``n_rows``: how many there will be, which sets the number of tasks: a
    task writes 16 small files, or one of many rows."""
    tasks = min(max(files, 1), max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), files // 16, n_rows // 1_000_000))
    level = F.col(f"`{layout.level}`")
    dealt = rows.repartition(tasks, level).sortWithinPartitions(level, *order).select(*_names(layout.columns), level)
    dealt.write.mode("append").option("maxRecordsPerFile", 0).partitionBy(layout.level).parquet(folder)


def _names(columns: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in columns]


def read_files(spark: SparkSession, layout: Layout, folder: str) -> DataFrame:
    """The rows in ``folder`` with the label and path of their file and their place in it."""
    kinds = [*((f.name, f.dataType.simpleString()) for f in layout.schema.fields), (layout.level, "string")]
    rows = spark.read.schema(", ".join(f"`{n}` {kind}" for n, kind in kinds)).parquet(folder)
    return rows.select("*", F.col("_metadata.file_path").alias("path?"), F.col("_metadata.row_index").alias("place?"))


def listing(files: DataFrame, layout: Layout) -> DataFrame:
    """(day, lot, piece, path, n_rows) of each file; counts come from the footers."""
    return files.select(*layout.parts(), F.col("`path?`").alias("path")).groupBy("day", "lot", "piece", "path").agg(F.count(F.lit(1)).alias("n_rows"))


def plan(files: DataFrame, small: int, capacity: int) -> DataFrame:
    """(day, lot, piece, path, n_rows, first_lot, first_piece, place, members, sources): the group of each file by
    its first file, the place in it, and, in the row of the first, lots and pieces of all in joining order. Files of ``small`` rows or
    more stay alone. ``files`` is a listing; each partition's files are packed in one task."""

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_rows", "lot", "piece"], ascending=[False, True, True], ignore_index=True)
        whole = int((rows.n_rows >= small).sum())
        groups = [[i] for i in range(whole)] + [[i + whole for i in g] for g in pack(rows.n_rows[whole:].tolist(), capacity)]
        lots, pieces = rows.lot.tolist(), rows.piece.tolist()
        made = [(i, lots[g[0]], pieces[g[0]], k, len(g), ",".join(f"{lots[x]}-{pieces[x]}" for x in g) if not k else "") for g in groups for k, i in enumerate(g)]
        extra = pd.DataFrame(made, columns=["row", "first_lot", "first_piece", "place", "members", "sources"]).set_index("row")
        return rows.join(extra)

    return files.groupBy("day").applyInPandas(packed, "day long, lot long, piece long, path string, n_rows long, first_lot long, first_piece long, place long, members long, sources string")


def execute(spark: SparkSession, layout: Layout, folder: str, planned: DataFrame, again: bool = False, rows: DataFrame | None = None) -> None:
    """Carry out a plan that lies in a table: append the merged files, compare, delete the sources. ``again``: the plan
    may have been carried out in part before; merged files that lie there already are not written twice. ``rows``: the
    files as they were planned, if they have been listed already."""
    merges = planned.where("members > 1")
    groups = merges.where("place = 0").count()
    if not groups:
        return
    def merged() -> DataFrame:
        return listing(read_files(spark, layout, folder), layout).join(planned.select("path"), "path", "left_anti")

    if not again or merged().isEmpty():
        label = layout.label(F.col("day"), F.col("first_lot"), F.col("first_piece"))
        moves = merges.select(F.col("path").alias("path?"), F.col("place").alias("nth?"), label.alias("into?"))
        rows = (rows or read_files(spark, layout, folder)).drop(layout.level).join(moves, "path?").withColumnRenamed("into?", layout.level)
        write_files(rows, layout, [F.col("`nth?`"), F.col("`place?`")], folder, groups, merges.agg(F.sum("n_rows")).first()[0])
    asked = merges.groupBy("day", F.col("first_lot").alias("lot"), F.col("first_piece").alias("piece")).agg(F.sum("n_rows").alias("asked")).alias("a")
    same = asked.join(merged().alias("m"), F.col("a.day").eqNullSafe(F.col("m.day")) & (F.col("a.lot") == F.col("m.lot")) & (F.col("a.piece") == F.col("m.piece")), "full_outer")
    if not same.where("asked IS NULL OR n_rows IS NULL OR asked != n_rows").isEmpty():
        raise RuntimeError(f"{folder}: the merged files don't hold the rows of their sources; no source was deleted")
    jvm = spark.sparkContext._jvm
    system = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for row in merges.select("path").toLocalIterator():
        system.delete(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(row.path)), False)


def digests(files: DataFrame, layout: Layout, id_col: str, amount_col: str) -> DataFrame:
    """(day, lot, piece, path, n_rows, min_id, max_id, cents, ids_sha256) of each file in ``files``, as
    :func:`read_files` gives them. Rows of a file meet in one task in their order, and go through it as a stream."""
    cents = F.coalesce(F.floor(F.col(f"`{amount_col}`") * 100 + 0.5), F.lit(0)).cast("long").alias("cents")
    rows = files.select(*layout.parts(), F.col("`path?`").alias("path"), F.col("`place?`").alias("place"), F.col(f"`{id_col}`").cast("long").alias("id"), cents)
    rows = rows.repartition("path").sortWithinPartitions("path", "place").drop("place")
    return rows.mapInArrow(common.lean(_digested), "day long, lot long, piece long, path string, n_rows long, min_id long, max_id long, cents long, ids_sha256 string")


_DIGEST = pa.schema([("day", pa.int64()), ("lot", pa.int64()), ("piece", pa.int64()), ("path", pa.string()), ("n_rows", pa.int64()), ("min_id", pa.int64()), ("max_id", pa.int64()), ("cents", pa.int64()), ("ids_sha256", pa.string())])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    head, state = None, None  # the file that is being read, and (rows, smallest, largest, cents, hash) of it so far

    def row() -> pa.RecordBatch:
        n, low, high, cents, ids = state
        return pa.RecordBatch.from_pylist([dict(zip(_DIGEST.names, (*head, n, low, high, cents, ids.hexdigest())))], schema=_DIGEST)

    for batch in batches:
        runs = pc.run_end_encode(batch.column("path"))
        start = 0
        for end in runs.run_ends.to_pylist() if batch.num_rows else ():
            part = batch.slice(start, end - start)
            own = tuple(part.column(c)[0].as_py() for c in ("day", "lot", "piece", "path"))
            if own != head:
                if head is not None:
                    yield row()
                head, state = own, (0, None, None, 0, hashlib.sha256())
            n, low, high, cents, ids = state
            span = pc.min_max(part.column("id")).as_py()
            known = [x for x in (low, span["min"]) if x is not None], [x for x in (high, span["max"]) if x is not None]
            ids.update(((b"," if n else b"") + ",".join("" if x is None else str(x) for x in part.column("id").to_pylist()).encode()))
            state = (n + part.num_rows, min(known[0], default=None), max(known[1], default=None), cents + (pc.sum(part.column("cents")).as_py() or 0), ids)
            start = end
    if head is not None:
        yield row()


def compact(table: DataFrame, folder: str, *, at_col: str = "arrived_at", id_col: str = "click_id", lot_share: int = 150, small_share: int = 600, group_share: int = 500) -> tuple[Layout, DataFrame]:
    """Write ``table`` to the new ``folder`` in files by day, lot and piece, and compact it there. Bounds are shares of
    all R rows: S(x) = 1 + R div x. A day of r rows has 1 + r div S(lot_share) lots, so a day with a third of all
    rows gets a third of all files. Returns the layout and the executed plan."""
    spark, layout = table.sparkSession, Layout(table)
    day = F.unix_date(F.col(f"`{at_col}`").cast("date")).cast("long")
    counts = common.materialise(table.select(day.alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("r")), "compact-days")
    total = counts.agg(F.coalesce(F.sum("r"), F.lit(0))).first()[0]
    share = lambda x: 1 + total // x
    files = 4 * counts.agg(F.coalesce(F.sum(F.floor(F.col("r") / share(lot_share)) + 1), F.lit(0))).first()[0]
    lots = counts.select(F.col("d").alias("d?"), (F.floor(F.col("r") / share(lot_share)) + 1).alias("lots?"))
    h = F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary"))
    lot, piece = (F.floor(h / 16) % F.col("`lots?`")).cast("long"), F.least(h % 4, F.floor(h / 4) % 4).cast("long")
    # days are few in any table of this size, but nothing is broadcast unless its measured size is below Spark's bound
    rows = table.select("*", day.alias("d?")).join(lots.withColumnRenamed("d?", "e?"), F.col("`d?`").eqNullSafe(F.col("`e?`")))
    order = [at_col, id_col, *(c for c in table.columns if c not in (at_col, id_col) and table.schema[c].dataType.typeName() not in ("map", "variant"))]
    rows = rows.select(*_names(table.columns), layout.label(F.col("`d?`"), lot, piece))
    write_files(rows, layout, _names(order), folder, files, total)  # nulls first; all columns break ties, so a rerun writes the same
    written = read_files(spark, layout, folder)
    planned = common.materialise(plan(listing(written, layout), share(small_share), share(group_share)), "compact-plan")
    execute(spark, layout, folder, planned, rows=written)
    return layout, planned


def final_files(spark: SparkSession, layout: Layout, folder: str, planned: DataFrame, *, id_col: str = "click_id", amount_col: str = "value") -> DataFrame:
    """A row of each file that ``folder`` holds now: its digests, the files it was made of, and whether it was rewritten."""
    found = digests(read_files(spark, layout, folder), layout, id_col, amount_col).alias("f")
    groups = planned.where("place = 0").select("day", "lot", "piece", "sources", (F.col("members") > 1).alias("rewritten")).alias("g")
    both = found.join(groups, F.col("f.day").eqNullSafe(F.col("g.day")) & (F.col("f.lot") == F.col("g.lot")) & (F.col("f.piece") == F.col("g.piece")), "left")
    columns = [c for c in spark.read.parquet(folder).columns if c != layout.level] if not planned.isEmpty() else layout.columns
    return both.select("f.*", "sources", "rewritten", F.lit(",".join(columns)).alias("columns"))
