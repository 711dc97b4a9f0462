"""Embedding near-duplicates by a pivot-permutation index.

Reference points (pivots) are a sample of the vectors, one for ``per_pivot`` of them up to ``growth`` times
the root of their number, so that neither the lists nor the work for a vector grows with the table alone; they
are sent to all tasks, ``max_pivot_bytes`` of a dimension at most. Each vector is described by its ``depth``
nearest pivots in order, and stands in the inverted list of each but its ``shared`` - 1 of the highest numbers
(the lowest pivot of ``shared`` common ones is never among these). Two vectors are candidates if they share at
least ``shared`` pivots and hold these far enough in front: the place r of a pivot in a permutation weighs
``depth`` - r, and the products of the weights at both vectors must add up to ``in_order``. Candidates are
verified by cosine in double precision; the pair is looked at in the list of the smallest pivot they share, and
nowhere else.

Execution. Only vectors of one label and dimension are compared. Equal vectors are one class with a
multiplicity, so copies cost one entry. A list longer than ``tile`` is cut into chunks by hash, and each
pair of chunks is a task's tile, so a long list (one huge group of near copies) is spread over tasks; no
task holds more than two chunks. A tile's links leave it as a count for each vector and a spanning
forest, never as pairs.

The index is approximate by design, what it links is exact. Recall is the share of true pairs that are
candidates; tests/llm/test_embedding_dedup.py measures it with the parameters of the query on made-up pairs at
cosines of 0.93 to 0.96 (the test tables hold no pair at 0.93 to measure it on). Where a dimension has fewer
pivots than ``depth``, sharing ``shared`` of them, or all if there are fewer, is enough: vectors that are all
close to one pivot are all compared (a number of pairs that grows with the square of their number).
``exact=True`` compares all pairs of a label and dimension instead, tile by tile, whatever their pivots.

Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, like those without
a label. Norms are taken after scaling by the largest component, so no finite vector is too long or too short.
Repeated ids are rows of their own. The smallest id of a component ignores null ids, a row with a null id keeps
a null component unless it is linked. Equal vectors are told apart from others by a 64-bit hash of label and
components. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .simhash import forest


def _matrix(column: pa.Array, kind: str = "f8") -> np.ndarray:
    """Rows of equal length."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1) if n else np.zeros((0, 0))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length one. The scale is a power of two, so it changes no digit of the result."""
    if len(rows):
        rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def spread(rows: np.ndarray, apart: float) -> np.ndarray:
    """Unit vectors in order, without those closer than ``apart`` (a cosine) to one kept before: a group of
    near copies gives one pivot at most, so its members see the others in the same order."""
    kept = np.empty_like(rows)
    n = 0
    for row in rows:
        if not n or (kept[:n] @ row).max() < apart:
            kept[n] = row
            n += 1
    return kept[:n]


def permutation(rows: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The nearest pivots of each unit vector, nearest first."""
    near = rows @ pivots.T
    depth = min(depth, len(pivots))
    some = np.argpartition(-near, depth - 1, axis=1)[:, :depth]
    order = np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1)


def _describe(sent, depth: int, step: int = 2048):
    """(node, grp, n, vec) to the same with the permutation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = sent.value
        for batch in batches:
            size = np.diff(batch.column("vec").offsets.to_numpy())
            lists: list = [None] * batch.num_rows
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                for part in np.split(at, np.arange(step, len(at), step)):
                    rows = unit(_matrix(batch.column("vec").take(pa.array(part))))
                    for i, p in zip(part.tolist(), permutation(rows, pivots[int(d)], depth).tolist()):
                        lists[i] = p
            yield pa.record_batch([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*batch.schema.names, "pivots"])

    return run


def tile_links(rows: np.ndarray, pivots: np.ndarray, chunk: np.ndarray, own: int, shared: int, cosine: float, in_order: int = 0, depth: int = 0, step: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links i < j of a tile of the list of pivot ``own``. chunk: 0 or 1; with both, only pairs across."""
    shared, whole = min(shared, pivots.shape[1]), pivots.shape[1] >= depth  # a dimension may have fewer pivots
    names, at = np.unique(pivots, return_inverse=True)
    has = np.zeros((len(rows), len(names)), np.float32)
    has[np.arange(len(rows))[:, None], at.reshape(pivots.shape)] = 1
    front = np.zeros_like(has)  # small whole numbers: exact in single precision
    front[np.arange(len(rows))[:, None], at.reshape(pivots.shape)] = np.arange(pivots.shape[1], 0, -1)
    below = names < own
    across = len(np.unique(chunk)) > 1
    for a in range(0, len(rows), step):
        part = slice(a, a + step)
        near = (has[part] @ has.T >= shared) & (has[part][:, below] @ has[:, below].T == 0)
        if in_order and whole:
            near &= front[part] @ front.T >= in_order
        near &= np.arange(len(rows))[None, :] > np.arange(len(rows))[part, None]
        if across:
            near &= chunk[None, :] != chunk[part, None]
        i, j = np.nonzero(near)
        for b in range(0, len(i), 1 << 16):
            x, y = i[b : b + (1 << 16)] + a, j[b : b + (1 << 16)]
            ok = np.einsum("ij,ij->i", rows[x], rows[y]) >= cosine
            yield x[ok], y[ok]


def _link(shared: int, cosine: float, in_order: int, depth: int):
    """Rows sorted by list and tile to (node, links, root), one for each vector with links in a tile."""

    def tile(rows: pa.Table) -> pa.RecordBatch:
        vectors = unit(_matrix(rows["vec"].combine_chunks()))
        pivots = _matrix(rows["pivots"].combine_chunks(), "i4")
        chunk, n = rows["chunk"].to_numpy(), rows["n"].to_numpy()
        links = np.zeros(len(n), np.int64)
        pairs = list(tile_links(vectors, pivots, chunk, int(rows["pivot"][0].as_py()), shared, cosine, in_order, depth))
        for i, j in pairs:
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
        root = forest(len(n), iter(pairs))
        some = np.flatnonzero(links)
        node = rows["node"].to_numpy()
        return pa.record_batch([pa.array(node[some]), pa.array(links[some]), pa.array(node[root[some]])], names=["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(key)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                if a == b:
                    continue
                if held and key[a] != last:
                    table = pa.Table.from_batches(held)
                    if table.num_rows > 1:
                        yield tile(table)
                    held = []
                held.append(batch.take(pa.array(np.arange(a, b))))
                last = key[a]
        if held and sum(x.num_rows for x in held) > 1:
            yield tile(pa.Table.from_batches(held))

    return run


def near_duplicates(
    vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.93,
    depth: int = 8, shared: int = 2, in_order: int = 24, per_pivot: int = 32, growth: int = 8, max_pivot_bytes: int = 256 << 20, apart: float = 0.8,
    tile: int = 2048, exact: bool = False,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row. ``max_pivot_bytes`` bounds the sample of reference
    points of a dimension, which is sent to all tasks."""
    spark = vectors.sparkSession
    item = "float" if vectors.schema[vec_col].dataType.elementType.typeName() == "float" else "double"
    vec = F.col(vec_col).cast(f"array<{item}>")  # moved at the width it came in, compared in double precision
    whole = F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists(vec, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), vec.alias("vec"), F.coalesce(whole, F.lit(False)).alias("ok"))
    node = F.when(F.col("ok"), F.xxhash64("label", "vec"))
    rows = rows.withColumn("node", node)
    members = common.materialise(rows.select("id", "node"), "emb-members")
    classes = rows.where("ok").groupBy("node", "label", "vec").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
    classes = common.materialise(classes.withColumn("grp", F.concat_ws("|", F.size("vec").cast("string"), "label")).drop("label"), "emb-classes")
    pivots: dict[int, np.ndarray] = {}
    sizes = classes.groupBy(F.size("vec")).count().collect()  # a row for each dimension
    for d, count in sizes if not exact else ():
        want = int(min(max(16, count // per_pivot), max(2048, growth * math.isqrt(count)), max(16, max_pivot_bytes // (8 * d))))
        chosen = classes.where(F.size("vec") == d).orderBy(F.xxhash64("node"), "node").limit(want).select("vec").collect()
        pivots[d] = spread(unit(np.array([r.vec for r in chosen], np.float64)), apart)
    if not sizes:
        return members.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if exact:
        described = classes.select("node", "grp", "n", "vec", F.array(F.lit(0)).alias("pivots"))
    else:
        described = common.materialise(classes.select("node", "grp", "n", "vec").mapInArrow(common.lean(_describe(spark.sparkContext.broadcast(pivots), depth)), f"node long, grp string, n long, vec array<{item}>, pivots array<int>"), "emb-described")
    lists = F.explode(F.slice(F.array_sort("pivots"), F.lit(1), F.greatest(F.size("pivots") - min(shared, depth) + 1, F.lit(1)))).alias("pivot")
    listed = described.select("node", "grp", lists)
    chunks = listed.groupBy("grp", "pivot").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("chunks")).where("chunks > 1")
    placed = described.select("*", lists).join(chunks, ["grp", "pivot"], "left")
    total = F.coalesce("chunks", F.lit(1))
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("node", F.lit("chunk")), total).cast("int"))
    # the tiles of chunk c are (i, c) and (c, j): in (i, j) with i < j it is 0 as the first and 1 as the second
    tiles = F.transform(F.sequence(F.lit(0), total - 1), lambda o: F.struct(F.least(F.col("mine"), o).alias("i"), F.greatest(F.col("mine"), o).alias("j"), (o < F.col("mine")).cast("int").alias("chunk")))
    keyed = placed.select("node", "n", "vec", "pivots", "pivot", "grp", F.explode(tiles).alias("t")).select("node", "n", "vec", "pivots", "pivot", "t.chunk", F.xxhash64("grp", "pivot", "t.i", "t.j").alias("key"))
    found = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(common.lean(_link(shared, cosine, in_order, depth)), "node long, links long, root long")
    found = common.materialise(found, "emb-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    of = classes.select("node", "n", "low").join(links, "node", "left").join(roots, "node", "left")
    of = of.select("node", "low", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("root"))
    lows = of.groupBy("root").agg(F.min("low").alias("component_id"))
    of = of.join(lows, "root").select("node", "n_links", "component_id")
    out = members.join(of, "node", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()))
