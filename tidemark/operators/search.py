"""Filtered similarity search with rescoring, and what is done to ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, vector
from ..schema import now_column


def literal_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def dense_topk(points: DataFrame, query: Column, k: int, *, vec: str = "embedding") -> DataFrame:
    """The k points most similar to ``query``, ties by id: one pass, k rows of a task meet."""
    return points.withColumn("similarity", vector.cosine(F.col(vec), query)).orderBy(F.desc("similarity"), "id").limit(k)


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """1-based rank of a bounded list (a top-k result)."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def memory_search(pool: DataFrame, *, now: str, top_k: int = 10, decay: float = 0.001, history: bool = False, sparse: Column | None = None, sparse_lift: float = 0.25, floor: float = 0.0, **exact: str) -> DataFrame:
    """Rescore a dense pool (k rows with ``similarity``): min-max over the pool, times importance and
    recency, plus the lifted sparse score, times provenance. top_k is clamped to 1..20."""
    fresh = scoring.recency(F.col("created_at"), now_column(now), decay)
    scored = pool.withColumn("normalised", scoring.minmax(F.col("similarity")))
    base = scoring.final_score(F.col("normalised"), F.col("importance"), fresh)
    if sparse is not None:
        base = base + sparse_lift * sparse
    scored = scored.withColumn("score", base * scoring.provenance_factor(history=history, **exact))
    if floor > 0:
        scored = scored.where(F.col("score") >= floor)
    order = (F.desc("score"), F.desc("similarity"), F.asc("id"))
    return ranked(scored.orderBy(*order).limit(max(1, min(top_k, 20))), *order)


def learning_search(pool: DataFrame, *, now: str, top_k: int = 10, decay: float = 0.001, raw_floor: float = 0.0) -> DataFrame:
    """As :func:`memory_search` without provenance; a missing importance is 7, the raw floor always holds."""
    fresh = scoring.recency(F.col("created_at"), now_column(now), decay)
    scored = pool.withColumn("normalised", scoring.minmax(F.col("similarity"))).where(F.col("similarity") >= raw_floor)
    scored = scored.withColumn("score", scoring.final_score(F.col("normalised"), F.coalesce("importance", F.lit(7)), fresh))
    order = (F.desc("score"), F.desc("similarity"), F.asc("id"))
    return ranked(scored.orderBy(*order).limit(max(1, min(top_k, 20))), *order)


def rrf(lists: DataFrame, k: float = 60.0) -> DataFrame:
    """Reciprocal rank fusion of (list, rank, id): sum of 1 / (k + rank); ties by first appearance."""
    fused = lists.groupBy("id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("fused"), F.min(F.struct("list", "rank")).alias("first"))
    return ranked(fused, F.desc("fused"), F.asc("first"), F.asc("id")).drop("first")


def first_wins(items: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row for each key, the first in ``order``; rows without a key are dropped."""
    kept = items.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def interleave(lists: DataFrame, top_k: int) -> DataFrame:
    """The first of each list, then the second, and so on; repeated ids are left out."""
    once = first_wins(lists, "id", F.asc("rank"), F.asc("list"))
    return ranked(once.orderBy("rank", "list").limit(top_k), F.asc("rank"), F.asc("list"), name="position")


def lane_topk(items: DataFrame, lanes: list[str], k: int) -> DataFrame:
    """The first k of each lane, lanes in fixed order, repeated ids left out."""
    place = F.array_position(F.array(*[F.lit(x) for x in lanes]), F.col("lane"))
    kept = items.withColumn("lane_no", place).where("lane_no > 0").withColumn("n", F.row_number().over(Window.partitionBy("lane").orderBy("rank"))).where(F.col("n") <= k)
    return first_wins(kept, "id", F.asc("lane_no"), F.asc("n")).drop("n")


def budget_prefix(items: DataFrame, limit: int, *, group: str, order: str, size: str) -> DataFrame:
    """Items in order until ``limit`` characters are used; the last one is cut to what is left."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    used = items.withColumn("used", F.coalesce(F.sum(size).over(before), F.lit(0)))
    return used.where(F.col("used") < limit).withColumn("kept_chars", F.least(F.col(size), limit - F.col("used")))


def budget_greedy(items: DataFrame, limit: int, *, group: str, order: str, size: str, id_col: str, cap: int = 512) -> DataFrame:
    """Greedy skip packing: an item that would overflow is left out, later smaller ones may still fit.
    A group is a packet of ``cap`` items at most (checked): the fold runs over its array in the JVM."""
    lists = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, F.col(size).cast("long").alias("size"), F.col(id_col).alias("item")))).alias("items"))
    lists = lists.withColumn("items", F.when(F.size("items") > cap, F.raise_error(F.lit("more items than a packet may have"))).otherwise(F.col("items")))
    item = lists.schema["items"].dataType.elementType["item"].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{item}>").alias("kept"))

    def step(state: Column, x: Column) -> Column:
        fits = state["used"] + x["size"] <= limit
        return F.struct(F.when(fits, state["used"] + x["size"]).otherwise(state["used"]).alias("used"), F.when(fits, F.concat(state["kept"], F.array(x["item"]))).otherwise(state["kept"]).alias("kept"))

    packed = lists.withColumn("p", F.aggregate("items", start, step))
    return packed.select(group, F.col("p.used").alias("used"), F.explode("p.kept").alias(id_col))


def even_share(items: DataFrame, limit: int, *, group: str, order: str, size: str) -> DataFrame:
    """Each item in order may use what is left divided by the items left."""
    rows = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("size")))).alias("items"))
    start = F.struct(F.lit(limit).cast("long").alias("left"), F.size("items").cast("long").alias("n"), F.array().cast("array<long>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        take = F.least(x["size"], F.floor(s["left"] / s["n"]).cast("long"))
        return F.struct((s["left"] - take).alias("left"), (s["n"] - 1).alias("n"), F.concat(s["kept"], F.array(take)).alias("kept"))

    packed = rows.withColumn("kept", F.aggregate("items", start, step, lambda s: s["kept"]))
    return packed.select(group, F.posexplode(F.arrays_zip("items", "kept")).alias("pos", "z")).select(group, F.col("z.items.o").alias(order), F.col("z.kept").alias("kept_chars"))
