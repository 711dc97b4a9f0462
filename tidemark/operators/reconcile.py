"""Reconciling a table of points with what it should hold: a plan by digests of ranges, and an apply that can be repeated.

Ids are dealt into a fixed number of ranges by hash. A range has a digest that doesn't depend on the order of its rows, so the tree
of digests is one aggregation with map-side combine, and ranges that agree are left out before anything is joined. Tables that are
partitioned by ``range`` are read only where ranges differ: the filter names them, a list of ``RANGES`` numbers at most.

Null ids are no points. A repeated id counts as a difference of its range and is planned once, by its largest digest. Empty tables have an
empty tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGES = 4096


def in_range(id_col: Column, ranges: int = RANGES) -> Column:
    return F.pmod(F.xxhash64(id_col.cast("string")), F.lit(ranges)).cast("int")


def digest_tree(rows: DataFrame, ranges: int = RANGES) -> DataFrame:
    """rows: (id, digest, and ``range`` if they are stored by it). (range, n, digest) of each range that has rows."""
    where = F.col("range") if "range" in rows.columns else in_range(F.col("id"), ranges)
    mixed = F.xxhash64(F.col("id").cast("string"), F.coalesce("digest", F.lit(""))).cast("decimal(38,0)")
    found = rows.where("id IS NOT NULL").select(where.alias("range"), mixed.alias("h")).groupBy("range")
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum("h").cast("string").alias("digest"))


def root(tree: DataFrame) -> str:
    """One digest of a whole tree."""
    row = tree.agg(F.sum(F.xxhash64("range", "n", "digest").cast("decimal(38,0)")).cast("string").alias("h"), F.sum("n").alias("n")).first()
    return f"{row.n or 0}:{row.h or 0}"


def differing(a: DataFrame, b: DataFrame) -> list[int]:
    """Numbers of the ranges whose digests differ; as many as there are ranges at most."""
    both = a.alias("a").join(b.alias("b"), "range", "full_outer")
    return sorted(r.range for r in both.where("NOT (a.digest <=> b.digest AND a.n <=> b.n)").select("range").collect())


def plan(existing: DataFrame, desired: DataFrame, ranges: int = RANGES) -> tuple[DataFrame, str, str]:
    """(id, action, digest) for every id that is new, changed or retired; then the digest of what exists, for which alone the plan is valid, and the
    plan's own digest. Both tables: (id, digest)."""
    now, then = digest_tree(existing, ranges), digest_tree(desired, ranges)
    open_ones = differing(now, then)

    def part(rows: DataFrame, name: str) -> DataFrame:
        where = F.col("range") if "range" in rows.columns else in_range(F.col("id"), ranges)
        return rows.where(F.col("id").isNotNull() & where.isin(open_ones)).groupBy("id").agg(F.max(F.coalesce("digest", F.lit(""))).alias(name))

    both = part(existing, "old").join(part(desired, "new"), "id", "full_outer")
    action = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "retired").when(F.col("old") != F.col("new"), "changed")
    planned = both.withColumn("action", action).where("action IS NOT NULL").select("id", "action", F.col("new").alias("digest"))
    own = planned.agg(F.sum(F.xxhash64(F.col("id").cast("string"), "action", "digest").cast("decimal(38,0)")).cast("string").alias("h"), F.count(F.lit(1)).alias("n")).first()
    return planned, root(now), f"{own.n}:{own.h or 0}"


def apply(existing: DataFrame, planned: DataFrame, *, snapshot: str, plan_digest: str, applied: set[str], gone: bool = False, ranges: int = RANGES) -> DataFrame:
    """What exists after the plan: (id, digest, status). Retired points stay, ``superseded`` (``stale`` where their source is gone); changed ones have
    the new digest; new ones are active. A plan in ``applied`` changes nothing; one that was made for something else than ``existing`` is refused."""
    if plan_digest in applied:
        return existing
    live = existing.where("status = 'active'")
    if root(digest_tree(live, ranges)) != snapshot:
        raise ValueError("the points have changed since the plan was made")
    step = planned.select("id", "action", F.col("digest").alias("new"))
    hit = F.col("status") == "active"
    status = F.when(hit & (F.col("action") == "retired"), "stale" if gone else "superseded").otherwise(F.col("status"))
    digest = F.when(hit & (F.col("action") == "changed"), F.col("new")).otherwise(F.col("digest"))
    kept = existing.join(step.where("action != 'new'"), "id", "left").select("id", digest.alias("digest"), status.alias("status"))
    return kept.unionByName(step.where("action = 'new'").select("id", F.col("new").alias("digest"), F.lit("active").alias("status")))
