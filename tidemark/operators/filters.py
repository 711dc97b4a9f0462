"""Filter builders: predicates of a read, applied before any limit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match(name: str, values) -> Column:
    """Nothing given: no condition. One value: equality. Several: membership."""
    values = [values] if isinstance(values, (str, int, float, bool)) else list(values or [])
    if not values:
        return F.lit(True)
    return F.col(name) == values[0] if len(values) == 1 else F.col(name).isin(*values)


def tristate(name: str, value: bool | None) -> Column:
    """True: must be true. False: must not be true, so null passes. None: no condition."""
    if value is None:
        return F.lit(True)
    flag = F.coalesce(F.col(name), F.lit(False))
    return flag if value else ~flag


def tags_all(name: str, tags: str) -> Column:
    """Comma-separated tags, all of which must be there."""
    wanted = [t.strip() for t in tags.split(",") if t.strip()]
    return reduce(lambda a, b: a & b, [F.array_contains(name, t) for t in wanted], F.lit(True))


def between(name: str, since: str | None = None, until: str | None = None) -> Column:
    out = F.lit(True)
    if since:
        out = out & (F.col(name) >= F.lit(since).cast("timestamp"))
    if until:
        out = out & (F.col(name) <= F.lit(until).cast("timestamp"))
    return out


def floors(score: str, raw: str, final_floor: float, raw_floor: float) -> Column:
    """Final floor always; raw floor only where there is a raw score (0 means found by exact signals only)."""
    return (F.col(score) >= final_floor) & ((F.col(raw) == 0) | (F.col(raw) >= raw_floor))


def demote_unsafe(items: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Rows in two sections: ``results``, and ``warnings`` for flags or statuses that are unsafe to quote."""
    unsafe = F.coalesce(F.col("stale"), F.lit(False)) | F.coalesce(F.col("requires_review"), F.lit(False)) | F.coalesce(F.col("fact_status").isin(*statuses), F.lit(False))
    return items.withColumn("section", F.when(unsafe, "warnings").otherwise("results"))


def keep_matches_or_all(items: DataFrame, flag: str) -> DataFrame:
    """Rows with the flag; if no row has it, all rows."""
    some = items.agg(F.max(F.col(flag).cast("int")).alias("_any"))
    return items.crossJoin(F.broadcast(some)).where(F.col(flag) | (F.coalesce("_any", F.lit(0)) == 0)).drop("_any")
