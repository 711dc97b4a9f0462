"""Event logs: folding to the last state, expiry, and the same fold as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import now_column


def fold(events: DataFrame, *, key: str, at: str, seq: str, kind: str) -> DataFrame:
    """(key, status, at, n_events): the last event of each key by time, then sequence."""
    return events.groupBy(key).agg(F.max_by(kind, F.struct(at, seq)).alias("status"), F.max(at).alias("last_at"), F.count(F.lit(1)).alias("n_events"))


def expire(state: DataFrame, *, now: str, days: int = 21, open_status: str = "queued") -> DataFrame:
    """States still open ``days`` after their last event are expired by the clock."""
    old = F.col("last_at") + F.expr(f"INTERVAL {days} DAYS") <= now_column(now)
    return state.withColumn("status", F.when((F.col("status") == open_status) & old, "expired").otherwise(F.col("status")))


def count_on_day(events: DataFrame, *, day: str, at: str, where: Column) -> DataFrame:
    """One row ``n``: the events of a calendar day, in the session's time zone, that a predicate holds for."""
    return events.where(where & (F.to_date(at) == F.lit(day).cast("date"))).agg(F.count(F.lit(1)).alias("n"))


def capped_ids(rows: DataFrame, *, by: str, id_col: str = "id", cap: int = 20, salts: int = 64) -> DataFrame:
    """(by, n, n_ids, ids, truncated): rows and distinct ids of each group, and its ``cap`` smallest ids.

    The ids are cut within ``salts`` parts of a group first, so that no task sorts a whole group. Null groups are a
    group; null ids count as rows only. No rows give no groups.
    """
    part = F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts))
    each = rows.groupBy(by, id_col).agg(F.count(F.lit(1)).alias("n")).withColumn("_part", part)
    found = F.col(id_col).isNotNull()
    placed = each.withColumn("_place", F.row_number().over(Window.partitionBy(by, "_part").orderBy(F.col(id_col).asc_nulls_last())))
    first = F.array_sort(F.collect_list(F.when(found & (F.col("_place") <= cap), F.col(id_col))))
    groups = placed.groupBy(by).agg(F.sum("n").alias("n"), F.count(F.when(found, 1)).alias("n_ids"), F.slice(first, 1, cap).alias("ids"))
    return groups.withColumn("truncated", F.col("n_ids") > cap)


def fold_stream(events: DataFrame, sink, *, key: str, at: str, seq: str, kind: str, checkpoint: str):
    """The fold as a stream: each micro-batch is folded and handed to ``sink(df, epoch)``, which merges it
    by (key, last event). Late events lose against newer ones, as in the batch fold."""

    def batch(df: DataFrame, epoch: int) -> None:
        last = df.groupBy(key).agg(F.max(F.struct(at, seq, kind)).alias("last"), F.count(F.lit(1)).alias("n_events"))
        sink(last.select(key, "last.*", "n_events"), epoch)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def merge_states(old: DataFrame, new: DataFrame, *, key: str, at: str, seq: str, kind: str) -> DataFrame:
    """Of two folded states the newer event of each key, counts added."""
    both = old.unionByName(new)
    last = both.groupBy(key).agg(F.max(F.struct(at, seq, kind)).alias("last"), F.sum("n_events").alias("n_events"))
    return last.select(key, "last.*", "n_events")
