"""Point tables: paged scans, keyed writes, manifests, backups. A write returns the new table's rows; the
caller chooses where they go (``df.write``), so that a write is one atomic job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page(points: DataFrame, after, limit: int) -> DataFrame:
    """The next ``limit`` rows in id order; ``after`` None: from the start."""
    rows = points if after is None else points.where(F.col("id") > after)
    return rows.orderBy("id").limit(limit)


def window_scan(points: DataFrame, start, limit: int) -> tuple[DataFrame, object]:
    """Rows from ``start`` on (a lower bound, so a deleted cursor resumes at the next id) and the next start."""
    rows = points if start is None else points.where(F.col("id") >= start)
    ahead = [r.id for r in rows.select("id").orderBy("id").limit(limit + 1).collect()]  # limit + 1 ids
    following = ahead[limit] if len(ahead) > limit else None
    return rows.orderBy("id").limit(limit), following


def bounded(points: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """At most ``limit`` rows, and whether that is all of them."""
    return points.orderBy("id").limit(limit), points.limit(limit + 1).count() <= limit


def lookup(points: DataFrame, ids: DataFrame) -> DataFrame:
    return points.join(ids.select("id").distinct(), "id", "left_semi")


def upsert(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert or replace by id; of changes with one id the last by all columns counts."""
    last = changes.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(*[F.desc(c) for c in changes.columns if c != "id"]))).where("_n = 1").drop("_n")
    return current.join(last.select("id"), "id", "left_anti").unionByName(last)


def merge_payload(current: DataFrame, patch: DataFrame) -> DataFrame:
    """Shallow merge of the patch's non-null columns into rows of the same id."""
    names = [c for c in patch.columns if c != "id"]
    renamed = patch.select("id", *[F.col(c).alias(f"_{c}") for c in names])
    joined = current.join(renamed, "id", "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in names else F.col(c) for c in current.columns])


def delete(current: DataFrame, ids: DataFrame) -> DataFrame:
    return current.join(ids.select("id"), "id", "left_anti")


def delete_where(current: DataFrame, condition) -> DataFrame:
    """Without the rows that a filter matches; rows for which it is null stay."""
    return current.where(~F.coalesce(condition, F.lit(False)))


def merged(own: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """Own and read-only collections with a ``collection`` column; the own one is ``own`` and comes first."""
    out = own.withColumn("collection", F.lit("own"))
    for name, df in others.items():
        out = out.unionByName(df.withColumn("collection", F.lit(name)), allowMissingColumns=True)
    return out


def manifest_diff(existing: DataFrame, desired: DataFrame) -> DataFrame:
    """(id, change): stale ids to delete, new ids to write."""
    stale = existing.select("id").join(desired.select("id"), "id", "left_anti").withColumn("change", F.lit("stale"))
    return stale.unionByName(desired.select("id").join(existing.select("id"), "id", "left_anti").withColumn("change", F.lit("new")))


def row_digest(df: DataFrame) -> DataFrame:
    """Adds point_sha256 over the row as JSON, columns in order of their names."""
    body = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return df.withColumn("point_sha256", F.sha2(body.cast("binary"), 256))


def restore_plan(backup: DataFrame, current: DataFrame) -> DataFrame:
    """(id, action): same, changed or missing, by digest; points that the backup lacks are untouched."""
    now = current.select("id", F.col("point_sha256").alias("now"))
    joined = backup.select("id", "point_sha256").join(now, "id", "left")
    return joined.select("id", F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("point_sha256"), "same").otherwise("changed").alias("action"))


def verify_backup(backup: DataFrame) -> DataFrame:
    """Rows whose digest does not fit them."""
    fresh = row_digest(backup.drop("point_sha256")).withColumnRenamed("point_sha256", "_fresh").select("id", "_fresh")
    return backup.join(fresh, "id").where(F.col("point_sha256") != F.col("_fresh")).drop("_fresh")


def retention(backups: DataFrame, keep_last: int = 7) -> DataFrame:
    """Backups to prune: (backup_id, created_at, referenced), all but the newest and those referenced."""
    n = F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("backup_id")))
    return backups.withColumn("n", n).where((F.col("n") > keep_last) & ~F.col("referenced")).drop("n")
