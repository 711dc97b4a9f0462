"""Backups as files, and restores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import points
from ..session import shared_folder, table
from ..sources import backup
from .common import POINTS, Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


@R.add()
def backup_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points with their vectors exported to a new folder and read back from it."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    rows = points(spark, sf_dir).join(vectors, "id", "left")
    size = vectors.select(F.size("embedding").alias("n")).where("n > 0").first()
    path = backup.export(rows, f"{shared_folder(spark)}/tidemark-backups", backup_id=f"backup-{uuid.uuid4().hex}", created_at="2024-03-01T00:00:00Z", vector="embedding", vector_size=size.n if size else None)
    back = backup.load(spark, path)
    dims = F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("n_dims")
    return back.select("id", "source", F.unix_micros("created_at").alias("created_us"), F.md5(F.col("text").cast("binary")).alias("text_md5"), dims, "point_sha256")


CURRENT = f"""WITH {POINTS}, rows AS (SELECT id, source, importance, CASE WHEN id % 5 = 0 THEN 'session ' || id % 3 END AS origin FROM points),
now AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'edited' ELSE source END AS source, importance, CASE WHEN id % 7 = 0 THEN 'live' ELSE origin END AS origin FROM rows WHERE id % 9 <> 0
UNION ALL SELECT id + 1000000000, source, importance, origin FROM rows WHERE id % 50 = 0)"""


def _backup_and_current(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    session = F.concat(F.lit("session "), (F.col("id") % 3).cast("string"))
    rows = points(spark, sf_dir).select("id", "source", "importance", F.when(F.col("id") % 5 == 0, session).alias("origin"))
    edited = F.when(F.col("id") % 4 == 0, "edited").otherwise(F.col("source"))
    now = rows.where("id % 9 != 0").select("id", edited.alias("source"), "importance", F.when(F.col("id") % 7 == 0, "live").otherwise(F.col("origin")).alias("origin"))
    later = rows.where("id % 50 = 0").withColumn("id", F.col("id") + 1_000_000_000)
    return rows.withColumn("point_sha256", backup.digest(rows)), now.unionByName(later)


@R.add(f"""{CURRENT} SELECT r.id, CASE WHEN n.id IS NULL THEN 'missing' WHEN r.source IS NOT DISTINCT FROM n.source AND r.origin IS NOT DISTINCT FROM n.origin THEN 'same' WHEN n.importance = 10 THEN 'refused' ELSE 'changed' END AS action
FROM rows r LEFT JOIN now n ON r.id = n.id""")
def restore_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backup.outcomes(*_backup_and_current(spark, sf_dir), protected=F.col("importance") == 10)


@R.add(f"""{CURRENT} SELECT coalesce(n.id, r.id) AS id, CASE WHEN r.id IS NULL THEN n.source ELSE r.source END AS source, coalesce(n.importance, r.importance) AS importance, coalesce(n.origin, r.origin) AS origin FROM rows r FULL JOIN now n ON r.id = n.id""")
def restore_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restored, then restored again."""
    stored, now = _backup_and_current(spark, sf_dir)
    shared_folder(spark)
    once = backup.restore(stored, now, live=("origin",)).checkpoint()
    return backup.restore(stored, once, live=("origin",))
