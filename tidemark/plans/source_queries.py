"""Scans, keyed writes, manifests, backups, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import points, scoped, visible
from ..session import table
from ..sources import files, tables
from .common import POINTS, VISIBLE, Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


def _ids(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    return points(spark, sf_dir).where(where).select("id", "source", "importance")


@R.add(f"WITH {POINTS}, {VISIBLE} SELECT id FROM visible WHERE id > 100 ORDER BY id LIMIT 50")
def scan_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.page(visible(points(spark, sf_dir)).select("id"), 100, 50)


@R.add(f"WITH {POINTS}, {VISIBLE}, w AS (SELECT id FROM visible WHERE id >= 100 ORDER BY id LIMIT 50) SELECT id, (SELECT min(id) FROM visible WHERE id > (SELECT max(id) FROM w)) AS following FROM w")
def rotating_scan_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, following = tables.window_scan(visible(points(spark, sf_dir)).select("id"), 100, 50)
    return rows.withColumn("following", F.lit(following).cast("long"))


@R.add(f"WITH {POINTS} SELECT id, false AS whole FROM points ORDER BY id LIMIT 25")
def bounded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, whole = tables.bounded(points(spark, sf_dir).select("id"), 25)
    return rows.withColumn("whole", F.lit(whole))


@R.add(f"WITH {POINTS} SELECT id, source FROM points WHERE id IN (3, 14, 15, 92, 65)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame([(3,), (14,), (15,), (92,), (65,)], "id long")
    return tables.lookup(points(spark, sf_dir), ids).select("id", "source")


@R.add(f"WITH {POINTS}, {VISIBLE} SELECT profile_id, count(*) AS n FROM visible GROUP BY profile_id")
def count_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible(points(spark, sf_dir)).groupBy("profile_id").agg(F.count(F.lit(1)).alias("n"))


@R.add(f"WITH {POINTS} SELECT id, CASE WHEN id % 10 = 4 THEN 'patched' ELSE source END AS source, importance FROM points")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = _ids(spark, sf_dir, "id % 20 != 4")
    return tables.upsert(current, _ids(spark, sf_dir, "id % 10 = 4").withColumn("source", F.lit("patched")))


@R.add(f"WITH {POINTS} SELECT id, source, CASE WHEN id % 3 = 0 THEN 10 ELSE importance END AS importance FROM points")
def payload_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ids(spark, sf_dir, "true")
    return tables.merge_payload(rows, rows.where("id % 3 = 0").select("id", F.lit(10).alias("importance"), F.lit(None).cast("string").alias("source")))


@R.add(f"WITH {POINTS} SELECT id FROM points WHERE id % 4 <> 0")
def delete_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ids(spark, sf_dir, "true").select("id")
    return tables.delete(rows, rows.where("id % 4 = 0"))


@R.add("SELECT 'own' AS collection, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages")
def multi_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return tables.merged(own, {"pages": table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"))}).groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


@R.add("SELECT doc_id AS id, 'stale' AS change FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id % 7 = 0 AND doc_id % 5 = 0")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    desired = ids.where("id % 5 != 0").unionByName(ids.where("id % 7 = 0 and id % 5 = 0").select((F.col("id") + 1_000_000).alias("id")))
    return tables.manifest_diff(ids, desired).select(F.when(F.col("change") == "new", F.col("id") - 1_000_000).otherwise(F.col("id")).alias("id"), "change")


@R.add(f"WITH {POINTS} SELECT CASE WHEN id % 9 = 0 THEN 'missing' WHEN id % 4 = 0 THEN 'changed' ELSE 'same' END AS action, count(*) AS n FROM points GROUP BY 1")
def restore_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ids(spark, sf_dir, "true")
    current = rows.where("id % 9 != 0").withColumn("source", F.when(F.col("id") % 4 == 0, "edited").otherwise(F.col("source")))
    return tables.restore_plan(tables.row_digest(rows), tables.row_digest(current)).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@R.add(f"WITH {POINTS} SELECT id FROM points WHERE id % 30 = 7")
def backup_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = tables.row_digest(_ids(spark, sf_dir, "true"))
    damaged = kept.withColumn("importance", F.when(F.col("id") % 30 == 7, F.col("importance") + 1).otherwise(F.col("importance")))
    return tables.verify_backup(damaged).select("id")


@R.add("SELECT DISTINCT conv_id AS backup_id FROM conversations WHERE conv_id % 6 <> 0 AND conv_id NOT IN (SELECT DISTINCT conv_id FROM conversations ORDER BY conv_id DESC LIMIT 7)")
def backup_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    backups = rows.select(F.col("conv_id").alias("backup_id"), F.timestamp_seconds(F.col("conv_id")).alias("created_at"), (F.col("conv_id") % 6 == 0).alias("referenced"))
    return tables.retention(backups).select("backup_id")


@R.add(f"WITH {POINTS} SELECT id, profile_id FROM points WHERE profile_id = 'fr' AND source = 'src4' AND id NOT IN (SELECT doc_id FROM labels)")
def scope_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return scoped(points(spark, sf_dir), profile_id="fr", source="src4").join(labelled, "id", "left_anti").select("id", "profile_id")


@R.add("SELECT page_id AS id, CASE WHEN page_id % 5 = 0 THEN 'missing' WHEN page_id % 5 = 1 THEN 'exists' WHEN page_id % 5 = 2 THEN 'changed' ELSE 'current' END AS freshness FROM pages")
def source_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))
    key = F.concat(F.lit("page/"), F.col("page_id").cast("string"))
    stored = pages.select(F.col("page_id").alias("id"), key.alias("source_uri"), F.when(F.col("page_id") % 5 == 2, F.lit("old")).when(F.col("page_id") % 5 != 1, F.col("sha256")).alias("content_hash"))
    return files.freshness(stored, pages.where("page_id % 5 != 0").select(key.alias("path"), "sha256"))


@R.add()
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.regexp_replace("text", r"\n", "\n\n").alias("text"))
    return files.chunks(docs).select("path", "chunk_index", F.length("text").alias("n_chars"), "chunk_hash")
