"""Reconciliation of points with their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reconcile
from ..session import table
from .common import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

#: What the sources hold now: some texts changed, some gone, some added.
WANTED = """old AS (SELECT doc_id AS id, md5(coalesce(text, '')) AS digest FROM documents),
wanted AS (SELECT doc_id AS id, md5(coalesce(text, '') || CASE WHEN doc_id % 11 = 3 THEN '!' ELSE '' END) AS digest FROM documents WHERE doc_id % 19 <> 0 UNION ALL SELECT doc_id + 1000000000, md5('new ' || doc_id) FROM documents WHERE doc_id % 37 = 0)"""


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    old = docs.select(F.col("doc_id").alias("id"), F.md5(text.cast("binary")).alias("digest"))
    wanted = docs.where("doc_id % 19 != 0").select(F.col("doc_id").alias("id"), F.md5(F.concat(text, F.when(F.col("doc_id") % 11 == 3, "!").otherwise("")).cast("binary")).alias("digest"))
    fresh = docs.where("doc_id % 37 = 0").select((F.col("doc_id") + 1_000_000_000).alias("id"), F.md5(F.concat(F.lit("new "), F.col("doc_id").cast("string")).cast("binary")).alias("digest"))
    return old, wanted.unionByName(fresh)


@R.add(f"""WITH {WANTED} SELECT coalesce(o.id, w.id) AS id, CASE WHEN o.id IS NULL THEN 'new' WHEN w.id IS NULL THEN 'retired' ELSE 'changed' END AS action, w.digest FROM old o FULL JOIN wanted w ON o.id = w.id WHERE o.digest IS DISTINCT FROM w.digest""")
def reconcile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.plan(*_tables(spark, sf_dir))[0]


@R.add(f"""WITH {WANTED} SELECT coalesce(o.id, w.id) AS id, coalesce(w.digest, o.digest) AS digest, CASE WHEN w.id IS NULL THEN 'superseded' ELSE 'active' END AS status FROM old o FULL JOIN wanted w ON o.id = w.id""")
def reconcile_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan carried out, then again: the second time changes nothing."""
    old, wanted = _tables(spark, sf_dir)
    planned, snapshot, own = reconcile.plan(old, wanted)
    once = reconcile.apply(old.withColumn("status", F.lit("active")), planned, snapshot=snapshot, plan_digest=own, applied=set())
    return reconcile.apply(once, planned, snapshot=snapshot, plan_digest=own, applied={own})
