"""Plans of invalidation over what orders and their lines depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import invalidation
from ..session import shared_folder, table
from .common import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

DEPTH, MAX_POINTS, MAX_EDGES = 2, 400, 350

# Lines of some orders are no points; each nation, some customers (with their even orders) and some orders change.
PLAN = f"""WITH RECURSIVE edges AS (SELECT DISTINCT * FROM (SELECT 'c' || c_custkey AS dependent, 'n' || c_nationkey AS source FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders
UNION ALL SELECT 'l' || l_orderkey || '-' || l_linenumber, 'o' || l_orderkey FROM lineitem) WHERE dependent IS NOT NULL AND source IS NOT NULL),
points AS (SELECT 'c' || c_custkey AS id, NULL AS fact_status, CAST([] AS VARCHAR[]) AS causes FROM customer UNION ALL SELECT 'o' || o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'disputed' END, CASE WHEN o_orderkey % 3 = 0 THEN ['cust-' || o_custkey] ELSE [] END FROM orders
UNION ALL SELECT 'l' || l_orderkey || '-' || l_linenumber, CASE l_returnflag WHEN 'R' THEN 'stale' WHEN 'A' THEN '' ELSE 'active' END, CASE WHEN l_linenumber = 1 THEN list_transform(range(1, 33), lambda i: 'x' || i) ELSE [] END FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) WHERE l_orderkey % 50 <> 7),
roots AS (SELECT 'nation-' || n_nationkey AS event, 'n' || n_nationkey AS id FROM nation UNION ALL SELECT 'cust-' || c_custkey, 'c' || c_custkey FROM customer WHERE c_custkey % 10 = 0
UNION ALL SELECT 'cust-' || o_custkey, 'o' || o_orderkey FROM orders WHERE o_custkey % 10 = 0 AND o_orderkey % 2 = 0 UNION ALL SELECT 'order-' || o_orderkey, 'o' || o_orderkey FROM orders WHERE o_orderkey % 20 = 7),
walk AS (SELECT event, id, 0 AS d FROM roots UNION SELECT w.event, e.dependent, w.d + 1 FROM walk w JOIN edges e ON e.source = w.id WHERE w.d <= {DEPTH}),
dist AS (SELECT event, id, min(d) AS d FROM walk GROUP BY 1, 2), lv AS (SELECT t.event, t.d, count(*) AS n FROM dist t JOIN edges e ON e.source = t.id WHERE t.d <= {DEPTH} GROUP BY 1, 2),
un AS (SELECT event, d - 1 AS d, count(*) AS unseen, count(*) FILTER (WHERE id NOT IN (SELECT id FROM points)) AS missing FROM dist WHERE d > 0 GROUP BY 1, 2),
b AS (SELECT lv.event, lv.d, lv.n, coalesce(unseen, 0) AS unseen, coalesce(missing, 0) AS missing FROM lv LEFT JOIN un ON un.event = lv.event AND un.d = lv.d),
s AS (SELECT *, coalesce(sum(unseen) OVER w, 0) AS before, coalesce(sum(n) OVER w, 0) AS edges_before FROM b WINDOW w AS (PARTITION BY event ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j AS (SELECT *, CASE WHEN n > {MAX_POINTS} - before THEN 'points' WHEN missing > 0 THEN 'missing' WHEN edges_before + n > {MAX_EDGES} THEN 'edges' WHEN d = {DEPTH} AND unseen > 0 THEN 'depth' END AS error FROM s),
bad AS (SELECT * FROM j WHERE error IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event ORDER BY d) = 1),
status AS (SELECT r.event, bad.error IS NULL AS complete, bad.error, CAST(coalesce(bad.before, t.points, 0) AS BIGINT) AS points, CAST(coalesce(bad.edges_before + CASE WHEN bad.error = 'depth' THEN bad.n ELSE 0 END, t.edges, 0) AS BIGINT) AS edges
FROM (SELECT DISTINCT event FROM roots) r LEFT JOIN bad ON bad.event = r.event LEFT JOIN (SELECT event, sum(unseen) AS points, sum(n) AS edges FROM j GROUP BY 1) t ON t.event = r.event),
reach AS (SELECT event, id, id AS root, 0 AS d FROM roots UNION SELECT w.event, e.dependent, w.root, w.d + 1 FROM reach w JOIN edges e ON e.source = w.id JOIN dist t ON t.event = w.event AND t.id = e.dependent AND t.d = w.d + 1 JOIN status st ON st.event = w.event AND st.complete)"""


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    name = lambda letter, *c: F.concat(F.lit(letter), F.concat_ws("-", *[F.col(x).cast("string") for x in c]))
    shared_folder(spark)
    nations, customers, orders, lines = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders", "lineitem"))
    lines = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag")).checkpoint()  # keys repeat there; edges and points are made of them
    c, o, line = name("c", "c_custkey"), name("o", "o_orderkey"), name("l", "l_orderkey", "l_linenumber")
    edges = customers.select(c.alias("dependent"), name("n", "c_nationkey").alias("source")).unionByName(orders.select(o.alias("dependent"), name("c", "o_custkey").alias("source"))).unionByName(lines.select(line.alias("dependent"), name("o", "l_orderkey").alias("source")))
    none = F.array().cast("array<string>")
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "disputed")
    flag = F.when(F.col("l_returnflag") == "R", "stale").when(F.col("l_returnflag") == "A", "").otherwise("active")
    many = F.array(*[F.lit(f"x{i}") for i in range(1, 33)])
    points = customers.select(c.alias("id"), F.lit(None).cast("string").alias("fact_status"), none.alias("causes")).unionByName(
        orders.select(o.alias("id"), status.alias("fact_status"), F.when(F.col("o_orderkey") % 3 == 0, F.array(name("cust-", "o_custkey"))).otherwise(none).alias("causes"))
    ).unionByName(lines.where("l_orderkey % 50 != 7").select(line.alias("id"), flag.alias("fact_status"), F.when(F.col("l_linenumber") == 1, many).otherwise(none).alias("causes")))
    roots = nations.select(name("nation-", "n_nationkey").alias("event"), name("n", "n_nationkey").alias("id")).unionByName(customers.where("c_custkey % 10 = 0").select(name("cust-", "c_custkey").alias("event"), c.alias("id")))
    roots = roots.unionByName(orders.where("o_custkey % 10 = 0 AND o_orderkey % 2 = 0").select(name("cust-", "o_custkey").alias("event"), o.alias("id"))).unionByName(orders.where("o_orderkey % 20 = 7").select(name("order-", "o_orderkey").alias("event"), o.alias("id")))
    return roots, edges, points


@R.add(f"{PLAN} SELECT * FROM status")
def invalidation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalidation.plan(*_tables(spark, sf_dir), depth=DEPTH, max_points=MAX_POINTS, max_edges=MAX_EDGES)[0]


@R.add(f"""{PLAN}, g AS (SELECT event, id, CAST(min(d) AS INTEGER) AS depth, string_agg(DISTINCT root, ',' ORDER BY root) AS roots FROM reach WHERE d > 0 GROUP BY 1, 2)
SELECT g.event, g.id, depth, roots, CASE WHEN coalesce(fact_status, '') IN ('', 'active') THEN 'review_required' ELSE fact_status END AS fact_status, len(causes) >= 32 AS truncated,
CAST(CASE WHEN list_contains(causes, g.event) OR len(causes) >= 32 THEN len(causes) ELSE len(causes) + 1 END AS INTEGER) AS n_causes FROM g JOIN points p ON p.id = g.id""")
def invalidation_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots, edges, points = _tables(spark, sf_dir)
    changed = invalidation.patches(invalidation.plan(roots, edges, points, depth=DEPTH, max_points=MAX_POINTS, max_edges=MAX_EDGES)[1], points)
    return changed.select("event", "id", "depth", F.array_join("roots", ",").alias("roots"), "fact_status", "truncated", F.size("causes").alias("n_causes"))
