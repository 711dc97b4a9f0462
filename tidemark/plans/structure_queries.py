"""Transcripts, windows, graphs, trees and closures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, tree, windows
from ..schema import points
from ..session import table
from ..streaming import window_index
from .common import POINTS, Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

LINE = r"upper(role) || ': ' || trim(regexp_replace(text, '\s+', ' ', 'g')) || chr(10)"
LINES = f"l AS (SELECT conv_id, turn, {LINE} AS line FROM conversations), o AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l)"
WINDOWS = f"""{LINES}, s AS (SELECT conv_id, string_agg(line, '' ORDER BY turn) AS whole FROM l GROUP BY conv_id),
w AS (SELECT conv_id, char_start, substr(whole, char_start + 1, 1000) AS text FROM (SELECT conv_id, whole, unnest(range(0, CAST(greatest(ceil((length(whole) - 1000) / 872.0), 0) AS BIGINT) * 872 + 1, 872)) AS char_start FROM s)),
v AS (SELECT w.conv_id, w.char_start, min(o.turn) AS first_turn, max(o.turn) AS last_turn, sha256(any_value(w.text)) AS text_sha256 FROM w JOIN o ON o.conv_id = w.conv_id AND o.start < w.char_start + 1000 AND o.start + length(o.line) > w.char_start GROUP BY 1, 2)"""


@R.add("SELECT conv_id, count(*) AS n, max(conv_id * 1000 + turn) AS max_id, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("conv_id") * 1000 + F.col("turn")).alias("max_id"), F.sum(F.length("text")).alias("chars"))


@R.add("SELECT conv_id, count(*) - count(*) FILTER (WHERE turn < 2) AS behind FROM conversations GROUP BY conv_id HAVING count(*) - count(*) FILTER (WHERE turn < 2) > 0")
def index_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return window_index.lag(rows, rows.where("turn < 2").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages")))


@R.add("SELECT conv_id, turn, role FROM (SELECT *, conv_id * 1000 + turn AS mid FROM conversations) WHERE mid > 20003 AND mid <= 60000")
def snapshot_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after the cursor and up to the largest id when the snapshot was taken."""
    return table(spark, sf_dir, "conversations").withColumn("mid", F.col("conv_id") * 1000 + F.col("turn")).where("mid > 20003 and mid <= 60000").select("conv_id", "turn", "role")


@R.add("""SELECT c.conv_id, c.turn FROM conversations c WHERE c.role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations e WHERE e.conv_id = c.conv_id AND e.role = 'user' AND e.turn < c.turn)""")
def first_row_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("turn"))


@R.add("""WITH RECURSIVE p AS (SELECT DISTINCT conv_id AS id, conv_id - 1 AS parent FROM conversations WHERE conv_id % 5 <> 0), r AS (SELECT id, parent AS ancestor, 1 AS distance FROM p UNION ALL SELECT r.id, p.parent, r.distance + 1 FROM r JOIN p ON p.id = r.ancestor WHERE r.distance < 32)
SELECT * FROM r""")
def session_chain_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct().where("id % 5 != 0").withColumn("parent", F.col("id") - 1)
    return graph.chain(parents)


@R.add(f"WITH {LINES} SELECT conv_id, turn, CAST(start AS BIGINT) AS start, CAST(length(line) AS INTEGER) AS length FROM o")
def serialize_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.serialise(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "start", F.length("line").alias("length"))


@R.add(f"WITH {WINDOWS} SELECT * FROM v")
def char_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.char_windows(windows.serialise(table(spark, sf_dir, "conversations"))).drop("text")


@R.add(f"WITH {WINDOWS}, h AS (SELECT *, (conv_id * 31 + char_start) % 17 / 17.0::DOUBLE AS score FROM v) SELECT text_sha256, arg_max(conv_id, (score, conv_id, char_start)) AS conv_id, arg_max(char_start, (score, conv_id, char_start)) AS char_start, count(*) AS n_copies FROM h GROUP BY text_sha256")
def exact_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.collapse_exact(_scored_windows(spark, sf_dir)).select("text_sha256", "conv_id", "char_start", "n_copies")


def _scored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = windows.char_windows(windows.serialise(table(spark, sf_dir, "conversations")))
    return made.withColumn("score", (F.col("conv_id") * 31 + F.col("char_start")) % 17 / 17.0)


@R.add(f"WITH {WINDOWS} SELECT text_sha256, CAST(least(count(*), 10) AS INTEGER) AS n_listed, count(*) > 10 AS truncated FROM v GROUP BY text_sha256")
def also_in_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.collapse_exact(_scored_windows(spark, sf_dir)).select("text_sha256", "n_listed", "truncated")


@R.add("SELECT c.conv_id, c.turn, c.role FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations h WHERE h.conv_id = c.conv_id AND h.turn = 2 AND h.conv_id % 3 = 0 AND c.turn BETWEEN -1 AND 5)")
def expand_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return windows.expand_messages(rows.where("turn = 2 and conv_id % 3 = 0").select("conv_id", "turn"), rows).select("conv_id", "turn", "role")


@R.add(f"WITH {WINDOWS} SELECT * FROM v")
def window_index_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of the first turns, advanced by the rest: the same windows as a rebuild."""
    rows = table(spark, sf_dir, "conversations")
    first = rows.where("turn < 3")
    index = windows.char_windows(windows.serialise(first))
    return window_index.advance(index, window_index.cursor(first), rows).drop("text")


EDGES = """e AS (SELECT DISTINCT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    return orders.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst")).unionByName(items.select(name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst")))


@R.add(f"WITH {EDGES} SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY dst) AS INTEGER) AS n FROM e QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 3")
def graph_neighbors_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(_edges(spark, sf_dir), 3)


@R.add(f"""WITH {EDGES}, n AS (SELECT src, dst FROM e QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 8), s AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_custkey <= 20),
a AS (SELECT DISTINCT n.dst AS id FROM s JOIN n ON n.src = s.id WHERE n.dst NOT IN (SELECT id FROM s)), b AS (SELECT DISTINCT n.dst AS id FROM a JOIN n ON n.src = a.id WHERE n.dst NOT IN (SELECT id FROM s UNION SELECT id FROM a))
SELECT id, 0 AS depth FROM s UNION ALL SELECT id, 1 FROM a UNION ALL SELECT id, 2 FROM b""")
def graph_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "customer").where("c_custkey <= 20").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    return graph.expand(seeds, _edges(spark, sf_dir), depth=2, cap=8)


@R.add("SELECT r_regionkey AS id FROM region WHERE contains('sales in asia and europe last year', lower(r_name))")
def graph_query_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("label"), F.array().cast("array<string>").alias("aliases"))
    return graph.query_entities(entities, "Sales in Asia and Europe last year").select("id")


@R.add("""WITH RECURSIVE d AS (SELECT n_nationkey AS source, 'n' || n_nationkey AS s, 'c' || c_custkey AS t FROM nation JOIN customer ON c_nationkey = n_nationkey), seeds AS (SELECT 'n' || n_nationkey AS id FROM nation WHERE n_nationkey = 3),
l1 AS (SELECT DISTINCT t AS id FROM d WHERE s IN (SELECT id FROM seeds)), l2 AS (SELECT DISTINCT 'o' || o_orderkey AS id FROM orders WHERE 'c' || o_custkey IN (SELECT id FROM l1))
SELECT id, 0 AS depth FROM seeds UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2""")
def dependents_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    depends = table(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("dependent"), name("n", "c_nationkey").alias("source"))
    depends = depends.unionByName(table(spark, sf_dir, "orders").select(name("o", "o_orderkey").alias("dependent"), name("c", "o_custkey").alias("source")))
    seeds = table(spark, sf_dir, "nation").where("n_nationkey = 3").select(name("n", "n_nationkey").alias("id"))
    return graph.closure(seeds, depends, max_points=1_000_000)[0]


SAFE = f"{POINTS}, safe AS (SELECT * FROM points WHERE NOT consolidation_quarantined AND NOT stale AND NOT requires_review)"
NODES = f"""{SAFE}, n AS (SELECT *, CAST((row_number() OVER (PARTITION BY profile_id, source ORDER BY id) - 1) // 8 AS INTEGER) AS chunk FROM safe),
t AS (SELECT profile_id, source, chunk, list_sort(list(id)) AS children FROM n GROUP BY 1, 2, 3),
d AS (SELECT *, sha256(concat_ws(chr(10), 'tree-1', profile_id, source, array_to_string(children, ','))) AS h FROM t),
nodes AS (SELECT *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS node_id FROM d)"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    safe = points(spark, sf_dir).where("not consolidation_quarantined and not stale and not requires_review")
    return tree.level_one(safe, scope="profile_id", bucket="source")


@R.add(f"WITH {NODES} SELECT profile_id, source, chunk, CAST(len(children) AS INTEGER) AS n_children, node_id FROM nodes")
def tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("profile_id", "source", "chunk", F.size("children").alias("n_children"), "node_id")


@R.add(f"WITH {NODES}, g AS (SELECT profile_id, count(*) AS n_nodes, CAST(sum(len(children)) AS BIGINT) AS n_leaves, sha256(concat_ws(chr(10), 'tree-2', profile_id, array_to_string(list_sort(list(node_id)), ','))) AS h FROM nodes GROUP BY profile_id) SELECT profile_id, n_nodes, n_leaves, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS node_id FROM g")
def tree_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.roots(_nodes(spark, sf_dir), scope="profile_id")




@R.add(f"WITH {POINTS}, s AS (SELECT source || '/' || CAST(id // 40 AS VARCHAR) AS node_id, bool_or(consolidation_quarantined) AS q, bool_or(stale OR requires_review) AS u FROM points GROUP BY 1) SELECT node_id, CASE WHEN q THEN 'excluded' WHEN u THEN 'stale' ELSE 'active' END AS status FROM s")
def parent_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir)
    node = F.concat_ws("/", "source", F.floor(F.col("id") / 40).cast("string"))
    return tree.parent_status(rows.groupBy(node.alias("node_id")).agg(F.collect_list("id").alias("children")), rows)


@R.add(f"WITH {NODES} SELECT node_id FROM nodes WHERE list_has_any(children, range(0, 100))")
def evidence_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    cited = nodes.select("node_id", F.explode("children").alias("id")).where("id < 100")
    return tree.with_evidence(nodes.select("node_id"), cited)
