"""Similarity search, filters, fusion and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions import vector
from ..operators import filters, retrieve, search
from ..schema import NOW, PENALISED_STATUSES, points, scoped, visible
from ..session import table
from .common import POINTS, POOL, VISIBLE, Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


def _query_vector(spark: SparkSession, sf_dir: str):
    row = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return search.literal_vector(row[0])


def _pool(spark: SparkSession, sf_dir: str, k: int = 20, history: bool = False) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    joined = visible(points(spark, sf_dir), history).join(vectors, "id")
    return search.dense_topk(joined, _query_vector(spark, sf_dir), k)


MINMAX = "CASE WHEN abs(max(similarity) OVER () - min(similarity) OVER ()) <= 1e-9 * greatest(abs(max(similarity) OVER ()), abs(min(similarity) OVER ())) THEN 1.0::DOUBLE ELSE (similarity - min(similarity) OVER ()) / (max(similarity) OVER () - min(similarity) OVER ()) END"
RECENCY = f"exp(-0.001::DOUBLE * greatest(epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at), 0) / 3.6e9)"
PROVENANCE = "(CASE WHEN stale THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN requires_review THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN fact_status IN ('stale', 'review_required', 'disputed', 'superseded', 'deprecated') THEN 0.65::DOUBLE ELSE 1.0::DOUBLE END)"
CANONICAL = "(CASE WHEN canonical THEN 1.08::DOUBLE ELSE 1.0::DOUBLE END)"


def _search_sql(factor: str, limit: int = 10, pool: str = POOL) -> str:
    return f"""WITH {pool}, n AS (SELECT *, {MINMAX} AS normalised FROM pool),
s AS (SELECT id, similarity, greatest(normalised, 0) * importance / 10.0::DOUBLE * {RECENCY} * {factor} AS score FROM n),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, similarity DESC, id) AS INTEGER) AS rank FROM s)
SELECT id, rank, round(score, 6) AS score FROM r WHERE rank <= {limit}"""


@R.add(f"WITH {POOL} SELECT id, round(similarity, 6) AS similarity FROM pool")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir).select("id", F.round("similarity", 6).alias("similarity"))


@R.add(_search_sql(f"{PROVENANCE} * {CANONICAL}"))
def memory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.memory_search(_pool(spark, sf_dir), now=NOW).select("id", "rank", F.round("score", 6).alias("score"))


@R.add(_search_sql(CANONICAL, pool=POOL.replace(VISIBLE, "visible AS (SELECT * FROM points WHERE NOT consolidation_quarantined)")))
def memory_search_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _pool(spark, sf_dir, history=True)
    return search.memory_search(pool, now=NOW, history=True).select("id", "rank", F.round("score", 6).alias("score"))


@R.add(_search_sql(f"{PROVENANCE} * {CANONICAL} * (CASE WHEN lower(source) = 'src3' THEN 1.04::DOUBLE ELSE 1.0::DOUBLE END)").replace("WHERE rank <= 10", "WHERE rank <= 10").replace("FROM n),", "FROM n),"))
def memory_search_source_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.memory_search(_pool(spark, sf_dir), now=NOW, source="src3").select("id", "rank", F.round("score", 6).alias("score"))


@R.add(f"""WITH {POOL}, n AS (SELECT *, {MINMAX} AS normalised FROM pool), s AS (SELECT id, similarity, greatest(normalised, 0) * importance / 10.0::DOUBLE * {RECENCY} AS score FROM n),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, similarity DESC, id) AS INTEGER) AS rank FROM s) SELECT id, rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def learning_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.learning_search(_pool(spark, sf_dir), now=NOW).select("id", "rank", F.round("score", 6).alias("score"))


@R.add(f"WITH {POINTS}, {VISIBLE} SELECT id FROM visible WHERE profile_id = 'en' AND source = 'src0' AND id % 2 = 0")
def filter_tags_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible(points(spark, sf_dir)).where(filters.tags_all("tags", "lang:en, src:src0,even")).select("id")


@R.add(f"WITH {POINTS} SELECT id, stale, requires_review FROM points WHERE stale AND NOT coalesce(requires_review, false)")
def filter_tristate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where(filters.tristate("stale", True) & filters.tristate("requires_review", False) & filters.tristate("canonical", None)).select("id", "stale", "requires_review")


@R.add(f"WITH {POINTS} SELECT id, epoch_us(created_at) AS created_us FROM points WHERE created_at >= TIMESTAMP '2024-01-10 00:00:00' AND created_at <= TIMESTAMP '2024-01-20 12:00:00'")
def filter_range_since_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = points(spark, sf_dir).where(filters.between("created_at", "2024-01-10 00:00:00", "2024-01-20 12:00:00"))
    return found.select("id", F.unix_micros("created_at").alias("created_us"))


@R.add(f"WITH {POINTS} SELECT id, source FROM points WHERE source IN ('src1', 'src7') AND profile_id = 'en'")
def filter_match_any_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoped(points(spark, sf_dir), profile_id="en").where(filters.match("source", ["src1", "src7"]) & filters.match("fact_key", [])).select("id", "source")


@R.add(f"WITH {POOL}, n AS (SELECT *, {MINMAX} AS normalised FROM pool) SELECT id FROM n WHERE normalised * importance / 10.0::DOUBLE >= 0.1 AND (similarity = 0 OR similarity >= 0.2)")
def relevance_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _pool(spark, sf_dir).withColumn("final", scoring.minmax(F.col("similarity")) * F.col("importance") / 10.0)
    return pool.where(filters.floors("final", "similarity", 0.1, 0.2)).select("id")


@R.add(f"WITH {POOL} SELECT id, CASE WHEN stale OR requires_review OR fact_status IN ('stale', 'review_required', 'disputed', 'superseded', 'deprecated') THEN 'warnings' ELSE 'results' END AS section FROM pool")
def unsafe_status_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.demote_unsafe(_pool(spark, sf_dir), PENALISED_STATUSES).select("id", "section")


@R.add(f"WITH {POOL}, m AS (SELECT *, profile_id = 'xx' AS hit FROM pool) SELECT id FROM m WHERE hit OR NOT (SELECT bool_or(hit) FROM m)")
def prune_keep_all_when_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.keep_matches_or_all(_pool(spark, sf_dir).withColumn("hit", F.col("profile_id") == "xx"), "hit").select("id")


LISTS = """a AS (SELECT CAST(label AS INTEGER) AS list, vec_id AS id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INTEGER) AS rank FROM embeddings),
b AS (SELECT 100 AS list, doc_id AS id, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 200)),
lists AS (SELECT * FROM a WHERE rank <= 50 UNION ALL SELECT * FROM b)"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "embeddings").select(F.col("label").alias("list"), F.col("vec_id").alias("id"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("rank")).where("rank <= 50")
    top = table(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(200)
    b = search.ranked(top, F.desc("n_chars"), F.asc("doc_id")).select(F.lit(100).alias("list"), F.col("doc_id").alias("id"), "rank")
    return a.unionByName(b)


@R.add(f"""WITH {LISTS}, f AS (SELECT id, sum(1.0::DOUBLE / (60.0::DOUBLE + rank)) AS fused, min((list, rank)) AS first FROM lists GROUP BY id)
SELECT id, round(fused, 9) AS fused, CAST(row_number() OVER (ORDER BY round(fused, 12) DESC, first, id) AS INTEGER) AS rank FROM f""")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rrf(_lists(spark, sf_dir)).select("id", F.round("fused", 9).alias("fused"), "rank")


@R.add(f"WITH {LISTS} SELECT id, list, rank FROM lists QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, list) = 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.first_wins(_lists(spark, sf_dir), "id", F.asc("rank"), F.asc("list"))


@R.add(f"""WITH {LISTS}, o AS (SELECT id, list, rank FROM lists QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, list) = 1)
SELECT id, list, CAST(row_number() OVER (ORDER BY rank, list) AS INTEGER) AS position FROM o ORDER BY rank, list LIMIT 40""")
def interleave_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.interleave(_lists(spark, sf_dir), 40).select("id", "list", "position")


@R.add(f"""WITH {LISTS}, l AS (SELECT id, rank, CASE list WHEN 100 THEN 'exact' WHEN 1 THEN 'leaves' WHEN 2 THEN 'summaries' END AS lane, CASE list WHEN 2 THEN 1 WHEN 1 THEN 2 WHEN 100 THEN 3 END AS lane_no FROM lists),
k AS (SELECT * FROM l WHERE lane_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lane ORDER BY rank) <= 5)
SELECT id, lane FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY lane_no, rank) = 1""")
def lane_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    lanes = F.create_map(F.lit(100), F.lit("exact"), F.lit(1), F.lit("leaves"), F.lit(2), F.lit("summaries"))
    return search.lane_topk(_lists(spark, sf_dir).withColumn("lane", lanes[F.col("list")]), ["summaries", "leaves", "exact"], 5).select("id", "lane")


@R.add(f"""WITH {POINTS}, {VISIBLE}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0),
s AS (SELECT p.id, CASE WHEN p.id % 2 = 0 THEN 'own' ELSE 'shared' END AS collection, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.v) AS similarity FROM visible p JOIN embeddings e ON e.vec_id = p.id, q),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY collection ORDER BY similarity DESC, id) <= 10)
SELECT id, collection, round({MINMAX}, 6) AS normalised FROM k""")
def merged_pools_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    rows = visible(points(spark, sf_dir)).join(vectors, "id").withColumn("collection", F.when(F.col("id") % 2 == 0, "own").otherwise("shared"))
    query = _query_vector(spark, sf_dir)
    pools = [search.dense_topk(rows.where(F.col("collection") == c), query, 10) for c in ("own", "shared")]
    return pools[0].unionByName(pools[1]).select("id", "collection", F.round(scoring.minmax(F.col("similarity")), 6).alias("normalised"))


SIZES = "m AS (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS size FROM conversations)"


@R.add(f"""WITH {SIZES}, u AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM m)
SELECT conv_id, turn, CAST(least(size, 1200 - used) AS BIGINT) AS kept_chars FROM u WHERE used < 1200""")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return search.budget_prefix(rows, 1200, group="conv_id", order="turn", size="size").select("conv_id", "turn", "kept_chars")


@R.add(f"""WITH RECURSIVE {SIZES}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM m),
r AS (SELECT conv_id, turn, n, CASE WHEN size <= 1200 THEN size ELSE 0 END AS used, size <= 1200 AS kept FROM o WHERE n = 1
UNION ALL SELECT o.conv_id, o.turn, o.n, CASE WHEN r.used + o.size <= 1200 THEN r.used + o.size ELSE r.used END, r.used + o.size <= 1200 FROM r JOIN o ON o.conv_id = r.conv_id AND o.n = r.n + 1)
SELECT r.conv_id, r.turn, CAST(max(r.used) OVER (PARTITION BY r.conv_id) AS BIGINT) AS used FROM r QUALIFY r.kept""")
def budget_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return search.budget_greedy(rows, 1200, group="conv_id", order="turn", size="size", id_col="turn")


@R.add(f"""WITH RECURSIVE {SIZES}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS c FROM m),
r AS (SELECT conv_id, turn, n, least(size, 1200 // c) AS kept, 1200 - least(size, 1200 // c) AS rest FROM o WHERE n = 1
UNION ALL SELECT o.conv_id, o.turn, o.n, least(o.size, r.rest // (o.c - o.n + 1)), r.rest - least(o.size, r.rest // (o.c - o.n + 1)) FROM r JOIN o ON o.conv_id = r.conv_id AND o.n = r.n + 1)
SELECT conv_id, turn, CAST(kept AS BIGINT) AS kept_chars FROM r""")
def budget_even_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return search.even_share(rows, 1200, group="conv_id", order="turn", size="size")


@R.add("""SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 6) AS cosine,
round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm FROM embeddings""")
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    square = F.transform(e, lambda x: x.cast("double") * x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.cosine(e, square), 6).alias("cosine"), F.round(vector.norm(e), 6).alias("norm"))


@R.add(f"""WITH {POINTS}, n AS (SELECT id, least(id % 40, 30) AS depth, {RECENCY} AS fresh FROM points)
SELECT id, round(CASE WHEN depth > 0 THEN greatest(0.5::DOUBLE, 1 - depth * 0.02::DOUBLE) ELSE 1.0::DOUBLE END, 6) AS factor, round(fresh, 6) AS fresh,
round(fresh + CASE WHEN depth > 0 THEN 0.5::DOUBLE * exp(-depth::DOUBLE) ELSE 0 END + 0.35::DOUBLE * fresh + 0.15::DOUBLE * (fresh / greatest(fresh, 0.01::DOUBLE)) + 0.15::DOUBLE * 0.5::DOUBLE - CASE WHEN id % 3 = 0 THEN 0.15::DOUBLE ELSE 0 END, 6) AS graph FROM n""")
def score_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth, fresh = F.least(F.col("id") % 40, F.lit(30)), scoring.recency(F.col("created_at"), F.lit(NOW).cast("timestamp"))
    graph = scoring.graph_score(fresh, depth, fresh, fresh, fresh, F.lit(0.5), F.col("id") % 3 == 0)
    return points(spark, sf_dir).select("id", F.round(scoring.derivation_factor(depth), 6).alias("factor"), F.round(fresh, 6).alias("fresh"), F.round(graph, 6).alias("graph"))


@R.add()
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense pool and exact-signal lane over all visible points, ranked together."""
    rows = visible(points(spark, sf_dir))
    hits = retrieve.exact_hits(rows, ["sk-test", "HTTP 404", "example.com", "7"])
    found = retrieve.hybrid_search(_pool(spark, sf_dir, 40).select("id", "similarity"), rows, hits, now=NOW)
    return found.select("id", "rank", F.round("score", 6).alias("score"), F.col("sparse_score").alias("sparse"))
