"""Payload rules, merged retrieval, duplicate windows, write checks, lineage and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload as pl
from ..functions import text as tx
from ..operators import consolidation, graph, retrieve, tree, windows
from ..schema import NOW, points, visible
from ..session import shared_folder, table
from .common import POINTS, POOL, VISIBLE, Registry
from .quality_queries import FLAT, FP, IMPORTANCE, SCORED, SECRET_SQL, secret_sql
from .ranking_queries import CANONICAL, MINMAX, PROVENANCE, RECENCY, _pool
from .structure_queries import EDGES, NODES, _edges, _nodes

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


@R.add(f"""WITH {POINTS} SELECT id, CASE WHEN coalesce(fact_status, '') <> '' THEN fact_status WHEN stale THEN 'stale' ELSE 'active' END AS status,
CASE WHEN id % 4 = 0 THEN 'extracted_assertion' WHEN id % 3 = 0 THEN 'generated_summary' ELSE 'source_text' END AS section, CASE id % 3 WHEN 0 THEN 'skill_doc' WHEN 1 THEN 'project_doc' ELSE 'indexed_file' END AS path_type,
length(text) AS query_length, substr(sha256(text), 1, 16) AS query_digest, CASE WHEN id % 2 = 0 THEN 'p-' || id END AS point_id, id % 5 < 3 AS flag,
CASE WHEN id % 2 = 0 THEN id % 6 = 0 ELSE id % 4 = 1 END AS owner FROM points""")
def payload_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    folder = F.when(i % 3 == 0, "/home/Skills/").when(i % 3 == 1, "/home/Projects/").otherwise("/home/src/")
    word = F.element_at(F.array(*[F.lit(w) for w in (" Yes ", "ON", "1", "no", "")]), (i % 5 + 1).cast("int"))
    sender, chat = F.when(i % 2 == 0, F.when(i % 6 == 0, " Ana ").otherwise("bot")), F.when(i % 4 == 1, "DM").otherwise("group")
    digest = pl.query_digest(F.col("text"))
    return points(spark, sf_dir).select(
        "id", pl.status(F.col("fact_status"), F.col("stale")).alias("status"),
        pl.section(F.when(i % 4 == 0, "Assertion"), F.lit(None).cast("string"), F.when(i % 3 == 0, " Summary"), F.lit(None).cast("string")).alias("section"),
        pl.path_type(F.concat(folder, "source", F.lit(".md"))).alias("path_type"), digest["query_length"].alias("query_length"), digest["query_digest"].alias("query_digest"),
        pl.point_id(F.concat(F.when(i % 2 == 0, F.lit(" p-")).otherwise(F.lit("memory://p-")), i.cast("string"))).alias("point_id"), pl.truthy(word).alias("flag"), pl.owner_row(sender, chat, ("ana", "Eva")).alias("owner"),
    )


def _learning_sql() -> str:
    rules = [" OR ".join(f"contains(t, '{w}')" for w in words) + (" OR conv_id % 7 = 0" if kind == "tool_failure_lesson" else "") for kind, words in pl.LEARNING_WORDS]
    return "CASE " + " ".join(f"WHEN {r} THEN '{kind}'" for r, (kind, _) in zip(rules, pl.LEARNING_WORDS)) + " ELSE 'workflow_lesson' END"


@R.add(f"WITH c AS (SELECT conv_id, turn, lower(text) || chr(10) || role || chr(10) || CASE WHEN conv_id % 7 = 0 THEN 'shell' ELSE '' END AS t FROM conversations) SELECT conv_id, turn, {_learning_sql()} AS learning_type FROM c")
def learning_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = F.when(F.col("conv_id") % 7 == 0, "shell")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", pl.learning_type(F.col("text"), F.col("role"), tool).alias("learning_type"))


@R.add(f"""WITH {POINTS} SELECT id, array_to_string(list_filter([CASE WHEN requires_review THEN 'requires_review' END, CASE WHEN stale THEN 'stale' END, CASE WHEN consolidation_quarantined THEN 'consolidation_quarantined' END,
CASE WHEN fact_status IN ('stale', 'superseded', 'disputed', 'deprecated') THEN 'fact_status:' || fact_status END, CASE WHEN id % 13 = 0 THEN 'raptor_review_status:review_required' END], lambda x: x IS NOT NULL), ',') AS reasons FROM points""")
def parent_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {name: F.col(name) for name in ("requires_review", "stale", "consolidation_quarantined")}
    return points(spark, sf_dir).select("id", F.concat_ws(",", pl.trust_reasons(flags, F.col("fact_status"), F.when(F.col("id") % 13 == 0, " Review_Required"))).alias("reasons"))


@R.add(f"WITH {POINTS} SELECT profile_id, CASE WHEN min(source) = max(source) THEN min(source) END AS source, CASE WHEN min(id % 97) = max(id % 97) THEN min(fact_key) END AS fact_key, fact_key AS g FROM points GROUP BY profile_id, g")
def unanimous_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).withColumn("g", F.col("fact_key"))
    return rows.groupBy("profile_id", "g").agg(pl.unanimous(F.col("source")).alias("source"), pl.unanimous(F.col("fact_key")).alias("fact_key"))


@R.add(f"""WITH {POINTS} SELECT id, CASE WHEN id % 11 = 0 THEN 'modified' WHEN id % 7 = 0 THEN 'observed' WHEN id % 5 = 0 THEN 'deleted' WHEN id % 4 = 0 THEN 'observed' WHEN id % 3 = 0 THEN 'rechunked' WHEN id % 2 = 0 THEN 'restored' ELSE 'modified' END AS kind FROM points""")
def file_event_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    old = F.when(i % 4 != 0, F.when(i % 3 == 0, F.md5("text")).otherwise("old"))
    return points(spark, sf_dir).select("id", pl.event_kind(F.when(i % 11 == 0, "modified"), i % 7 == 0, i % 5 != 0, old, F.md5("text"), i % 2 == 0).alias("kind"))


#: The words of one text, as a query.
WORDS = rf"w AS (SELECT list_distinct(list_filter(string_split(lower({FLAT}), ' '), lambda t: length(t) > 5)) AS q FROM documents WHERE doc_id = 1)"


@R.add(f"""WITH {POOL}, {WORDS}, t AS (SELECT p.id, list_distinct(list_filter(string_split(lower({FLAT.replace('text', 'p.text')}), ' '), lambda x: x <> '')) AS words, p.consolidation_quarantined AS quarantined, {secret_sql('p.text')} AS secret FROM points p),
s AS (SELECT id, len(list_intersect(words, q)) AS matched, quarantined, secret FROM t, w), u AS (SELECT id, CAST(matched AS DOUBLE) AS score, quarantined OR secret AS blocked FROM s WHERE quarantined OR secret OR matched > 0),
d AS (SELECT id, similarity, CAST(row_number() OVER (ORDER BY similarity DESC, id) AS INTEGER) AS r FROM pool)
SELECT coalesce(d.id, u.id) AS id, d.r AS dense_rank, round(coalesce(d.similarity, 0), 6) AS dense_score, CASE WHEN coalesce(blocked, false) THEN 0.0::DOUBLE ELSE coalesce(u.score, 0.0::DOUBLE) END AS sparse_score,
CASE WHEN coalesce(blocked, false) THEN 0.0::DOUBLE ELSE round(coalesce(d.similarity, 0) + 0.5::DOUBLE * coalesce(u.score, 0), 6) END AS combined, coalesce(blocked, false) AS blocked FROM d FULL JOIN u ON d.id = u.id""")
def merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense pool and exact words of one text, merged; hits that only the words found are there too."""
    first = table(spark, sf_dir, "documents").where("doc_id = 1").select(F.array_distinct(F.filter(tx.tokens(F.col("text")), lambda t: F.length(t) > 5)).alias("q")).first()
    query = F.array(*[F.lit(w) for w in (first.q if first else [])]).cast("array<string>")
    matched = F.size(F.array_intersect(F.array_distinct(tx.tokens(F.col("text"))), query))
    sparse = points(spark, sf_dir).select("id", matched.cast("double").alias("sparse_score"), matched.alias("matched"), F.lit(False).alias("literal"), F.col("consolidation_quarantined").alias("quarantined"), tx.has_secret(F.col("text")).alias("secret"))
    dense = _pool(spark, sf_dir).select("id", F.col("similarity").alias("dense_score"))
    return retrieve.merge_candidates(dense, sparse).withColumn("dense_score", F.round("dense_score", 6)).withColumn("combined", F.round("combined", 6))


@R.add(f"""WITH {POOL}, {WORDS}, t AS (SELECT p.id, list_distinct(list_filter(string_split(lower({FLAT.replace('text', 'p.text')}), ' '), lambda x: x <> '')) AS words FROM visible p),
u AS (SELECT id, CAST(len(list_intersect(words, q)) AS DOUBLE) AS sparse FROM t, w WHERE len(list_intersect(words, q)) > 0), n AS (SELECT id, similarity, {MINMAX} AS normalised FROM pool),
c AS (SELECT coalesce(n.id, u.id) AS id, similarity, coalesce(sparse, 0.0::DOUBLE) AS sparse, coalesce(normalised, least(1.0::DOUBLE, sparse / 4.0::DOUBLE)) AS near FROM n FULL JOIN u ON n.id = u.id),
s AS (SELECT c.*, (near * importance / 10.0::DOUBLE * {RECENCY} + 0.25::DOUBLE * sparse) * {PROVENANCE} * {CANONICAL} AS score FROM c JOIN points p ON p.id = c.id WHERE NOT {secret_sql('p.text')})
SELECT id, CAST(row_number() OVER (ORDER BY score DESC, similarity DESC NULLS LAST, id) AS INTEGER) AS rank, sparse, round(score, 6) AS score, similarity IS NULL AS only_sparse FROM s ORDER BY score DESC, similarity DESC NULLS LAST, id LIMIT 20""")
def hybrid_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense pool and the points that share words with one text, ranked together."""
    first = table(spark, sf_dir, "documents").where("doc_id = 1").select(F.array_distinct(F.filter(tx.tokens(F.col("text")), lambda t: F.length(t) > 5)).alias("q")).first()
    query = F.array(*[F.lit(w) for w in (first.q if first else [])]).cast("array<string>")
    rows = visible(points(spark, sf_dir))
    shared = rows.select("id", F.size(F.array_intersect(F.array_distinct(tx.tokens(F.col("text"))), query)).cast("double").alias("sparse_score"))
    found = retrieve.hybrid_search(_pool(spark, sf_dir).select("id", "similarity"), rows, shared, now=NOW, top_k=20)
    return found.select("id", "rank", F.col("sparse_score").alias("sparse"), F.round("score", 6).alias("score"), F.col("similarity").isNull().alias("only_sparse"))


@R.add(f"""WITH {POOL}, r AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) AS rank, CASE WHEN id % 3 <> 0 THEN (id * 37 % 101) / 10.0::DOUBLE END AS rerank_score FROM pool)
SELECT id, CAST(row_number() OVER (ORDER BY rerank_score DESC, rank, id) AS INTEGER) AS place FROM r WHERE rerank_score >= 3.0 ORDER BY rerank_score DESC, rank, id LIMIT 5""")
def rerank_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = retrieve.merge_candidates(_pool(spark, sf_dir).select("id", F.col("similarity").alias("dense_score")), _nothing(spark)).select("id", F.col("dense_rank").alias("rank"))
    ranking = pool.where("id % 3 != 0").select("id", (F.col("id") * 37 % 101 / 10.0).alias("rerank_score"))
    return retrieve.rerank_order(pool, ranking, top_k=5, floor=3.0)


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id long, sparse_score double, matched int, literal boolean, quarantined boolean, secret boolean")


@R.add("""WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.v) AS c FROM q JOIN embeddings e ON e.vec_id <> q.vec_id)
SELECT query_id, id FROM s WHERE c >= 0.4 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) = 1""")
def semantic_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every hundredth vector, the nearest other one that reaches the threshold."""
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return retrieve.semantic_duplicates(vectors, vectors.where("id % 100 = 0"), threshold=0.4).select("query_id", "id")


@R.add()
def session_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that share words with a line of every hundredth conversation, copies collapsed; best groups of each line (conv_id/turn)."""
    lines = table(spark, sf_dir, "conversations")
    shared_folder(spark)
    found = windows.char_windows(windows.serialise(lines)).select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("char_start").cast("string")).alias("id"), "text", F.col("char_start").cast("double").alias("start_ts")).checkpoint()
    words = F.array_distinct(F.filter(tx.tokens(F.col("text")), lambda t: F.length(t) > 6)).alias("words")
    queries = lines.where("conv_id % 100 = 0").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), words)
    best = retrieve.shared_words(found.select("id", words), queries, fetch=384)
    hits = best.join(found, "id").select("query_id", "id", "text", "score", "start_ts")
    return retrieve.collapse_duplicates(hits, keep=15, fetch=384).select("query_id", "place", "id", F.size("members").alias("n_members"))


@R.add(f"""WITH {POINTS}, {SCORED}, c AS (SELECT id, CASE WHEN id % 29 = 0 THEN '' ELSE {FLAT} END AS flat, (({SECRET_SQL}) AND id % 29 <> 0) OR id % 19 = 0 OR id % 23 = 0 AS secret, id % 17 = 0 AS duplicate, {IMPORTANCE} AS own,
CASE WHEN id % 12 BETWEEN 1 AND 10 AND id % 19 <> 0 THEN greatest({IMPORTANCE}, id % 12) ELSE {IMPORTANCE} END AS importance, id % 3 = 0 OR id % 14 = 5 AS derived, id % 5 <> 0 OR id % 7 = 3 AS provenance,
CASE WHEN id % 6 = 4 THEN 0.8::DOUBLE ELSE confidence END AS confidence, id % 4 = 1 AS promote, id % 7 = 2 AS learning FROM imp),
d AS (SELECT id, CASE WHEN flat = '' THEN 1 WHEN secret THEN 2 WHEN duplicate THEN 3 WHEN own <= 1 OR importance <= 2 THEN 4 WHEN derived AND NOT provenance THEN 5 WHEN derived AND confidence < 0.65 THEN 6
WHEN promote AND confidence >= 0.85 AND importance >= 8 THEN 7 WHEN promote THEN 8 WHEN learning THEN 9 ELSE 10 END AS r FROM c)
SELECT id, ['skip', 'reject', 'skip', 'skip', 'draft_review', 'draft_review', 'skill_candidate', 'draft_review', 'learning_candidate', 'store'][r] AS decision,
['empty_text', 'possible_secret', 'duplicate_candidate', 'low_information', 'missing_provenance', 'low_confidence_derived_write', 'skill_candidate', 'weak_skill_candidate', 'learning_candidate', 'storeable'][r] AS reason, r IN (2, 5, 6, 7, 8, 9) AS requires_review FROM d""")
def write_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in the metadata's keys and in URIs count; so do edges as provenance and the metadata's importance."""
    i = F.col("id")
    deep = F.struct((i % 12).alias("importance"), F.array(F.struct(F.lit("plain").alias("note"))).alias("list"))
    bad = F.lit('{"list": [{"deep": {"password: hunter2222": 1}}]}')
    rows = points(spark, sf_dir).select(
        "id", F.when(i % 29 == 0, "  ").otherwise(tx.collapse(F.col("text"))).alias("text"), (i % 17 == 0).alias("duplicate"), tx.importance(F.col("text"), F.col("source").isin("src1", "src2")).alias("importance"),
        F.when(i % 19 == 0, bad).otherwise(F.to_json(deep)).alias("metadata"), F.when(i % 7 == 2, " Learnings").otherwise("memory").alias("target"), F.when(i % 14 == 5, "Proposal ").otherwise("conversation").alias("source_type"),
        F.when(i % 3 == 0, " Summary").alias("derivation_type"), F.when(i % 23 == 0, "https://user:pw@host/x").when(i % 5 != 0, "memory://x").alias("source_uri"), F.when(i % 7 == 3, '[{"id": "x"}]').when(i % 7 == 4, "[]").alias("derived_from"),
        F.when(i % 6 != 4, F.col("confidence")).alias("confidence"), (i % 4 == 1).alias("promote"),
    )
    return retrieve.write_gate(rows).select("id", "decision", "reason", "requires_review")


@R.add(f"""WITH {EDGES}, b AS (SELECT src AS id, dst AS other, 'source' AS side FROM e UNION ALL SELECT dst, src, 'target' FROM e) SELECT id, other, side FROM b QUALIFY row_number() OVER (PARTITION BY id, side ORDER BY other) <= 2""")
def graph_both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours_both(_edges(spark, sf_dir).withColumn("relation", F.lit("has")), 2).select("id", "other", "side")


@R.add(f"""WITH {POINTS}, {VISIBLE}, x AS (SELECT doc_id AS e, unnest(range(doc_id * 7 + 1, doc_id * 7 + 9, 1)) AS p FROM documents), f AS (SELECT e, CAST(p AS VARCHAR) AS p FROM x WHERE p IN (SELECT id FROM visible))
SELECT e AS entity_id, p AS point_id, false AS is_entity FROM f UNION ALL SELECT doc_id, CAST(doc_id AS VARCHAR), true FROM documents WHERE doc_id NOT IN (SELECT e FROM f)""")
def entity_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("doc_id") * 7
    entities = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity_id"), F.sequence(at + 1, at + 12).alias("source_point_ids"))
    return graph.entity_memories(entities, visible(points(spark, sf_dir)).select("id"))


@R.add(f"""WITH {NODES}, k AS (SELECT n.node_id, n.children, n.chunk, unnest(n.children) AS id FROM nodes n), j AS (SELECT k.node_id, bool_or(p.consolidation_quarantined) AS q, bool_or(p.id IS NULL OR (p.stale OR p.requires_review)) AS u FROM k LEFT JOIN (SELECT * FROM points WHERE id % 19 <> 0) p ON k.id = p.id GROUP BY 1)
SELECT n.node_id, CASE WHEN n.chunk % 3 = 2 THEN 'review_required' WHEN q THEN 'excluded' WHEN u THEN 'stale' ELSE 'active' END AS status FROM nodes n JOIN j ON j.node_id = n.node_id""")
def tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = F.array_compact(F.array(F.when(F.col("chunk") % 3 == 2, F.lit("requires_review"))))
    nodes = _nodes(spark, sf_dir).withColumn("reasons", reasons)
    return tree.search(nodes, points(spark, sf_dir).where("id % 19 != 0")).select("node_id", "status")


@R.add("""WITH e AS (SELECT 'o' || o_orderkey AS point, 'c' || o_custkey AS derived_from FROM orders), s AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_custkey % 100 = 0 UNION ALL SELECT 'o' || o_orderkey FROM orders WHERE o_orderkey % 100 = 0)
SELECT s.id, 'upstream' AS direction, e.derived_from AS other FROM s JOIN e ON e.point = s.id UNION ALL (SELECT s.id, 'downstream', e.point FROM s JOIN e ON e.derived_from = s.id QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY e.point) <= 5)""")
def lineage_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    edges = table(spark, sf_dir, "orders").select(name("o", "o_orderkey").alias("point"), name("c", "o_custkey").alias("derived_from"), F.lit("derived").alias("relation"))
    seeds = table(spark, sf_dir, "customer").where("c_custkey % 100 = 0").select(name("c", "c_custkey").alias("id")).unionByName(table(spark, sf_dir, "orders").where("o_orderkey % 100 = 0").select(name("o", "o_orderkey").alias("id")))
    return retrieve.trace(edges, seeds, cap=5).select("id", "direction", "other")


@R.add("""WITH p AS (SELECT doc_id // 4 AS proposal_id, doc_id AS id FROM documents), s AS (SELECT proposal_id, count(*) FILTER (WHERE id % 23 = 0) AS m, count(*) FILTER (WHERE id % 9 = 0 AND id % 23 <> 0) AS c FROM p GROUP BY 1)
SELECT proposal_id, CASE WHEN m > 0 THEN 'unknown' WHEN c > 0 THEN 'changed' ELSE 'unchanged' END AS state, c AS n_changed, m AS n_missing FROM s""")
def review_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    proposals = rows.select(F.floor(F.col("id") / 4).alias("proposal_id"), "id", F.when(F.col("id") % 9 == 0, "old").otherwise(F.col("digest")).alias("digest"))
    return retrieve.drift(proposals, rows.where("id % 23 != 0"))


@R.add(f"WITH {POINTS} SELECT id, created_at FROM points ORDER BY created_at, id LIMIT 25 OFFSET 50")
def review_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.review_page(points(spark, sf_dir).select("id", "created_at"), offset=50, limit=25, order=("created_at", "id"))


@R.add(f"""WITH {POINTS}, g AS (SELECT fact_key, arg_max(id, (importance, confidence, created_at, id)) AS canonical_id, count(*) AS n, count(DISTINCT nullif({FP}, '')) AS n_texts FROM points WHERE confidence >= 0.6 GROUP BY fact_key) SELECT * FROM g WHERE n >= 2 AND n_texts >= 2""")
def reconsolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidation.reconsolidations(points(spark, sf_dir))


@R.add(f"WITH k(kind, action) AS (VALUES {', '.join(f'({k!r}, {v!r})' for k, v in pl.ACTIONS.items())}, ('other', NULL)) SELECT kind, action FROM k")
def proposal_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k,) for k in (*pl.ACTIONS, "other")], "kind string").select("kind", pl.action(F.col("kind")).alias("action"))


@R.add("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role <> 'system' GROUP BY conv_id) SELECT c.conv_id, n FROM c LEFT JOIN (SELECT doc_id, source FROM documents) d ON d.doc_id = c.conv_id WHERE coalesce(source, '') NOT IN ('src1', 'src2')""")
def messages_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that count, by session, without those of excluded sources; sessions that are not listed stay."""
    sessions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), "source")
    return windows.eligible_sessions(table(spark, sf_dir, "conversations").where("role != 'system'"), sessions, exclude=("src1", "src2")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
