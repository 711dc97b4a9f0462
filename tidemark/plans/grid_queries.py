"""Floors judged in one pass as of each question's time, and rates of every combination of variant, domain and tag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate
from ..session import table
from .common import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
FLOORS = [0.0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4]

ASOF = """q AS (SELECT vec_id AS question, vec_id * 37 % 1000 AS cutoff, CAST(embedding AS DOUBLE[]) AS v, label, CASE WHEN vec_id % 200 = 0 THEN 'noise' ELSE 'gate' END AS set FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT question, vec_id AS item, list_cosine_similarity(q.v, CAST(e.embedding AS DOUBLE[])) AS score, 100 + vec_id % 300 AS chars, e.label = q.label AND q.set = 'gate' AS answers FROM q JOIN embeddings e ON e.vec_id <= q.cutoff),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY question ORDER BY score DESC, item) <= 32)"""


def _asof(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    questions = vectors.where("vec_id % 50 = 0").select(i.alias("question"), (i * 37 % 1000).alias("cutoff"), F.col("embedding").alias("v"), F.col("label").alias("q_label"), F.when(i % 200 == 0, "noise").otherwise("gate").alias("set"))
    items = vectors.select(i.alias("item"), i.alias("created_at"), F.col("embedding").alias("v"), "label", (F.lit(100) + i % 300).alias("chars"))
    found = evaluate.asof_candidates(questions.select("question", "cutoff", "v"), items.select("item", "created_at", "v"), 32)
    found = found.join(items.select("item", "label", "chars"), "item").join(questions.select("question", "q_label", F.col("set").alias("s")), "question")
    return questions.select("question", "set"), found.select("question", "item", "score", "chars", F.coalesce((F.col("label") == F.col("q_label")) & (F.col("s") == "gate"), F.lit(False)).alias("answers"))


@R.add(f"WITH {ASOF} SELECT question, item, round(score, 6) AS score FROM k")
def asof_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir)[1].select("question", "item", F.round("score", 6).alias("score"))


@R.add(f"""WITH {ASOF}, f AS (SELECT unnest({FLOORS}::DOUBLE[]) AS floor), b AS (SELECT *, sum(chars) OVER (PARTITION BY question ORDER BY score DESC, item ROWS UNBOUNDED PRECEDING) AS so_far FROM k),
c AS (SELECT q.set, f.floor, q.question, count(b.item) AS entries, coalesce(sum(b.chars), 0) AS chars, coalesce(bool_or(b.answers), false) AS hit FROM q CROSS JOIN f LEFT JOIN b ON b.question = q.question AND b.so_far <= 2000 AND b.score >= f.floor GROUP BY ALL)
SELECT set, floor, count(*) AS questions, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE entries > 0) AS nonempty, CAST(sum(entries) AS BIGINT) AS entries, CAST(sum(chars) AS BIGINT) AS chars FROM c GROUP BY set, floor""")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell against a direct count of its floor."""
    questions, candidates = _asof(spark, sf_dir)
    return evaluate.threshold_grid(questions, candidates, FLOORS, 2000)


#: Answers in conversations as runs: two variants, the length as latency.
RUNS = """r AS (SELECT CASE WHEN conv_id % 2 = 0 THEN 'dense' ELSE 'hybrid' END AS variant, CASE WHEN conv_id % 3 < 2 THEN 'd' || conv_id % 3 END AS domain, list_filter([role, CASE WHEN turn % 2 = 0 THEN 'even' END, CASE WHEN conv_id % 5 = 0 THEN role END], lambda x: x IS NOT NULL) AS tags,
  length(text) % 7 < 5 AS hit, length(text) % 11 = 0 AS wrong, CAST(length(text) AS DOUBLE) AS latency_ms FROM conversations), t AS (SELECT variant, domain, hit, wrong, latency_ms, unnest(list_distinct(tags)) AS tag FROM r)"""
_RATES = "count(*) AS runs, round(100.0::DOUBLE * avg(hit::INT), 4) AS hit_rate, round(100.0::DOUBLE * avg(wrong::INT), 4) AS wrong_rate, quantile_disc(latency_ms, 0.5) AS latency_p50, quantile_disc(latency_ms, 0.95) AS latency_p95"


@R.add(f"""WITH {RUNS} SELECT variant, domain, NULL AS tag, {_RATES} FROM r GROUP BY GROUPING SETS ((variant, domain), (variant), (domain), ())
UNION ALL SELECT variant, domain, tag, {_RATES} FROM t GROUP BY GROUPING SETS ((variant, domain, tag), (variant, tag), (tag))""")
def eval_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, size = F.col("conv_id"), F.length("text")
    runs = table(spark, sf_dir, "conversations").select(
        F.when(conv % 2 == 0, "dense").otherwise("hybrid").alias("variant"), F.when(conv % 3 < 2, F.concat(F.lit("d"), (conv % 3).cast("string"))).alias("domain"),
        F.array_compact(F.array("role", F.when(F.col("turn") % 2 == 0, "even"), F.when(conv % 5 == 0, F.col("role")))).alias("tags"), (size % 7 < 5).alias("hit"), (size % 11 == 0).alias("wrong"), size.cast("double").alias("latency_ms"),
    )
    return evaluate.matrix(runs)
