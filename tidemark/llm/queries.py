"""Queries opN_<name>: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import bpe, common, compaction, embedding_dedup, language, lm_scoring, mixing, mpeg_audio, quality, simhash, toxicity, url_filter, warc, whitening


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_scoring.score_texts(docs, common.remainder(F.col("doc_id"), 5) != 1)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = common.remainder(F.col("doc_id"), 3) != 1
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn)
    return found.select(F.col("id").alias("doc_id"), (common.remainder(F.col("id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: (host, path, verdict) of op3.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


OP3_SQL = """
WITH rules(host, rpath, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
parts AS (SELECT row_number() OVER () AS r, page_id, coalesce(substr(url, nullif(strpos(url, '://'), 0) + 3), '') AS rest FROM pages),
split AS (SELECT r, page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM parts),
urls AS (SELECT r, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM split),
fits AS (SELECT u.r, arg_max(x.host || x.rpath, length(x.host || x.rpath)) AS rule, arg_max(x.verdict, length(x.host || x.rpath)) AS verdict
         FROM urls u JOIN rules x ON (u.host = x.host OR ends_with(u.host, '.' || x.host)) AND starts_with(u.path, x.rpath) GROUP BY u.r)
SELECT page_id, host, path, f.rule AS rule, coalesce(f.verdict, 'allow') AS verdict FROM urls u LEFT JOIN fits f ON u.r = f.r
"""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    members, folder = warc.archive(pages)
    found = warc.read_archives(members, folder, payload=False)
    return found.select(F.col("rid").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


OP4_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d) END AS owner FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN owner > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN owner > page_id THEN owner END AS refers_to FROM m
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    return planned.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "position")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size::DOUBLE * 2 AS cap, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS mix FROM s),
l AS (SELECT *, (mix - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, least(cap, weight * coalesce((SELECT level FROM l WHERE level <= cap / weight ORDER BY cap / weight, rank LIMIT 1), 0)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.rank % 3 AS k, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT *, (greatest(least(floor(target)::BIGINT - start, size), 0) + greatest(least(floor(target)::BIGINT - start - source_size, size), 0))::BIGINT AS taken FROM p),
u AS (SELECT *, greatest(least(start::DOUBLE / target, 1.0::DOUBLE), 0.0::DOUBLE) AS x FROM g)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN CASE k
  WHEN 0 THEN CASE WHEN x < 3.0::DOUBLE / 7 THEN (0.0::DOUBLE + (x - 0.0::DOUBLE) / (3.0::DOUBLE / 7)) / 4 WHEN x < 3.0::DOUBLE / 7 + 2.0::DOUBLE / 7 THEN (1.0::DOUBLE + (x - 3.0::DOUBLE / 7) / (2.0::DOUBLE / 7)) / 4
    WHEN x < 3.0::DOUBLE / 7 + 2.0::DOUBLE / 7 + 1.0::DOUBLE / 7 THEN (2.0::DOUBLE + (x - (3.0::DOUBLE / 7 + 2.0::DOUBLE / 7)) / (1.0::DOUBLE / 7)) / 4 ELSE (3.0::DOUBLE + (x - (3.0::DOUBLE / 7 + 2.0::DOUBLE / 7 + 1.0::DOUBLE / 7)) / (1.0::DOUBLE / 7)) / 4 END
  WHEN 1 THEN CASE WHEN x < 0.25::DOUBLE THEN (x - 0.0::DOUBLE) / 0.25::DOUBLE / 4 WHEN x < 0.5::DOUBLE THEN (1.0::DOUBLE + (x - 0.25::DOUBLE) / 0.25::DOUBLE) / 4 WHEN x < 0.75::DOUBLE THEN (2.0::DOUBLE + (x - 0.5::DOUBLE) / 0.25::DOUBLE) / 4 ELSE (3.0::DOUBLE + (x - 0.75::DOUBLE) / 0.25::DOUBLE) / 4 END
  ELSE CASE WHEN x < 1.0::DOUBLE / 7 THEN (0.0::DOUBLE + (x - 0.0::DOUBLE) / (1.0::DOUBLE / 7)) / 4 WHEN x < 1.0::DOUBLE / 7 + 1.0::DOUBLE / 7 THEN (1.0::DOUBLE + (x - 1.0::DOUBLE / 7) / (1.0::DOUBLE / 7)) / 4
    WHEN x < 1.0::DOUBLE / 7 + 1.0::DOUBLE / 7 + 2.0::DOUBLE / 7 THEN (2.0::DOUBLE + (x - (1.0::DOUBLE / 7 + 1.0::DOUBLE / 7)) / (2.0::DOUBLE / 7)) / 4 ELSE (3.0::DOUBLE + (x - (1.0::DOUBLE / 7 + 1.0::DOUBLE / 7 + 2.0::DOUBLE / 7)) / (3.0::DOUBLE / 7)) / 4 END END END AS position
FROM u
"""


def op6_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = mpeg_audio.media_column(table(spark, sf_dir, "documents"))
    return mpeg_audio.digests(media).withColumnRenamed("id", "doc_id")


def vocabulary() -> str:
    """The tokenizer file that op8 and the pipeline use."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary()).withColumnRenamed("id", "doc_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, quality.trusted(labels, common.remainder(F.col("doc_id"), 5) != 0))
    found = quality.score(docs, model)
    return found.select(F.col("id").alias("doc_id"), (common.remainder(F.col("id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch_path(spark, "clicks", keep=True)
    layout, planned = compaction.compact(table(spark, sf_dir, "clicks"), folder)
    found = compaction.final_files(spark, layout, folder, planned)
    return found.withColumnsRenamed({"min_id": "min_click_id", "max_id": "max_click_id"})


#: Entries of op12: floor(64 * c) + 1000000.
X_SCALE, X_SHIFT, COMPONENTS = 64, 1_000_000, 32


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where(whitening.usable("embedding"))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * X_SCALE) + X_SHIFT)
    vectors = vectors.select("vec_id", x.alias("x"))
    model = whitening.fit(vectors, "x", COMPONENTS)
    found = whitening.transform(vectors, model, id_col="vec_id", vector_col="x", keep=("x",))
    # n*x - S of each dimension, squared and summed in whole numbers; null if that is beyond a long
    off = F.zip_with("x", whitening.constants(model.sums, "long"), lambda v, s: F.try_subtract(F.try_multiply(v, F.lit(model.n)), s))
    total = F.aggregate(off, F.lit(0).cast("long"), lambda t, v: F.try_add(t, F.try_multiply(v, v)))
    rows = found.select("id", F.lit(model.n).cast("long").alias("n"), total.alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(whitening.constants(model.explained, "double"), F.col("at") + 1)
    return rows.select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", explained.alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error")
    )


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(common.remainder(F.col("doc_id"), 4) != 2))
    found = language.predict(docs, model)
    return found.select(F.col("id").alias("doc_id"), (common.remainder(F.col("id"), 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_lm_scoring, op2_toxicity, op3_url_filter, op4_warc, op5_mixing, op6_mpeg_audio, op7_embedding_near_dedup, op8_bpe, op9_quality, op10_simhash_near_dedup, op11_compaction, op12_whitening, op13_language)
}
ORACLE_SQL: dict[str, str] = {"op3_url_filter": OP3_SQL, "op4_warc": OP4_SQL, "op5_mixing": OP5_SQL}
