"""A corpus pipeline of five operators: toxicity, quality, SimHash near-dedup, mixing, BPE.

Each stage is a function (spark, docs, sf_dir) to a DataFrame that is written as Parquet and reread as
the next one's ``docs``. All but the last return the columns of ``docs``:

* toxicity: drops documents that score 0.7 or more by their nearest labelled examples;
* quality: drops documents that score below 0.3 by the positive-unlabelled classifier;
* simhash_near_dedup: keeps one document of each group of near-duplicates, that with the smallest id (nulls last);
* mixing: repeats or leaves out documents, whole, as the mix of sources takes them, in curriculum order;
* bpe: ids and decoded text of every document left, with its id and source.

Labels come from ``sf_dir``; the classifiers learn from the same rows as op2 and op9, found among the
documents that reach the stage. Labels are by id, so rows without an id are judged but teach nothing.
Each stage gives its rows keys of their own and decides by them, so rows whose ids are null or repeated are
judged one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe as bpe_codec
from tidemark.llm import common, mixing, quality, simhash
from tidemark.llm import toxicity as toxic_votes
from tidemark.llm.queries import vocabulary
from tidemark.session import table

ORACLE_SQL = None


def _drop(docs: DataFrame, key: str, rejected: DataFrame) -> DataFrame:
    """Keyed docs without the rows whose key is in ``rejected``. Keys are narrow: the texts are only moved
    where the rejected rows are too many for a broadcast."""
    return docs.join(rejected, key, "left_anti").drop(key)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below 0.7. Null and empty texts are scored as empty; without labels all rows stay; no rows, none."""
    docs, row = common.keyed(docs, "toxicity-docs")
    scored = toxic_votes.score(docs, table(spark, sf_dir, "labels"), common.remainder(F.col("doc_id"), 3) != 1, key_col=row)
    return _drop(docs, row, common.materialise(scored.where("score >= 0.7").select(F.col("key").alias(row)), "pipeline-toxic"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.3 or more. Null and empty texts are scored as empty; without positives all rows stay; no rows, none."""
    docs, row = common.keyed(docs, "quality-docs")
    good = quality.trusted(table(spark, sf_dir, "labels"), common.remainder(F.col("doc_id"), 5) != 0)
    scored = quality.score(docs, quality.train(docs, good), id_col=row)
    return _drop(docs, row, common.materialise(scored.where("score < 0.3").select(F.col("id").alias(row)), "pipeline-bad"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the smallest id, nulls last, any one of equal ids. Texts without words are one group."""
    docs, row = common.keyed(docs, "simhash-docs")
    groups = simhash.simhash_groups(docs, id_col=row).select(F.col("id").alias(row), "component_id")
    groups = common.materialise(groups.join(docs.select(row, "doc_id"), row), "pipeline-groups")
    kept = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row))).alias("m")).select(F.col(f"m.{row}").alias(row))
    return _drop(docs, row, common.materialise(groups.join(kept, row, "left_anti").select(row), "pipeline-copies"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, null ids and sources included; texts without words are never taken."""
    return mixing.copies(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every row, with its id and source; null texts are empty."""
    return bpe_codec.encode(docs, vocabulary(), keep=("source",)).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxicity), ("quality", quality_filter), ("simhash_near_dedup", simhash_near_dedup), ("mixing", mix), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
