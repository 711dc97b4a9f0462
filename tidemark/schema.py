"""The data model: points (text, vector, payload), and views of the test tables as points.

The test tables hold no payload, so payload columns are derived by expressions that any SQL engine
evaluates alike. Every operator takes the column names it needs as given here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import table

# Fixed values of the reference's vocabularies.
HIDDEN_STATUSES = ("deprecated", "superseded")
PENALISED_STATUSES = ("stale", "review_required", "disputed", "superseded", "deprecated")
TERMINAL_STATUSES = ("superseded", "deprecated")
REVIEW_TERMS = ("review", "history", "historical", "stale", "deprecated", "superseded", "disputed", "conflict", "conflicting", "audit", "provenance")

#: The clock of the test queries; operators take ``now`` as a parameter and never read the wall clock.
NOW = "2024-03-01 00:00:00"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents joined with labels as memory points."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    i = F.col("doc_id")
    status = F.element_at(F.array(*[F.lit(x) for x in ("active", "stale", "superseded", "disputed", "deprecated")]), (i % 6).cast("int"))
    return docs.join(labels, "doc_id", "left").select(
        i.alias("id"), "text", "source", F.col("lang").alias("profile_id"),
        F.timestamp_seconds(F.lit(1704067200) + i * 3600).alias("created_at"),
        (1 + i % 10).cast("int").alias("importance"), (i % 3).cast("int").alias("access_count"), ((i % 10) / 10.0).alias("confidence"),
        (i % 7 == 0).alias("stale"), (i % 11 == 0).alias("requires_review"), F.when(i % 6 != 0, status).alias("fact_status"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("canonical"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("consolidation_quarantined"),
        F.filter(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("src:"), "source"), F.when(i % 2 == 0, F.lit("even"))), lambda t: t.isNotNull()).alias("tags"),
        F.concat(F.lit("fact-"), (i % 97).cast("string")).alias("fact_key"),
    )


def visible(df: DataFrame, include_history: bool = False) -> DataFrame:
    """Rows that a read may return: not quarantined, and no hidden status unless history is asked for.
    Applied before any limit, so hidden rows take no place in a top-k."""
    shown = df.where(~F.col("consolidation_quarantined"))
    return shown if include_history else shown.where(F.coalesce(~F.col("fact_status").isin(*HIDDEN_STATUSES), F.lit(True)))


def asks_for_history(query: str) -> bool:
    return any(term in query.casefold() for term in REVIEW_TERMS)


def scoped(df: DataFrame, **scope: str) -> DataFrame:
    """Fail-closed equality on scope columns; a missing value is the empty text, never a wildcard."""
    for name, value in scope.items():
        df = df.where(F.coalesce(F.col(name), F.lit("")) == value)
    return df


def now_column(now: str) -> Column:
    return F.lit(now).cast("timestamp")
