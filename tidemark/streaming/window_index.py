"""Incremental window index: increments give the same windows as a full rebuild.

The cursor of a session holds how many messages were indexed and the hash of their text. Sessions whose
indexed prefix is unchanged keep the windows that lie wholly in it; only windows from the last start
that reached its end are cut again. A session with a rewritten prefix is cut anew as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import windows


def cursor(messages: DataFrame) -> DataFrame:
    """(conv_id, n_messages, chars, prefix_hash) of what is indexed."""
    lines = windows.serialise(messages)
    return lines.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), F.sum(F.length("line")).alias("chars"), _hash().alias("prefix_hash"))


def _hash():
    """Order-free digest of lines with their places, so that it needs no text of a session in one place."""
    return F.sum(F.xxhash64("start", "line").cast("decimal(38,0)")).cast("string")


def advance(index: DataFrame, old: DataFrame, messages: DataFrame, width: int = 1000, overlap: int = 128) -> DataFrame:
    """The index after more messages: windows as :func:`windows.char_windows` gives them for all of them."""
    lines = windows.serialise(messages)
    known = lines.join(old, "conv_id", "left").withColumn("chars", F.coalesce("chars", F.lit(0)))
    prefix = known.where(F.col("start") < F.col("chars")).groupBy("conv_id").agg(_hash().alias("now"), F.sum(F.length("line")).alias("have"))
    state = lines.select("conv_id").distinct().join(old, "conv_id", "left").join(prefix, "conv_id", "left")
    intact = F.coalesce((F.col("now") == F.col("prefix_hash")) & (F.col("have") == F.col("chars")), F.lit(False))
    step = width - overlap
    # windows that ended within the indexed text for good: their start plus width is not beyond it
    frozen = F.when(intact, F.greatest(F.floor((F.col("chars") - width) / step) * step, F.lit(0))).otherwise(F.lit(0))
    state = state.select("conv_id", frozen.cast("long").alias("from_char")).withColumn("from_char", F.when(F.col("from_char") > 0, F.col("from_char")).otherwise(0))
    kept = index.join(state, "conv_id").where(F.col("char_start") < F.col("from_char")).drop("from_char")
    fresh = windows.char_windows(lines.join(state.where("from_char = 0").select("conv_id"), "conv_id", "left_semi"), width, overlap)
    tail = _tail(lines, state.where("from_char > 0"), width, overlap)
    return kept.unionByName(fresh).unionByName(tail)


def _tail(lines: DataFrame, state: DataFrame, width: int, overlap: int) -> DataFrame:
    """Windows from ``from_char`` on, cut from the lines that reach beyond it only."""
    later = lines.join(state, "conv_id").where(F.col("start") + F.length("line") > F.col("from_char"))
    cut = F.greatest(F.col("from_char") - F.col("start"), F.lit(0))
    moved = later.select("conv_id", "turn", F.expr("substring(line, cast(greatest(from_char - start, 0) + 1 as int))").alias("line"), (F.greatest(F.col("start"), F.col("from_char")) - F.col("from_char")).alias("start"), "from_char", cut.alias("_"))
    made = windows.char_windows(moved.select("conv_id", "turn", "line", "start"), width, overlap)
    return made.join(state, "conv_id").withColumn("char_start", F.col("char_start") + F.col("from_char")).drop("from_char").select("conv_id", "char_start", "first_turn", "last_turn", "text", "text_sha256")


def lag(messages: DataFrame, old: DataFrame) -> DataFrame:
    """(conv_id, behind): messages not indexed yet, for sessions that have any."""
    have = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).join(old.select("conv_id", "n_messages"), "conv_id", "left")
    return have.select("conv_id", (F.col("n") - F.coalesce("n_messages", F.lit(0))).alias("behind")).where("behind > 0")
