"""Sliding character windows over serialised sessions, and what is done to their hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def serialise(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, line, start): each message as a line and its offset in the session's text."""
    line = F.concat(F.upper("role"), F.lit(": "), tx.collapse(F.col("text")), F.lit("\n"))
    rows = messages.select("conv_id", "turn", line.alias("line"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.length("line")).over(before), F.lit(0)))


def window_starts(length, width: int, overlap: int):
    """Starts 0, step width - overlap, until a window reaches the end."""
    step = width - overlap
    last = F.greatest(F.ceil((length - width) / step), F.lit(0)) * step
    return F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step).cast("long"))


def char_windows(lines: DataFrame, width: int = 1000, overlap: int = 128) -> DataFrame:
    """(conv_id, char_start, first_turn, last_turn, text, text_sha256). A line is dealt to the windows it
    touches, so a long session is many small groups and never one text; windows are then joined up."""
    step = width - overlap
    whole = Window.partitionBy("conv_id")
    rows = lines.withColumn("length", F.length("line")).withColumn("total", F.sum(F.length("line")).over(whole))
    end = F.col("start") + F.col("length")
    last = F.greatest(F.ceil((F.col("total") - width) / step), F.lit(0))
    first = F.greatest(F.floor((F.col("start") - width) / step) + 1, F.lit(0))
    touched = rows.where("length > 0").withColumn("w", F.explode(F.sequence(F.least(first, last).cast("long"), F.least(F.floor((end - 1) / step), last).cast("long"))))
    a = F.greatest(F.col("w") * step, F.col("start"))
    b = F.least(F.col("w") * step + width, end)
    piece = F.substring("line", (a - F.col("start") + 1).cast("int"), (b - a).cast("int"))
    pieces = touched.where(b > a).select("conv_id", (F.col("w") * step).alias("char_start"), "turn", piece.alias("piece"))
    joined = pieces.groupBy("conv_id", "char_start").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "piece"))), lambda x: x["piece"]), "").alias("text"))
    return joined.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))


def collapse_exact(hits: DataFrame, *, key: str = "text_sha256", score: str = "score", cap: int = 10) -> DataFrame:
    """One row for each text: the copy of the highest score, newest first, with the number of copies and
    the newest ``cap`` others."""
    best = F.max_by(F.struct("conv_id", "char_start", score), F.struct(score, "conv_id", "char_start")).alias("best")
    copies = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("conv_id", "char_start")))), 1, cap).alias("copies")
    found = hits.groupBy(key).agg(best, F.count(F.lit(1)).alias("n_copies"), copies)
    return found.select(key, "best.*", "n_copies", (F.col("n_copies") > cap).alias("truncated"), F.size("copies").alias("n_listed"))


def expand_messages(hits: DataFrame, messages: DataFrame, around: int = 3) -> DataFrame:
    """Messages within ``around`` turns of a hit (conv_id, turn): an equi-join on a short range."""
    wanted = hits.select("conv_id", F.explode(F.sequence(F.col("turn") - around, F.col("turn") + around)).alias("turn")).distinct()
    return messages.join(wanted, ["conv_id", "turn"], "left_semi")


def eligible_sessions(rows: DataFrame, sessions: DataFrame, *, exclude: tuple[str, ...] = (), session: str = "conv_id") -> DataFrame:
    """Rows with the source of their session, null where it is not listed, without those of excluded sources."""
    joined = rows.join(sessions.select(session, F.col("source").alias("session_source")), session, "left")
    return joined.where(~F.coalesce("session_source", F.lit("")).isin(*exclude)) if exclude else joined
