"""Capture of facts from messages: rules for each row, then one state for each owner of a queue.

Rows are judged by column expressions first (who wrote it, which rule fires, secrets, length). Candidates then
meet the state of their key: a cursor, the last message that was read, and the facts that wait for review, each with
when it was queued. The first candidate of a fact goes to review; the same fact again is merged into it, or dropped where it
is the same message under another id; a fact that waited ``days`` is expired, and the next one goes to review again.

``route`` runs on a stream or on a table. On a stream the state lives in the checkpoint, so a query that is stopped, or
killed between batches, goes on where it was; rows at or before the cursor are not read twice. Expiry is decided by the rows'
own times, so cutting the rows into other batches changes nothing as long as a key's rows arrive in order of
their ids; one timer a key, at the earliest expiry, clears the state and emits the expired items when the watermark passes.

Null texts are empty; rows without an id or a time are dropped before the state (``unreadable``); a null key is a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import payload as pl
from ..functions import signals
from ..functions import text as tx

# Fixed limits of a fact.
MAX_CHARS, MIN_WORDS, REVIEW_DAYS = 280, 3, 21
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROUTED = "key string, msg_id long, candidate_id string, kind string, route string, reason string, into string"


def fact_key(fact: Column) -> Column:
    """Lower case, single spaces, no punctuation at the ends."""
    flat = tx.collapse(F.lower(F.coalesce(fact, F.lit(""))))
    return F.regexp_replace(flat, r"""^[ .;:,!¡?¿"'`]+|[ .;:,!¡?¿"'`]+$""", "")


def judge(messages: DataFrame, owners: tuple[str, ...], *, stored: DataFrame | None = None) -> DataFrame:
    """messages: (key, session_id, msg_id, ts, uid, role, content, sender, chat_type). Adds kind, fact_key, candidate_id and ``reason``, why a row
    is no candidate (null: it is one); rows of other roles are left out. stored: (candidate_id), what was captured before."""
    fact = tx.collapse(F.coalesce("content", F.lit("")))
    kind = signals.rules_fired(F.col("content"))["kind"]
    rows = messages.where("role = 'user'").withColumns({"kind": kind, "_fact": fact})
    rules = (
        (F.col("msg_id").isNull() | F.col("ts").isNull(), "unreadable"), (~pl.owner_row(F.col("sender"), F.col("chat_type"), owners), "not_owner"), (F.col("kind").isNull(), "not_detected"),
        (tx.has_secret(F.col("_fact")), "possible_secret"), (F.length("_fact") > MAX_CHARS, "too_long"), (F.size(F.split("_fact", " ")) < MIN_WORDS, "too_short"),
    )
    reason = F
    for when, why in rules:
        reason = reason.when(when, why)
    rows = rows.withColumn("reason", reason).withColumn("fact_key", fact_key(F.col("_fact")))
    material = F.concat_ws("\x1f", F.lit("capture-v1"), F.col("session_id").cast("string"), F.col("msg_id").cast("string"), "kind", "fact_key")
    rows = rows.withColumn("candidate_id", F.sha2(material.cast("binary"), 256)).withColumn("key", F.col("key").cast("string"))
    rows = rows.select("key", "session_id", "msg_id", F.col("ts").cast("timestamp").alias("ts"), F.col("uid").cast("string").alias("uid"), "kind", "fact_key", "candidate_id", "reason")
    if stored is None:
        return rows.withColumn("stored", F.lit(False))
    return rows.join(stored.select("candidate_id", F.lit(True).alias("stored")).distinct(), "candidate_id", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))


class Review(StatefulProcessor):
    """The queue of one key."""

    def __init__(self, days: int, timed: bool):
        self.span, self.timed = days * 86_400_000, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cursor = handle.getValueState("cursor", "msg_id long")
        self.waiting = handle.getMapState("waiting", "fact_key string", "candidate_id string, uid string, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["msg_id", "candidate_id"])
        last = self.cursor.get()[0] if self.cursor.exists() else None
        out = []
        for row in frame.itertuples(index=False):
            if last is not None and row.msg_id <= last:
                continue
            last, at = int(row.msg_id), int(row.ts.timestamp() * 1000)
            found = self.waiting.getValue((row.fact_key,)) if self.waiting.containsKey((row.fact_key,)) else None
            if found is not None and found[2] + self.span <= at:
                out.append((key[0], None, found[0], None, "expired", None, None))
                found = None
            if found is not None and found[1] == row.uid:
                out.append((key[0], last, row.candidate_id, row.kind, "drop", "compaction_clone", None))
            elif found is not None:
                out.append((key[0], last, row.candidate_id, row.kind, "merge_queued", None, found[0]))
            elif row.stored:
                out.append((key[0], last, row.candidate_id, row.kind, "drop", "already_stored", None))
            else:
                self.waiting.updateValue((row.fact_key,), (row.candidate_id, row.uid, at))
                out.append((key[0], last, row.candidate_id, row.kind, "review", None, None))
        if last is not None:
            self.cursor.update((last,))
        self._set_timer()
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for name, item in sorted(self.waiting.iterator()):
            if item[2] + self.span <= now:
                out.append((key[0], None, item[0], None, "expired", None, None))
                self.waiting.removeKey(name)
        self._set_timer()
        yield _frame(out)

    def _set_timer(self) -> None:
        if not self.timed:
            return
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        due = [item[2] + self.span for _, item in self.waiting.iterator()]
        if due:
            self.handle.registerTimer(min(due))

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [part.split()[0] for part in ROUTED.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({"msg_id": "Int64"})


def route(judged: DataFrame, *, days: int = REVIEW_DAYS, delay: str = "1 hour") -> DataFrame:
    """(key, msg_id, candidate_id, kind, route, reason, into) of a stream or table as :func:`judge` gives it: what the rules dropped, and
    what the state made of the candidates. An expired item is a row without a message; on a table only those are told that a later row of
    their fact met. The state store has to be RocksDB (set here for the session)."""
    judged.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    _ = judged.sparkSession.streams.active  # a table's states are kept by the same coordinator, which this starts
    dropped = judged.where("reason IS NOT NULL").select("key", "msg_id", "candidate_id", "kind", F.lit("drop").alias("route"), "reason", F.lit(None).cast("string").alias("into"))
    candidates = judged.where("reason IS NULL").select("key", "msg_id", "ts", "uid", "kind", "fact_key", "candidate_id", "stored")
    if judged.isStreaming:
        candidates = candidates.withWatermark("ts", delay)
    kept = candidates.groupBy("key").transformWithStateInPandas(Review(days, judged.isStreaming), ROUTED, "Append", "EventTime" if judged.isStreaming else "None")
    return kept.unionByName(dropped)


def start(judged: DataFrame, sink: str, checkpoint: str, **options):
    """One run over all that is there, appended to ``sink`` exactly once; a later run on the same checkpoint goes on."""
    return route(judged, **options).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
