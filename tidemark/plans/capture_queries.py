"""Capture of facts from conversations, as a table and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, table
from ..streaming import capture
from .common import Registry
from .quality_queries import secret_sql
from .signal_queries import OPENINGS, _array, hits_sql, unread_sql

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
OWNERS = ("ana",)


def _messages(rows: DataFrame) -> DataFrame:
    """Conversations of five owners, six hours apart; every fourth turn says one of some short things, others are as they stand."""
    conv, turn = F.col("conv_id"), F.col("turn")
    short = F.concat(F.element_at(F.array(*[F.lit(x) for x in OPENINGS]), ((conv + turn) % len(OPENINGS) + 1).cast("int")), F.lit(" item "), (conv % 3).cast("string"))
    return rows.select(
        (conv % 5).cast("string").alias("key"), conv.alias("session_id"), (conv * 100 + turn).alias("msg_id"), F.timestamp_seconds(F.lit(1704067200) + conv * 21600 + turn * 60).alias("ts"),
        F.when(conv % 11 == 4, "same").otherwise(F.concat_ws("-", conv.cast("string"), turn.cast("string"))).alias("uid"), "role", F.when(turn % 4 == 0, short).otherwise(F.col("text")).alias("content"),
        F.when(conv % 7 == 0, F.when(conv % 14 == 0, " Ana").otherwise("bot")).alias("sender"), F.when(conv % 13 == 0, "group").otherwise("DM").alias("chat_type"),
    )


_FLAT = r"trim(regexp_replace(content, '\s+', ' ', 'g'))"
_ENDS = r"""^[ .;:,!¡?¿"''`]+|[ .;:,!¡?¿"''`]+$"""
ROUTES = rf"""WITH RECURSIVE m AS (SELECT CAST(conv_id % 5 AS VARCHAR) AS key, conv_id AS s, conv_id * 100 + turn AS msg_id, TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id * 6) + to_minutes(turn) AS ts,
  CASE WHEN conv_id % 11 = 4 THEN 'same' ELSE conv_id || '-' || turn END AS uid, CASE WHEN turn % 4 = 0 THEN {_array(OPENINGS)}[1 + (conv_id + turn) % {len(OPENINGS)}] || ' item ' || (conv_id % 3) ELSE text END AS content,
  conv_id % 14 = 0 OR (conv_id % 7 <> 0 AND conv_id % 13 <> 0) AS owner FROM conversations WHERE role = 'user'),
r AS (SELECT *, {unread_sql('content')} AS t, {_FLAT} AS flat FROM m), k AS (SELECT *, nullif(split_part(coalesce({hits_sql('t')}[1], ''), ':', 2), '') AS kind, regexp_replace(lower(flat), '{_ENDS}', '', 'g') AS fk FROM r),
j AS (SELECT *, sha256(concat_ws(chr(31), 'capture-v1', s, msg_id, kind, fk)) AS candidate_id, CASE WHEN NOT owner THEN 'not_owner' WHEN kind IS NULL THEN 'not_detected' WHEN {secret_sql('flat')} THEN 'possible_secret'
  WHEN length(flat) > 280 THEN 'too_long' WHEN len(string_split(flat, ' ')) < 3 THEN 'too_short' END AS reason FROM k),
c AS MATERIALIZED (SELECT * FROM j WHERE reason IS NULL),
h AS (SELECT key, fk, min(msg_id) AS msg_id, arg_min(ts, msg_id) AS ts FROM c GROUP BY key, fk UNION ALL (SELECT c.key, c.fk, min(c.msg_id), arg_min(c.ts, c.msg_id) FROM h JOIN c ON c.key = h.key AND c.fk = h.fk AND c.ts >= h.ts + INTERVAL 21 DAYS GROUP BY c.key, c.fk)),
p AS (SELECT c.*, max(h.msg_id) AS head FROM c JOIN h ON h.key = c.key AND h.fk = c.fk AND h.msg_id <= c.msg_id GROUP BY ALL),
o AS (SELECT p.*, q.candidate_id AS head_id, q.uid = p.uid AS clone FROM p JOIN c q ON q.msg_id = p.head)
SELECT key, msg_id, candidate_id, kind, 'drop' AS route, reason, NULL AS into FROM j WHERE reason IS NOT NULL UNION ALL
SELECT key, msg_id, candidate_id, kind, CASE WHEN msg_id = head THEN 'review' WHEN clone THEN 'drop' ELSE 'merge_queued' END, CASE WHEN msg_id <> head AND clone THEN 'compaction_clone' END, CASE WHEN msg_id <> head AND NOT clone THEN head_id END FROM o"""


@R.add(ROUTES)
def capture_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route or drop reason of each message of a user, from the table as a whole."""
    return capture.route(capture.judge(_messages(table(spark, sf_dir, "conversations")), OWNERS)).where("route != 'expired'")


@R.add()
def capture_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of three parts, each read by a query of its own on one checkpoint; what expired is there too."""
    folder = f"{shared_folder(spark)}/tidemark/capture-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "conversations")
    a, b = rows.approxQuantile("conv_id", [0.3, 0.7], 0.01) or (0.0, 0.0)
    part = F.when(F.col("conv_id") <= a, 0).when(F.col("conv_id") <= b, 1).otherwise(2)
    for n in range(3):  # parts come in order of time, as a log is written
        rows.where(part == n).write.mode("append").parquet(f"{folder}/log")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/log")
        capture.start(capture.judge(_messages(stream), OWNERS), f"{folder}/routes", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/routes")
