"""Prompt blocks and context packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import packet
from ..schema import points
from ..session import table
from .common import POINTS, Registry
from .quality_queries import secret_sql

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

HEADER = packet.HEADER.replace("'", "''")
FLAT = r"trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))"


def _block_sql(items: str, lead: str) -> str:
    """items: a CTE o(conv_id, n, text, section, about); lead: SQL over r (so far) and o (the next item)."""
    room = f"(1200 - length(r.block) - length({lead}))"
    keep = f"({room} - {len(packet.MARKER)})"
    return f"""WITH RECURSIVE {items},
r AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, '{HEADER}' AS block, 0 AS shown, false AS cut, '' AS section FROM o
UNION ALL SELECT o.conv_id, o.n, CASE WHEN r.cut THEN r.block WHEN length(o.text) <= {room} THEN r.block || {lead} || o.text WHEN {keep} >= {packet.MIN_CUT} THEN r.block || {lead} || rtrim(substring(o.text, 1, {keep})) || '{packet.MARKER}' ELSE r.block END,
CASE WHEN NOT r.cut AND (length(o.text) <= {room} OR {keep} >= {packet.MIN_CUT}) THEN r.shown + 1 ELSE r.shown END, r.cut OR (length(o.text) > {room} AND {keep} >= {packet.MIN_CUT}),
CASE WHEN NOT r.cut AND (length(o.text) <= {room} OR {keep} >= {packet.MIN_CUT}) THEN o.section ELSE r.section END FROM r JOIN o ON o.conv_id = r.conv_id AND o.n = r.n + 1)
SELECT conv_id, CASE WHEN shown > 0 THEN regexp_replace(block, '\\s+$', '') ELSE '' END AS block, shown, cut FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1"""


@R.add(_block_sql(
    rf"""o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, {FLAT} AS text, '' AS section,
'. [' || strftime(TIMESTAMP '2024-01-01' + to_days(CAST(conv_id % 300 AS INTEGER)), '%Y-%m-%d') || ' | importance=' || CASE WHEN turn % 5 = 4 THEN '?' ELSE CAST(1 + turn % 10 AS VARCHAR) END || ' | score=' || printf('%.3f', 1.0::DOUBLE / (1 + turn)) ||
CASE WHEN turn % 3 = 1 THEN ' | kind=' || role ELSE '' END || ' | source=' || role || ' | talk/' || conv_id || CASE WHEN turn % 4 = 2 THEN ' | heading=turn ' || turn ELSE '' END || ']' || chr(10) || '   ' AS about FROM conversations)""",
    "(chr(10) || chr(10) || CAST(r.shown + 1 AS VARCHAR) || o.about)",
))
def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation as ranked memories."""
    turn = F.col("turn")
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", turn.alias("rank"), "text", F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") % 300 * 86400).alias("created_at"),
        F.when(turn % 5 != 4, 1 + turn % 10).cast("int").alias("importance"), (1.0 / (1 + turn)).alias("score"), F.col("role").alias("source_type"), F.when(turn % 3 == 1, F.col("role")).alias("memory_kind"),
        F.lit(None).cast("string").alias("fact_status"), F.concat(F.lit("talk/"), F.col("conv_id").cast("string")).alias("file_path"), F.when(turn % 4 == 2, F.concat(F.lit("turn "), turn.cast("string"))).alias("heading"),
    )
    return packet.prompt_block(rows, group="conv_id")


@R.add(_block_sql(
    f"""l AS (SELECT conv_id, turn, {FLAT} AS text, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 WHEN 'assistant' THEN 3 ELSE 4 END AS place FROM conversations WHERE {FLAT} <> '' AND NOT {secret_sql('text')}),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place, turn) AS n, text, CASE place WHEN 1 THEN 'Summaries' WHEN 2 THEN 'Relevant Memories' WHEN 3 THEN 'Source Evidence' ELSE 'Related Connections' END AS section FROM l)""",
    "(CASE WHEN r.section = o.section THEN chr(10) || '- ' ELSE chr(10) || chr(10) || '## ' || o.section || chr(10) || chr(10) || '- ' END)",
))
def section_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.col("role")
    lane = F.when(role == "system", "summaries").when(role == "user", "exact_hits").when(role == "assistant", "cited_leaves").otherwise("graph_relations")
    return packet.section_block(table(spark, sf_dir, "conversations").select("conv_id", lane.alias("lane"), F.col("turn").alias("rank"), "text"), group="conv_id")


RESULTS = f"""WITH {POINTS}, ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY fact_key ORDER BY importance DESC, id) AS INTEGER) AS place FROM points QUALIFY place <= 6),
e AS (SELECT fact_key AS packet, place, CASE WHEN id % 5 = 0 OR id % 10 = 3 THEN 'extracted_assertion' WHEN id % 5 = 1 OR id % 7 = 3 OR id % 8 = 5 THEN 'generated_summary' ELSE 'source_text' END AS section, CAST(id AS VARCHAR) AS point_id,
CASE WHEN id % 6 = 1 THEN 'vault://' || id WHEN id % 4 = 0 THEN 'https://' || source || '/' || id % 3 ELSE 'memory://point/' || id END AS source_uri, CASE WHEN id % 10 = 3 THEN 'claim of ' || source ELSE coalesce(text, '') END AS text,
stale OR coalesce(fact_status = 'stale', false) AS stale, requires_review AS review_required, coalesce(fact_status = 'disputed', false) AS disputed, coalesce(fact_status = 'superseded', false) OR id % 13 = 0 AS superseded FROM ranked)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each fact key the six points of most importance, the packet of a topic."""
    i = F.col("id")
    text = i.cast("string")
    best = points(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("fact_key").orderBy(F.desc("importance"), "id"))).where("rank <= 6")
    return best.select(
        F.col("fact_key").alias("packet"), "rank", i.alias("point_id"), "text", F.when(i % 10 == 3, F.concat(F.lit("claim of "), F.col("source"))).alias("claim_text"),
        F.when(i % 5 == 0, "assertion").when(i % 5 == 1, " Summary ").alias("memory_kind"), F.when(i % 7 == 3, "summary").alias("source_type"), F.when(i % 8 == 5, "Summarization").alias("derivation_type"),
        F.when(i % 6 == 1, F.concat(F.lit("vault://"), text)).alias("source_uri"), F.when(i % 4 == 0, F.concat(F.lit("https://"), F.col("source"), F.lit("/"), (i % 3).cast("string"))).otherwise(F.col("source")).alias("source"),
        "fact_status", "stale", "requires_review", F.when(i % 13 == 0, F.array(F.lit(""), text)).alias("superseded_by"), F.when(i % 17 == 0, F.array(F.lit(" "))).alias("invalidated_by"),
    )


@R.add(f"{RESULTS} SELECT packet, place, section, point_id, source_uri, md5(text) AS text_md5, stale, review_required, disputed, superseded FROM e")
def context_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packet.context_entries(_results(spark, sf_dir)).withColumn("text_md5", F.md5(F.col("text").cast("binary"))).drop("text")


@R.add(f"""{RESULTS}, u AS (SELECT packet, source_uri, min(place) AS first FROM e GROUP BY 1, 2), us AS (SELECT packet, string_agg(source_uri, ',' ORDER BY first) AS source_uris FROM u GROUP BY 1)
SELECT e.packet, CAST(count(*) AS INTEGER) AS n_results, string_agg(point_id, ',' ORDER BY place) AS point_ids, any_value(us.source_uris) AS source_uris, bool_or(stale) AS stale, bool_or(review_required) AS review_required, bool_or(disputed) AS disputed, bool_or(superseded) AS superseded,
CAST(1 + bool_or(stale)::INT + bool_or(review_required)::INT + bool_or(disputed)::INT + bool_or(superseded)::INT AS INTEGER) AS n_warnings, string_agg(CASE section WHEN 'extracted_assertion' THEN point_id END, ',' ORDER BY place) AS assertions FROM e JOIN us ON us.packet = e.packet GROUP BY 1""")
def context_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packet.context_packets(packet.context_entries(_results(spark, sf_dir)))
    quoted = F.array_join(F.transform("sections.extracted_assertion", lambda e: e["point_id"]), ",")
    return found.select("packet", "n_results", F.array_join("point_ids", ",").alias("point_ids"), F.array_join("source_uris", ",").alias("source_uris"), *packet.FLAGS, F.size("warnings").alias("n_warnings"), F.nullif(quoted, F.lit("")).alias("assertions"))
