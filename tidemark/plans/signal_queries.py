"""Rules that read messages, and counts over events and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signals as sg
from ..operators import extract
from ..schema import points
from ..session import table
from ..sources import tables
from ..streaming import events
from .common import POINTS, Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

#: The test texts hold few of these words, so each message starts with one of them, by its number.
OPENINGS = (
    "No, that's wrong.", "Ya te dije que nunca.", "From now on, always ask.", "`never` in code", "> never in a quote", "I prefer tea. We already have it.", "Guardalo en tu memoria", "this is out of scope",
    "see https://never.example/always now", "todas las pruebas las corremos aquí", "nothing here", "recuerdan recorda", "jamás", "rememberer", "debe ser así", "",
)
TURNS = (
    "User: Reply with exactly: PONG\nAssistant: pong.", "User: Say literally 'ok'\nAssistant: `ok`!", "User: Reply exactly PONG\nAssistant: Sure, PONG", "User: hello\nAssistant: hello", "Reply exactly PONG",
    "User: verbatim: a\nAssistant: a\nb", "User: exactly x\nAssistant: ...", "User: Exactamente 'sí'\nAssistant: Sí.\nAssistant: no",
)
TERMS = ("the", "LICENSE", "", "und", "zzz-absent")


def _array(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def unread_sql(text: str) -> str:
    """What the detector reads of a text."""
    for pattern in sg.UNREAD:
        text = f"regexp_replace({text}, '{pattern}', ' ', 'g')"
    return text


def hits_sql(t: str) -> str:
    """List of ``rule:kind`` that fire on what is read."""
    edge, word = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
    rules = []
    for name, kind, pattern in sg.USER_RULES:
        wide = pattern.replace(r"\w", r"[\p{L}\p{N}_]").replace("'", "''")
        full = f"(?i){pattern}" if name == "initial_no" else f"(?i){edge}(?:{wide}){word}"
        rules.append(f"CASE WHEN regexp_matches({t}, '{full}') THEN '{name}:{kind}' END")
    return f"list_filter([{', '.join(rules)}], lambda x: x IS NOT NULL)"


def _rules_sql() -> str:
    read = unread_sql(f"{_array(OPENINGS)}[1 + turn % {len(OPENINGS)}] || chr(10) || text")
    return f"""WITH c AS (SELECT conv_id, turn, {read} AS t FROM conversations), h AS (SELECT conv_id, turn, {hits_sql('t')} AS hits FROM c)
SELECT conv_id, turn, split_part(hits[1], ':', 2) AS kind, array_to_string(list_transform(hits, lambda x: split_part(x, ':', 1)), ',') AS rules FROM h"""


@R.add(_rules_sql())
def user_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    opening = F.element_at(F.array(*[F.lit(x) for x in OPENINGS]), (F.col("turn") % len(OPENINGS) + 1).cast("int"))
    found = sg.rules_fired(F.concat(opening, F.lit("\n"), F.col("text")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", found["kind"].alias("kind"), F.array_join(found["rules"], ",").alias("rules"))


#: Which of TURNS are scripted checks, worked out by hand.
PROBES = (0, 1)


@R.add(f"""SELECT conv_id, turn, CASE WHEN conv_id % 3 <> 0 THEN CASE WHEN conv_id % 3 = 1 THEN 'one_shot_session' ELSE '' END
WHEN (conv_id + turn) % {len(TURNS)} IN {PROBES} THEN 'echo_probe' ELSE '' END AS reason FROM conversations""")
def turn_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    text = F.element_at(F.array(*[F.lit(x) for x in TURNS]), ((c + F.col("turn")) % len(TURNS) + 1).cast("int"))
    source = F.when(c % 3 == 1, " OneShot").when(c % 3 == 2, "cli")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", sg.turn_noise(text, source.isNotNull(), source, ("oneshot",)).alias("reason"))


@R.add(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_concat(['lang-' || lang, source, 'x' || doc_id % 5], regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])#([A-Za-z0-9_/-]+)', 1)), ['end'])) , 'ASC'), ',') AS tags FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL""")
def front_matter_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    one = F.concat(F.lit("tags: [lang-"), "lang", F.lit(", '"), "source", F.lit("', x"), (i % 5).cast("string"), F.lit("]\n"))
    many = F.concat(F.lit("tags:\n - lang-"), "lang", F.lit("\n\n- \""), "source", F.lit("\"\n- #x"), (i % 5).cast("string"), F.lit("\nauthor: me\n- none\n"))
    head = F.concat(F.lit("---\ntitle: a\n"), F.when(i % 2 == 0, one).otherwise(many), F.lit("---\n"))
    rows = table(spark, sf_dir, "documents").where("text is not null and lang is not null and source is not null")
    return rows.select("doc_id", F.array_join(sg.tags(F.concat(head, "text", F.lit(" #end"))), ",").alias("tags"))


@R.add("SELECT doc_id, " + " || ".join(f"CASE WHEN contains(lower(coalesce(text, '')), '{t.lower()}') OR contains(lower(coalesce(source, '')), '{t.lower()}') THEN '{t},' ELSE '' END" for t in (*TERMS, "SRC1") if t) + " AS terms FROM documents")
def terms_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sg.terms_present([*TERMS, "SRC1"], F.col("text"), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(found, lambda t: F.concat(t, F.lit(","))), "").alias("terms"))


@R.add("""WITH g AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_ids, list_slice(list_sort(list(DISTINCT user_id) FILTER (WHERE user_id IS NOT NULL)), 1, 20) AS i FROM events GROUP BY event_type)
SELECT event_type, n, n_ids, array_to_string(i, ',') AS ids, n_ids > 20 AS truncated FROM g""")
def status_ids_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.capped_ids(table(spark, sf_dir, "events"), by="event_type", id_col="user_id", cap=20)
    return rows.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@R.add("SELECT count(*) AS n FROM events WHERE event_type = 'purchase' AND CAST(ts AS DATE) = (SELECT min(CAST(ts AS DATE)) FROM events)")
def applied_on_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    day = rows.agg(F.to_date(F.min("ts")).cast("string")).first()[0] or "1970-01-01"
    return events.count_on_day(rows, day=day, at="ts", where=F.col("event_type") == "purchase")


@R.add(f"WITH {POINTS} SELECT id, fact_status FROM points WHERE NOT (stale AND coalesce(fact_status = 'disputed', false))")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.delete_where(points(spark, sf_dir).select("id", "stale", "fact_status"), F.col("stale") & (F.col("fact_status") == "disputed")).select("id", "fact_status")


#: Lines put before each text, by its number, and what they say; worked out by hand.
SAID = (
    ("Decision: keep it.", "memory_candidate", "decision", "Decision: keep it.", 0.88), ("maybe decision: x", None, None, None, None), ("quirk - slow", "memory_candidate", "tool_quirk", "Tool quirk: slow.", 0.86),
    ("project invariant: one clock", "invariant_candidate", "project_invariant", "Project invariant: one clock.", 0.9), ("conflict resolved: b wins", "status_update_candidate", "assertion", "Resolved conflict: b wins.", 0.82),
    ("Actually, use b", "preference_candidate", "user_preference", "User preference/correction: use b.", 0.9), ("decision: my name is Z", None, None, None, None),
)


def _said(i: int, kind: str) -> str:
    return f"CASE doc_id % {len(SAID)} " + " ".join(f"WHEN {n} THEN " + ("NULL" if x[i] is None else f"CAST('{x[i]}' AS {kind})") for n, x in enumerate(SAID)) + " END"


@R.add(f"SELECT doc_id AS id, 3 AS line, {_said(1, 'VARCHAR')} AS candidate_type, {_said(2, 'VARCHAR')} AS memory_kind, {_said(3, 'VARCHAR')} AS text, {_said(4, 'DOUBLE')} AS confidence FROM documents WHERE {_said(1, 'VARCHAR')} IS NOT NULL")
def line_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(x[0]) for x in SAID]), (F.col("doc_id") % len(SAID) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("first\r\n\n"), said, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))
    return extract.line_signals(rows)


@R.add("""SELECT doc_id AS id, 2 AS line, 'entity' AS kind, 'doc' AS entity_type, source AS label, NULL AS relation, NULL AS target_type, NULL AS target FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL
UNION ALL SELECT doc_id, 3, 'edge', 'doc', source, 'WRITTEN_IN', 'lang', lang FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def graph_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("source is not null and lang is not null")
    marked = F.concat(F.lit("\nGraph entity: doc: "), "source", F.lit("\n graph edge : doc:"), "source", F.lit(" -[WRITTEN_IN]-> lang: "), "lang", F.lit("\n"), F.coalesce("text", F.lit("")))
    return extract.graph_markers(rows.select(F.col("doc_id").alias("id"), marked.alias("text")))


@R.add(r"""WITH c AS (SELECT doc_id, text, regexp_replace(substr(text, 1 + doc_id % 50, 60), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS k FROM documents), p AS (SELECT *, CASE WHEN k <> '' THEN strpos(text, k) END AS pos FROM c),
l AS (SELECT *, 1 + length(substr(text, 1, pos - 1)) - length(replace(substr(text, 1, pos - 1), chr(10), '')) AS a FROM p)
SELECT doc_id, a AS line_start, a + length(k) - length(replace(k, chr(10), '')) AS line_end, CASE WHEN pos IS NULL THEN 0 ELSE pos - 1 + length(k) END AS "end" FROM l""")
def locate_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.locate(F.col("text"), F.substr(F.col("text"), (F.col("doc_id") % 50 + 1).cast("int"), F.lit(60)), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("x")).select("doc_id", "x.line_start", "x.line_end", "x.end")


@R.add("""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, coalesce(role, '') AS role FROM conversations WHERE coalesce(text, '') <> '' AND coalesce(role, '') <> '')
SELECT conv_id, turn, 1 AS op, 'action+content+operations' AS shape, 'add' AS action, role AS target, text AS content, '' AS old_text FROM c WHERE turn % 2 = 0
UNION ALL SELECT conv_id, turn, 2, 'action+content+operations', 'remove', 'memory', '', role FROM c WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, 1, 'action+content', 'add', 'memory', text, '' FROM c WHERE turn % 2 = 1""")
def memory_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(F.lit("add").alias("action"), F.col("role").alias("target"), F.col("text").alias("content"), F.lit(None).cast("string").alias("old_text"))
    two = F.struct(F.lit("remove").alias("action"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("content"), F.col("role").alias("old_text"))
    args = F.to_json(F.struct(F.lit("add").alias("action"), F.col("text").alias("content"), F.when(F.col("turn") % 2 == 0, F.array(one, two)).alias("operations")))
    call = F.struct(F.col("turn").cast("string").alias("id"), F.struct(F.lit("memory").alias("name"), args.alias("arguments")).alias("function"))
    other = F.struct(F.lit("x").alias("id"), F.struct(F.lit("search").alias("name"), F.lit("{}").alias("arguments")).alias("function"))
    rows = table(spark, sf_dir, "conversations").where("coalesce(text, '') != '' and coalesce(role, '') != ''").select("conv_id", "turn", F.to_json(F.array(call, other)).alias("tool_calls"))
    return extract.memory_calls(rows).select("conv_id", "turn", "op", "shape", "action", "target", "content", "old_text")
