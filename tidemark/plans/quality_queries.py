"""Text rules, consolidation proposals, event logs and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import secrets
from ..functions import text as tx
from ..operators import consolidation, evaluate
from ..schema import NOW, points, visible
from ..session import table
from ..streaming import events as ev
from .common import POINTS, VISIBLE, Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
FP = rf"array_to_string(list_filter(list_transform(string_split(lower({FLAT}), ' '), lambda t: regexp_replace(t, '^[!-/:-@\[-`{{-~]+|[!-/:-@\[-`{{-~]+$', '', 'g')), lambda t: t <> ''), ' ')"


def _digest(column):
    return F.md5(column.cast("binary"))


@R.add(f"WITH {POINTS} SELECT id, md5({FP}) AS fp FROM points")
def text_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", _digest(tx.fingerprint(F.col("text"))).alias("fp"))


@R.add(f"WITH {POINTS} SELECT id, CASE WHEN length({FLAT}) > 240 THEN rtrim(substr({FLAT}, 1, 239)) || '…' ELSE {FLAT} END AS snippet FROM points")
def text_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", tx.snippet(F.col("text"), 240).alias("snippet"))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _placeholder_sql(v: str) -> str:
    def bare(x: str) -> str:
        return rf"regexp_replace(regexp_replace(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '[.,;:!?]+$', ''), '^\s+|\s+$', '', 'g')"

    once = bare(v)
    inner = f"""CASE WHEN length({once}) > 1 AND left({once}, 1) = right({once}, 1) AND left({once}, 1) IN ('"', '''', '`') THEN {bare(f"substr({once}, 2, length({once}) - 2)")} ELSE {once} END"""
    return f"lower({inner}) IN ({', '.join(_literal(p) for p in secrets.PLACEHOLDERS)})"


def secret_sql(text: str) -> str:
    """The secret rules over a column; the words that a loose value may not begin with are looked at afterwards."""
    plain = " OR ".join(f"regexp_matches({text}, '{p}')" for p in (r"(^|[^A-Za-z0-9_])sk-[A-Za-z0-9_-]{10,}", *secrets.SECRETS[1:]))

    def values(pattern: str) -> str:
        return f"regexp_extract_all({text}, {_literal('(?i)' + pattern)}, 1)"

    def loose(words: list[str]) -> str:
        return rf"NOT regexp_matches(v, '(?i)^(?:{'|'.join(words)})\b') AND NOT {_placeholder_sql('v')} AND length(v) >= 8 AND (regexp_matches(v, '\p{{Nd}}') OR length(regexp_replace(v, '[^\p{{L}}\p{{N}}]', '', 'g')) >= 16)"

    found = [
        (rf"(?:^|[^A-Za-z0-9]){secrets.NAMES}[ \t]*[:=][ \t]*{secrets.VALUE}", f"NOT {_placeholder_sql('v')}"),
        (rf"\b(?:access\s+)?token\s+{secrets.LOOSE}", loose(secrets.ABOUT_TOKENS)),
        (rf"\b(?:api[_-]?key|password|secret)\s+{secrets.LOOSE}", loose(secrets.ABOUT_CREDENTIALS)),
    ]
    return "(" + " OR ".join([plain, *(f"len(list_filter({values(p)}, lambda v: {rule})) > 0" for p, rule in found)]) + ")"


SECRET_SQL = secret_sql("text")


@R.add(f"WITH {POINTS} SELECT id, {SECRET_SQL} AS secret FROM points")
def secret_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", tx.has_secret(F.col("text")).alias("secret"))


@R.add()
def secret_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted texts; a text that still holds a secret afterwards is replaced as a whole."""
    rows = points(spark, sf_dir).withColumn("clean", secrets.redact(F.col("text")))
    return rows.select("id", (F.col("clean") != F.col("text")).alias("changed"), F.length("clean").alias("n_chars"), secrets.has_secret(F.col("clean")).alias("secret"))


#: Endings of a text, and what is left of them.
ENDINGS = (
    (' password: "hunter2"', f" password: {secrets.MARKER}"),
    (" api_key = [redacted].", " api_key = [redacted]."),
    (" the token budget of 1234567890", " the token budget of 1234567890"),
    (" access token q7r8s9t0u1", f" access token {secrets.MARKER}"),
    (" secret rotation 12345678", " secret rotation 12345678"),
    (" password plainword", " password plainword"),
    (" Bearer: Bearer abcdefghijklmnopqrst", f" Bearer: {secrets.MARKER}{secrets.MARKER}"),
)


@R.add(f"""WITH {POINTS} SELECT id, CASE id % 7 {' '.join(f"WHEN {i} THEN {_literal(after)}" for i, (_, after) in enumerate(ENDINGS))} END AS clean, id % 7 IN (0, 3, 6) AS secret FROM points""")
def secret_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments, placeholders, loose values and spans that overlap, one for each row."""
    rows = points(spark, sf_dir).select("id", F.element_at(F.array(*[F.lit(before) for before, _ in ENDINGS]), (F.col("id") % 7 + 1).cast("int")).alias("text"))
    return rows.select("id", secrets.redact(F.col("text")).alias("clean"), secrets.has_secret(F.col("text")).alias("secret"))


IMPORTANCE = f"""CASE WHEN regexp_matches(lower(coalesce(text, '')), '^\\s*{tx.TRIVIAL[1:-1]}\\s*$') THEN 1 ELSE greatest(1, least(10, s - CASE WHEN length(coalesce(text, '')) < 40 AND s < 8 THEN 2 ELSE 0 END)) END"""
_KEYWORD = " OR ".join(f"contains(lower(text), '{w}')" for w in tx.KEYWORDS)
SCORED = f"imp AS (SELECT *, 5 + CASE WHEN source IN ('src1', 'src2') THEN 2 ELSE 0 END + CASE WHEN {_KEYWORD} THEN 2 ELSE 0 END AS s FROM points)"


@R.add(f"WITH {POINTS}, {SCORED} SELECT id, {IMPORTANCE} AS importance FROM imp")
def importance_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", tx.importance(F.col("text"), F.col("source").isin("src1", "src2")).alias("importance"))


def _quoted(words):
    return ", ".join(f"'{w}'" for w in words)


@R.add()
def signal_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("|", tx.signal_tokens(F.col("text"))).alias("tokens"))


@R.add(r"""SELECT page_id, regexp_matches(url, '\b[A-Z][A-Z0-9]{1,9}-\d{1,8}\b') OR regexp_matches(url, '(?:/[A-Za-z0-9_.@:-]+){2,}') OR regexp_matches(url, '\b[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*){1,}\b')
OR regexp_matches(url, '\b[A-Za-z_][A-Za-z0-9_]*(?:::[A-Za-z_][A-Za-z0-9_]*){1,}\b') OR regexp_matches(url, '\b[A-Z][A-Za-z0-9_]*(?:Error|Exception|Warning|Failure)\b') OR regexp_matches(url, '\bHTTP\s*[1-5]\d{2}\b')
OR regexp_matches(url, '\b[A-Za-z]+_[A-Za-z0-9_]+\b') OR regexp_matches(url, '\b[a-z]+[A-Z][A-Za-z0-9]*\b') OR regexp_matches(url, '\b[A-Za-z]+[0-9][A-Za-z0-9]*\b') AS strong FROM pages""")
def strong_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.strong_signal(F.col("url")).alias("strong"))


@R.add(r"""WITH p AS (SELECT page_id, list_filter(regexp_split_to_array(regexp_replace(lower(regexp_replace(url, '[?#].*$', '')), '\.[a-z0-9]{1,10}$', ''), '/|::|\.'), lambda x: x <> '') AS parts FROM pages)
SELECT page_id, len(list_filter(range(1, len(parts)), lambda i: parts[i] = 'example' AND parts[i + 1] = 'com')) > 0 AS hit FROM p""")
def structural_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = tx.path_parts(F.regexp_replace("url", r"[?#].*$", ""))
    return table(spark, sf_dir, "pages").select("page_id", tx.aligned(F.array(F.lit("example"), F.lit("com")), parts).alias("hit"))


@R.add("""WITH h AS (SELECT doc_id, sha256(concat_ws(chr(10), source, text)) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uid FROM h""")
def point_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.digest_uuid(F.col("source"), F.col("text")).alias("uid"))


@R.add(f"""WITH {POINTS}, {VISIBLE}, f AS (SELECT id, importance, confidence, created_at, {FP} AS fp FROM visible), g AS (SELECT fp, CAST(count(*) AS INTEGER) AS n, arg_max(id, (importance, confidence, created_at, id)) AS canonical_id FROM f GROUP BY fp HAVING count(*) > 1)
SELECT id, 'duplicate-' || substr(sha256(fp), 1, 16) AS proposal_id, canonical_id, n FROM f JOIN g USING (fp)""")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each visible point that has copies, with its group."""
    return consolidation.exact_duplicates(visible(points(spark, sf_dir)))


TOKENS = rf"list_distinct(list_filter(string_split(lower({FLAT}), ' '), lambda t: t <> ''))"


@R.add(f"""WITH w AS (SELECT doc_id AS id, {TOKENS} AS w FROM documents), l AS (SELECT id, w, len(w) AS n FROM w WHERE len(w) > 0)
SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.w, b.w)) / (a.n + b.n - len(list_intersect(a.w, b.w)))::DOUBLE, 6) AS jaccard FROM l a JOIN l b ON a.id < b.id AND least(a.n, b.n) >= 0.92 * greatest(a.n, b.n)
WHERE len(list_intersect(a.w, b.w)) / (a.n + b.n - len(list_intersect(a.w, b.w)))::DOUBLE >= 0.92""")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of texts: groups of equal word sets are expanded."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return consolidation.expand_pairs(consolidation.jaccard_pairs(docs, 0.92)).withColumn("jaccard", F.round("jaccard", 6))


@R.add()
def greedy_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return consolidation.greedy_star(consolidation.jaccard_pairs(docs, 0.92))


@R.add(f"WITH {POINTS} SELECT id FROM points WHERE created_at <= TIMESTAMP '2024-05-01 00:00:00' - INTERVAL 90 DAYS AND importance < 4 AND access_count = 0 AND confidence <= 0.5")
def stale_low_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidation.stale_low_value(points(spark, sf_dir), "2024-05-01 00:00:00").select("id")


#: Links and validity of facts, and the pool of learnings, which the tables do not hold.
FACTS = f"""{POINTS}, facts AS (SELECT *, id % 4 = 3 AS learning, id % 2 = 1 AS promote, id % 10 = 9 AS promoted, CASE WHEN id % 13 = 0 THEN 'p' || (id + 1) WHEN id % 13 = 1 THEN ' ' END AS superseded_by,
  CASE WHEN id % 17 = 0 THEN 'p' || (id + 2) END AS invalidated_by, CASE WHEN id % 5 = 1 THEN created_at + INTERVAL 10 DAYS END AS valid_until FROM points),
current AS (SELECT *, CASE WHEN coalesce(fact_status, '') <> '' THEN fact_status WHEN stale THEN 'stale' ELSE 'active' END AS now_status FROM facts),
updates AS (SELECT *, CASE WHEN confidence < 0.6 THEN NULL WHEN stale AND now_status <> 'stale' THEN 1 WHEN coalesce(trim(superseded_by), '') <> '' AND now_status <> 'superseded' THEN 2 WHEN invalidated_by IS NOT NULL AND now_status <> 'disputed' THEN 3
  WHEN valid_until < TIMESTAMP '{NOW}' AND now_status NOT IN ('stale', 'superseded', 'deprecated') THEN 4 END AS rule FROM current)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    other = lambda n: F.concat(F.lit("p"), (i + n).cast("string"))
    return points(spark, sf_dir).withColumns({
        "learning": i % 4 == 3, "promote": i % 2 == 1, "promoted": i % 10 == 9, "superseded_by": F.when(i % 13 == 0, other(1)).when(i % 13 == 1, " "),
        "invalidated_by": F.when(i % 17 == 0, other(2)), "valid_until": F.when(i % 5 == 1, F.col("created_at") + F.expr("INTERVAL 10 DAYS")),
    })


@R.add(f"""WITH {FACTS} SELECT id, fact_status, ['stale', 'superseded', 'disputed', 'stale'][rule] AS new_status,
['payload stale flag is set', 'payload superseded_by link is set', 'payload invalidated_by link is set', 'valid_until is in the past'][rule] AS reason FROM updates WHERE rule IS NOT NULL""")
def status_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidation.status_updates(_facts(spark, sf_dir), NOW)


LIVE = "coalesce(fact_status NOT IN ('superseded', 'deprecated'), true)"


@R.add(f"WITH {POINTS} SELECT fact_key, count(*) AS n, count(DISTINCT {FP}) AS n_texts FROM points WHERE confidence >= 0.6 AND {LIVE} GROUP BY fact_key HAVING count(*) >= 2 AND count(DISTINCT {FP}) >= 2")
def fact_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidation.conflicts(points(spark, sf_dir))


@R.add(f"""WITH {POINTS}, k AS (SELECT * FROM points WHERE confidence >= 0.6), m AS (SELECT fact_key, arg_max(id, (created_at, importance, confidence, id)) AS m, max(created_at) AS at FROM k GROUP BY fact_key)
SELECT k.id, m.m AS superseded_by FROM k JOIN m ON k.fact_key = m.fact_key WHERE k.created_at < m.at AND {LIVE}""")
def fact_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidation.supersessions(points(spark, sf_dir))


@R.add(f"WITH {POINTS} SELECT fact_key, arg_max(id, (importance, confidence, created_at, id)) AS canonical_id, count(*) AS n FROM points GROUP BY fact_key")
def canonical_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).groupBy("fact_key").agg(F.max_by("id", F.struct("importance", "confidence", "created_at", "id")).alias("canonical_id"), F.count(F.lit(1)).alias("n"))


@R.add(f"WITH {POINTS} SELECT id FROM points WHERE confidence >= 0.85 AND importance >= 8 AND NOT ({SECRET_SQL})")
def promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidation.promotions(points(spark, sf_dir)).select("id")


#: A heading without its marks, and when it is noise.
BARE = r"trim(regexp_replace(flat, '^(#\s*)+', ''))"
HEADING = FP.replace(FLAT, BARE)
NOISE = f"""flat <> '' AND length(flat) <= 80 AND ({HEADING} IN ({_quoted(consolidation.KNOWN_HEADINGS)}) OR (starts_with(flat, '#') AND len(list_filter(string_split({HEADING}, ' '), lambda x: x <> '')) <= 4 AND NOT regexp_matches({BARE}, '[.!?;:]')))"""
#: Headings, known and other, and the beginnings of texts.
BEGIN = f"array_to_string(list_slice(string_split({FLAT}, ' '), 1, 3), ' ')"
HEADED = f"headed AS (SELECT id, CASE id % 5 WHEN 0 THEN '# ' || {BEGIN} WHEN 1 THEN '## Next handoff:' WHEN 2 THEN 'Notas' WHEN 3 THEN {BEGIN} ELSE text END AS text FROM points)"


@R.add(f"WITH {POINTS}, {HEADED}, h AS (SELECT id, {FLAT} AS flat FROM headed) SELECT id, {HEADING} IN ({_quoted(consolidation.KNOWN_HEADINGS)}) AS known FROM h WHERE {NOISE}")
def heading_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On texts of which some are cut down to headings."""
    begin = F.concat_ws(" ", F.slice(F.split(tx.collapse(F.col("text")), " "), 1, 3))
    i = F.col("id") % 5
    text = F.when(i == 0, F.concat(F.lit("# "), begin)).when(i == 1, "## Next handoff:").when(i == 2, "Notas").when(i == 3, begin).otherwise(F.col("text"))
    return consolidation.heading_noise(points(spark, sf_dir).withColumn("text", text)).select("id", "known")


#: Seeds of the greedy clusters of each pool: of the pairs whose ends are both free, the smallest end takes all that are linked to it.
SEEDS = f"""q AS MATERIALIZED (SELECT id, learning, list_distinct(list_filter(string_split({FP}, ' '), lambda t: t <> '')) AS w FROM facts WHERE NOT consolidation_quarantined AND id NOT IN (SELECT id FROM noise)),
pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM q a JOIN q b ON a.learning = b.learning AND a.id <> b.id AND len(a.w) > 0 AND least(len(a.w), len(b.w)) >= 0.92 * greatest(len(a.w), len(b.w))
  WHERE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE >= 0.92),
seeds AS (SELECT (SELECT min(a) FROM pairs) AS seed, (SELECT list(b) FROM pairs WHERE a = (SELECT min(a) FROM pairs)) || [(SELECT min(a) FROM pairs)] AS used
  UNION ALL SELECT n.seed, n.used || [n.seed] || (SELECT coalesce(list(b), []) FROM pairs WHERE a = n.seed) FROM (SELECT (SELECT min(a) FROM pairs WHERE NOT list_contains(s.used, a) AND NOT list_contains(s.used, b)) AS seed, s.used FROM seeds s) n WHERE n.seed IS NOT NULL)"""
REPORT = rf"""WITH RECURSIVE {FACTS}, noise AS (SELECT id FROM (SELECT id, {FLAT} AS flat FROM points) WHERE {NOISE}), {SEEDS},
clash AS (SELECT fact_key, min(created_at) < max(created_at) AS two FROM facts WHERE NOT learning AND confidence >= 0.6 AND {LIVE} GROUP BY fact_key HAVING count(*) >= 2 AND count(DISTINCT {FP}) >= 2),
again AS (SELECT fact_key FROM facts WHERE NOT learning AND confidence >= 0.6 GROUP BY fact_key HAVING count(*) >= 2 AND count(DISTINCT nullif({FP}, '')) >= 2),
k AS (SELECT 1 AS o, 'quality_warning' AS proposal_type, learning::INT AS pool, id AS nth, CAST(id AS VARCHAR) AS key FROM facts WHERE {SECRET_SQL}
UNION ALL SELECT 2, 'heading_noise', learning::INT, id, CAST(id AS VARCHAR) FROM facts WHERE id IN (SELECT id FROM noise) AND NOT consolidation_quarantined
UNION ALL SELECT 3 + learning::INT, 'duplicate_cluster', 0, id, CAST(id AS VARCHAR) FROM facts WHERE id IN (SELECT seed FROM seeds)
UNION ALL SELECT 5, 'stale_low_value', 0, id, CAST(id AS VARCHAR) FROM facts WHERE created_at <= TIMESTAMP '{NOW}' - INTERVAL 90 DAYS AND importance < 4 AND access_count = 0 AND confidence <= 0.5 AND NOT learning AND NOT consolidation_quarantined AND id NOT IN (SELECT id FROM noise)
UNION ALL SELECT 6, 'learning_promotion_candidate', 0, id, CAST(id AS VARCHAR) FROM facts WHERE learning AND promote AND NOT promoted AND confidence >= 0.85 AND importance >= 8 AND NOT ({SECRET_SQL})
UNION ALL SELECT 7, 'fact_status_update_candidate', 0, id, CAST(id AS VARCHAR) FROM updates WHERE rule IS NOT NULL AND NOT learning
UNION ALL SELECT 8, kind, 0, row_number() OVER (ORDER BY fact_key, kind), fact_key FROM (SELECT fact_key, unnest(['fact_conflict_candidate', 'fact_supersession_candidate'][1:1 + two::INT]) AS kind FROM clash)
UNION ALL SELECT 9, 'reconsolidation_candidate', 0, row_number() OVER (ORDER BY fact_key), fact_key FROM again),
n AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY pool, nth) AS n FROM k), c AS (SELECT * FROM n WHERE n <= CASE WHEN o >= 7 THEN 10 ELSE 1000 END ORDER BY o, n LIMIT 1000)"""


@R.add(f"{REPORT} SELECT proposal_type, key, CAST(row_number() OVER (ORDER BY o, n) AS INTEGER) AS position FROM c")
def consolidation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 1,000 proposals, 10 of each kind about facts: a report for reading."""
    return consolidation.report(_facts(spark, sf_dir), NOW, max_groups=1000)


@R.add(f"{REPORT} SELECT proposal_type, count(*) AS n FROM c GROUP BY proposal_type")
def consolidation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidation.report(_facts(spark, sf_dir), NOW, max_groups=1000).groupBy("proposal_type").agg(F.count(F.lit(1)).alias("n"))


@R.add(f"WITH {POINTS} SELECT id, consolidation_quarantined OR id % 50 = 3 AS consolidation_quarantined, CASE WHEN id % 50 = 3 THEN '2024-06-01' END AS until FROM points")
def quarantine_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir)
    done = consolidation.quarantine(rows, rows.where("id % 50 = 3").select("id"), "2024-06-01 00:00:00")
    return done.select("id", "consolidation_quarantined", F.date_format("quarantine_until", "yyyy-MM-dd").alias("until"))


@R.add("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, epoch_us(max(ts)) AS last_us, count(*) AS n_events FROM events GROUP BY user_id")
def event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = ev.fold(table(spark, sf_dir, "events"), key="user_id", at="ts", seq="event_id", kind="event_type")
    return state.select("user_id", "status", F.unix_micros(F.col("last_at").cast("timestamp")).alias("last_us"), "n_events")


@R.add("""WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS last_at FROM events GROUP BY user_id), m AS (SELECT max(ts) AS now FROM events)
SELECT user_id, CASE WHEN status = 'view' AND last_at + INTERVAL 2 DAYS <= TIMESTAMP '2024-01-20 00:00:00' THEN 'expired' ELSE status END AS status FROM s""")
def event_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = ev.fold(table(spark, sf_dir, "events"), key="user_id", at="ts", seq="event_id", kind="event_type")
    return ev.expire(state, now="2024-01-20 00:00:00", days=2, open_status="view").select("user_id", "status")


@R.add("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean_value, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean_k FROM events GROUP BY event_type")
def event_type_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.avg(k), 6).alias("mean_k"))


RUNS = """c AS (SELECT item_id AS case_id, [item_id * 7 % 100, item_id * 7 % 100 + 1] AS expected, [item_id * 3 % 100] AS forbidden FROM benchmark),
r AS (SELECT item_id AS case_id, CASE v WHEN 0 THEN 'dense' WHEN 1 THEN 'hybrid' ELSE 'tree' END AS variant, (item_id * 13 + v * 29) % 400 + 10.5::DOUBLE AS latency_ms,
  list_transform(range(0, 8), lambda i: (item_id * (7 - v) + i * (v + 1)) % 100) AS results, CAST(500 + item_id * 10 + v * 100 AS BIGINT) AS chars FROM benchmark, range(0, 3) t(v)),
s AS (SELECT r.case_id, variant, latency_ms, chars, len(list_intersect(results[1:5], expected)) > 0 AS hit_at_k, list_has_any(results[1:5], forbidden) AS wrong,
  CAST(coalesce(list_position(results, expected[1]), 0) AS BIGINT) AS first_position, round(len(list_intersect(results[1:5], expected)) / greatest(1.0::DOUBLE, chars / 1000.0::DOUBLE), 6) AS zoom FROM r JOIN c ON r.case_id = c.case_id)"""


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "benchmark").select("item_id")
    i = F.col("item_id")
    cases = items.select(i.alias("case_id"), F.array(i * 7 % 100, i * 7 % 100 + 1).alias("expected"), F.array(i * 3 % 100).alias("forbidden"))
    runs = items.withColumn("v", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        i.alias("case_id"), F.element_at(F.array(F.lit("dense"), F.lit("hybrid"), F.lit("tree")), F.col("v") + 1).alias("variant"), ((i * 13 + F.col("v") * 29) % 400 + 10.5).alias("latency_ms"),
        F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: (i * (7 - F.col("v")) + k * (F.col("v") + 1)) % 100).alias("results"), (500 + i * 10 + F.col("v") * 100).alias("chars"),
    )
    return runs, cases


@R.add(f"WITH {RUNS} SELECT * FROM s")
def eval_case_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.score_runs(*_runs(spark, sf_dir))


RATES = f"""{RUNS}, g AS (SELECT variant, count(*) AS runs, round(100.0::DOUBLE * sum(hit_at_k::INT) / count(hit_at_k), 4) AS hit_at_k_rate, round(100.0::DOUBLE * sum(wrong::INT) / count(wrong), 4) AS wrong_memory_rate,
  round(avg(chars), 2) AS mean_chars, round(avg(zoom), 6) AS mean_zoom, quantile_cont(latency_ms, 0.5) AS latency_p50, quantile_cont(latency_ms, 0.95) AS latency_p95 FROM s GROUP BY variant)"""


@R.add(f"WITH {RATES} SELECT * FROM g")
def eval_variant_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.variant_rates(evaluate.score_runs(*_runs(spark, sf_dir)))


_FLAGS = "latency_ms >= 400 AS errored, CASE WHEN case_id % 3 <> 0 THEN first_position BETWEEN 1 AND 5 END AS source_hit, CASE WHEN case_id % 2 = 0 THEN first_position = 1 END AS exact_hit, latency_ms <= 300 AS in_budget"
_PERCENT = "round(100.0::DOUBLE * count(*) FILTER (NOT errored AND {0}) / nullif(count(*) FILTER (NOT errored AND {1}), 0), 4)"
SUMMARY = f"""{RUNS}, f AS (SELECT *, {_FLAGS} FROM s), m AS (SELECT variant, count(*) AS case_count, count(*) FILTER (NOT errored) AS scored_count, count(*) FILTER (errored) AS errored_count,
  coalesce({_PERCENT.format('hit_at_k', 'true')}, 0) AS hit_at_k_rate, {_PERCENT.format('source_hit', 'source_hit IS NOT NULL')} AS source_hit_at_k_rate, {_PERCENT.format('exact_hit', 'exact_hit IS NOT NULL')} AS exact_identifier_hit_rate,
  coalesce({_PERCENT.format('wrong', 'true')}, 0) AS wrong_memory_rate, quantile_cont(latency_ms, 0.95) FILTER (NOT errored) AS latency_ms_p95, {_PERCENT.format('in_budget', 'in_budget IS NOT NULL')} AS latency_budget_pass_rate FROM f GROUP BY variant)"""


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    position = F.col("first_position")
    scores = evaluate.score_runs(*_runs(spark, sf_dir))
    return evaluate.summarise(scores.select(
        "variant", (F.col("latency_ms") >= 400).alias("errored"), "hit_at_k", F.when(F.col("case_id") % 3 != 0, position.between(1, 5)).alias("source_hit_at_k"),
        F.when(F.col("case_id") % 2 == 0, position == 1).alias("exact_identifier_hit"), F.col("wrong").alias("wrong_memory"), "latency_ms", (F.col("latency_ms") <= 300).alias("latency_budget_met"),
    ))


@R.add(f"WITH {SUMMARY} SELECT * FROM m")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir)


def _checks_sql() -> str:
    own = ("ge", "le")
    found = []
    for name, metric, kind, bound in evaluate.CHECKS:
        value = {"lift": f"{metric} - best_{metric}", "drop": f"greatest(0, best_{metric} - {metric})", "rise": f"greatest(0, {metric} - best_{metric})"}.get(kind, metric)
        known = f"{metric} IS NOT NULL" + (f" AND best_{metric} IS NOT NULL" if kind not in own else "")
        value = f"CASE WHEN {known} THEN {value} END"
        shown = value if kind in own else f"round({value}, 4)"
        found.append(f"{{'check_name': '{name}', 'actual': CAST({shown} AS DOUBLE), 'threshold': {bound}::DOUBLE, 'passed': coalesce({value} {'>=' if kind in ('ge', 'lift') else '<='} {bound}, false)}}")
    return f"SELECT unnest([{', '.join(found)}], recursive := true) FROM x"


@R.add(f"""WITH {SUMMARY}, b AS (SELECT max(hit_at_k_rate) AS best_hit_at_k_rate, max(source_hit_at_k_rate) AS best_source_hit_at_k_rate, max(exact_identifier_hit_rate) AS best_exact_identifier_hit_rate, min(wrong_memory_rate) AS best_wrong_memory_rate
FROM m WHERE variant IN ('dense', 'tree')), x AS (SELECT m.*, b.* FROM m, b WHERE variant = 'hybrid') {_checks_sql()}""")
def gate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.gate(_summary(spark, sf_dir), "hybrid", ["dense", "tree"])
