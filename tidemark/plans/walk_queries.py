"""Nested payloads, sensitive topics, and origins of memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import jsonwalk, secrets, signals
from ..operators import graph, origin, tree
from ..schema import points
from ..session import shared_folder, table
from .common import Registry
from .quality_queries import SECRET_SQL
from .structure_queries import NODES, _nodes

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nested payloads: whole texts deep inside, quotes and line ends in keys and values, names of credentials."""
    i = F.col("doc_id")
    inner = F.struct(F.col("text").alias("note"), F.array(F.lit("a"), F.array_join(F.array(F.lit('q"u'), "source"), "\n")).alias("list"))
    deep = F.struct(i.alias("id"), F.array(inner, F.struct(F.lit("x").alias("note"), F.array().cast("array<string>").alias("list"))).alias("rows"))
    more = F.struct(F.struct(F.array(F.struct(F.lit(1).alias("n"))).alias("list")).alias("API_Token"), (i % 2 == 0).alias("contains_secret_text"), F.when(i % 3 == 0, "true").otherwise("no bearer").alias("said"), i.alias("Secret_Bearing"))
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(deep.alias("deep"), more.alias("more"))).alias("payload"))


@R.add(f"SELECT doc_id, {SECRET_SQL} AS secret FROM documents")
def json_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _payloads(spark, sf_dir).select("doc_id", jsonwalk.any_secret(F.col("payload")).alias("secret"))


@R.add(f"""SELECT doc_id, md5(CASE WHEN {SECRET_SQL} OR contains(lower(text), 'bearer') THEN '{secrets.MARKER}' ELSE text END) AS note, 'q"u' || chr(10) || source AS second, '{secrets.MARKER}' AS token,
doc_id % 2 = 0 AS flag, CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE '{secrets.MARKER}' END AS said, '{secrets.MARKER}' AS bearing FROM documents""")
def json_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = _payloads(spark, sf_dir).select("doc_id", jsonwalk.redact(F.col("payload")).alias("p"))
    at = lambda path: F.get_json_object("p", path)
    return clean.select(
        "doc_id", F.md5(at("$.deep.rows[0].note").cast("binary")).alias("note"), at("$.deep.rows[0].list[1]").alias("second"), at("$.more.API_Token").alias("token"),
        at("$.more.contains_secret_text").cast("boolean").alias("flag"), at("$.more.said").alias("said"), at("$.more.Secret_Bearing").alias("bearing"),
    )


def _topic_sql(free: tuple[str, ...], words: str) -> str:
    every = "|".join([*free, rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{words})(?:$|[^\p{{L}}\p{{N}}_])"]).replace(r"\w", r"[\p{L}\p{N}_]").replace(r"[[\p{L}\p{N}_]", r"[\p{L}\p{N}_")
    return f"regexp_matches(text, '(?i){every}')"


@R.add(f"""SELECT conv_id, turn, array_to_string(list_filter([{', '.join(f"CASE WHEN {_topic_sql(free, words)} THEN '{name}' END" for name, free, words in signals.SENSITIVE_TOPICS)}], lambda x: x IS NOT NULL), ',') AS topics,
array_to_string(list_filter([{', '.join(f"CASE WHEN {_topic_sql((), words)} THEN '{name}' END" for name, words in signals.SENSITIVE_FLAGS)}], lambda x: x IS NOT NULL), ',') AS flags FROM conversations""")
def sensitive_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(",", signals.sensitive_topics(text)).alias("topics"), F.concat_ws(",", signals.sensitive_flags(text)).alias("flags"))


#: Messages when they were cited, and as they are now: texts changed, messages moved to a session that continues theirs, gone, or added.
MESSAGES = """was AS (SELECT 's' || (conv_id % 7) AS session_id, conv_id * 100 + turn AS id, 'u' || conv_id || '-' || turn AS uid, conv_id * 100 + turn AS ts, role, text AS content, conv_id, turn FROM conversations),
now AS (SELECT CASE WHEN conv_id % 13 = 5 THEN 'c' || (conv_id % 7) ELSE session_id END AS session_id, CASE WHEN conv_id % 13 = 5 THEN id + 100000000 ELSE id END AS id, uid, ts, role, CASE WHEN conv_id % 11 = 0 THEN content || '!' ELSE content END AS content
  FROM was WHERE conv_id % 17 <> 3 AND conv_id % 7 <> 6 UNION ALL SELECT session_id, id + 50, uid || '+', ts, role, content FROM was WHERE conv_id % 19 = 1 AND turn = 0 AND conv_id % 7 <> 6),
wanted AS (SELECT DISTINCT conv_id AS citation, 's' || (conv_id % 7) AS session_id, conv_id * 100 AS first_msg_id, conv_id * 100 + 99 + CASE WHEN conv_id % 50 = 0 THEN 3500000 ELSE conv_id % 3 * 700 END AS last_msg_id FROM conversations)"""
_LINE = "sha256(concat_ws(chr(31), coalesce(role, ''), coalesce(content, '')))"
ORIGIN = f"""{MESSAGES}, w AS (SELECT *, {_LINE} AS line FROM was), n AS (SELECT *, {_LINE} AS line FROM now),
cited AS (SELECT c.*, count(*) AS msg_count, sha256(c.session_id || chr(10) || string_agg(id || ':' || line, chr(10) ORDER BY id)) AS span, sha256(string_agg(uid, chr(10) ORDER BY id)) AS uids, sha256(c.session_id || chr(10) || string_agg(line, chr(10) ORDER BY id)) AS content
  FROM wanted c JOIN w ON w.session_id = c.session_id AND w.id BETWEEN c.first_msg_id AND c.last_msg_id GROUP BY c.citation, c.session_id, c.first_msg_id, c.last_msg_id),
here AS (SELECT c.citation, count(n.id) AS k, sha256(c.session_id || chr(10) || string_agg(n.id || ':' || line, chr(10) ORDER BY n.id)) AS span, sha256(string_agg(uid, chr(10) ORDER BY n.id)) AS uids
  FROM cited c LEFT JOIN n ON n.session_id = c.session_id AND n.id BETWEEN c.first_msg_id AND c.last_msg_id GROUP BY c.citation, c.session_id),
ids AS (SELECT c.*, CASE WHEN c.citation % 29 = 1 THEN 'unavailable' WHEN c.session_id = 's6' THEN 'expired' WHEN h.k = c.msg_count AND h.span = c.span THEN 'verified' WHEN h.k > c.msg_count THEN 'drifted' WHEN h.k = c.msg_count AND h.uids = c.uids THEN 'drifted' END AS status FROM cited c JOIN here h USING (citation)),
alluids AS (SELECT i.citation, n.uid, min(n.id) AS id, arg_min(n.ts, n.id) AS ts, arg_min(n.line, n.id) AS line FROM ids i JOIN n ON (n.session_id = i.session_id OR n.session_id = 'c' || substr(i.session_id, 2)) AND n.id >= i.first_msg_id WHERE i.status IS NULL GROUP BY 1, 2),
runs AS (SELECT i.citation, i.session_id, i.uids, i.content, CAST(i.msg_count AS BIGINT) AS k, list(a.uid ORDER BY a.ts, a.id) AS us, list(a.line ORDER BY a.ts, a.id) AS ls FROM ids i JOIN alluids a USING (citation) GROUP BY i.citation, i.session_id, i.uids, i.content, i.msg_count),
found AS (SELECT *, list_filter(range(1, len(us) - k + 2), lambda x: sha256(array_to_string(us[x:x + k - 1], chr(10))) = uids)[1] AS x FROM runs),
checked AS (SELECT i.citation, coalesce(i.status, CASE WHEN f.x IS NOT NULL THEN CASE WHEN sha256(f.session_id || chr(10) || array_to_string(f.ls[f.x:f.x + f.k - 1], chr(10))) = f.content THEN 'verified_via_uid' ELSE 'drifted' END END, 'partially_missing') AS status FROM ids i LEFT JOIN found f USING (citation))"""


def _origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    was = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("s"), (conv % 7).cast("string")).alias("session_id"), (conv * 100 + turn).alias("id"), F.concat(F.lit("u"), conv.cast("string"), F.lit("-"), turn.cast("string")).alias("uid"),
        (conv * 100 + turn).alias("ts"), "role", F.col("text").alias("content"), "conv_id", "turn",
    )
    moved, more = conv % 13 == 5, (conv % 19 == 1) & (turn == 0)
    left = was.where((conv % 17 != 3) & (conv % 7 != 6))
    now = left.select(
        F.when(moved, F.concat(F.lit("c"), (conv % 7).cast("string"))).otherwise(F.col("session_id")).alias("session_id"), F.when(moved, F.col("id") + 100_000_000).otherwise(F.col("id")).alias("id"), "uid", "ts", "role",
        F.when(conv % 11 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("content"),
    )
    now = now.unionByName(was.where(more & (conv % 7 != 6)).select("session_id", (F.col("id") + 50).alias("id"), F.concat("uid", F.lit("+")).alias("uid"), "ts", "role", "content"))
    wide = F.when(conv % 50 == 0, 3_500_000).otherwise(conv % 3 * 700)
    wanted = was.select(conv.alias("citation"), "session_id", (conv * 100).alias("first_msg_id"), (conv * 100 + 99 + wide).alias("last_msg_id")).distinct()
    cited = origin.cite(wanted, was).withColumn("content_sha256", F.when(F.col("citation") % 29 != 1, F.col("content_sha256")))
    sessions = spark.range(7).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("session_id"), F.lit(None).cast("string").alias("parent")).where("session_id != 's6'")
    sessions = sessions.unionByName(sessions.select(F.concat(F.lit("c"), F.substring("session_id", 2, 9)).alias("session_id"), F.col("session_id").alias("parent")))
    return origin.check(cited, now, sessions)


@R.add(f"WITH {ORIGIN} SELECT citation, status FROM checked")
def origin_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation cites a span of its session, every fiftieth one of 35,000 conversations; then the messages change."""
    return _origins(spark, sf_dir)


@R.add(f"""WITH {ORIGIN}, p AS (SELECT citation // 3 AS point, CASE WHEN citation % 31 <> 0 THEN citation END AS citation FROM checked), r AS (SELECT point, CASE WHEN p.citation IS NULL THEN 'uncited' ELSE status END AS status FROM p LEFT JOIN checked c ON c.citation = p.citation)
SELECT status, count(*) AS citations, count(DISTINCT point) AS points, array_to_string(list_sort(list(DISTINCT point))[1:5], ',') AS ids, count(DISTINCT point) > 5 AS truncated FROM r GROUP BY status""")
def origin_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = _origins(spark, sf_dir)
    points = checked.select(F.floor(F.col("citation") / 3).alias("point"), F.when(F.col("citation") % 31 != 0, F.col("citation")).alias("citation"))
    return origin.summary(points, checked, 5).withColumn("ids", F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))))


@R.add("""WITH c AS (SELECT conv_id % 97 AS point, turn AS captured_at, conv_id AS nth, CAST(conv_id // 3 AS VARCHAR) || '-' || turn AS key, CASE WHEN (conv_id + turn) % 4 = 1 THEN substr(text, 1, 280) END AS quote, to_json({'c': conv_id, 't': substr(text, 1, 600)}) AS body, conv_id % 41 <> 0 AS resolved FROM conversations),
f AS (SELECT point, bool_and(resolved) AS verified FROM c GROUP BY point),
u AS (SELECT point, key, captured_at, nth, quote, body FROM c QUALIFY row_number() OVER (PARTITION BY point, key ORDER BY captured_at, nth) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY captured_at, nth, key) AS r, count(*) OVER (PARTITION BY point) AS n, count(quote) OVER (PARTITION BY point) AS quotes, row_number() OVER (PARTITION BY point, quote IS NOT NULL ORDER BY captured_at, nth, key) AS qr FROM u),
k AS (SELECT point, key, r, n, quotes, CASE WHEN qr <= 3 THEN quote END AS quote, octet_length(encode(body)) + coalesce(octet_length(encode(CASE WHEN qr <= 3 THEN quote END)), 0) AS size FROM o),
s AS (SELECT *, count(*) OVER w AS cnt, sum(size) OVER w AS bytes FROM k WINDOW w AS (PARTITION BY point ORDER BY (r = 1) DESC, (quote IS NOT NULL) DESC, r DESC ROWS UNBOUNDED PRECEDING)), l AS (SELECT * FROM s WHERE r = 1 OR (cnt <= 8 AND bytes <= 4096))
SELECT l.point, CAST(row_number() OVER (PARTITION BY l.point ORDER BY r) AS INTEGER) AS place, key, md5(quote) AS quote, n - count(*) OVER (PARTITION BY l.point) AS dropped, greatest(quotes - 3, 0) AS quotes_dropped, verified FROM l JOIN f ON f.point = l.point""")
def origin_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    rows = table(spark, sf_dir, "conversations").select(
        (conv % 97).alias("point"), turn.alias("captured_at"), conv.alias("nth"), F.concat_ws("-", F.floor(conv / 3).cast("string"), turn.cast("string")).alias("key"), F.when((conv + turn) % 4 == 1, F.substring("text", 1, 280)).alias("quote"),
        F.to_json(F.struct(conv.alias("c"), F.substring("text", 1, 600).alias("t"))).alias("body"), (conv % 41 != 0).alias("resolved"),
    )
    return origin.merge(rows).withColumn("quote", F.md5(F.col("quote").cast("binary")))


#: Trees of documents: nodes over chunks of a source, over the sources of a language, and a root; a walk starts at a source's nodes.
TREES = f"""{NODES}, one AS (SELECT profile_id, source, node_id, chunk, 1 AS level, list_transform(children, lambda x: 'd' || x) AS child_ids, ['s-' || profile_id || '-' || source] AS parent_ids FROM nodes),
two AS (SELECT profile_id, source, 's-' || profile_id || '-' || source AS node_id, 2 AS level, list(node_id ORDER BY node_id) AS child_ids, ['r-' || profile_id] AS parent_ids FROM one GROUP BY profile_id, source),
three AS (SELECT profile_id, 'r-' || profile_id AS node_id, 3 AS level, list(node_id ORDER BY node_id) AS child_ids FROM two GROUP BY profile_id),
tops AS (SELECT profile_id, source, node_id, chunk FROM one QUALIFY row_number() OVER (PARTITION BY profile_id, source ORDER BY node_id) <= 3),
met AS (SELECT profile_id || '/' || source AS walk, o.node_id, 0 AS depth, row_number() OVER (PARTITION BY profile_id, source ORDER BY o.node_id) AS place, o.child_ids, o.chunk % 3 = 2 AS flagged FROM one o SEMI JOIN tops t ON o.node_id = t.node_id
  UNION ALL SELECT w.walk, t.node_id, 1, w.n + 1, t.child_ids, false FROM (SELECT profile_id || '/' || source AS walk, profile_id, source, count(*) AS n FROM tops GROUP BY ALL) w JOIN two t ON t.profile_id = w.profile_id AND t.source = w.source
  UNION ALL SELECT w.walk, r.node_id, 2, w.n + 2, r.child_ids, false FROM (SELECT profile_id || '/' || source AS walk, profile_id, count(*) AS n FROM tops GROUP BY profile_id, source) w JOIN three r ON r.profile_id = w.profile_id),
kids AS (SELECT walk, place, node_id, unnest(child_ids) AS id, generate_subscripts(child_ids, 1) AS pos FROM met), cited AS (SELECT * FROM kids WHERE pos <= 8),
leaves AS (SELECT 'd' || id AS id, id % 23 = 5 AS bad FROM points WHERE id % 31 <> 7 UNION ALL SELECT node_id, chunk % 3 = 2 FROM one UNION ALL SELECT node_id, false FROM two),
bad AS (SELECT c.walk, c.place, bool_or(coalesce(l.bad, true)) AS trouble FROM cited c LEFT JOIN leaves l ON l.id = c.id GROUP BY 1, 2)"""


@R.add(f"""WITH {TREES} SELECT m.walk, 'summary' AS kind, m.node_id AS id, NULL AS parent, CASE WHEN flagged THEN 'review_required' WHEN trouble THEN 'stale' ELSE 'active' END AS status, depth, CAST(m.place AS INTEGER) AS place FROM met m LEFT JOIN bad b ON b.walk = m.walk AND b.place = m.place
UNION ALL SELECT walk, 'leaf', c.id, node_id, 'safe', NULL, CAST(row_number() OVER (PARTITION BY walk ORDER BY node_id, c.id) AS INTEGER) FROM cited c JOIN leaves l ON l.id = c.id WHERE NOT l.bad""")
def tree_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up from the first nodes of each source in each tree, with the children that each summary cites."""
    up = F.concat_ws("-", F.lit("s"), "profile_id", "source")
    one = _nodes(spark, sf_dir).select("profile_id", "source", "chunk", "node_id", "text", F.transform("children", lambda x: F.concat(F.lit("d"), x.cast("string"))).alias("child_ids"), F.array(up).alias("parent_ids"))
    shared_folder(spark)
    one = one.checkpoint()  # read by every level
    listed = F.array_sort(F.collect_list("node_id")).alias("child_ids")  # of one source, or of one language
    two = one.groupBy("profile_id", "source").agg(listed).withColumn("node_id", up).withColumn("parent_ids", F.array(F.concat(F.lit("r-"), "profile_id")))
    three = two.groupBy("profile_id").agg(listed).withColumn("node_id", F.concat(F.lit("r-"), "profile_id"))
    flagged = F.col("chunk") % 3 == 2
    reasons = F.when(flagged, F.array(F.lit("requires_review"))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    nodes = one.select("node_id", F.lit(1).alias("level"), "child_ids", "parent_ids", "text", F.lit(False).alias("secret"), reasons.alias("reasons"))
    nodes = nodes.unionByName(two.select("node_id", F.lit(2).alias("level"), "child_ids", "parent_ids", F.lit("sources").alias("text"), F.lit(False).alias("secret"), none.alias("reasons")))
    nodes = nodes.unionByName(three.select("node_id", F.lit(3).alias("level"), "child_ids", none.alias("parent_ids"), F.lit("root").alias("text"), F.lit(False).alias("secret"), none.alias("reasons")))
    rows = points(spark, sf_dir).where("id % 31 != 7").select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("id"), "text", (F.col("id") % 23 == 5).alias("unsafe"), F.lit(False).alias("secret"))
    leaves = rows.unionByName(one.select(F.col("node_id").alias("id"), "text", flagged.alias("unsafe"), F.lit(False).alias("secret"))).unionByName(two.select(F.col("node_id").alias("id"), F.lit("sources").alias("text"), F.lit(False).alias("unsafe"), F.lit(False).alias("secret")))
    first = one.withColumn("rank", F.row_number().over(Window.partitionBy("profile_id", "source").orderBy("node_id"))).where(F.col("rank") <= 3)
    seeds = first.select(F.concat_ws("/", "profile_id", "source").alias("walk"), "node_id", "rank")
    return tree.walk(seeds, nodes, leaves, top_k=20, max_children=8).select("walk", "kind", "id", "parent", "status", "depth", "place")


@R.add()
def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every hundredth customer over all orders and their parts; no SQL, as what a seed has met decides what counts."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    status = lambda c: F.when(F.col(c) % 13 == 0, "superseded").otherwise("active")
    placed = orders.select(name("eo", "o_orderkey").alias("edge_id"), name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"), (F.col("o_orderkey") % 10 / 10).alias("confidence"), status("o_orderkey").alias("status"))
    parts = items.select(F.concat_ws("-", name("el", "l_orderkey"), F.col("l_partkey").cast("string")).alias("edge_id"), name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst"), (F.col("l_quantity") / 50).alias("confidence"), status("l_partkey").alias("status")).distinct()
    seeds = table(spark, sf_dir, "customer").where("c_custkey % 100 = 0").select(name("c", "c_custkey").alias("seed"), name("c", "c_custkey").alias("id"), F.lit(0.6).alias("vector_score"))
    payload = table(spark, sf_dir, "part").select(name("p", "p_partkey").alias("id"), (F.col("p_size") / 50).alias("usefulness"), F.when(F.col("p_partkey") % 7 == 0, "stale").alias("status"))
    found = graph.search(seeds, placed.unionByName(parts), payload, top_k=20)
    return found.withColumn("path", F.concat_ws(">", "path"))
