"""Where memories came from: citations of message spans, their check against the messages, and their merge.

A citation names a session, the first and last message id of a span, how many messages it had, and three digests: of the
rows as they stood (ids, roles, contents), of the messages' uids in order, and of roles and contents in order. It may name the uids of the first and the last message too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder

DIGESTS = ("span_sha256", "uids_sha256", "content_sha256")
HEX = r"^[0-9a-f]{64}$"
#: Ids of a session that share a bin in the join of spans to messages.
BIN = 1024
# Fixed bounds of a merged origin.
MAX_CITATIONS, MAX_QUOTED, MAX_BYTES = 8, 3, 4096


def _sha(parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", parts).cast("binary"), 256)


def _digests(rows: Column, session: Column) -> list[Column]:
    """The three digests of an ordered array of (id, uid, line), line a digest of role and content."""
    line = lambda r: F.lower(F.hex(r["line"]))
    return [
        _sha(F.concat(F.array(session.cast("string")), F.transform(rows, lambda r: F.concat_ws(":", r["id"].cast("string"), line(r))))).alias("span_sha256"),
        _sha(F.transform(rows, lambda r: r["uid"])).alias("uids_sha256"), _sha(F.concat(F.array(session.cast("string")), F.transform(rows, line))).alias("content_sha256"),
    ]


def _lined(messages: DataFrame) -> DataFrame:
    line = F.unhex(F.sha2(F.concat_ws("\x1f", F.coalesce("role", F.lit("")), F.coalesce("content", F.lit(""))).cast("binary"), 256))
    return messages.select("session_id", F.col("id").cast("long").alias("id"), F.coalesce(F.col("uid").cast("string"), F.lit("")).alias("uid"), "ts", line.alias("line"))


def _hits(citations: DataFrame, messages: DataFrame) -> DataFrame:
    """(citation, id, uid, line) of the messages of each cited session with ids within the span. An interval join by bins: a span lists the bins of
    ids that it touches, a message has one, so both meet on equal (session, bin); long spans and long sessions are dealt out by bin."""
    bins = F.explode(F.sequence(F.floor(F.col("first_msg_id") / BIN), F.floor(F.col("last_msg_id") / BIN))).alias("bin")
    asked = citations.select("citation", "session_id", "first_msg_id", "last_msg_id", bins)
    lined = _lined(messages).withColumn("bin", F.floor(F.col("id") / BIN))
    return asked.join(lined, ["session_id", "bin"]).where("id BETWEEN first_msg_id AND last_msg_id").select("citation", "id", "uid", "line")


def spans(citations: DataFrame, messages: DataFrame) -> DataFrame:
    """(citation, rows): the messages of each span, in order of id; only ids, uids and digests are moved."""
    return _hits(citations, messages).groupBy("citation").agg(F.array_sort(F.collect_list(F.struct("id", "uid", "line"))).alias("rows"))  # as long as a span


def cite(wanted: DataFrame, messages: DataFrame) -> DataFrame:
    """wanted: (citation, session_id, first_msg_id, last_msg_id). Citations of what the messages hold now, with the uids of the first and
    the last of them, by which :func:`check` finds messages that moved."""
    found = wanted.join(spans(wanted, messages), "citation")
    ends = F.element_at("rows", 1)["uid"].alias("first_uid"), F.element_at("rows", -1)["uid"].alias("last_uid")
    return found.select("citation", "session_id", "first_msg_id", "last_msg_id", F.size("rows").alias("msg_count"), *_digests(F.col("rows"), F.col("session_id")), *ends)


def check(citations: DataFrame, messages: DataFrame, sessions: DataFrame, *, max_chain: int = 1000) -> DataFrame:
    """(citation, status) of each citation, first match:

    * unavailable: a digest, an id or the session is missing or malformed;
    * expired: the session is gone;
    * verified: the span has the cited count and digest;
    * drifted: the span has more messages than were cited, or the same uids with other contents;
    * verified_via_uid, drifted: the cited uids stand in a row among the messages of the session and its continuations (one message
      a uid, the lowest id, by time and id), with the cited contents or others;
    * partially_missing: anything else.

    sessions: (session_id, parent). Spans are counted first, within the join's tasks; rows are collected only where the count is the cited one. Only
    spans that did not settle by ids are looked up by uid: between the places of ``first_uid`` and ``last_uid``, which :func:`cite` adds (a run of
    the cited uids can stand nowhere else), or, for citations without them, at every place of the session and what continues it. Citations are
    written to the shared folder once, as each step reads them."""
    shared_folder(citations.sparkSession)
    fine = F.col("session_id").isNotNull() & (F.col("first_msg_id") <= F.col("last_msg_id")) & (F.col("msg_count") >= 0)
    for c in DIGESTS:
        fine &= F.col(c).rlike(HEX)
    fine = F.coalesce(fine, F.lit(False))
    there = sessions.select("session_id", F.lit(True).alias("there")).distinct()
    for c in ("first_uid", "last_uid"):
        citations = citations if c in citations.columns else citations.withColumn(c, F.lit(None).cast("string"))
    marked = citations.withColumn("fine", fine).join(there, "session_id", "left").checkpoint()
    live = marked.where("fine AND there")
    counts = _hits(live, messages).groupBy("citation").agg(F.count(F.lit(1)).alias("n"))
    counted = live.join(counts, "citation", "left").withColumn("n", F.coalesce("n", F.lit(0))).checkpoint()
    same = counted.where("n = msg_count")
    none = F.array().cast("array<struct<id:bigint,uid:string,line:binary>>")
    found = same.join(spans(same, messages), "citation", "left").withColumn("rows", F.coalesce("rows", none))
    now = dict(zip(DIGESTS, _digests(F.col("rows"), F.col("session_id"))))
    by_id = F.when(now["span_sha256"] == F.col("span_sha256"), "verified").when(now["uids_sha256"] == F.col("uids_sha256"), "drifted")
    kept = ["citation", "session_id", "first_msg_id", "msg_count", *DIGESTS[1:], "first_uid", "last_uid"]
    judged = found.select(*kept, by_id.alias("status")).unionByName(counted.where("n != msg_count").select(*kept, F.when(F.col("n") > F.col("msg_count"), "drifted").alias("status"))).checkpoint()
    uid = _by_uid(judged.where("status IS NULL"), messages, sessions, max_chain)
    judged = judged.select("citation", "status").join(uid, "citation", "left")
    judged = judged.select("citation", F.coalesce("status", "by_uid", F.lit("partially_missing")).alias("status"))
    rest = marked.where("NOT fine OR there IS NULL").select("citation", F.when(~F.col("fine"), "unavailable").otherwise("expired").alias("status"))
    return judged.unionByName(rest)


def _by_uid(citations: DataFrame, messages: DataFrame, sessions: DataFrame, max_chain: int) -> DataFrame:
    """(citation, by_uid) of citations whose uids are found in a row in the session or what continues it."""
    from .graph import chain

    own = sessions.select(F.col("session_id").alias("member"), F.col("session_id").alias("session_id"))
    links = chain(sessions.where("parent IS NOT NULL").select(F.col("session_id").alias("id"), "parent"), depth=max_chain)
    family = own.unionByName(links.select(F.col("id").alias("member"), F.col("ancestor").alias("session_id"))).distinct().checkpoint()
    known = F.col("first_uid").isNotNull() & F.col("last_uid").isNotNull()
    rows = _between(citations.where(known & (F.col("msg_count") > 0)), messages, family).unionByName(_anywhere(citations.where(~known), messages, family))
    rows = citations.join(rows, "citation")
    width = F.col("msg_count").cast("int")
    starts = F.when((F.size("rows") >= width) & (width > 0), F.sequence(F.lit(1), F.size("rows") - width + 1))
    uids = lambda part: _sha(F.transform(part, lambda r: r["uid"]))
    at = F.get(F.filter(starts, lambda i: uids(F.slice("rows", i, width)) == F.col("uids_sha256")), F.lit(0))
    rows = rows.withColumn("at", at).where("at IS NOT NULL").withColumn("run", F.slice("rows", F.col("at"), width))
    content = _sha(F.concat(F.array(F.col("session_id").cast("string")), F.transform("run", lambda r: F.lower(F.hex(r["line"])))))
    return rows.select("citation", F.when(content == F.col("content_sha256"), "verified_via_uid").otherwise("drifted").alias("by_uid"))


def _anywhere(citations: DataFrame, messages: DataFrame, family: DataFrame) -> DataFrame:
    """(citation, rows): one message a uid of the session and what continues it from the first id on, by time and id."""
    asked = citations.join(family, "session_id").select("citation", "first_msg_id", "member")
    hits = asked.join(_lined(messages).withColumnRenamed("session_id", "member"), "member").where("id >= first_msg_id")
    # one message a uid: the lowest id is the original, copies come later
    first = hits.groupBy("citation", "uid").agg(F.min(F.struct("id", "ts", "line")).alias("m"))
    return first.groupBy("citation").agg(F.array_sort(F.collect_list(F.struct("m.ts", "m.id", "uid", "m.line"))).alias("rows"))


def _between(citations: DataFrame, messages: DataFrame, family: DataFrame) -> DataFrame:
    """(citation, rows) as :func:`_anywhere`, from the message with the first cited uid to that with the last, of citations with as many
    messages between them as were cited. An interval join by bins of time; counts are taken within its tasks, and only rows of uids
    with copies, and those of the citations that are left, are moved."""
    lined = _lined(messages).withColumnRenamed("session_id", "member")
    uids = F.explode(F.array_distinct(F.array("first_uid", "last_uid"))).alias("uid")
    ends = citations.join(family, "session_id").select("citation", "first_msg_id", "member", uids).join(lined, ["member", "uid"]).where("id >= first_msg_id")
    place = F.struct(F.col("m.ts").alias("ts"), F.col("m.id").alias("id"), "uid")
    ends = ends.groupBy("citation", "uid").agg(F.min(F.struct("id", "ts", "line")).alias("m")).select("citation", "uid", place.alias("place"))
    at = citations.join(ends.select("citation", F.col("uid").alias("first_uid"), F.col("place").alias("low")), ["citation", "first_uid"])
    at = at.join(ends.select("citation", F.col("uid").alias("last_uid"), F.col("place").alias("high")), ["citation", "last_uid"])
    at = at.where("low <= high").select("citation", "session_id", "first_msg_id", "msg_count", "low", "high").checkpoint()
    # some hundred messages of a session share a bin of time
    time = F.col("ts").cast("double")
    sizes = lined.groupBy("member").agg(F.min(time).alias("lo"), F.max(time).alias("hi"), F.ceil(F.count(F.lit(1)) / 256).alias("parts")).checkpoint()
    part = lambda ts: F.coalesce(F.when(F.col("hi") > F.col("lo"), F.least(F.greatest(F.floor((ts.cast("double") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("parts")), F.lit(0)), F.col("parts"))), F.lit(0))
    copied = lined.groupBy("uid").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("uid", F.lit(True).alias("copied"))
    placed = lined.join(copied, "uid", "left").join(sizes, "member").select("member", "id", "uid", "ts", "line", F.coalesce("copied", F.lit(False)).alias("copied"), part(F.col("ts")).alias("bin")).checkpoint()

    def hits(at: DataFrame) -> DataFrame:
        asked = at.join(family, "session_id").join(sizes, "member").select("citation", "first_msg_id", "low", "high", "member", F.explode(F.sequence(part(F.col("low.ts")), part(F.col("high.ts")))).alias("bin"))
        found = asked.join(placed, ["member", "bin"]).withColumn("here", F.struct("ts", "id", "uid"))
        return found.where("id >= first_msg_id AND here >= low AND here <= high").select("citation", "ts", "id", "uid", "line", "copied")

    # a uid with copies stands where its lowest id is, which may be outside
    some = hits(at).where("copied").select("citation", "uid").distinct().join(at, "citation").join(family, "session_id").join(placed.where("copied"), ["member", "uid"]).where("id >= first_msg_id")
    some = some.groupBy("citation", "uid").agg(F.min(F.struct("id", "ts", "line")).alias("m"), F.first("low").alias("low"), F.first("high").alias("high")).where(F.expr("struct(m.ts AS ts, m.id AS id, uid AS uid) >= low AND struct(m.ts AS ts, m.id AS id, uid AS uid) <= high"))
    some = some.select("citation", "m.ts", "m.id", "uid", "m.line").checkpoint()
    counts = hits(at).where("NOT copied").groupBy("citation").agg(F.count(F.lit(1)).alias("n")).unionByName(some.groupBy("citation").agg(F.count(F.lit(1)).alias("n")))
    full = at.join(counts.groupBy("citation").agg(F.sum("n").alias("n")), "citation").where("n = msg_count").drop("n").checkpoint()
    rows = hits(full).where("NOT copied").drop("copied").unionByName(some.join(full, "citation", "left_semi"))
    return rows.groupBy("citation").agg(F.array_sort(F.collect_list(F.struct("ts", "id", "uid", "line"))).alias("rows"))  # as many as were cited


def summary(points: DataFrame, checked: DataFrame, max_ids: int = 50) -> DataFrame:
    """points: (point, citation); (status, citations, points, ids, truncated): how many citations have a status, how many points have one
    such citation, and the first ``max_ids`` of these. A point without citations has the status ``uncited``."""
    rows = points.join(checked, "citation", "left").select("point", F.when(F.col("citation").isNull(), "uncited").otherwise(F.col("status")).alias("status"))
    counts = rows.groupBy("status").agg(F.count(F.lit(1)).alias("citations"), F.countDistinct("point").alias("points"))
    each = rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy("status").orderBy("point"))).where(F.col("n") <= max_ids)
    ids = each.groupBy("status").agg(F.array_sort(F.collect_list("point")).alias("ids"))
    return counts.join(ids, "status").select("status", "citations", "points", "ids", (F.col("points") > max_ids).alias("truncated"))


def merge(captures: DataFrame, *, max_citations: int = MAX_CITATIONS, max_quoted: int = MAX_QUOTED, max_bytes: int = MAX_BYTES) -> DataFrame:
    """captures: (point, captured_at, nth, key, quote, body, resolved), a row a citation: when and as which mapping it was captured,
    what makes two citations the same, its quote or null, its JSON without the quote, and whether its mapping was verified.

    (point, place, key, quote, dropped, quotes_dropped, verified): what is left of all copies' citations, in capture order, under the
    bounds: the same citation counts once, where it was captured first; the first ``max_quoted`` quotes stay; while there are
    too many citations or bytes, the oldest after the first goes, without a quote first. One unresolved mapping makes the point so.

    The drops have a fixed order, so what stays is the longest end of it that fits: no fold. A point's citations are cut before the exchange to
    those that can stay at all (the first, ``max_quoted`` quoted, ``max_citations`` others), so a point with any number of them is one small group, however rows are dealt out."""
    order = F.struct("captured_at", "nth", "key")
    rows = captures.groupBy("point", "key").agg(F.min(order).alias("o"), F.min_by("quote", order).alias("quote"), F.min_by("body", order).alias("body"))
    facts = captures.groupBy("point").agg(F.min(F.coalesce("resolved", F.lit(False))).alias("verified"))
    totals = rows.groupBy("point").agg(F.count(F.lit(1)).alias("n"), F.count("quote").alias("quotes"), F.min("o").alias("first"))
    quoted = rows.where("quote IS NOT NULL").withColumn("q", F.row_number().over(Window.partitionBy("point").orderBy("o"))).where(F.col("q") <= max_quoted).drop("q")
    late = quoted.groupBy("point").agg(F.max("o").alias("last_quote"), F.count(F.lit(1)).alias("kept_quotes"))
    bare = rows.join(late, "point", "left").where((F.col("quote").isNull()) | ((F.col("kept_quotes") == max_quoted) & (F.col("o") > F.col("last_quote"))))
    bare = bare.withColumn("b", F.row_number().over(Window.partitionBy("point").orderBy(F.desc("o")))).where(F.col("b") <= max_citations)
    first = rows.join(totals.select("point", F.col("first").alias("o")), ["point", "o"])
    cut = quoted.select("point", "o", "quote", "body").unionByName(bare.select("point", "o", F.lit(None).cast("string").alias("quote"), "body"))
    lone = first.join(cut.select("point", "o"), ["point", "o"], "left_anti").select("point", "o", "quote", "body")  # the first, if it is among neither
    every = cut.unionByName(lone).join(totals, "point").withColumn("head", F.col("o") == F.col("first"))
    size = F.octet_length("body") + F.coalesce(F.octet_length("quote"), F.lit(0))
    stays = Window.partitionBy("point").orderBy(F.desc("head"), F.desc(F.col("quote").isNotNull()), F.desc("o")).rowsBetween(Window.unboundedPreceding, 0)
    kept = every.withColumns({"count": F.count(F.lit(1)).over(stays), "bytes": F.sum(size).over(stays)}).where(F.col("head") | ((F.col("count") <= max_citations) & (F.col("bytes") <= max_bytes)))
    whole = Window.partitionBy("point")
    kept = kept.withColumn("place", F.row_number().over(whole.orderBy("o"))).withColumn("left", F.count(F.lit(1)).over(whole))
    quotes_dropped = F.greatest(F.col("quotes") - max_quoted, F.lit(0))
    return kept.join(facts, "point").select("point", "place", F.col("o.key").alias("key"), "quote", (F.col("n") - F.col("left")).alias("dropped"), quotes_dropped.alias("quotes_dropped"), "verified")
