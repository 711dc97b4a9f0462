"""What lines, chunks and tool calls hold: signals of candidates, graph markers, line numbers, memory calls.

Rows with null texts give nothing. One row of the input may give many; none is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import payload as pl
from ..functions import secrets

# Fixed patterns, kinds, confidences and openings of the signals, in the order in which they are tried.
SIGNALS = (
    (r"(?:decision|decided)\s*[:\-]\s*(.+)", "memory_candidate", "decision", 0.88),
    (r"(?:tool\s+quirk|environment\s+quirk|quirk)\s*[:\-]\s*(.+)", "memory_candidate", "tool_quirk", 0.86),
    (r"(?:project\s+invariant|invariant)\s*[:\-]\s*(.+)", "invariant_candidate", "project_invariant", 0.9),
    (r"(?:resolved\s+conflict|conflict\s+resolved)\s*[:\-]\s*(.+)", "status_update_candidate", "assertion", 0.82),
)
POSSIBLE = r"(?:possible|maybe)\s+(decision|tool\s+quirk|project\s+invariant|invariant|preference|correction)\s*[:\-]\s*(.+)"
POSSIBLE_KINDS = {
    "preference": ("preference_candidate", "user_preference"), "correction": ("preference_candidate", "user_preference"), "project_invariant": ("invariant_candidate", "project_invariant"),
    "invariant": ("invariant_candidate", "project_invariant"), "tool_quirk": ("memory_candidate", "tool_quirk"), "decision": ("memory_candidate", "decision"),
}
POSSIBLE_CONFIDENCE, CORRECTION_CONFIDENCE = 0.5, 0.9
CORRECTION = r"(?:actually|correction|remember this|i prefer|prefer)\b[:, ]*\s*(.+)"
CORRECTION_WORDS = ("prefer", "use", "always", "never", "instead", "not ")
PRIVATE_IDENTITY = r"(?i)\b(?:my|user(?:'s)?|customer(?:'s)?|person(?:'s)?)\s+(?:name|surname|email|phone|address|birth(?:day|date)?|age|ssn|passport|identity|id)\b"
OPENINGS = {"decision": "Decision: ", "tool_quirk": "Tool quirk: ", "project_invariant": "Project invariant: ", "user_preference": "User preference/correction: ", "assertion": "Resolved conflict: "}
ENTITY_LINE = r"(?i)^\s*graph\s+entity\s*:\s*([a-zA-Z][a-zA-Z0-9_]*)\s*:\s*(.+)$"
EDGE_LINE = r"(?i)^\s*graph\s+edge\s*:\s*([a-zA-Z][a-zA-Z0-9_]*)\s*:\s*([^-]+?)\s*-\[([A-Z_]+)\]->\s*([a-zA-Z][a-zA-Z0-9_]*)\s*:\s*(.+)$"
MEMORY_TOOL = "memory"

#: What every line with a signal begins with, unless a fence is taken out of it: others need not be cleaned.
_BEGINS = rf"(?idU)^\s*(?:{'|'.join([POSSIBLE, *[s[0] for s in SIGNALS], CORRECTION])})"
_FENCE = "```"


def lines(rows: DataFrame, text: str = "text") -> DataFrame:
    """A row for each line of a text, ``line`` from 1; the text is not kept."""
    others = [c for c in rows.columns if c != text]
    split = rows.select(*others, F.posexplode(F.split(F.col(text), r"\R|[\x1c-\x1e]")).alias("_at", "body"))
    return split.select(*others, (F.col("_at") + 1).alias("line"), "body")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _unsafe(text: Column) -> Column:
    return (text == "") | secrets.has_secret(text) | text.rlike(PRIVATE_IDENTITY)


def _signal(text: Column) -> Column:
    """Struct of candidate_type, memory_kind, body and confidence of a clean line; null without a signal."""

    def found(kind: str, memory: str, body: Column, confidence: float) -> Column:
        return F.struct(F.lit(kind).alias("candidate_type"), F.lit(memory).alias("memory_kind"), body.alias("body"), F.lit(confidence).alias("confidence"))

    def whole(pattern: str) -> str:
        return rf"(?idU)^\s*{pattern}"

    def first(label: Column) -> Column:
        out = F
        for name, (kind, memory) in POSSIBLE_KINDS.items():
            out = out.when(label == name, found(kind, memory, F.regexp_extract(text, whole(POSSIBLE), 2), POSSIBLE_CONFIDENCE))
        out = out.when(label != "", found("memory_candidate", "decision", F.regexp_extract(text, whole(POSSIBLE), 2), POSSIBLE_CONFIDENCE))
        for pattern, kind, memory, confidence in SIGNALS:
            out = out.when(text.rlike(whole(pattern)), found(kind, memory, F.regexp_extract(text, whole(pattern), 1), confidence))
        corrects = text.rlike(whole(CORRECTION)) & F.exists(F.array(F.lower(body)), lambda b: pl.any_of(b, CORRECTION_WORDS))
        return out.when(corrects, found("preference_candidate", "user_preference", body, CORRECTION_CONFIDENCE))

    body = F.regexp_extract(text, whole(CORRECTION), 1)
    return _let(F.regexp_replace(F.lower(F.regexp_extract(text, whole(POSSIBLE), 1)), " ", "_"), first)


def _stated(line: Column, floor: float) -> Column:
    """Array of what a line states, one struct or none. The steps are arrays of one, as filters over a projection would
    be pushed below it and work out the clean line anew for each use."""
    clean = F.filter(F.array(pl.clean(line)), lambda c: ~_unsafe(c))
    signals = F.filter(F.transform(clean, _signal), lambda s: s.isNotNull() & (s["confidence"] >= floor))
    kept = ("candidate_type", "memory_kind", "confidence")
    own = F.transform(signals, lambda s: F.struct(*[s[c].alias(c) for c in kept], F.regexp_replace(pl.clean(s["body"]), r"^[ .\n\t]+|[ .\n\t]+$", "").alias("own")))
    return F.filter(own, lambda s: ~_unsafe(s["own"]))


def line_signals(rows: DataFrame, *, id_col: str = "id", text: str = "text", floor: float = 0.65, cap: int = 8) -> DataFrame:
    """(id, line, candidate_type, memory_kind, text, confidence): candidates that lines state in so many words.

    Lines with secrets or private identity are left out, and those below ``floor``. A text gives its first ``cap``.
    """
    body = F.col("body")
    hinted = lines(rows.select(id_col, text), text).where(body.rlike(_BEGINS) | F.contains(body, F.lit(_FENCE)))
    found = hinted.select(id_col, "line", F.explode(_stated(body, floor)).alias("s"))
    opening = F.element_at(F.create_map(*[F.lit(x) for pair in OPENINGS.items() for x in pair]), F.col("s.memory_kind"))
    placed = found.withColumn("_place", F.row_number().over(Window.partitionBy(id_col).orderBy("line"))).where(F.col("_place") <= cap)
    return placed.select(id_col, "line", "s.candidate_type", "s.memory_kind", F.concat(opening, "s.own", F.lit(".")).alias("text"), "s.confidence")


def graph_markers(rows: DataFrame, *, id_col: str = "id", text: str = "text") -> DataFrame:
    """(id, line, kind, entity_type, label, relation, target_type, target): entities and edges that lines declare.
    Lines with secrets are left out; the last three are null for entities."""
    body = F.col("body")
    found = lines(rows.select(id_col, text), text).where(body.rlike(r"(?i)^\s*graph\s+(entity|edge)\s*:")).where(~secrets.has_secret(body))
    entity, edge = body.rlike(ENTITY_LINE), body.rlike(EDGE_LINE)

    def part(own: int | None, other: int) -> Column:
        of_edge = F.when(edge, F.regexp_extract(body, EDGE_LINE, other))
        return of_edge if own is None else F.when(entity, F.regexp_extract(body, ENTITY_LINE, own)).otherwise(of_edge)

    return found.where(entity | edge).select(
        id_col, "line", F.when(entity, "entity").otherwise("edge").alias("kind"), part(1, 1).alias("entity_type"), part(2, 2).alias("label"),
        part(None, 3).alias("relation"), part(None, 4).alias("target_type"), part(None, 5).alias("target"),
    )


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def locate(source: Column, chunk: Column, start_at: Column) -> Column:
    """Struct of line_start, line_end (from 1; null if not found) and end (characters before the end of the find,
    else ``start_at``): the chunk without outer white space, from ``start_at`` on, else anywhere, else the same two with
    any white space where the chunk has some."""
    clean = F.regexp_replace(chunk, r"(?U)^\s+|\s+$", "")

    def loose(text: Column) -> Column:
        literal = F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q"))
        return F.concat(F.lit(r"(?U)\Q"), F.regexp_replace(literal, r"(?U)\s+", r"\\E\\s+\\Q"), F.lit(r"\E"))

    def find(v: Column) -> Column:
        tail = F.substr(v["text"], v["begin"] + 1)
        exact = [(F.instr(tail, v["clean"]), F.length(v["clean"]), v["begin"]), (F.instr(v["text"], v["clean"]), F.length(v["clean"]), F.lit(0))]
        near = [(F.regexp_instr(t, v["loose"]), F.length(F.regexp_substr(t, v["loose"])), off) for t, off in ((tail, v["begin"]), (v["text"], F.lit(0)))]
        # tried in turn: the patterns only where the chunk itself is nowhere
        return F.when(v["clean"] != "", F.coalesce(*[F.when(at > 0, F.struct((at + off).alias("at"), n.alias("n"))) for at, n, off in exact + near]))

    def place(v: Column, hit: Column) -> Column:
        first = _breaks(F.substr(v["text"], F.lit(1), hit["at"] - 1)) + 1
        last = first + _breaks(F.substr(v["text"], hit["at"], hit["n"]))
        end = F.when(hit.isNull(), v["start"]).otherwise(hit["at"] - 1 + hit["n"])
        return F.struct(F.when(hit.isNotNull(), first).alias("line_start"), F.when(hit.isNotNull(), last).alias("line_end"), end.alias("end"))

    known = F.struct(source.alias("text"), clean.alias("clean"), start_at.alias("start"), F.greatest(start_at, F.lit(0)).alias("begin"))
    known = _let(known, lambda v: F.struct(v["text"].alias("text"), v["clean"].alias("clean"), v["start"].alias("start"), v["begin"].alias("begin"), loose(v["clean"]).alias("loose")))
    return _let(known, lambda v: _let(find(v), lambda hit: place(v, hit)))


def memory_calls(rows: DataFrame, calls: str = "tool_calls", tool: str = MEMORY_TOOL) -> DataFrame:
    """One row for each operation of each call of the memory tool: call (its place, from 1), call_id, shape, batch,
    op, action, target, content, old_text, digest. Arguments that are no JSON object give one empty operation of the
    shape ``<unparseable>``; a column that is no JSON array gives nothing. The digest is that of the call's id and raw
    arguments, null where the arguments are not a string."""
    others = [c for c in rows.columns if c != calls]
    each = rows.select(*others, F.posexplode(F.from_json(calls, "array<string>")).alias("_at", "raw"))
    own = "id string, call_id string, name string, arguments string, function struct<name: string, arguments: string>"
    call = each.withColumn("c", F.from_json("raw", own))

    def given(*values: Column) -> Column:
        return F.coalesce(*[F.when(v != "", v) for v in values], F.lit(""))

    named = call.where(given(F.col("c.function.name"), F.col("c.name")) == tool)
    raw = F.coalesce(F.col("c.function.arguments"), F.col("c.arguments"))
    parsed = F.try_parse_json("raw")
    kind = F.schema_of_variant(F.coalesce(F.try_variant_get(parsed, "$.function.arguments", "variant"), F.try_variant_get(parsed, "$.arguments", "variant")))
    fields = "action string, target string, content string, new_text string, old_text string"
    args = named.select(*others, (F.col("_at") + 1).alias("call"), given(F.col("c.id"), F.col("c.call_id")).alias("call_id"), given(raw, F.lit("{}")).alias("args"), F.when(kind == "STRING", raw).alias("_raw"))
    args = args.withColumn("keys", F.json_object_keys("args")).withColumn("a", F.from_json("args", f"{fields}, operations array<struct<{fields.replace(' string', ': string')}>>"))
    fine, batch = F.col("keys").isNotNull(), F.col("a.operations").isNotNull()
    target = F.when(fine, given(F.col("a.target"), F.lit("memory"))).otherwise("memory")
    single = F.array(F.struct(*[F.when(fine, F.col(f"a.{f.split()[0]}")).alias(f.split()[0]) for f in fields.split(", ")]))
    shaped = args.select(
        *others, "call", "call_id", F.when(fine, F.when(F.size("keys") > 0, F.array_join(F.array_sort("keys"), "+")).otherwise("<empty>")).otherwise("<unparseable>").alias("shape"),
        (fine & batch).alias("batch"), target.alias("_target"), F.sha2(F.concat("call_id", F.lit("\x1f"), "_raw").cast("binary"), 256).alias("digest"), F.posexplode(F.when(fine & batch, F.col("a.operations")).otherwise(single)).alias("_op", "o"),
    )
    return shaped.select(
        *others, "call", "call_id", "shape", "batch", (F.col("_op") + 1).alias("op"), given(F.col("o.action")).alias("action"), given(F.col("o.target"), F.col("_target")).alias("target"),
        given(F.col("o.content"), F.col("o.new_text")).alias("content"), given(F.col("o.old_text")).alias("old_text"), "digest",
    )
