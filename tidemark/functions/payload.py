"""Rules over the payload of a point, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

# Fixed vocabularies of the reference.
TRUE_WORDS = ("1", "true", "yes", "y", "on")
ACTIVE_STATUSES = ("current", "verified", "unknown")
SUMMARY_DERIVATIONS = ("summary", "generated_summary", "summarization")
DIRECT_CHATS = ("", "dm", "private", "direct")
PROJECT_FOLDERS = ("docs", "plans", "project", "projects")
PARENT_FLAGS = ("requires_review", "stale", "consolidation_quarantined", "raptor_excluded", "raptor_forgotten")
UNSAFE_STATUSES = ("stale", "review_required", "disputed", "superseded", "deprecated")
LEARNING_WORDS = (
    ("user_correction", ("correction", "corrected", "corrig", "correg", "spelled", "surname", "prefer")),
    ("workflow_lesson", ("workflow", "playbook", "procedure", "dry-run", "dry run", "before live", "steps")),
    ("environment_quirk", ("env", "environment", "local", "venv", "path", "installed", "not found", "quirk")),
    ("tool_failure_lesson", ("tool", "failed", "failure", "error", "exception", "traceback", "http 500", "exit code")),
)
ACTIONS = {
    "duplicate_cluster": "merge", "heading_noise": "delete", "stale_low_value": "delete", "learning_promotion_candidate": "promote_to_skill",
    "reconsolidation_candidate": "draft_review", "fact_conflict_candidate": "draft_review", "fact_supersession_candidate": "draft_review", "fact_status_update_candidate": "draft_review",
}
POINT_ID = r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,255}$"


def plain(value: Column) -> Column:
    """Trimmed, lower-cased text; empty for null."""
    return F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))


def truthy(value: Column, words: tuple[str, ...] = TRUE_WORDS) -> Column:
    return plain(value).isin(*words)


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def status(fact_status: Column, stale: Column) -> Column:
    """Normal form of a status: synonyms of active, else what is stored, else by the stale flag."""
    stored = plain(fact_status)
    return F.when(stored.isin(*ACTIVE_STATUSES), "active").when(stored != "", stored).when(F.coalesce(stale, F.lit(False)), "stale").otherwise("active")


def observed_at(*values: Column) -> Column:
    """The first value that parses as a time: observed_at, valid_from, created_at, source_modified_at."""
    return F.coalesce(*[F.try_to_timestamp(v.cast("string")) for v in values])


def section(memory_kind: Column, source_type: Column, derivation: Column, claim: Column) -> Column:
    asserted = (plain(memory_kind) == "assertion") | (plain(source_type) == "assertion") | (F.coalesce(claim, F.lit("")) != "")
    made = (plain(memory_kind) == "summary") | (plain(source_type) == "summary") | plain(derivation).isin(*SUMMARY_DERIVATIONS)
    return F.when(asserted, "extracted_assertion").when(made, "generated_summary").otherwise("source_text")


def path_type(path: Column) -> Column:
    """Kind of a file by the folders of its path."""
    parts = F.split(F.lower(path), "/")
    return F.when(F.array_contains(parts, "skills"), "skill_doc").when(F.arrays_overlap(parts, F.array(*[F.lit(p) for p in PROJECT_FOLDERS])), "project_doc").otherwise("indexed_file")


def learning_type(trigger: Column, correction: Column, tool: Column) -> Column:
    """The first list that has a word of the texts; a tool's name stands for its list."""
    whole = F.lower(F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in (trigger, correction, tool)]))
    out = F
    for kind, words in LEARNING_WORDS:
        hit = any_of(whole, words)
        out = out.when(hit | (F.coalesce(tool, F.lit("")) != "") if kind == "tool_failure_lesson" else hit, kind)
    return out.otherwise("workflow_lesson")


def query_digest(query: Column) -> Column:
    """What may be logged of a query: its length and the first 16 hex digits of its sha256."""
    raw = F.coalesce(query, F.lit(""))
    return F.struct(F.length(raw).alias("query_length"), F.substring(F.sha2(raw.cast("binary"), 256), 1, 16).alias("query_digest"))


def point_id(value: Column) -> Column:
    """The id if it is a plain one: no URI, no path, no secret; else null."""
    bare = F.trim(value)
    return F.when(bare.rlike(POINT_ID) & ~tx.has_secret(bare), bare)


def entity_refs(scalars: list[Column], listed: Column, pattern: str) -> Column:
    """Distinct valid ids in order: those of the scalars, then of the list."""
    every = F.concat(F.array(*scalars), F.coalesce(listed, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull() & x.rlike(pattern)))


def bucket_key(override: Column, source_type: Column, project_path: Column, file_path: Column, heading: Column, text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Bucket of a leaf: the first of these that is not empty, then the text's first word of three letters or more."""
    given = [F.when(F.trim(c) != "", F.trim(c)) for c in (override, source_type, project_path, file_path)]
    head = F.substring(tx.collapse(F.lower(heading)), 1, 60)
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]+)"), 1), lambda w: (F.length(w) > 2) & ~w.isin(*stop) if stop else F.length(w) > 2)
    return F.coalesce(*given, F.when(head != "", F.concat(F.lit("heading:"), head)), F.when(F.size(words) > 0, F.concat(F.lit("tokens:"), F.get(words, F.lit(0)))), F.lit("default"))


def trust_reasons(flags: dict[str, Column], fact_status: Column, review_status: Column) -> Column:
    """Why a parent is not to be trusted, in order: its flags, its status, its review status. Empty: it is."""
    found = [F.when(F.coalesce(flags[k], F.lit(False)), F.lit(k)) for k in PARENT_FLAGS if k in flags]
    found.append(F.when(plain(fact_status).isin(*UNSAFE_STATUSES), F.concat(F.lit("fact_status:"), plain(fact_status))))
    found.append(F.when(plain(review_status) == "review_required", F.lit("raptor_review_status:review_required")))
    return F.array_compact(F.array(*found))


def owner_row(sender: Column, chat_type: Column, owners: tuple[str, ...]) -> Column:
    """Whether the owner wrote a row: a listed sender, or none in a one-to-one conversation."""
    named = F.coalesce(sender, F.lit("")) != ""
    return F.when(named, plain(sender).isin(*[o.strip().lower() for o in owners])).otherwise(plain(chat_type).isin(*DIRECT_CHATS))


def action(kind: Column) -> Column:
    """What a proposal of a kind may lead to; null for unknown kinds."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair]), kind)


def unanimous(value: Column) -> Column:
    """Aggregate: the value if all rows have the same one, else null."""
    same = F.coalesce(F.min(value).eqNullSafe(F.max(value)) & (F.count(value) == F.count(F.lit(1))), F.lit(False))
    return F.when(same, F.min(value))


def mean(values: Column) -> Column:
    """Mean of an array; 0 if empty."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)).otherwise(0.0)


def event_kind(pending: Column, bootstrap: Column, here: Column, old_hash: Column, new_hash: Column, seen_before: Column) -> Column:
    """What happened to a file, first match: an event that is pending, bootstrap, gone, first seen, cut anew,
    an earlier version, a new one."""
    return (
        F.when(F.coalesce(pending, F.lit("")) != "", pending).when(bootstrap, "observed").when(~here, "deleted").when(old_hash.isNull(), "observed")
        .when(old_hash == new_hash, "rechunked").when(seen_before, "restored").otherwise("modified")
    )


def clean(text: Column, fence: str = "memory") -> Column:
    """Text as it is stored: without blocks that recall put there (from their heading to the next heading of
    the first level that is none), without fenced blocks of the store's own tag ``fence``, no more than one empty line in a row."""
    injected = r"(?i)^#\s+(Relevant Long-Term Memory|Past Learnings)\b"
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r")
    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("kept"))

    def step(s: Column, line: Column) -> Column:
        own = F.trim(line).rlike(injected)
        skip = own | (s["skip"] & ~line.startswith("# "))
        return F.struct(skip.alias("skip"), F.when(skip, s["kept"]).otherwise(F.concat(s["kept"], F.array(line))).alias("kept"))

    kept = F.concat_ws("\n", F.aggregate(lines, start, step)["kept"])
    return F.trim(F.regexp_replace(F.regexp_replace(kept, rf"(?i)```{re.escape(fence)}\b[\s\S]*?```", ""), r"\n{3,}", "\n\n"))
