"""Text rules as column expressions (regular expressions run in the JVM)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import secrets
from .secrets import has_secret  # noqa: F401  one of the text rules

# Fixed patterns of exact signals: UUIDs, hex digests, tickets, routes, paths, colon and dotted chains, errors, HTTP statuses.
TOKENS = (
    r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    r"\b[0-9a-fA-F]{32}\b",
    r"\b[A-Z][A-Z0-9]{1,9}-\d{1,8}\b",
    r"(?:/[A-Za-z0-9_.@:-]+){2,}",
    r"/(?:[A-Za-z0-9_.-]+/){1,}[A-Za-z0-9_.-]+",
    r"\b[A-Za-z_][A-Za-z0-9_]*(?:::[A-Za-z_][A-Za-z0-9_]*){1,}\b",
    r"\b[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*){1,}\b",
    r"\b[A-Z][A-Za-z0-9_]*(?:Error|Exception|Warning|Failure)\b(?:\s*:?\s*[A-Za-z0-9_./-]{2,})?",
    r"\bHTTP\s*[1-5]\d{2}\b",
)
IDENTIFIER = r"\b[A-Za-z_][A-Za-z0-9_]{2,}\b"
# Fixed words that are no identifiers.
STOP_WORDS = (
    "the", "and", "for", "with", "this", "that", "from", "into", "onto", "your", "you", "are", "was", "were", "but", "not", "all", "any", "can",
    "use", "using", "run", "running", "have", "has", "had", "get", "got", "via", "per", "its", "out", "his", "her", "him", "she", "they", "them",
    "our", "who", "why", "how", "what", "when", "where", "here", "there", "these", "those", "such", "than", "then", "also", "about", "more", "most",
    "less", "much", "many", "some", "each", "every", "either", "neither", "both", "none", "one", "two", "three", "four", "five", "six", "seven",
    "eight", "nine", "ten", "quick", "brown", "fox", "jumps", "over", "lazy", "dog", "see", "look", "recall", "find", "show", "tell", "know", "think",
    "make", "made", "go", "went", "going", "done", "do", "does", "did", "doing", "thing", "things", "stuff", "data", "info", "note", "notes",
    "general", "specific", "kind", "type", "types",
)
# Fixed patterns of structure in a query: tickets, routes, dotted and colon paths, errors, HTTP statuses.
SIGNALS = (
    r"\b[A-Z][A-Z0-9]{1,9}-\d{1,8}\b",
    r"(?:/[A-Za-z0-9_.@:-]+){2,}",
    r"\b[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*){1,}\b",
    r"\b[A-Za-z_][A-Za-z0-9_]*(?:::[A-Za-z_][A-Za-z0-9_]*){1,}\b",
    r"\b[A-Z][A-Za-z0-9_]*(?:Error|Exception|Warning|Failure)\b",
    r"\bHTTP\s*[1-5]\d{2}\b",
)
# Fixed weights of fields in the sparse score.
TEXT_WEIGHT, META_WEIGHT, LITERAL_BONUS, AGREEMENT_BONUS = 1.0, 1.5, 2.0, 0.5


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def snippet(text: Column, n: int) -> Column:
    """At most n characters; a cut text ends in an ellipsis."""
    flat = collapse(text)
    return F.when(F.length(flat) > n, F.concat(F.rtrim(F.substring(flat, 1, n - 1)), F.lit("…"))).otherwise(flat)


def tokens(text: Column) -> Column:
    """Words of the collapsed, lower-cased text."""
    return F.filter(F.split(F.lower(collapse(text)), " "), lambda t: t != "")


#: Runs of punctuation at the start or the end of a word, in a text whose words are parted by spaces.
_ENDS = r"(?=[!-/:-@\[-`{-~])(?:(?<![^ ])[!-/:-@\[-`{-~]++|(?<![!-/:-@\[-`{-~])[!-/:-@\[-`{-~]++(?![^ ]))"


def fingerprint(text: Column) -> Column:
    """Words without punctuation at their ends, lower-cased, empty ones dropped, joined by a space. The whole text is rewritten at once."""
    bare = F.regexp_replace(F.lower(collapse(text)), _ENDS, "")
    return F.coalesce(F.trim(F.regexp_replace(bare, " {2,}", " ")), F.lit(""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def redact(text: Column, marker: str = "[REDACTED]") -> Column:
    """Texts without their credentials, see :func:`tidemark.functions.secrets.redact`."""
    return secrets.redact(text, marker)


def signal_tokens(text: Column, limit: int = 64) -> Column:
    """The first ``limit`` distinct exact-signal tokens, pattern by pattern, then identifiers that are no stop
    words; stripped of quotes and punctuation."""
    every = lambda p: F.regexp_extract_all(text, F.lit(f"(?U)({p})"), 1)  # noqa: E731  boundaries by Unicode's word characters
    found = [every(p) for p in TOKENS]
    names = F.filter(every(IDENTIFIER), lambda t: ~F.lower(t).isin(*STOP_WORDS))
    bare = F.transform(F.concat(*found, names), lambda t: F.regexp_replace(F.trim(t), r"^[`'\".,;:()\[\]{}<>]+|[`'\".,;:()\[\]{}<>]+$", ""))
    return F.slice(F.array_distinct(F.filter(bare, lambda t: t != "")), 1, limit)


def strong_signal(text: Column) -> Column:
    """Whether a query names something exactly: structure, or an identifier in snake, camel or digits."""
    parts = [text.rlike(p) for p in SIGNALS] + [text.rlike(r"\b[A-Za-z]+_[A-Za-z0-9_]+\b"), text.rlike(r"\b[a-z]+[A-Z][A-Za-z0-9]*\b"), text.rlike(r"\b[A-Za-z]+[0-9][A-Za-z0-9]*\b")]
    return F.coalesce(reduce(lambda a, b: a | b, parts), F.lit(False))


def path_parts(text: Column) -> Column:
    """Components of a path, dotted or colon chain, lower-cased, without a last short extension."""
    bare = F.regexp_replace(F.lower(text), r"\.[a-z0-9]{1,10}$", "")
    return F.filter(F.split(bare, r"/|::|\."), lambda p: p != "")


def aligned(query: Column, field: Column) -> Column:
    """Whether the components of ``query`` (two at least) are a contiguous run of those of ``field``."""
    n = F.size(query)
    starts = F.sequence(F.lit(1), F.greatest(F.size(field) - n + 1, F.lit(1)))
    return (n >= 2) & (F.size(field) >= n) & F.exists(starts, lambda i: F.slice(field, i, n) == query)


def sparse_score(query_tokens: list[str], fields: dict[str, Column], point_id: Column) -> Column:
    """Weighted hits of exact tokens in fields, plus a bonus for the id itself and for two fields agreeing."""
    wanted = F.array(*[F.lit(t) for t in query_tokens])
    hits = {name: F.size(F.array_intersect(signal_tokens(F.coalesce(col, F.lit(""))), wanted)) for name, col in fields.items()}
    literal = F.array_contains(wanted, point_id.cast("string"))
    score = reduce(lambda a, b: a + b, [h * (TEXT_WEIGHT if name == "text" else META_WEIGHT) for name, h in hits.items()])
    agreeing = reduce(lambda a, b: a + b, [(h > 0).cast("int") for h in hits.values()]) + literal.cast("int")
    return score + F.when(literal, TEXT_WEIGHT + LITERAL_BONUS).otherwise(0.0) + F.when(agreeing >= 2, AGREEMENT_BONUS).otherwise(0.0)


def digest_uuid(*parts: Column) -> Column:
    """The first 32 hex digits of sha256 over lines, written as a UUID."""
    return F.regexp_replace(F.substring(F.sha2(F.concat_ws("\n", *parts).cast("binary"), 256), 1, 32), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def slug(text: Column, joiner: str = "-", limit: int = 160) -> Column:
    out = F.regexp_replace(F.lower(text), r"[^a-z0-9]+", joiner)
    return F.substring(F.regexp_replace(out, rf"^\{joiner}+|\{joiner}+$", ""), 1, limit)


def word_chars(text: Column) -> Column:
    """Number of Unicode word characters."""
    return F.regexp_count(text, F.lit(r"(?U)\w"))


# Fixed words of the importance rule.
TRIVIAL = r"^(ok|okay|thanks|thank you|got it|sure|yes|no|yep|nope|k|ty|thx|np)\.?$"
KEYWORDS = ("remember", "important", "decision", "prefer", "correction", "never", "always")


def importance(text: Column, trusted: Column) -> Column:
    """1 for trivial texts, else 5, 2 more for a trusted source and for a keyword anywhere, then 2 less for a text
    below 40 characters that has not 8 yet; 1 to 10."""
    low = F.lower(F.coalesce(text, F.lit("")))
    score = F.lit(5) + F.when(trusted, 2).otherwise(0) + F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in KEYWORDS]), 2).otherwise(0)
    score = F.when((F.length(low) < 40) & (score < 8), score - 2).otherwise(score)
    return F.when(F.regexp_replace(low, r"^\s+|\s+$", "").rlike(TRIVIAL), 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(10), score)))
