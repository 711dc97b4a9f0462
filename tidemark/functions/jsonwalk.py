"""JSON values of any depth, walked in the JVM as one pass over their tokens.

A document is cut into tokens by one pattern: keys with their colon, strings, brackets and commas, and everything else (numbers,
true, false, null). Nothing is parsed into a schema, so depth and shape don't matter. Null documents hold nothing
and stay null; what is no JSON is cut the same way and gives no error. The rewritten text grows by concatenation, which
suits payloads of some hundred kilobytes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import secrets

# Possessive, as other repeats of a group recurse in Java and overflow on long strings.
_STRING = r'"(?:[^"\\]++|\\.)*+"'
TOKEN = rf'{_STRING}\s*:|{_STRING}|[{{}}\[\],]|[^\s{{}}\[\],:"]+'
# Fixed parts of key names whose value is redacted whole, and names that keep a boolean.
SECRET_KEYS = ("api_key", "apikey", "token", "password", "passwd", "secret", "authorization", "bearer", "credential", "private_key")
EXEMPT_KEYS = ("contains_secret_text", "secret_bearing")


def tokens(document: Column) -> Column:
    return F.regexp_extract_all(document, F.lit(TOKEN), 0)


def _plain(token: Column) -> Column:
    """What a key or a string says, without quotes and escapes."""
    quoted = F.regexp_replace(token, r"\s*:$", "")
    return F.from_json(F.concat(F.lit("["), quoted, F.lit("]")), "array<string>")[0]


def strings(document: Column) -> Column:
    """Every key and every string value, in order."""
    return F.transform(F.filter(tokens(document), lambda t: t.startswith('"')), _plain)


def any_secret(document: Column) -> Column:
    """Whether a key or a string at any depth holds a credential."""
    return F.coalesce(F.exists(strings(document), secrets.has_secret), F.lit(False))


def redact(document: Column, marker: str = secrets.MARKER) -> Column:
    """The document, without white space between tokens, with a marker for each value whose key names a credential (an object or
    a list as a whole; the exempt keys keep a boolean), and for each string that holds a credential or the word bearer."""
    shown = F.lit(f'"{marker}"')

    def kind(token: Column) -> Column:
        key = token.startswith('"') & token.endswith(":")
        text = token.startswith('"') & ~key

        def after(name: Column) -> Column:
            # 2: its value goes unless it is a boolean; 1: its value goes
            return F.when(name.isin(*EXEMPT_KEYS), 2).when(reduce(lambda a, b: a | b, [F.contains(name, F.lit(k)) for k in SECRET_KEYS]), 1).otherwise(0)

        def bad(said: Column) -> Column:
            return F.contains(F.lower(said), F.lit("bearer")) | secrets.has_secret(said)

        # arrays of one: what a token says is read once, for all rules
        named = F.get(F.transform(F.array(F.when(key, F.lower(_plain(token)))), after), F.lit(0))
        held = F.exists(F.array(F.when(text, _plain(token))), bad)
        bare = F.when(key, F.regexp_replace(token, r"\s*:$", ":")).otherwise(token)
        return F.struct(bare.alias("t"), F.when(key, named).otherwise(0).alias("after"), F.coalesce(text & held, F.lit(False)).alias("bad"))

    def step(state: Column, token: Column) -> Column:
        t, opens, closes = token["t"], token["t"].isin("{", "["), token["t"].isin("}", "]")
        depth = state["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        skipping, pending = state["skip"] >= 0, state["after"] > 0
        boolean = (state["after"] == 2) & t.isin("true", "false")
        hidden = pending & ~boolean
        skip = F.when(skipping, F.when(depth == state["skip"], -1).otherwise(state["skip"])).when(hidden & opens, state["depth"]).otherwise(-1)
        piece = F.when(skipping, "").when(hidden | token["bad"], shown).otherwise(t)
        after = F.when(skipping, 0).otherwise(token["after"])
        return F.struct(depth.alias("depth"), skip.cast("int").alias("skip"), after.alias("after"), F.concat(state["out"], piece).alias("out"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("skip"), F.lit(0).alias("after"), F.lit("").alias("out"))
    return F.aggregate(F.transform(tokens(document), kind), start, step, lambda s: s["out"])
