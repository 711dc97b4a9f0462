"""URL filters: a blocked Bloom filter before an exact hash join.

A rule is a host and the beginning of a path; it fits its host and all subdomains where the URL's path
starts with the rule's. A URL can only fit rules whose key (host and path) is one of its own host's
parents with one of its path's beginnings of a length that occurs in the list: its candidates. These are
hashed and looked up in a blocked Bloom filter of the listed keys (one 512-bit block a key, eight bits
in it), so a lookup touches one cache line and nearly all candidates end there. The rest are joined with
the list by the key itself, which removes false positives; the longest rule that fits wins, and URLs
without one get the verdict ``allow``.

The filter is built on the executors, a block's bits are OR-ed before they meet, and its size is bounded
by ``max_filter_bytes``: beyond that more false positives reach the join, never a wrong verdict. The list
itself is joined, not broadcast, unless Spark finds it small.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to
``?``, ``#`` or the end; a null URL, or one without ``://``, has neither. Equal rows are judged once and
kept as often as they came. Of equal rules with different verdicts, block wins. An empty list allows all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORDS = 8  # 64-bit words of a block
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def parents(host: Column) -> Column:
    """The host and each of its parent domains."""
    parts = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys of all rules of paths of these lengths that could fit."""
    begin = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(path))
    return F.flatten(F.transform(parents(host), lambda h: F.transform(begin, lambda n: F.concat(h, F.substring(path, F.lit(1), n)))))


def bits(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each 64-bit hash, and the eight words of its bits in there."""
    h = hashes.view(np.uint64)
    with np.errstate(over="ignore"):
        block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        seed = (h & np.uint64(0xFFFFFFFF))[:, None] * (np.arange(1, 2 * WORDS, 2, dtype=np.uint64) * np.uint64(0x9E3779B1))[None, :]
        return block.astype(np.int64), np.uint64(1) << ((seed >> np.uint64(20)) & np.uint64(63))


def build_filter(keys: DataFrame, bits_per_key: int = 16, max_filter_bytes: int = 32 << 20) -> np.ndarray:
    """keys: (h long). The filter as blocks of eight 64-bit words."""
    n = keys.count()
    blocks = min(max(1, math.ceil(n * bits_per_key / (64 * WORDS))), max_filter_bytes // (8 * WORDS))
    schema = "block long, " + ", ".join(f"w{i} long" for i in range(WORDS))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((blocks, WORDS), np.uint64)
        for batch in batches:
            block, word = bits(batch.column("h").to_numpy(zero_copy_only=False), blocks)
            np.bitwise_or.at(own, block, word)
        used = np.flatnonzero(own.any(axis=1))
        yield pa.record_batch([pa.array(used), *(pa.array(own[used, i].view(np.int64)) for i in range(WORDS))], names=["block", *(f"w{i}" for i in range(WORDS))])

    found = keys.select("h").mapInArrow(common.lean(part), schema).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
    out = np.zeros((blocks, WORDS), np.int64)
    for row in found.collect():  # max_filter_bytes at most
        out[row.block] = row[1:]
    return out.view(np.uint64)


def _probe(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            keys, hashes = batch.column("keys"), batch.column("hashes")
            block, word = bits(hashes.flatten().to_numpy(zero_copy_only=False), len(table))
            hit = ((table[block] & word) == word).all(axis=1)
            owner = np.repeat(np.arange(len(keys)), np.diff(keys.offsets.to_numpy()))[hit]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(keys)))]).astype(np.int32)
            kept = pa.ListArray.from_arrays(offsets, keys.flatten().filter(pa.array(hit)))
            yield pa.record_batch([*(batch.column(c) for c in ("id", "host", "path", "n")), kept], names=["id", "host", "path", "n", "keys"])

    return run


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """rules: (host, path, verdict). Returns (id, host, path, rule, verdict), rule null where none fits."""
    spark = pages.sparkSession
    listed = rules.select(F.concat(F.translate("host", _UPPER, _LOWER), "path").alias("rule"), F.length("path").alias("l"), "verdict").where("rule is not null")
    lengths = sorted(r.l for r in listed.select("l").distinct().collect())  # lengths of paths, not rules
    exact = listed.groupBy("rule").agg(F.max("verdict").alias("verdict"))
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).groupBy("id", "host", "path").agg(F.count(F.lit(1)).alias("n"))
    if not lengths:
        judged = rows.select("id", "host", "path", "n", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    else:
        table = spark.sparkContext.broadcast(build_filter(exact.select(F.xxhash64("rule").alias("h")), **options))
        keyed = rows.withColumn("keys", candidates(F.col("host"), F.col("path"), lengths)).withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k)))
        passed = keyed.mapInArrow(common.lean(_probe(table)), f"id {kind}, host string, path string, n long, keys array<string>")
        hits = passed.select("id", "host", "path", "n", F.explode_outer("keys").alias("rule")).join(exact, "rule", "left")
        best = F.max(F.when(F.col("verdict").isNotNull(), F.struct(F.length("rule").alias("l"), "rule", "verdict"))).alias("b")
        judged = hits.groupBy("id", "host", "path", "n").agg(best).select("id", "host", "path", "n", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit("allow")).alias("verdict"))
    return judged.select("id", "host", "path", "rule", "verdict", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_")).drop("_")
