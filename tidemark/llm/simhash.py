"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprint: each shingle of ``shingle`` words, repeats included, votes with the bits of its XXH64
(seed 42); a bit is set if more than half of the votes have it. Shorter texts are one shingle, a
text without words has fingerprint zero.

Index. Distinct fingerprints only, so exact copies cost one entry. The upper nodes of the index are
the patterns that groups share under the masks of three segments of the 64 bits: two fingerprints at
distance 2 or less agree on one of them whole, so each fingerprint hangs below three upper nodes and
is compared below these only (accumulated difference 0 there, anything else is pruned without being
visited). A group with more than ``hot`` entries gets further upper nodes, three segments of the bits
left, by the same argument. Below an upper node, fingerprints are sorted by Gray rank; runs of
``fanout`` neighbours make a node that keeps the bits on which all below agree (mask and pattern),
and so on up. A search goes down from the top with one accumulated difference per node and leaves out
whole groups once it is above the limit. All searches of a batch go down together in numpy.

The links of a group leave it as a spanning forest, never as pairs; components are then found over
distinct fingerprints by :mod:`tidemark.llm.components`.

Null texts are empty. Repeated rows keep a row each. A null id counts as larger than any id. Columns
besides id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

SEED = 42
#: Lowest bit and width of the three segments, and of the three parts of what each of them leaves.
SEGMENTS = ((43, 21), (22, 21), (0, 22))


def fingerprint(starts: np.ndarray, ends: np.ndarray, text: bytes, shingle: int) -> int:
    """starts, ends: of the words in ``text``, which are separated by one space each."""
    n = len(starts)
    if not n:
        return 0
    k = min(shingle, n)
    digest = xxhash.xxh64_digest
    votes = b"".join([digest(text[a:b], SEED) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist())])
    ones = np.zeros(64, np.int64)
    votes = np.frombuffer(votes, np.uint8).reshape(-1, 8)
    for at in range(0, len(votes), 1 << 16):
        ones += np.unpackbits(votes[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(votes)).tobytes(), "big")


def _fingerprints(shingle: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch, "text", limit):
                counts, words = common.words_of(part.column("text"))
                size = pc.binary_length(words).to_numpy(zero_copy_only=False)
                stop = np.cumsum(counts)
                joined = pc.binary_join(pa.ListArray.from_arrays(np.concatenate([[0], stop]).astype(np.int32), words.cast(pa.string())), " ")
                found = np.empty(len(counts), np.uint64)
                for i, (a, b) in enumerate(zip((stop - counts).tolist(), stop.tolist())):
                    ends = np.cumsum(size[a:b] + 1) - 1
                    found[i] = fingerprint(ends - size[a:b], ends, joined[i].as_buffer().to_pybytes() if b > a else b"", shingle)
                yield pa.record_batch([part.column("id"), pa.array(found.view(np.int64))], names=["id", "fp"])

    return run


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in the reflected Gray sequence."""
    out = codes.astype(np.uint64, copy=True)
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Groups of fingerprints, each in Gray order, under levels of nodes that hold the bits shared below.

    codes: fingerprints sorted by (group, Gray rank). group: ascending group number of each.
    """

    def __init__(self, codes: np.ndarray, group: np.ndarray, fanout: int = 8):
        self.codes, self.group = codes, group
        self.levels: list[tuple[np.ndarray, ...]] = []
        first, both, either, owner = np.arange(len(codes)), codes, codes, group
        while True:
            # runs of ``fanout`` neighbours of one group
            begins = np.flatnonzero(np.diff(owner, prepend=-1))
            within = np.arange(len(owner)) - np.repeat(begins, np.diff(np.append(begins, len(owner))))
            cut = np.flatnonzero(within % fanout == 0)
            both, either = np.bitwise_and.reduceat(both, cut), np.bitwise_or.reduceat(either, cut)
            self.levels.append((cut, np.append(cut[1:], len(owner)), both, ~(both ^ either)))
            owner = owner[cut]
            if len(np.unique(owner)) == len(owner):
                break
        self.top_of = owner

    def links(self, limit: int, tile: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs i < j of one group at ``limit`` or fewer differing bits, some at a time."""
        top = np.searchsorted(self.top_of, self.group)
        for at in range(0, len(self.codes), tile):
            query = np.arange(at, min(at + tile, len(self.codes)))
            stack = [(len(self.levels) - 1, query, top[query])]
            while stack:
                level, query, node = stack.pop()
                if len(query) > 4 * tile:  # go down in parts, so that memory stays bounded
                    half = len(query) // 2
                    stack += [(level, query[:half], node[:half]), (level, query[half:], node[half:])]
                    continue
                begin, end, pattern, mask = self.levels[level]
                near = np.bitwise_count((self.codes[query] ^ pattern[node]) & mask[node]) <= limit
                query, node = query[near], node[near]
                width = end[node] - begin[node]
                query = np.repeat(query, width)
                below = np.repeat(begin[node] - (np.cumsum(width) - width), width) + np.arange(width.sum())
                if level:
                    stack.append((level - 1, query, below))
                else:
                    later = below > query
                    query, below = query[later], below[later]
                    near = np.bitwise_count(self.codes[query] ^ self.codes[below]) <= limit
                    yield query[near], below[near]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest member of the component of each of n members."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            ra, rb = root[a], root[b]
            split = ra != rb
            a, b, ra, rb = a[split], b[split], ra[split], rb[split]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
    return root


def _link(limit: int, fanout: int, batch_rows: int):
    """Sorted (key, gray) rows to edges; a group may span batches, so the last one is held back."""

    def edges(key: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
        root = forest(len(codes), GrayIndex(codes, group, fanout).links(limit))
        tied = np.flatnonzero(root != np.arange(len(codes)))
        return pa.record_batch([pa.array(codes[tied].view(np.int64)), pa.array(codes[root[tied]].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, codes = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy(zero_copy_only=False)])
            codes = np.concatenate([codes, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(keys) >= batch_rows:
                whole = int(np.searchsorted(keys, keys[-1]))
                if whole:
                    yield edges(keys[:whole], codes[:whole])
                    keys, codes = keys[whole:], codes[whole:]
        if len(keys):
            yield edges(keys, codes)

    return run


def _segment(bits: F.Column, at: int, width: int) -> F.Column:
    return F.shiftrightunsigned(bits, at).bitwiseAND(F.lit((1 << width) - 1))


def _keys(fps: DataFrame, hot: int) -> DataFrame:
    """Three rows (key, fp) for each fingerprint; nine keys for those in groups above ``hot``."""
    bits = F.col("fp")
    top = F.array(*[F.struct(F.lit(i).cast("long").alias("seg"), _segment(bits, at, w).alias("val")) for i, (at, w) in enumerate(SEGMENTS)])
    rows = fps.select("fp", F.explode(top).alias("k")).select("fp", "k.seg", "k.val")
    large = rows.groupBy("seg", "val").count().where(F.col("count") > hot).select("seg", "val", F.lit(True).alias("hot"))
    rest = []  # of the bits outside a segment, three parts: two differences leave one of them equal
    for i, (at, w) in enumerate(SEGMENTS):
        left = [b for b in range(64) if not at <= b < at + w]
        rest += [(i, j, left[j * len(left) // 3 : (j + 1) * len(left) // 3]) for j in range(3)]
    def part(own: list[int]) -> F.Column:
        return F.xxhash64(bits.bitwiseAND(F.lit(int(np.array(sum(1 << b for b in own), np.uint64).view(np.int64)))))
    sub = F.when(F.col("hot"), F.transform(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), part(own).alias("h")) for i, j, own in rest]), lambda x: F.when(x["i"] == F.col("seg"), F.xxhash64(x["j"], x["h"]))))
    sub = F.filter(F.coalesce(sub, F.array(F.lit(0).cast("long"))), lambda x: x.isNotNull())
    return rows.join(large, ["seg", "val"], "left").select("fp", "seg", "val", F.explode(sub).alias("sub")).select(F.xxhash64("seg", "val", "sub").alias("key"), "fp")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, chunk_bytes: int = 8 << 20) -> DataFrame:
    """(id, fp): the fingerprint of every text, as a signed 64-bit integer."""
    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(common.lean(_fingerprints(shingle, chunk_bytes)), f"id {id_type}, fp long")


def simhash_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, limit: int = 2, fanout: int = 8, hot: int = 100_000, batch_rows: int = 200_000) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id whose text is reachable by links.

    ``limit``: differing bits of a link; the segments hold for 2 at most. ``hot``, ``batch_rows``:
    entries below an upper node, and of a batch of them; they change memory, not the result.
    """
    if not 0 <= limit < len(SEGMENTS):
        raise ValueError(f"limit must be 0 to {len(SEGMENTS) - 1}")
    rows = common.materialise(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "simhash-fp")
    fps = rows.groupBy("fp").agg(F.min("id").alias("low"))
    rank = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    keyed = _keys(fps.select("fp"), hot).withColumn("rank", rank.bitwiseXOR(F.lit(-(1 << 63))))
    edges = keyed.repartition("key").sortWithinPartitions("key", "rank").select("key", "fp").mapInArrow(common.lean(_link(limit, fanout, batch_rows)), "a long, b long")
    members = connected_components(edges)
    roots = fps.join(members.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    lows = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    of = roots.join(lows, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("id", "fp", "component_id")
