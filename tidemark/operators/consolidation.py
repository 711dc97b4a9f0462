"""Data-quality proposals over points: one function for each kind."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import payload as pl
from ..functions import text as tx
from ..schema import TERMINAL_STATUSES, now_column
from ..session import scratch_table, shared_folder

#: Words whose frequency orders a set; the rest are rarer.
FREQUENT = 200_000
#: Odd numbers that put words in other orders; sets of which one of these makes the same word the smallest meet.
MIXERS = (1, 0xD6E8FEB86659FD93, 0xA3B195354A39B70D)
#: Sets that meet in one task, bits of the filter of sets that are in a pair, and the cell of pairs that have none.
TILE, FILTER, LOOSE = 1024, 1 << 26, -(1 << 40)


def exact_duplicates(points: DataFrame) -> DataFrame:
    """(id, proposal_id, canonical_id, n): each point of a group of two or more of one fingerprint, with the group's name, its size and its canonical
    point (importance, confidence, created_at, id). A group is named by its fingerprint, so no group's ids are collected."""
    best = F.max_by("id", F.struct("importance", "confidence", "created_at", "id")).alias("canonical_id")
    shared_folder(points.sparkSession)
    rows = points.select("id", "importance", "confidence", "created_at", F.sha2(tx.fingerprint(F.col("text")).cast("binary"), 256).alias("fp")).checkpoint()
    groups = rows.groupBy("fp").agg(F.count(F.lit(1)).cast("int").alias("n"), best).where("n > 1")
    return rows.select("id", "fp").join(groups, "fp").select("id", F.concat(F.lit("duplicate-"), F.substring("fp", 1, 16)).alias("proposal_id"), "canonical_id", "n")


def jaccard_pairs(points: DataFrame, threshold: float, *, words: Column | None = None, block: str | None = None) -> DataFrame:
    """(a, b, jaccard): pairs a < b of representatives with Jaccard >= threshold over word sets, and each representative
    with its copies at 1. Exact, by prefix filtering; only points of one ``block`` (a column) meet, if given.

    Equal sets (by digest) are one representative, the smallest id. Words are 64-bit hashes, the ``FREQUENT`` most frequent ones last, by rarity, the
    others by hash (any fixed order is exact): two such sets share one of the first |x| - ceil(t |x|) + 1, which each task takes from its own sets. A pair is looked at where both sizes, what
    is left of both behind the shared word, and 128 parities of the words of either allow the overlap it needs. The rarest words are joined, so no key is as
    long as a frequent word's list. Texts without words are in no pair.

    The pairs grow faster than the texts, so a pair carries no words: :func:`_overlaps` brings the sets of many pairs together once. Sets are written
    once, and only those that are in a pair are moved."""
    own = F.filter(words, lambda w: w != "") if words is not None else tx.tokens(F.col("text"))
    room = F.col(block).cast("string") if block else F.lit("")
    hashes = F.array_sort(F.array_distinct(F.transform(own, lambda w: F.xxhash64(w, room))))
    # texts are cut into words once, by a generator, which the planner does not copy into the filter and the digest
    sets = points.select("id", F.explode(F.array(hashes)).alias("w")).where(F.size("w") > 0)
    sets = scratch_table(sets.select("id", "w", F.xxhash64("w").alias("d"), F.xxhash64(F.lit(1), "w").alias("e")))
    leader = sets.groupBy("d", "e").agg(F.min("id").alias("rep"))
    member = scratch_table(sets.select("id", "d", "e").join(leader, ["d", "e"]).select("rep", "id"))
    prefix = _prefixes(sets.select("id", "w"), member.where("id = rep").select("id"), threshold)
    a, b = prefix.alias("a"), prefix.alias("b")
    need = threshold / (1 + threshold) * (F.col("a.n") + F.col("b.n")) - 1e-9
    close = (F.col("a.id") < F.col("b.id")) & (F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n") - 1e-9)
    close &= F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i")) >= need
    # bits of the parities that differ are never more than words that differ
    differ = F.bit_count(F.col("a.s").bitwiseXOR(F.col("b.s"))) + F.bit_count(F.col("a.z").bitwiseXOR(F.col("b.z")))
    close &= differ <= (1 - threshold) / (1 + threshold) * (F.col("a.n") + F.col("b.n")) + 1e-9
    cell = F.coalesce(*[F.when(F.col(f"a.c{k}") == F.col(f"b.c{k}"), F.col(f"a.c{k}")) for k in range(len(MIXERS))])
    candidates = scratch_table(a.join(b, (F.col("a.t") == F.col("b.t")) & close).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), cell.alias("cell")).distinct())
    scored = _overlaps(candidates, sets.select("id", "w"), threshold).where(F.col("jaccard") >= threshold)
    copies = member.where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"))
    return scored.select("a", "b", "jaccard").unionByName(copies)


def expand_pairs(pairs: DataFrame, parts: int = 16) -> DataFrame:
    """(a, b, jaccard): every pair a < b of points, from pairs as :func:`jaccard_pairs` gives them: copies are put in for their representative, and meet
    each other. That is quadratic in a group of copies; no group is collected, and each is met in ``parts`` places."""
    pairs = scratch_table(pairs)
    copies, near = pairs.where("jaccard >= 1").select(F.col("a").alias("rep"), F.col("b").alias("id")), pairs.where("jaccard < 1")
    member = scratch_table(copies.unionByName(copies.select("rep", F.col("rep").alias("id")).distinct()))
    x, y = member.select(F.col("rep").alias("a"), F.col("id").alias("x")), member.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    far = near.join(x, "a", "left").join(y, "b", "left").withColumns({"x": F.coalesce("x", "a"), "y": F.coalesce("y", "b")})
    place = F.pmod(F.xxhash64("x"), F.lit(parts))
    one = x.withColumn("part", place)
    two = y.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    same = one.join(two, (one["a"] == two["b"]) & (one["part"] == two["part"]) & (one["x"] < two["y"])).select("x", "y", F.lit(1.0).alias("jaccard"))
    return far.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard").unionByName(same.select(F.col("x").alias("a"), F.col("y").alias("b"), "jaccard"))


def _rows(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists end to end, and how many each has."""
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())


def _smallest(flat: np.ndarray, starts: np.ndarray, mixers: tuple[int, ...]) -> list[np.ndarray]:
    """For each of ``mixers``, the smallest mixed word of each set, as a number of 32 bits: sets that share most words agree in most of these."""
    found = []
    for k, mixer in enumerate(mixers):
        least = np.minimum.reduceat(flat.view(np.uint64) * np.uint64(mixer), starts) if len(starts) else flat.view(np.uint64)
        found.append(((least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32) ^ np.uint32(k * 0x3C6EF372)).view(np.int32))
    return found


def _prefixes(sets: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(id, n, s, z, c0, .., i, t): the first words of each set (id, w) of ``reps``, which are all that the join of pairs has to look at, whether the words that fall
    on each of 128 bits are odd in number, and the set's smallest mixed words. Only the frequent words, a bounded
    number, reach the driver; the sets are ordered by Arrow batch, where they are read, and only their first words are moved."""
    often = sets.select(F.explode("w").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1").orderBy(F.desc("df"), "t").limit(FREQUENT)
    often = sorted((r["t"], place) for place, r in enumerate(sorted(often.collect(), key=lambda r: (r["df"], r["t"])), 1))
    words, places = np.array([t for t, _ in often], np.int64), np.array([p for _, p in often], np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, n = _rows(batch.column("w"))
            row = np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(words, flat), max(len(words) - 1, 0))
            place = np.where(words[at] == flat, places[at], 0) if len(words) else np.zeros(len(flat), np.int64)
            order = np.argsort(row * (len(words) + 1) + place, kind="stable")  # by set, then place; a set's hashes come in order
            many = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
            first = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(many, n)
            bit, starts = np.left_shift(1, flat & 63), np.cumsum(n) - n
            s, z = (np.bitwise_xor.reduceat(np.where((flat >> 6 & 1) == side, bit, 0), starts) if len(n) else flat for side in (0, 1))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(flat[order][first], pa.int64()))
            columns = [batch.column("id"), pa.array(n, pa.int32()), pa.array(s, pa.int64()), pa.array(z, pa.int64()), *(pa.array(c) for c in _smallest(flat, starts, mixers)), lists]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "s", "z", *cells, "t"])

    mixers, cells = MIXERS, [f"c{k}" for k in range(len(MIXERS))]
    cards = sets.mapInArrow(cut, f"id {sets.schema['id'].dataType.simpleString()}, n int, s bigint, z bigint, {', '.join(f'{c} int' for c in cells)}, t array<bigint>")
    return cards.join(reps, "id", "left_semi").select("id", "n", "s", "z", *cells, F.posexplode("t").alias("i", "t"))


def _bits(own: np.ndarray, cell: np.ndarray | int) -> np.ndarray:
    """The places of points (by the hash of their id) in their cells, in a filter of :data:`FILTER` bits."""
    mixed = (own.view(np.uint64) ^ (np.atleast_1d(cell).astype(np.int64).view(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - FILTER.bit_length() + 1)).astype(np.int64)


def _filter(rows: DataFrame) -> np.ndarray:
    """Of the places of rows (own, cell), see :func:`_bits`, a bit each; Spark puts them together, in pieces."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bits(*(batch.column(c).to_numpy() for c in ("own", "cell"))))], ["at"])

    chunk, held = 1 << 15, np.zeros(FILTER // 8, np.uint8)
    for r in rows.mapInArrow(placed, "at bigint").groupBy(F.floor(F.col("at") / chunk).alias("k")).agg(F.bitmap_construct_agg(F.col("at") % chunk).alias("bits")).collect():
        held[r["k"] * chunk // 8 : (r["k"] + 1) * chunk // 8] = np.frombuffer(r["bits"], np.uint8)
    return held


def _known(held: np.ndarray, own: np.ndarray, cell: np.ndarray | int) -> np.ndarray:
    at = _bits(own, cell)
    return (held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _overlaps(candidates: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of candidates (a, b, cell): pairs of distinct sets (id, w) of sorted 64-bit words.

    The sets of a cell's pairs meet in one task, where their overlaps are counted: a set is moved once for each of its cells, ``len(MIXERS)`` times at most, and not
    for each of its pairs. Cells are put together until they hold some ``TILE`` sets; larger ones are parted into tiles of about as many on either side. Few similar
    pairs have no cell: of those that 1,024 parities leave, the words are joined. Sets without pairs stay where they are read, by a filter of a fixed size."""
    cells = scratch_table(candidates.select(F.explode(F.array("a", "b")).alias("id"), F.coalesce(F.col("cell").cast("long"), F.lit(LOOSE)).alias("cell")).distinct().select(F.xxhash64("id").alias("own"), "cell"))
    groups = 1 + cells.where(F.col("cell") != LOOSE).count() // TILE
    big = cells.where(F.col("cell") != LOOSE).groupBy(F.pmod("cell", F.lit(groups)).alias("x")).count().where(F.col("count") > 2 * TILE).collect()  # one row for thousands of sets
    parts = {r["x"]: 1 + r["count"] // TILE for r in big}

    held, mixers = _filter(cells), MIXERS

    def tiles(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = cell.astype(np.int64) % groups
        return x, np.array([parts.get(i, 1) for i in x.tolist()], np.int64)

    def deal_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, n = _rows(batch.column("w"))
            own = batch.column("own").to_numpy()
            for cell in _smallest(flat, np.cumsum(n) - n, mixers):
                row = np.flatnonzero(_known(held, own, cell))
                x, size = tiles(cell[row])
                at = np.repeat(np.arange(len(row)), size)
                i, j = own[row][at] % size[at], np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
                picked = pa.array(row[at])
                yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in (x[at], np.minimum(i, j), np.maximum(i, j))), batch.column("id").take(picked), batch.column("w").take(picked)], ["x", "i", "j", "id", "w"])

    def deal_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, size = tiles(batch.column("cell").to_numpy())
            i, j = (batch.column(c).to_numpy() % size for c in ("p", "q"))
            yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in (x, np.minimum(i, j), np.maximum(i, j))), batch.column("a"), batch.column("b")], ["x", "i", "j", "a", "b"])

    def parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_known(held, batch.column("own").to_numpy(), LOOSE)))
            flat, n = _rows(batch.column("w"))
            # the bits of sets are counted side by side: 16 numbers of 64 bits each
            odd = np.bincount(np.repeat(np.arange(len(n)), n) * 1024 + (flat & 1023), minlength=1024 * len(n)).astype(np.uint8) & 1
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * 16, pa.int32()), pa.array(np.packbits(odd).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int32()), lists], ["id", "n", "p"])

    kind = sets.schema["id"].dataType.simpleString()
    named = sets.select("id", "w", F.xxhash64("id").alias("own"))
    key = "x bigint, i bigint, j bigint"
    left = candidates.where("cell IS NOT NULL").select("a", "b", "cell", F.xxhash64("a").alias("p"), F.xxhash64("b").alias("q")).mapInArrow(deal_pairs, f"{key}, a {kind}, b {kind}")
    right = named.mapInArrow(deal_sets, f"{key}, id {kind}, w array<bigint>")
    near = left.groupBy("x", "i", "j").cogroup(right.groupBy("x", "i", "j")).applyInArrow(_count_shared, f"a {kind}, b {kind}, jaccard double")
    sized = named.mapInArrow(parities, f"id {kind}, n int, p array<bigint>")
    a, b = (sized.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("p").alias(f"p_{c}")) for c in ("a", "b"))
    differ = F.aggregate(F.zip_with("p_a", "p_b", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, x: t + x)
    loose = candidates.where("cell IS NULL").join(a, "a").join(b, "b").where(differ <= (1 - threshold) / (1 + threshold) * (F.col("n_a") + F.col("n_b")) + 1e-9).select("a", "b")
    few = _filter(loose.select(F.explode(F.array("a", "b")).alias("id")).select(F.xxhash64("id").alias("own"), F.lit(LOOSE).alias("cell")))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_known(few, batch.column("own").to_numpy(), LOOSE))).select(["id", "w"])

    picked = named.mapInArrow(pick, f"id {kind}, w array<bigint>")
    far = loose.join(picked.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a").join(picked.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b")
    return near.unionByName(far.select("a", "b", tx.jaccard(F.col("wa"), F.col("wb")).alias("jaccard")))


def _count_shared(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """Jaccard of pairs (a, b) of the sets (id, w) of a tile. The words of one set are marked, and looked up for all sets that it is paired with."""
    pairs, ids, lists = pairs.combine_chunks(), sets.column("id").combine_chunks(), sets.column("w").combine_chunks()
    if not len(pairs):
        return pa.table({"a": pairs.column("a"), "b": pairs.column("b"), "jaccard": pa.array([], pa.float64())})
    a, b = (pc.index_in(pairs.column(c), value_set=ids).to_numpy() for c in ("a", "b"))
    flat, n = _rows(lists)
    known, code = np.unique(flat, return_inverse=True)
    starts, marks, shared = np.cumsum(n) - n, np.zeros(len(known), np.uint8), np.empty(len(a), np.int64)
    order = np.argsort(a, kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
        one = a[run[0]]
        own = code[starts[one] : starts[one] + n[one]]
        marks[own] = 1
        for at in range(0, len(run), 1024):
            some = run[at : at + 1024]
            many = n[b[some]]
            ends = np.cumsum(many)
            place = np.arange(ends[-1]) + np.repeat(starts[b[some]] - ends + many, many)
            shared[some] = np.add.reduceat(marks[code[place]], ends - many, dtype=np.int64)
        marks[own] = 0
    return pa.table({"a": pairs.column("a"), "b": pairs.column("b"), "jaccard": pa.array(shared / (n[a] + n[b] - shared))})


def stale_low_value(points: DataFrame, now: str, *, days: int = 90, importance: int = 4, confidence: float = 0.5) -> DataFrame:
    return points.where(stale_rule(now, days=days, importance=importance, confidence=confidence))


def stale_rule(now: str, *, days: int = 90, importance: int = 4, confidence: float = 0.5) -> Column:
    old = F.col("created_at") <= now_column(now) - F.expr(f"INTERVAL {days} DAYS")
    return F.coalesce(old & (F.col("importance") < importance) & (F.col("access_count") == 0) & (F.col("confidence") <= confidence), F.lit(False))


def status_update(now: str, confidence: float = 0.6) -> Column:
    """Struct of the new status of a fact and why, first match: a stale flag, a link to what supersedes it, a link to what
    invalidates it, a validity that ended. Null: none, or no fact key, or too little confidence (none given counts as 1)."""
    current = pl.status(F.col("fact_status"), F.col("stale"))
    linked = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""
    known = (F.coalesce(F.trim("fact_key"), F.lit("")) != "") & (F.coalesce("confidence", F.lit(1.0)) >= confidence)
    over = (F.col("valid_until") < now_column(now)) & ~current.isin("stale", *TERMINAL_STATUSES)
    rules = (
        (F.coalesce(F.col("stale"), F.lit(False)) & (current != "stale"), "stale", "payload stale flag is set"),
        (linked("superseded_by") & (current != "superseded"), "superseded", "payload superseded_by link is set"),
        (linked("invalidated_by") & (current != "disputed"), "disputed", "payload invalidated_by link is set"),
        (over, "stale", "valid_until is in the past"),
    )
    found = F
    for when, what, why in rules:
        found = found.when(known & when, F.struct(F.lit(what).alias("status"), F.lit(why).alias("reason")))
    return found


def status_updates(points: DataFrame, now: str, confidence: float = 0.6) -> DataFrame:
    """(id, fact_status, new_status, reason) of points whose stored status should be looked at."""
    rows = points.withColumn("update", status_update(now, confidence)).where(F.col("update").isNotNull())
    return rows.select("id", "fact_status", F.col("update.status").alias("new_status"), F.col("update.reason").alias("reason"))


def _digest() -> Column:
    return F.sha2(tx.fingerprint(F.col("text")).cast("binary"), 256)


def conflicts(points: DataFrame, confidence: float = 0.6, dated: bool = False, digest: Column | None = None) -> DataFrame:
    """(fact_key, n, n_texts): two or more texts for one fact among non-terminal points; ``dated`` adds the times of
    the first and the last of them. ``digest``: that of the texts' fingerprints, if it is known already."""
    live = points.where((F.col("confidence") >= confidence) & F.coalesce(~F.col("fact_status").isin(*TERMINAL_STATUSES), F.lit(True)))
    found = live.groupBy("fact_key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(_digest() if digest is None else digest).alias("n_texts"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    found = found if dated else found.drop("first_at", "last_at")
    return found.where("n >= 2 and n_texts >= 2")


def supersessions(points: DataFrame, confidence: float = 0.6) -> DataFrame:
    """(id, superseded_by): strictly older non-terminal points of a fact, and its newest point."""
    known = points.where(F.col("confidence") >= confidence)
    newest = known.groupBy("fact_key").agg(F.max(F.struct("created_at", "importance", "confidence", "id")).alias("m"))
    older = known.where(F.coalesce(~F.col("fact_status").isin(*TERMINAL_STATUSES), F.lit(True))).join(newest, "fact_key")
    return older.where(F.col("created_at") < F.col("m.created_at")).select("id", F.col("m.id").alias("superseded_by"))


def promotions(points: DataFrame) -> DataFrame:
    return points.where((F.col("confidence") >= 0.85) & (F.col("importance") >= 8) & ~tx.has_secret(F.col("text")))


# Fixed headings that indexers and agents leave behind.
KNOWN_HEADINGS = (
    "tareas", "notas", "reflexion", "reflexión", "contribution", "implementation", "files modified this turn", "plan de implementacion",
    "plan de implementación", "risks doubts", "next handoff",
)


def heading_kind(text: Column) -> Column:
    """``known`` for a text of at most 80 characters that is only a known heading, which may be removed unattended; ``generic``
    for a marked one of four words at most without a sentence, which is for review; else null."""
    flat = tx.collapse(text)
    bare = F.regexp_replace(flat, r"^(#\s*)+", "")
    words = tx.fingerprint(bare)
    generic = flat.startswith("#") & (F.size(F.filter(F.split(words, " "), lambda w: w != "")) <= 4) & ~bare.rlike("[.!?;:]")
    # most texts are longer: they are not cut into words
    return F.when((F.length(text) > 80) & (F.length(flat) > 80), None).when((flat != "") & (F.length(flat) <= 80), F.when(words.isin(*KNOWN_HEADINGS), "known").when(generic, "generic"))


def heading_noise(points: DataFrame) -> DataFrame:
    """Points whose text is only a heading, with ``known``, see :func:`heading_kind`."""
    return points.withColumn("known", heading_kind(F.col("text")) == "known").where(F.col("known").isNotNull())


def reconsolidations(points: DataFrame, confidence: float = 0.6, digest: Column | None = None) -> DataFrame:
    """(fact_key, canonical_id, n, n_texts): facts with two or more points and texts, whatever their status; the
    canonical point has the highest importance, confidence, creation time and id. ``digest`` as in :func:`conflicts`."""
    known = points.where((F.col("confidence") >= confidence) & (F.coalesce("fact_key", F.lit("")) != ""))
    # a text is digested once, by the tasks that read it, and each fact's texts are counted before facts are
    text = (_digest() if digest is None else digest).alias("fp")
    texts = known.groupBy("fact_key", text).agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("importance", "confidence", "created_at", "id")).alias("top"))
    worded = F.when(F.col("fp") != F.sha2(F.lit("").cast("binary"), 256), 1)
    found = texts.groupBy("fact_key").agg(F.max("top")["id"].alias("canonical_id"), F.sum("k").alias("n"), F.count(worded).alias("n_texts"))
    return found.where("n >= 2 and n_texts >= 2")


def greedy_star(pairs: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(seed, id): in id order, a point that no earlier seed took is a seed and takes all points linked to it that
    are left. pairs: (a, b, jaccard), links of representatives and, at 1.0, of each representative to its copies,
    as :func:`jaccard_pairs` gives them; copies go where their representative goes.

    A representative is a seed if none of its smaller neighbours is one, and is taken by its smallest neighbour
    that is. Each round settles all whose smaller neighbours are settled, by joins of the links that are left: no
    group is collected anywhere. Rounds are cut by checkpoints in the folder that the session names."""
    shared_folder(pairs.sparkSession)
    pairs = scratch_table(pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.when(F.col("jaccard") >= 1, F.col("a")).alias("rep"), F.when(F.col("jaccard") >= 1, F.col("b")).alias("id")))  # found once
    copies = pairs.where("rep IS NOT NULL").select("rep", "id")
    links = pairs.where("rep IS NULL").select(F.col("x").alias("a"), F.col("y").alias("b"))  # more than once does no harm
    left, taken = links, links.select(F.col("b").alias("t")).limit(0)  # links that may still decide something; who is no seed
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        # ends that are nobody's larger one are seeds: no smaller neighbour is left that could take them
        seeds = left.select(F.col("a").alias("s")).distinct().join(left.select(F.col("b").alias("s")).distinct(), "s", "left_anti")
        hit = left.join(seeds, left["a"] == seeds["s"], "left_semi").select(F.col("b").alias("t")).distinct().checkpoint()
        taken = taken.unionByName(hit).checkpoint()
        left = scratch_table(left.join(hit, left["a"] == hit["t"], "left_anti").join(hit, F.col("b") == hit["t"], "left_anti"))
    else:
        raise RuntimeError(f"seeds did not settle in {max_rounds} rounds")
    by_seed = links.join(taken, links["a"] == taken["t"], "left_anti").join(taken, F.col("b") == taken["t"], "left_semi")
    taken = by_seed.groupBy("b").agg(F.min("a").alias("seed")).select("seed", F.col("b").alias("id"))
    owner = taken.select(F.col("id").alias("rep"), "seed")
    moved = copies.join(owner, "rep", "left").select(F.coalesce("seed", "rep").alias("seed"), "id")
    return taken.select("seed", "id").unionByName(moved)


def quarantine(points: DataFrame, ids: DataFrame, until: str) -> DataFrame:
    """Points with the flag and its end set for the given ids."""
    marked = ids.select("id").distinct().withColumn("_q", F.lit(True))
    out = points.join(marked, "id", "left").withColumn("consolidation_quarantined", F.col("consolidation_quarantined") | F.coalesce("_q", F.lit(False)))
    return out.withColumn("quarantine_until", F.when(F.col("_q"), F.lit(until).cast("timestamp"))).drop("_q")


def report(points: DataFrame, now: str, *, max_groups: int = 20, max_candidates: int = 10, confidence: float = 0.6, threshold: float = 0.92, facts: bool = True) -> DataFrame:
    """(proposal_type, position, key): proposals in a fixed order of kinds, each kind cut after ``max_groups`` (kinds about facts:
    after ``max_candidates``), then all after ``max_groups``. ``key`` is a point's id, a seed's id or a fact key.

    points has, besides their columns: learning (boolean: the pool), promote and promoted (booleans), superseded_by,
    invalidated_by, valid_until. Headings are in no later kind about texts. Rules that look at one point are
    evaluated once a row and stacked, and what all kinds need of a row, its text's digest included, is written to the shared folder without its text, which
    is read once more for its words; a kind is cut by a window that Spark limits before the exchange."""
    learning, calm = F.coalesce("learning", F.lit(False)), ~F.coalesce("consolidation_quarantined", F.lit(False))
    rows = points.withColumns({"_secret": tx.has_secret(F.col("text")), "_heading": heading_kind(F.col("text")).isNotNull(), "_learning": learning})
    whole = rows.where(~F.col("_heading") & calm).select("id", "text", "_learning")
    rows = rows.withColumns({"_update": status_update(now, confidence).isNotNull(), "_digest": F.when(~learning & (F.col("confidence") >= confidence), _digest())} if facts else {"_update": F.lit(False)}).drop("text")
    shared_folder(points.sparkSession)
    rows = rows.checkpoint()
    old = stale_rule(now)
    promote = F.col("promote") & ~F.coalesce("promoted", F.lit(False)) & (F.coalesce("confidence", F.lit(0.0)) >= 0.85) & (F.coalesce("importance", F.lit(0)) >= 8)
    rules = (
        (1, "quality_warning", F.col("_secret")), (2, "heading_noise", F.col("_heading") & calm), (5, "stale_low_value", ~F.col("_heading") & ~F.col("_learning") & calm & old),
        (6, "learning_promotion_candidate", F.col("_learning") & promote & ~F.col("_secret")), *([(7, "fact_status_update_candidate", ~F.col("_learning") & F.col("_update"))] if facts else []),
    )
    kinds = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(o).alias("o"), F.lit(kind).alias("proposal_type"))) for o, kind, rule in rules]))
    single = rows.select(F.explode(kinds).alias("k"), F.col("_learning").cast("int").alias("pool"), "id").select("k.o", "k.proposal_type", "pool", F.col("id").alias("nth"), F.col("id").cast("string").alias("key"))
    seeds = greedy_star(jaccard_pairs(whole, threshold, words=F.split(tx.fingerprint(F.col("text")), " "), block="_learning")).select(F.col("seed").alias("id")).distinct()
    doubles = rows.where(~F.col("_heading") & calm).join(seeds, "id", "left_semi").select((F.col("_learning").cast("int") + 3).alias("o"), F.lit("duplicate_cluster").alias("proposal_type"), F.lit(0).alias("pool"), F.col("id").alias("nth"), F.col("id").cast("string").alias("key"))
    parts = single.unionByName(doubles)
    cap = F.when(F.col("o") >= 7, max_candidates).otherwise(max_groups)
    cut = parts.withColumn("n", F.row_number().over(Window.partitionBy("o").orderBy("pool", "nth"))).where((F.col("n") <= max(max_groups, max_candidates)) & (F.col("n") <= cap)).drop("nth", "pool")
    if facts:
        memory = rows.where(~F.col("_learning"))
        ordered = Window.partitionBy("o").orderBy("key", "proposal_type")
        pair = F.array(F.struct(F.lit("fact_conflict_candidate").alias("proposal_type")), F.struct(F.lit("fact_supersession_candidate").alias("proposal_type")))
        clash = conflicts(memory, confidence, dated=True, digest=F.col("_digest")).select(F.lit(8).alias("o"), F.explode(F.slice(pair, F.lit(1), F.when(F.col("first_at") < F.col("last_at"), 2).otherwise(1))).alias("p"), F.col("fact_key").alias("key")).select("o", "p.proposal_type", "key")
        again = reconsolidations(memory, confidence, digest=F.col("_digest")).select(F.lit(9).alias("o"), F.lit("reconsolidation_candidate").alias("proposal_type"), F.col("fact_key").alias("key"))
        cut = cut.unionByName(clash.unionByName(again).withColumn("n", F.row_number().over(ordered)).where(F.col("n") <= max_candidates))
    final = cut.orderBy("o", "n").limit(max_groups)
    return final.withColumn("position", F.row_number().over(Window.orderBy("o", "n"))).select("proposal_type", "position", "key")
