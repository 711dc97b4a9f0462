"""Mixing sources to target weights by a time-varying curriculum.

Targets. The mix takes ``share`` times all words. Sources get shares of that by weight, none more than
``repeats`` times its own size; what is cut off goes to the others by weight until none is above. That
water level is found in one pass over the table of sources: with sources in order of cap / weight, the
level of i is (mix - caps before i) / weights from i on, and the first i whose level is not above its own
ratio sets it.

Curriculum. A source's documents form a stream in the order of a hash; the stream starts anew when it
ends (an epoch), and the source's target says after how many words it is left. So a document is taken
whole in each epoch but the last, and there it is taken if the stream gets to it. Each source has a
schedule of weights over phases of the training run; its integral up to time t is the demand for the
source by then, and inverting it at the words that precede a document in the stream gives the document's
training position between 0 and 1. Documents are then range-sorted by position.

Execution. The order is that of a hash of id and text, so rows without an id are spread like others. Rows
that are equal in both and in source are one class with a count before anything is shuffled. The running sums
have two levels, (source, hash bucket) and then classes of a bucket, so a source that holds a third of all
rows is spread over all tasks. Everything is DataFrame expressions; only narrow rows (id, source, size) are
shuffled for the plan. ``copies`` moves each text twice: to its class, and to its range of positions.

Null texts have size 0 and are never taken. A null source is a source, the last one. Repeated rows are
documents of their own. With no words at all every target is 0; an empty table gives no rows. Columns of any
name are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Weights of the sources, by their rank in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Weight over equal phases of the run, by the same rank: early, even, late.
SCHEDULES = ((3.0, 2.0, 1.0, 1.0), (1.0, 1.0, 1.0, 1.0), (1.0, 1.0, 2.0, 3.0))
BUCKETS = 4096
#: Rows that one row of a class becomes at once.
RUN = 4096


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """sizes: (source, source_size), a row for each source. Adds rank, weight and target. One row a source
    meets in one task here, after the aggregation of its documents."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sizes.withColumn("rank", rank)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", pick).withColumn("cap", F.col("source_size").cast("double") * repeats)
    mix = F.sum("source_size").over(Window.partitionBy()).cast("double") * share
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumn("level", (mix - before) / rest)
    first = F.struct((F.col("cap") / F.col("weight")).alias("ratio"), "rank", "level")
    water = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), first)).over(Window.partitionBy())["level"]
    water = F.coalesce(water, F.lit(0.0))
    return levels.withColumn("target", F.least("cap", water * F.col("weight"))).drop("level", "cap")


def position(offset: Column, target: Column, rank: Column, schedules: tuple[tuple[float, ...], ...] = SCHEDULES) -> Column:
    """When a source's demand reaches ``offset`` of its ``target`` words: the inverse of its schedule's integral."""
    share = F.greatest(F.least(offset / target, F.lit(1.0)), F.lit(0.0))
    out = None
    for i, schedule in enumerate(schedules):
        total, done, own = sum(schedule), 0.0, F.lit(1.0)
        steps = []
        for phase, weight in enumerate(schedule):
            steps.append((done, weight / total, phase))
            done += weight / total
        for start, width, phase in reversed(steps):
            here = (F.lit(float(phase)) + (share - start) / width) / len(schedule)
            own = here if phase == len(schedule) - 1 else F.when(share < start + width, here).otherwise(own)
        out = F.when(rank % len(schedules) == i, own) if out is None else out.when(rank % len(schedules) == i, own)
    return out


def _stream(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """Columns key (the source, told apart from null), who (the id, likewise), h (place in its stream) and size of
    each row of docs. ``h`` alone doesn't tell a null id from an empty one, nor where the id ends."""
    source = F.col(source_col).cast("string")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [
        F.coalesce(F.concat(F.lit("s"), source), F.lit("")).alias("key"), F.coalesce(F.concat(F.lit("s"), F.col(id_col).cast("string")), F.lit("")).alias("who"), F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), text).cast("binary")).alias("h"),
        F.regexp_count(text, F.lit(common.WORD)).cast("long").alias("size"), source.alias("source"), F.col(id_col).alias("id"),
    ]


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, repeats: int) -> DataFrame:
    """(key, who, h, id, source, size, n, start, source_size, target, rank, goal): rows of equal id, source and
    text are one class of n, which take up n times their size of the stream from ``start`` on."""
    classes = docs.select(_stream(docs, id_col, text_col, source_col)).groupBy("key", "who", "h", "size", "source", "id").agg(F.count(F.lit(1)).alias("n"))
    classes = common.materialise(classes.withColumn("bucket", F.conv(F.substring("h", 1, 3), 16, 10).cast("int")), "mix-classes")
    words = F.col("size") * F.col("n")
    buckets = common.materialise(classes.groupBy("key", "source", "bucket").agg(F.sum(words).alias("words")), "mix-buckets")
    targets = source_targets(buckets.groupBy("key", "source").agg(F.sum("words").alias("source_size")), weights, share, repeats)
    ahead = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    offsets = offsets.select("key", "bucket", "ahead").join(targets.select("key", "source_size", "target", "rank"), "key")
    within = Window.partitionBy("key", "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = classes.withColumn("inside", F.coalesce(F.sum(words).over(within), F.lit(0))).join(offsets, ["key", "bucket"])
    return placed.withColumn("start", F.col("ahead") + F.col("inside")).withColumn("goal", F.floor("target")).drop("ahead", "inside", "bucket")


def plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """(id, size, source, source_size, target, start, taken, position), range-sorted by position; documents
    that are not taken come last and have none. start: words of the source's stream before the document."""
    placed = _placed(docs, id_col, text_col, source_col, weights, share, repeats)
    # a class of n equal rows becomes n rows in two steps, so no row holds an array as long as the class
    placed = placed.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    ends = F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1
    placed = placed.withColumn("start", F.explode(F.transform(F.sequence(F.col("run") * RUN, ends), lambda i: F.col("start") + i * F.col("size")))).drop("run")
    taken = sum(F.greatest(F.least(F.col("goal") - F.col("start") - epoch * F.col("source_size"), F.col("size")), F.lit(0)) for epoch in range(repeats))
    placed = placed.withColumn("taken", taken.cast("long"))
    placed = placed.withColumn("position", F.when(F.col("taken") > 0, position(F.col("start").cast("double"), F.col("target"), F.col("rank"))))
    placed = common.materialise(placed.select("id", "size", "source", "source_size", "target", "start", "taken", "rank", "position"), "mix-placed")
    return placed.repartitionByRange(F.col("position").asc_nulls_last(), F.col("id")).sortWithinPartitions(F.col("position").asc_nulls_last(), "id")


def copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """The rows of ``docs`` that the mix takes, once for each epoch, whole, in the order of their positions.
    Each row is taken as it stands in the stream, whether its id is null, repeated or its own."""
    key, who, h, *_ = _stream(docs, id_col, text_col, source_col)
    placed = _placed(docs, id_col, text_col, source_col, weights, share, repeats).where((F.col("size") > 0) & (F.col("start") < F.col("goal")))
    placed = placed.select("key", "who", "h", "n", "size", "start", "goal", "source_size", "target", "rank")
    # one row of ``placed`` a class of documents: it is as long as ``docs``, so both sides are sorted by the class
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key, who, h).join(placed.hint("merge"), ["key", "who", "h"])
    nth = F.row_number().over(Window.partitionBy("key", "who", "h").orderBy(F.xxhash64("doc"))) - 1  # of equal texts of one id
    rows = rows.withColumn("start", F.col("start") + nth * F.col("size"))
    epochs = F.filter(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda e: F.col("start") + e * F.col("source_size")), lambda at: at < F.col("goal"))
    times = rows.select("doc", F.explode(epochs).alias("at"), "target", "rank")
    mixed = times.select("doc", position(F.col("at").cast("double"), F.col("target"), F.col("rank")).alias("position"))
    return mixed.repartitionByRange("position", F.col(f"doc.`{id_col}`")).sortWithinPartitions("position", f"doc.`{id_col}`").select("doc.*")
