"""Bounded graph expansion, closures and components over entity and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder


def neighbours(edges: DataFrame, cap: int) -> DataFrame:
    """(src, dst, n): the first ``cap`` neighbours of each node, by id; loops dropped."""
    clean = edges.where("src != dst").select("src", "dst").distinct()
    return clean.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("n") <= cap)


def neighbours_both(edges: DataFrame, cap: int) -> DataFrame:
    """(id, other, relation, side): edges of each node at either end, the first ``cap`` of each side by the other
    end; loops dropped."""
    clean = edges.where("src != dst").select("src", "dst", "relation").distinct()
    sides = clean.select(F.col("src").alias("id"), F.col("dst").alias("other"), "relation", F.lit("source").alias("side")).unionByName(
        clean.select(F.col("dst").alias("id"), F.col("src").alias("other"), "relation", F.lit("target").alias("side"))
    )
    return sides.withColumn("_n", F.row_number().over(Window.partitionBy("id", "side").orderBy("other", "relation"))).where(F.col("_n") <= cap).drop("_n")


def entity_memories(entities: DataFrame, points: DataFrame, *, first: int = 8) -> DataFrame:
    """entities: (entity_id, source_point_ids). (entity_id, point_id, is_entity): visible points among the first
    ids of each; an entity none of whose ids resolves stands for itself."""
    listed = entities.select("entity_id", F.explode(F.array_distinct(F.slice("source_point_ids", 1, first))).alias("point_id"))
    found = listed.join(points.select(F.col("id").alias("point_id")), "point_id", "left_semi").select("entity_id", F.col("point_id").cast("string").alias("point_id"), F.lit(False).alias("is_entity"))
    alone = entities.select("entity_id").distinct().join(found, "entity_id", "left_anti")
    return found.unionByName(alone.select("entity_id", F.col("entity_id").cast("string").alias("point_id"), F.lit(True).alias("is_entity")))


def expand(seeds: DataFrame, edges: DataFrame, *, depth: int = 2, cap: int = 8, total: int | None = None) -> DataFrame:
    """Breadth-first levels of (id): (id, depth), each id at the smallest depth. One equi-join a level;
    the frontier is bounded by cap**depth for each seed, and by ``total`` over all if given."""
    near = neighbours(edges, cap).select("src", "dst")
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for level in range(1, depth + 1):
        found = frontier.join(near, frontier["id"] == near["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = found.join(seen, "id", "left_anti").withColumn("depth", F.lit(level))
        seen = seen.unionByName(frontier)
    if total is not None:
        seen = seen.orderBy("depth", "id").limit(total)
    return seen


def closure(seeds: DataFrame, depends_on: DataFrame, *, depth: int = 8, max_points: int = 4096) -> tuple[DataFrame, bool]:
    """Reverse-dependency closure of (id) over (dependent, source): (id, depth), and whether it is whole.
    A cap that is hit makes the whole plan incomplete."""
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    frontier, whole = seen, True
    for level in range(1, depth + 2):
        found = frontier.join(depends_on, frontier["id"] == depends_on["source"]).select(F.col("dependent").alias("id")).distinct()
        frontier = found.join(seen, "id", "left_anti").withColumn("depth", F.lit(level))
        if frontier.isEmpty():
            break
        if level > depth or seen.count() > max_points:
            whole = False
            break
        seen = seen.unionByName(frontier)
    return seen, whole


def chain(parents: DataFrame, *, depth: int = 32) -> DataFrame:
    """(id, ancestor, distance) over (id, parent), nearest first, cycles cut, by doubling: one join for each power of two
    of the longest chain, each written to the shared folder, so no plan holds the joins before it."""
    shared_folder(parents.sparkSession)
    reach = parents.where("parent is not null and parent != id").select("id", F.col("parent").alias("ancestor")).distinct().withColumn("distance", F.lit(1)).checkpoint()
    jump, known = 1, reach.count()
    while jump < depth and known:
        a, b = reach.alias("a"), reach.alias("b")
        longer = a.join(b, F.col("a.ancestor") == F.col("b.id")).select("a.id", "b.ancestor", (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        reach = reach.unionByName(longer).where((F.col("distance") <= depth) & (F.col("id") != F.col("ancestor"))).groupBy("id", "ancestor").agg(F.min("distance").alias("distance")).checkpoint()
        before, known, jump = known, reach.count(), jump * 2
        if before == known:
            break
    return reach


def query_entities(entities: DataFrame, query: str) -> DataFrame:
    """Entities whose label or alias is part of the query."""
    text = F.lit(query.casefold())
    names = F.concat(F.array(F.lower("label")), F.transform("aliases", lambda a: F.lower(a)))
    return entities.where(F.exists(names, lambda n: (F.length(n) > 0) & F.contains(text, n)))


# Fixed weights of a candidate's score, and bounds of a search.
WEIGHTS = {"vector": 0.50, "distance": 0.20, "confidence": 0.10, "usefulness": 0.05, "stale": 0.20}
INACTIVE = ("stale", "superseded", "deprecated", "disputed")


def search(seeds: DataFrame, edges: DataFrame, points: DataFrame, *, top_k: int = 8, depth: int = 2, cap: int = 8, total: int = 64, floor: float = 0.0, history: bool = False, max_results: int = 20, weights: dict[str, float] | None = None) -> DataFrame:
    """(seed, id, distance, path, score, place): the best of what can be reached from each seed.

    seeds: (seed, id, vector_score), entities to start from, best first; edges: (edge_id, src, dst, confidence, status); points:
    (id, usefulness, status), payload by entity. Each seed expands by itself, level by level. A node looks at the edges where it is the source, then at those
    where it is the target, by edge id, leaves out inactive edges and those below ``floor``, loops, and what its seed has met on the way (at the last
    level: on the levels before), and takes the first ``cap`` of the rest; a seed takes ``total`` in all, nodes in the order in which they were met. A candidate
    scores by its seed's vector score (seeds only), exp(-distance), the mean confidence of its path, usefulness and staleness; none above 0 is
    dropped, ``max_results``, then ``top_k`` are kept, ties (scores are rounded to nine digits) to the smaller id.

    A level joins the frontier to the edges, numbers the edges of a node (cut to those that can matter before the exchange: ``cap`` and as many as a
    seed can have met), folds the rows of a seed, which the bounds keep small, and is written to the shared folder, so levels don't pile up in
    one plan and a hot node is cut where it is read."""
    shared_folder(edges.sparkSession)
    w = {**WEIGHTS, **(weights or {})}
    good = edges.where((F.coalesce("confidence", F.lit(0.0)) >= floor) & F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    if not history:
        good = good.where(~F.coalesce("status", F.lit("active")).isin(*INACTIVE))
    conf = F.coalesce("confidence", F.lit(0.0))
    sides = good.select(F.col("src").alias("id"), F.lit(0).alias("side"), "edge_id", F.col("dst").alias("other"), conf.alias("conf")).unionByName(
        good.select(F.col("dst").alias("id"), F.lit(1).alias("side"), "edge_id", F.col("src").alias("other"), conf.alias("conf"))
    )
    first = seeds.groupBy("seed", "id").agg(F.max("vector_score").alias("vector_score"))
    order = Window.partitionBy("seed").orderBy(F.desc("vector_score"), "id")
    kind = first.schema["id"].dataType.simpleString()
    frontier = first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= total).select("seed", "id", "n", F.array("id").alias("path"), F.array().cast("array<double>").alias("confs")).checkpoint()
    met, found = frontier.groupBy("seed").agg(F.collect_list("id").alias("met"), F.lit(0).alias("used")), None
    for level in range(1, max(1, min(depth, 3)) + 1):
        asked = frontier.select("id").distinct()
        near = sides.join(asked, "id", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("side", "edge_id"))).where(F.col("k") <= cap + 3 * total)
        rows = frontier.join(near, "id").select("seed", F.struct("n", "k", "other", F.concat("path", F.array("other")).alias("path"), F.concat("confs", F.array("conf")).alias("confs")).alias("r"))
        rows = rows.groupBy("seed").agg(F.array_sort(F.collect_list("r")).alias("rows")).join(met, "seed")
        last = level == depth
        entry = f"struct<id:{kind},path:array<{kind}>,confs:array<double>>"
        start = F.struct(F.col("met").alias("met"), F.lit(-1).alias("node"), F.lit(0).alias("taken"), F.array().cast(f"array<{entry}>").alias("out"))

        def step(state, r, last):
            taken = F.when(state["node"] == r["n"], state["taken"]).otherwise(0)
            fits = (taken < cap) & (F.size(state["out"]) + F.col("used") < total) & ~F.array_contains(state["met"], r["other"])
            new = F.struct(r["other"].alias("id"), r["path"].alias("path"), r["confs"].alias("confs"))
            known = state["met"] if last else F.when(fits, F.array_append(state["met"], r["other"])).otherwise(state["met"])
            return F.struct(known.alias("met"), r["n"].alias("node"), F.when(fits, taken + 1).otherwise(taken).alias("taken"), F.when(fits, F.array_append(state["out"], new)).otherwise(state["out"]).alias("out"))

        done = rows.select("seed", "used", F.aggregate("rows", start, lambda state, r: step(state, r, last)).alias("s")).checkpoint()
        level_rows = done.select("seed", F.posexplode("s.out").alias("at", "x")).select("seed", "x.id", F.lit(level).alias("distance"), (F.col("at") + 1).alias("n"), "x.path", "x.confs")
        found = level_rows if found is None else found.unionByName(level_rows)
        frontier = level_rows.select("seed", "id", "n", "path", "confs")
        met = done.select("seed", F.col("s.met").alias("met"), (F.col("used") + F.size("s.out")).alias("used"))
    own = first.select("seed", "id", F.lit(0).alias("distance"), F.lit(0).alias("n"), F.array("id").alias("path"), F.array().cast("array<double>").alias("confs"), "vector_score")
    every = own.unionByName(found.withColumn("vector_score", F.lit(0.0)))
    best = every.groupBy("seed", "id").agg(F.min_by(F.struct("distance", "path", "confs", "vector_score"), F.struct("distance", "n")).alias("c")).select("seed", "id", "c.*")
    best = best.join(points.select("id", "usefulness", "status"), "id", "left")
    mean = F.when(F.size("confs") > 0, F.aggregate("confs", F.lit(0.0), lambda a, c: a + c) / F.size("confs")).otherwise(0.0)
    score = w["vector"] * F.col("vector_score") + F.when(F.col("distance") > 0, w["distance"] * F.exp(-F.col("distance").cast("double"))).otherwise(0.0) + w["confidence"] * mean
    score = score + w["usefulness"] * F.coalesce("usefulness", F.lit(0.0)) - F.when(F.col("status").isin(*INACTIVE), w["stale"]).otherwise(0.0)
    placed = best.withColumn("score", F.round(score, 9)).where("score > 0").withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "id")))
    return placed.where(F.col("place") <= min(top_k, max_results)).select("seed", "id", "distance", "path", "score", "place")
