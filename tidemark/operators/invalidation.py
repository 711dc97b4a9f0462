"""What has to be looked at again when sources change: plans of all events at once, within bounds, whole or not at all.

An event names the points that changed (its roots). What depends on them, directly or through others, is found level by level, for all
events together: a level asks for the edges of the frontier only, cut where they are read to as many of a source as can matter, and is
written to the shared folder, so a plan never holds the levels before it. Which roots a point goes back to is kept in rows, one for each
root, so that no array grows on the way.

An event stops without any change where a level has more edges than points are left (``points``), a dependent is no known point
(``missing``), all its edges are too many (``edges``), or points not met before lie beyond the last level (``depth``); the first of these
that holds, in this order, is its error. Roots are never dependents. Null ids are left out, repeated edges count once, an event
without roots has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder

# Fixed bounds of a plan, and of the causes a point may carry.
DEPTH, HARD_DEPTH, MAX_POINTS, MAX_EDGES, MAX_CAUSES = 8, 16, 4096, 8192, 32


def _links(frontier: DataFrame, edges: DataFrame, enough: int) -> DataFrame:
    """(event, id, dependent, known): edges of the frontier, ``enough`` of a source at most. edges: (source, dependent, known), distinct."""
    ids = frontier.select("event", "id").distinct()
    near = edges.join(ids.select(F.col("id").alias("source")).distinct(), "source", "left_semi")
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy("dependent"))).where(F.col("_n") <= enough)
    return ids.join(near.select(F.col("source").alias("id"), "dependent", "known"), "id").select("event", "id", "dependent", "known")


def _judged(running: DataFrame, level: DataFrame, *, last: bool, max_points: int, max_edges: int) -> DataFrame:
    """Counts and errors of all events after a level: (event, points, edges, error)."""
    both = running.join(level, "event", "left").na.fill(0, ["new_edges", "unseen", "missing"])
    error = F.when(F.col("new_edges") > max_points - F.col("points"), "points").when(F.col("missing") > 0, "missing").when(F.col("edges") + F.col("new_edges") > max_edges, "edges")
    if last:
        error = error.when(F.col("unseen") > 0, "depth")
    error = F.coalesce("error", error)
    counted = error.isNull() | (error == "depth")
    return both.select("event", (F.col("points") + F.when(error.isNull(), F.col("unseen")).otherwise(0)).alias("points"), (F.col("edges") + F.when(counted, F.col("new_edges")).otherwise(0)).alias("edges"), error.alias("error"))


def plan(roots: DataFrame, depends_on: DataFrame, points: DataFrame, *, depth: int = DEPTH, max_points: int = MAX_POINTS, max_edges: int = MAX_EDGES) -> tuple[DataFrame, DataFrame]:
    """roots: (event, id); depends_on: (dependent, source); points: (id). Two tables: (event, complete, error, points, edges) of every event, and (event, id,
    depth, root) of all dependents of the complete ones."""
    if not 0 <= depth <= HARD_DEPTH:
        raise ValueError(f"depth must be between 0 and {HARD_DEPTH}")
    shared_folder(roots.sparkSession)
    frontier = roots.where("event IS NOT NULL AND id IS NOT NULL").select("event", "id").distinct().withColumn("root", F.col("id")).checkpoint()
    seen = frontier.select("event", "id")
    zero = F.lit(0).cast("long")
    running = seen.select("event").distinct().select("event", zero.alias("points"), zero.alias("edges"), F.lit(None).cast("string").alias("error")).checkpoint()
    found = frontier.withColumn("depth", F.lit(0)).limit(0)
    # edges are cleaned, and their dependents looked up among the points, once for all levels
    edges = depends_on.where("dependent IS NOT NULL AND source IS NOT NULL").select("source", "dependent").distinct()
    edges = edges.join(points.select(F.col("id").alias("dependent"), F.lit(True).alias("known")).distinct(), "dependent", "left").select("source", "dependent", "known").checkpoint()
    for at in range(depth + 1):
        links = _links(frontier, edges, max(max_points, max_edges) + 1).checkpoint()
        fresh = links.select("event", F.col("dependent").alias("id"), "known").distinct().join(seen, ["event", "id"], "left_anti").checkpoint()
        level = links.groupBy("event").agg(F.count(F.lit(1)).alias("new_edges")).join(fresh.groupBy("event").agg(F.count(F.lit(1)).alias("unseen"), F.count_if(F.col("known").isNull()).alias("missing")), "event", "left")
        running = _judged(running, level, last=at == depth, max_points=max_points, max_edges=max_edges).checkpoint()
        going = fresh.join(running.where("error IS NULL").select("event"), "event", "left_semi").select("event", "id")
        reached = frontier.join(links, ["event", "id"]).select("event", F.col("dependent").alias("id"), "root").distinct()
        frontier = reached.join(going, ["event", "id"], "left_semi").checkpoint()
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier.withColumn("depth", F.lit(at + 1)))
        seen = seen.unionByName(going)
    status = running.select("event", F.col("error").isNull().alias("complete"), "error", "points", "edges")
    return status, found.join(running.where("error IS NULL").select("event"), "event", "left_semi").select("event", "id", "depth", "root")


def patches(dependents: DataFrame, points: DataFrame) -> DataFrame:
    """What the plans change: (event, id, depth, roots, requires_review, fact_status, causes, truncated), for one event and point a row.

    points: (id, fact_status, causes), unique. A point that is active, or has no status, is to be reviewed, others keep theirs. The event becomes
    one of its causes; where it has ``MAX_CAUSES`` already, they stay and ``truncated`` says so."""
    one = dependents.groupBy("event", "id").agg(F.min("depth").alias("depth"), F.array_sort(F.collect_set("root")).alias("roots"))  # as many as an event has
    both = one.join(points.select("id", "fact_status", "causes"), "id")
    causes = F.array_distinct(F.coalesce("causes", F.array().cast("array<string>")))
    named, full = F.array_contains(causes, F.col("event")), F.size(causes) >= MAX_CAUSES
    status: Column = F.when(F.coalesce("fact_status", F.lit("")).isin("", "active"), "review_required").otherwise(F.col("fact_status"))
    return both.select(
        "event", "id", "depth", "roots", F.lit(True).alias("requires_review"), status.alias("fact_status"),
        F.when(named | full, causes).otherwise(F.array_append(causes, F.col("event"))).alias("causes"), (~named & full).alias("truncated"),
    )
