"""Connected components of a graph that no single machine holds.

Alternating star contraction (Kiveris et al., "Connected Components in MapReduce and Beyond"): a
large-star step hangs each larger neighbour of u on the smallest node that u knows, a small-star
step does so for the smaller ones. Both are a min() with map-side combine and an equi-join, so a hub
is a skewed join that AQE splits, and no neighbourhood is ever collected. Each round is written to
the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: (a, b), any order, repeats allowed. Returns (node, component): every node that has an
    edge to another node, with the smallest node it is connected to. No edges: no rows. Nulls and
    loops are no edges."""
    spark = edges.sparkSession
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    now, path = _step(now, "cc"), None
    size = now.count()
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # every a of large is larger than its b: these are the smaller neighbours of a
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        after = _step(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "cc")
        if path:
            common.drop_scratch(spark, path)
        path = now.inputFiles()[0].rsplit("/", 1)[0] if now.inputFiles() else None
        n = after.count()
        settled = n == size and after.join(now, ["a", "b"], "left_anti").isEmpty()  # both hold each edge once
        now, size = after, n
        if settled:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _step(edges: DataFrame, name: str) -> DataFrame:
    return common.materialise(edges, name)
