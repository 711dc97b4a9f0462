"""Connected components by propagating the smallest id with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder


def components(pairs: DataFrame, max_rounds: int = 30) -> DataFrame:
    """pairs: (a, b). Returns (node, component), the smallest node reachable. A round is two joins and an
    aggregation, checkpointed to the folder that the session names."""
    shared_folder(pairs.sparkSession)
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    label = both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "node").checkpoint()
    for _ in range(max_rounds):
        near = both.join(label.withColumnRenamed("node", "b").withColumnRenamed("component", "c"), "b").groupBy("a").agg(F.min("c").alias("c"))
        step = label.join(near, label["node"] == near["a"]).select("node", F.least("component", "c").alias("component"), F.col("component").alias("old"))
        up = step.select(F.col("node").alias("component"), F.col("component").alias("upper"))
        new = step.join(up, "component", "left").select("node", F.coalesce("upper", "component").alias("component"), "old").checkpoint()
        if new.where("component != old").isEmpty():
            return new.select("node", "component")
        label = new.select("node", "component")
    raise RuntimeError("components did not settle")
