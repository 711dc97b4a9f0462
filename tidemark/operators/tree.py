"""Hierarchical summary trees: leaves in chunks below level 1, and a root for each scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Fixed bounds of a walk: levels up, children of a node, characters of a text and of all texts of a walk, seeds of a walk.
MAX_DEPTH, MAX_CHILDREN, MAX_CHARS, BUDGET, MAX_TOP, ROUNDS = 3, 16, 2400, 16_000, 20, 6


def level_one(leaves: DataFrame, *, scope: str, bucket: str, width: int = 8) -> DataFrame:
    """(scope, bucket, chunk, children, node_id, text): id-ordered leaves in chunks of ``width``. Ids come
    from the children, so the order of the input does not matter. A bucket is numbered by a window, so a
    hot one should be split by the bucket key."""
    number = F.row_number().over(Window.partitionBy(scope, bucket).orderBy("id")) - 1
    placed = leaves.withColumn("chunk", F.floor(number / width).cast("int"))
    line = F.concat(F.lit("- "), F.col("id").cast("string"), F.lit(": "), tx.snippet(F.col("text"), 240))
    nodes = placed.groupBy(scope, bucket, "chunk").agg(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("c"))
    children = F.transform("c", lambda x: x["id"])
    nodes = nodes.withColumn("children", children).withColumn("text", F.substring(F.concat_ws("\n", F.transform("c", lambda x: x["line"])), 1, 1024)).drop("c")
    key = F.concat_ws(",", F.transform("children", lambda x: x.cast("string")))
    return nodes.withColumn("node_id", tx.digest_uuid(F.lit("tree-1"), F.col(scope), F.col(bucket), key))


def roots(nodes: DataFrame, *, scope: str) -> DataFrame:
    """(scope, n_nodes, n_leaves, node_id): one root for each scope."""
    made = nodes.groupBy(scope).agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(F.size("children")).alias("n_leaves"), F.array_sort(F.collect_list("node_id")).alias("ids"))
    return made.withColumn("node_id", tx.digest_uuid(F.lit("tree-2"), F.col(scope), F.concat_ws(",", "ids"))).drop("ids")


def parent_status(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(node_id, status): excluded if there are no children or one is quarantined, stale if any other is
    unsafe or missing, else active."""
    kids = nodes.select("node_id", F.explode_outer("children").alias("id"))
    state = leaves.select("id", "consolidation_quarantined", "stale", "requires_review", F.lit(True).alias("there"))
    rows = kids.join(state, "id", "left")
    unsafe = F.coalesce(F.col("stale") | F.col("requires_review"), F.lit(False)) | F.col("there").isNull()
    found = rows.groupBy("node_id").agg(F.count("id").alias("n"), F.max(F.coalesce("consolidation_quarantined", F.lit(False))).alias("q"), F.max(unsafe).alias("u"))
    return found.select("node_id", F.when((F.col("n") == 0) | F.col("q"), "excluded").when(F.col("u"), "stale").otherwise("active").alias("status"))


def search(nodes: DataFrame, leaves: DataFrame, *, max_children: int = 8, budget: int = 16_000, order: str = "node_id") -> DataFrame:
    """Summaries with the status that their children and their own flags give them. nodes: (node_id, children,
    text, reasons), a bounded list of seeds; leaves as in :func:`parent_status`. A node without children is
    excluded, one with reasons is review_required, else its children decide; text is blank unless active. The
    lengths of the texts add up in order, also of what is left out; from the first overflow on, ``kept`` is false."""
    state = parent_status(nodes.withColumn("children", F.slice(F.array_sort("children"), 1, max(1, min(max_children, 16)))), leaves)
    rows = nodes.join(state.withColumnRenamed("status", "by_children"), "node_id")
    status = F.when(F.size("children") <= 0, "excluded").when(F.size("reasons") > 0, "review_required").otherwise(F.col("by_children"))
    rows = rows.withColumn("status", status).withColumn("text", F.when(F.col("status") == "active", F.col("text")).otherwise(""))
    so_far = F.sum(F.length("text")).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select("node_id", "status", "text", (so_far <= budget).alias("kept"))


def with_evidence(summaries: DataFrame, cited: DataFrame) -> DataFrame:
    """Summaries that have a cited leaf."""
    return summaries.join(cited.select("node_id").distinct(), "node_id", "left_semi")


def walk(seeds: DataFrame, nodes: DataFrame, leaves: DataFrame, *, top_k: int = 5, depth: int = 2, max_children: int = 8, max_chars: int = 1200) -> DataFrame:
    """Summaries above each walk's seeds, and the leaves that they cite.

    seeds: (walk, node_id, rank); nodes: (node_id, level, child_ids, parent_ids, text, secret, reasons), all ids text; leaves: (id, text, unsafe,
    secret). A walk takes its seeds in order of rank, then the parents of these, level by level, each node once, at most ``depth`` levels up, in
    batches of ``max_children`` nodes, until a batch begins with ``top_k`` summaries found (or after six batches). Nodes with
    secrets are left out. A summary cites the first ``max_children`` of its children that none before it cites, and every one that is cited
    already. It is excluded without children, review_required with reasons, stale if a cited child is unsafe, holds a secret or is missing, else active;
    only active ones keep their text, cut to ``max_chars``. A safe leaf is shown under the first summary that cites it.

    Returns (walk, kind, id, parent, status, depth, place, text, kept): summaries in order, then leaves by parent and id. Lengths
    add up in that order, also of what is left out; what overflows the budget, and summaries after ``top_k``, are not kept.

    All walks go at once: a level is two joins on node ids; a walk holds 48 nodes and their children at most, so windows and the fold over one
    walk's summaries are small, however many walks there are."""
    top_k, depth = max(1, min(top_k, MAX_TOP)), max(1, min(depth, MAX_DEPTH))
    max_children, max_chars = max(1, min(max_children, MAX_CHILDREN)), max(1, min(max_chars, MAX_CHARS))
    own = seeds.groupBy("walk", "node_id").agg(F.min("rank").alias("rank"))
    level = own.withColumn("ord", F.row_number().over(Window.partitionBy("walk").orderBy("rank", "node_id"))).where(F.col("ord") <= ROUNDS * max_children).select("walk", "node_id", F.lit(0).alias("depth"), "ord")
    seen = level
    parents = nodes.where("NOT secret").select("node_id", F.posexplode("parent_ids").alias("at", "parent"))
    for d in range(1, depth + 1):
        found = level.join(parents, "node_id").where("parent != ''").groupBy("walk", F.col("parent").alias("node_id")).agg(F.min(F.struct("ord", "at")).alias("o"))
        found = found.join(seen.select("walk", "node_id"), ["walk", "node_id"], "left_anti")
        base = seen.groupBy("walk").agg(F.max("ord").alias("base"))
        placed = found.join(base, "walk").withColumn("ord", F.col("base") + F.row_number().over(Window.partitionBy("walk").orderBy("o", "node_id")))
        level = placed.where(F.col("ord") <= ROUNDS * max_children).select("walk", "node_id", F.lit(d).alias("depth"), "ord")
        seen = seen.unionByName(level)
    there = seen.join(nodes, "node_id", "left").withColumn("summary", F.coalesce(~F.col("secret"), F.lit(False))).withColumn("batch", F.floor((F.col("ord") - 1) / max_children))
    before = F.sum(F.col("summary").cast("int")).over(Window.partitionBy("walk").orderBy("batch").rangeBetween(Window.unboundedPreceding, -1))
    met = there.withColumn("before", F.coalesce(before, F.lit(0))).where((F.col("before") < top_k) & F.col("summary"))
    children = F.array_distinct(F.filter("child_ids", lambda c: c != ""))
    met = met.withColumn("place", F.row_number().over(Window.partitionBy("walk").orderBy("ord"))).withColumn("children", F.coalesce(children, F.array().cast("array<string>")))

    none = F.array().cast("array<string>")

    def step(state, row):
        fresh = F.slice(F.filter(row["children"], lambda c: ~F.array_contains(state["taken"], c)), 1, max_children)
        cited = F.filter(row["children"], lambda c: F.array_contains(state["taken"], c) | F.array_contains(fresh, c))
        return F.struct(F.concat(state["taken"], fresh).alias("taken"), F.concat(state["out"], F.array(F.struct(row["place"].alias("place"), cited.alias("cited")))).alias("out"))

    folded = met.groupBy("walk").agg(F.array_sort(F.collect_list(F.struct("place", "children"))).alias("rows"))
    start = F.struct(none.alias("taken"), F.array().cast("array<struct<place:int,cited:array<string>>>").alias("out"))
    cited = folded.select("walk", F.explode(F.aggregate("rows", start, step)["out"]).alias("x")).select("walk", "x.place", F.explode("x.cited").alias("id"))
    looked = cited.join(leaves.select("id", F.col("text").alias("leaf"), (F.coalesce("unsafe", F.lit(False)) | F.coalesce("secret", F.lit(False))).alias("bad"), F.lit(True).alias("there")), "id", "left")
    trouble = looked.groupBy("walk", "place").agg(F.max(F.coalesce("bad", F.lit(True))).alias("trouble"))
    summaries = met.join(trouble, ["walk", "place"], "left")
    status = F.when(F.size("children") == 0, "excluded").when(F.size("reasons") > 0, "review_required").when(F.coalesce("trouble", F.lit(False)), "stale").otherwise("active")
    summaries = summaries.select(
        "walk", F.lit("summary").alias("kind"), F.col("node_id").alias("id"), F.lit(None).cast("string").alias("parent"), status.alias("status"), "depth", "place",
        F.when(status == "active", F.substring("text", 1, max_chars)).otherwise("").alias("text"),
    )
    shown = looked.where("there AND NOT bad").groupBy("walk", "id").agg(F.min("place").alias("place"), F.first("leaf").alias("leaf"))
    shown = shown.join(met.select("walk", "place", F.col("node_id").alias("parent")), ["walk", "place"])
    shown = shown.withColumn("place", F.row_number().over(Window.partitionBy("walk").orderBy("parent", "id")))
    shown = shown.select("walk", F.lit("leaf").alias("kind"), "id", "parent", F.lit("safe").alias("status"), F.lit(None).cast("int").alias("depth"), "place", F.substring("leaf", 1, max_chars).alias("text"))
    both = summaries.unionByName(shown)
    so_far = F.sum(F.length("text")).over(Window.partitionBy("walk").orderBy(F.desc("kind"), "place").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("kept", (so_far <= BUDGET) & ((F.col("kind") == "leaf") | (F.col("place") <= top_k)))
