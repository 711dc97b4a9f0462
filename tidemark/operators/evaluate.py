"""Offline retrieval evaluation: scores of runs, rates by variant, and promotion gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, vector
from ..session import shared_folder


def score_runs(runs: DataFrame, cases: DataFrame, k: int = 5) -> DataFrame:
    """runs: (case_id, variant, latency_ms, results array<long>, chars). cases: (case_id, expected,
    forbidden arrays). One row for each run of a known case."""
    top = F.slice("results", 1, k)
    joined = runs.join(cases, "case_id").withColumn("top", top)
    useful = F.size(F.array_intersect("top", "expected"))
    return joined.select(
        "case_id", "variant", "latency_ms", "chars", (useful > 0).alias("hit_at_k"), F.arrays_overlap("top", "forbidden").alias("wrong"),
        F.when(F.size("results") > 0, F.array_position("results", F.element_at("expected", 1))).otherwise(0).alias("first_position"),
        scoring.zoom_efficiency(useful, F.col("chars")).alias("zoom"),
    )


def variant_rates(scores: DataFrame) -> DataFrame:
    """Counts, percentage rates, means and latency percentiles for each variant; nulls leave a denominator."""
    def rate(flag: str) -> Column:
        return F.bround(100.0 * F.sum(F.col(flag).cast("int")) / F.count(flag), 4)

    return scores.groupBy("variant").agg(
        F.count(F.lit(1)).alias("runs"), rate("hit_at_k").alias("hit_at_k_rate"), rate("wrong").alias("wrong_memory_rate"), F.bround(F.avg("chars"), 2).alias("mean_chars"),
        F.bround(F.avg("zoom"), 6).alias("mean_zoom"), F.percentile("latency_ms", F.lit(0.5)).alias("latency_p50"), F.percentile("latency_ms", F.lit(0.95)).alias("latency_p95"),
    )


def summarise(rows: DataFrame) -> DataFrame:
    """rows: (variant, errored, hit_at_k, source_hit_at_k, exact_identifier_hit, wrong_memory, latency_ms,
    latency_budget_met). Counts and percentage rates of the rows without an error, for each variant; a flag that is null
    has no label and leaves its denominator, but for hits and wrong memories, where it counts as false. Rates without
    any label are null."""
    ok = ~F.coalesce(F.col("errored"), F.lit(False))

    def rate(flag: str, labelled: Column | None = None) -> Column:
        n = F.count(F.when(ok if labelled is None else ok & labelled, 1))
        share = F.when(n > 0, F.bround(100.0 * F.count(F.when(ok & F.col(flag), 1)) / n, 4))
        return (F.coalesce(share, F.lit(0.0)) if labelled is None else share).alias(f"{flag}_rate")

    def known(flag: str) -> Column:
        return rate(flag, F.col(flag).isNotNull())

    return rows.groupBy("variant").agg(
        F.count(F.lit(1)).alias("case_count"), F.count(F.when(ok, 1)).alias("scored_count"), F.count(F.when(~ok, 1)).alias("errored_count"), rate("hit_at_k"), known("source_hit_at_k"),
        known("exact_identifier_hit"), rate("wrong_memory"), F.percentile(F.when(ok, F.col("latency_ms")), F.lit(0.95)).alias("latency_ms_p95"), known("latency_budget_met").alias("latency_budget_pass_rate"),
    )


# Fixed checks of a promotion, in order: name, metric, rule (own value, or against the best baseline) and default bound.
CHECKS = (
    ("case_count", "case_count", "ge", 10),
    ("scored_count", "scored_count", "ge", 10),
    ("errored_count", "errored_count", "le", 0),
    ("candidate_hit_at_k", "hit_at_k_rate", "ge", 80.0),
    ("candidate_source_hit_at_k", "source_hit_at_k_rate", "ge", 80.0),
    ("hit_at_k_lift", "hit_at_k_rate", "lift", 0.0),
    ("source_hit_at_k_lift", "source_hit_at_k_rate", "lift", 0.0),
    ("exact_id_drop", "exact_identifier_hit_rate", "drop", 5.0),
    ("wrong_memory_rate", "wrong_memory_rate", "le", 3.0),
    ("wrong_memory_regression", "wrong_memory_rate", "rise", 1.0),
    ("latency_p95", "latency_ms_p95", "le", 500.0),
    ("latency_budget_pass_rate", "latency_budget_pass_rate", "ge", 95.0),
)


def gate(summary: DataFrame, candidate: str, baselines: list[str], bounds: dict[str, float] | None = None) -> DataFrame:
    """(check_name, actual, threshold, passed) of a candidate's row of :func:`summarise`; ``bounds`` by check name. The
    best baseline has the highest rate, of wrong memories the lowest. A value that is missing fails its check; a
    candidate that is missing gives the one row ``candidate_present``. One aggregate over one row a variant, no join."""
    bounds = {name: bound for name, _, _, bound in CHECKS} | (bounds or {})
    own, base = F.col("variant") == candidate, F.col("variant").isin(*baselines)
    best = {m: (F.min if kind == "rise" else F.max)(F.when(base, F.col(m))) for _, m, kind, _ in CHECKS if kind in ("lift", "drop", "rise")}
    mine = {m: F.max(F.when(own, F.col(m))) for _, m, _, _ in CHECKS}
    row = summary.agg(F.max(own).alias("present"), *[c.cast("double").alias(f"own_{m}") for m, c in mine.items()], *[c.cast("double").alias(f"best_{m}") for m, c in best.items()])

    def check(name: str, metric: str, kind: str) -> Column:
        value, bound = F.col(f"own_{metric}"), F.lit(float(bounds[name]))
        if kind in ("lift", "drop", "rise"):
            gap = value - F.col(f"best_{metric}")
            gap = -gap if kind == "drop" else gap
            value = gap if kind == "lift" else F.when(gap < 0, 0.0).otherwise(gap)
        passed = value >= bound if kind in ("ge", "lift") else value <= bound
        return result(name, value if kind in ("ge", "le") else F.bround(value, 4), bound, F.coalesce(passed, F.lit(False)))

    def result(name: str, actual: Column, bound: Column, passed: Column) -> Column:
        return F.struct(F.lit(name).alias("check_name"), actual.alias("actual"), bound.alias("threshold"), passed.alias("passed"))

    missing = F.array(result("candidate_present", F.lit(0.0), F.lit(1.0), F.lit(False)))
    checks = F.when(F.col("present"), F.array(*[check(name, metric, kind) for name, metric, kind, _ in CHECKS])).otherwise(missing)
    return row.select(F.explode(checks).alias("c")).select("c.*")


def asof_candidates(questions: DataFrame, items: DataFrame, k: int, *, block: int = 256) -> DataFrame:
    """The ``k`` most similar items of each question among those that were there at its cutoff: (question, item, score).

    questions: (question, cutoff, v), a stated set; items: (item, created_at, v). Questions go in blocks of ``block``, one row each; an item meets every
    block once, its score and time are looked at there, and a task keeps ``k`` rows a question before the exchange."""
    number = F.pmod(F.xxhash64("question"), F.greatest(F.lit(1), F.ceil(F.lit(questions.count() / block))))
    blocks = questions.withColumn("part", number).groupBy("part").agg(F.collect_list(F.struct("question", "cutoff", "v")).alias("block"))
    rows = items.select("item", "created_at", F.col("v").alias("w")).join(F.broadcast(blocks))
    open_ones = F.filter("block", lambda q: q["cutoff"] >= F.col("created_at"))
    scored = rows.select("item", F.explode(F.transform(open_ones, lambda q: F.struct(q["question"].alias("question"), vector.cosine(q["v"], F.col("w")).alias("score")))).alias("x")).select("x.question", "item", "x.score")
    best = Window.partitionBy("question").orderBy(F.desc("score"), "item")
    return scored.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")


def threshold_grid(questions: DataFrame, candidates: DataFrame, floors: list[float], budget: int) -> DataFrame:
    """(set, floor, questions, hits, nonempty, entries, chars) for every floor, from one pass over the candidates.

    questions: (question, set); candidates: (question, item, score, chars, answers). A question is given its candidates in order of score while
    their lengths stay within the budget and their score reaches the floor. A floor only cuts the end of that list, so a candidate counts
    for all floors up to its own score, and a question is a hit for all floors up to the score of its best answer: each is put
    in the bin of the highest floor it reaches, and a cell is the sum of the bins from its floor on. Sets without candidates have zeros."""
    steps = sorted(floors)
    grid = F.array(*[F.lit(float(f)) for f in steps])
    order = Window.partitionBy("question").orderBy(F.desc("score"), "item").rowsBetween(Window.unboundedPreceding, 0)
    kept = candidates.withColumn("so_far", F.sum("chars").over(order)).where(F.col("so_far") <= budget).withColumn("bin", F.size(F.filter(grid, lambda f: f <= F.col("score"))))
    kept = kept.join(questions, "question").where("bin > 0")
    each = kept.groupBy("set", "question").agg(F.max("bin").alias("any"), F.max(F.when(F.col("answers"), F.col("bin"))).alias("hit"))
    zero = F.lit(0).cast("long")
    parts = [
        kept.groupBy("set", "bin").agg(zero.alias("hits"), zero.alias("nonempty"), F.count(F.lit(1)).alias("entries"), F.sum("chars").cast("long").alias("chars")),
        each.groupBy("set", F.col("any").alias("bin")).agg(zero.alias("hits"), F.count(F.lit(1)).alias("nonempty"), zero.alias("entries"), zero.alias("chars")),
        each.where("hit IS NOT NULL").groupBy("set", F.col("hit").alias("bin")).agg(F.count(F.lit(1)).alias("hits"), zero.alias("nonempty"), zero.alias("entries"), zero.alias("chars")),
    ]
    bins = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("floor", F.explode(F.slice(grid, F.lit(1), F.col("bin"))))
    names = ("hits", "nonempty", "entries", "chars")
    cells = bins.groupBy("set", "floor").agg(*[F.sum(n).alias(n) for n in names])
    every = questions.groupBy("set").agg(F.count(F.lit(1)).alias("questions")).withColumn("floor", F.explode(grid))
    return every.join(cells, ["set", "floor"], "left").select("set", "floor", "questions", *[F.coalesce(n, zero).alias(n) for n in names])


def matrix(runs: DataFrame, *, parts: int = 64) -> DataFrame:
    """(variant, domain, tag, runs, hit_rate, wrong_rate, latency_p50, latency_p95): rates over all runs, and by variant, domain and tag in every
    combination that makes sense; a null stands for all. runs: (variant, domain, tags, hit, wrong, latency_ms).

    A run has many tags but counts once where tags are not asked for, so sets with a tag group the exploded runs and the others the runs themselves. Runs
    are counted by latency before the exchange. Latencies are discrete percentiles, exact: a sketch only cuts a cell's latencies into some ``parts`` ranges,
    which are counted, and only the range that holds a percentile is put in order."""
    shared_folder(runs.sparkSession)
    keys, shares = ["cell", "variant", "domain", "tag"], {"latency_p50": 0.5, "latency_p95": 0.95}
    sums = [F.count(F.lit(1)).alias("n"), *[f(F.col(c).cast("int")).alias(f"{c}_{name}") for c in ("hit", "wrong") for name, f in (("sum", F.sum), ("n", F.count))]]

    def counted(rows: DataFrame, sets: list[list[str]], names: list[str]) -> DataFrame:
        found = rows.groupingSets([[*s, "latency_ms"] for s in sets], *names, "latency_ms").agg(F.grouping_id().alias("gid"), *sums)
        found = found if "tag" in names else found.withColumn("tag", F.lit(None).cast("string"))
        return found.withColumn("cell", F.to_json(F.struct(F.lit(len(names)).alias("names"), "gid", "variant", "domain", "tag"))).drop("gid")

    plain = counted(runs, [["variant", "domain"], ["variant"], ["domain"], []], ["variant", "domain"])
    tagged = counted(runs.withColumn("tag", F.explode(F.array_distinct("tags"))), [["variant", "domain", "tag"], ["variant", "tag"], ["tag"]], ["variant", "domain", "tag"])
    counts = plain.unionByName(tagged).checkpoint()
    rate = lambda c: F.round(100.0 * F.try_divide(F.sum(f"{c}_sum").cast("double"), F.sum(f"{c}_n")), 4).alias(f"{c}_rate")
    cells = counts.groupBy(*keys).agg(F.sum("n").alias("runs"), rate("hit"), rate("wrong"))

    timed = counts.where("latency_ms IS NOT NULL").select("cell", "latency_ms", "n")
    cuts = timed.groupBy("cell").agg(F.percentile_approx("latency_ms", [i / parts for i in range(1, parts)], 10 * parts).alias("cuts"))
    ranged = timed.join(cuts, "cell").select("cell", "latency_ms", "n", F.size(F.filter("cuts", lambda c: c < F.col("latency_ms"))).alias("range"))
    so_far = Window.partitionBy("cell").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranged.groupBy("cell", "range").agg(F.sum("n").alias("k")).withColumns({"upto": F.sum("k").over(so_far), "all": F.sum("k").over(Window.partitionBy("cell"))})
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.ceil(F.col("all") * q - 1e-9).alias("rank")) for name, q in shares.items()])).alias("asked")
    holds = ranges.select("cell", "range", "upto", (F.col("upto") - F.col("k")).alias("below"), asked).where("asked.rank > below AND asked.rank <= upto")
    order = Window.partitionBy("cell", "asked.name").orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, 0)
    reached = ranged.join(holds, ["cell", "range"]).withColumn("place", F.col("below") + F.sum("n").over(order)).where("place >= asked.rank")
    found = reached.groupBy("cell").agg(*[F.min(F.when(F.col("asked.name") == name, F.col("latency_ms"))).alias(name) for name in shares])
    return cells.join(found, "cell", "left").select("variant", "domain", "tag", "runs", "hit_rate", "wrong_rate", *shares)
