"""Clustered permutation tests and false-discovery-rate control over run logs.

Swapping whole clusters between two engines changes the statistic only through counts that add up, so
rows are counted once by (cluster, engine) and the masks meet those counts, never the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: All swaps are tried while there are at most so many, else SAMPLED seeded ones.
EXHAUSTIVE, SAMPLED, SEED = 50_000, 10_000, 41
#: Ranges that the masks of a test are dealt to.
MASK_RANGES = 16
#: Test level, and the least difference that matters.
ALPHA, PRACTICAL = 0.05, 0.02


def null_distribution(rows: DataFrame, cluster: str, first: str, second: str) -> DataFrame:
    """mask, difference: second minus first accuracy with the clusters of a mask swapped. Mask 0 is as observed."""
    hit = (F.col("true_label") == F.col("pred_label")).cast("long")
    side = lambda engine: F.sum(F.when(F.col("engine") == engine, hit).otherwise(0))
    size = F.sum(F.when(F.col("engine") == first, 1).otherwise(0))
    counts = rows.groupBy(cluster).agg(side(first).alias("a"), side(second).alias("b"), size.alias("n"))
    counts = counts.withColumn("bit", F.row_number().over(Window.orderBy(cluster)) - 1)  # one row a cluster
    met = _swapped(counts.withColumn("family", F.lit("all")), "family")
    swap = F.col("swap")
    return met.groupBy("mask").agg((F.sum(F.when(swap, F.col("a") - F.col("b")).otherwise(F.col("b") - F.col("a"))) / F.sum("n")).alias("difference"))


def macro_f1_null(rows: DataFrame, cluster: str, first: str, second: str, slices: dict[str, Column]) -> DataFrame:
    """slice, mask, first_score, second_score, n_clusters: macro-F1 of both engines under each swap of whole clusters, per slice.

    Macro-F1 is no sum, but the counts by label that it is made of are: rows are counted once by slice, cluster and label, and the
    masks meet those counts. Labels that neither the truth nor the engine names take no part in its mean. Clusters of a slice are
    numbered within it; every swap is tried while there are at most EXHAUSTIVE, else SAMPLED drawn by a hash.
    """
    inside = F.array_compact(F.array(*(F.when(kept, F.lit(name)) for name, kept in slices.items())))
    hit = (F.col("true_label") == F.col("pred_label")).cast("long")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    sides = F.array(F.struct(F.col("true_label").alias("label"), hit.alias("tp"), one.alias("w")), F.struct(F.col("pred_label").alias("label"), none.alias("tp"), one.alias("w")))
    used = rows.filter(F.col("engine").isin(first, second)).select(F.col(cluster).alias("cluster"), "engine", F.explode(inside).alias("slice"), F.inline(sides))
    of = lambda c, e: F.sum(F.when(F.col("engine") == e, F.col(c)).otherwise(0))
    counts = used.groupBy("slice", "cluster", "label").agg(of("tp", first).alias("tp_a"), of("w", first).alias("w_a"), of("tp", second).alias("tp_b"), of("w", second).alias("w_b"))
    own = Window.partitionBy("slice").orderBy("cluster")  # one partition a slice of its clusters x labels
    counts = counts.withColumn("bit", (F.dense_rank().over(own) - 1).cast("int"))
    met = _swapped(counts, "slice")
    side = lambda x, y: F.sum(F.when(F.col("swap"), F.col(y)).otherwise(F.col(x)))
    summed = met.groupBy("slice", "n_clusters", "mask", "label").agg(side("tp_a", "tp_b").alias("tp_a"), side("w_a", "w_b").alias("w_a"), side("tp_b", "tp_a").alias("tp_b"), side("w_b", "w_a").alias("w_b"))
    f1 = lambda tp, w: F.avg(F.when(F.col(w) > 0, 2 * F.col(tp) / F.col(w)))
    return summed.groupBy("slice", "n_clusters", "mask").agg(f1("tp_a", "w_a").alias("first_score"), f1("tp_b", "w_b").alias("second_score"))


def comparison_family(rows: DataFrame, cluster: str, first: str, second: str, slices: dict[str, Column]) -> DataFrame:
    """slice, first_score, second_score, effect, p, floor, p_adjusted, verdict: the whole family, corrected together."""
    return judged(macro_f1_null(rows, cluster, first, second, slices), "slice")


def finding_null(observed: DataFrame, cluster: str, first: str, second: str) -> DataFrame:
    """test, mask, first_score, second_score, n_clusters: precision and recall of each finding code under each swap of whole clusters.

    ``observed``: engine, code, needed, emitted, correct (booleans) and the cluster. Both ratios are made of counts that add up: right
    accusations over all accusations, and over the fields that need one; a swap exchanges the engines' counts."""
    used = observed.filter(F.col("engine").isin(first, second)).withColumn("right", F.col("emitted") & F.col("correct"))
    of = lambda c, e: F.count_if(F.col(c) & (F.col("engine") == e))
    names = [(f"{c}_{k}", of(c, e)) for c in ("right", "emitted", "needed") for k, e in (("a", first), ("b", second))]
    counts = used.groupBy("code", F.col(cluster).alias("cluster")).agg(*(x.alias(n) for n, x in names))
    counts = counts.withColumn("bit", (F.row_number().over(Window.partitionBy("code").orderBy("cluster")) - 1).cast("int"))  # the clusters of a code
    met = _swapped(counts, "code")
    side = lambda x, y: F.sum(F.when(F.col("swap"), F.col(y)).otherwise(F.col(x)))
    summed = met.groupBy("code", "n_clusters", "mask").agg(*(side(f"{c}_{x}", f"{c}_{y}").alias(f"{c}_{x}") for c in ("right", "emitted", "needed") for x, y in (("a", "b"), ("b", "a"))))
    ratio = lambda k, c: F.coalesce(F.try_divide(F.col(f"right_{k}").cast("double"), F.col(f"{c}_{k}").cast("double")), F.lit(0.0))
    both = F.array(*(F.struct(F.lit(f"/{name}").alias("metric"), ratio("a", c).alias("first_score"), ratio("b", c).alias("second_score")) for name, c in (("precision", "emitted"), ("recall", "needed"))))
    each = summed.select("code", "n_clusters", "mask", F.inline(both))
    return each.select(F.concat("code", "metric").alias("test"), "mask", "first_score", "second_score", "n_clusters")


def _swapped(counts: DataFrame, key: str) -> DataFrame:
    """Counts (key, bit, ..) with every mask of their key's clusters: n_clusters, mask, swap. All swaps while there are few, else drawn ones.
    Masks are dealt over their numbers, so a key is not one task."""
    sizes = counts.groupBy(key).agg((F.max("bit") + 1).alias("n_clusters"))
    every = F.pow(F.lit(2), F.col("n_clusters")) <= EXHAUSTIVE
    last = F.when(every, F.pow(F.lit(2), F.col("n_clusters")).cast("long") - 1).otherwise(F.lit(SAMPLED).cast("long"))
    ranges = F.sequence(F.lit(0), F.lit(MASK_RANGES - 1))
    masks = sizes.select(key, "n_clusters", every.alias("every"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("mask")).withColumn("range", (F.col("mask") % MASK_RANGES).cast("int"))
    met = masks.join(counts.withColumn("range", F.explode(ranges)), [key, "range"]).drop("range")
    drawn = (F.col("mask") > 0) & (F.pmod(F.xxhash64("mask", "bit", F.lit(SEED)), F.lit(2)) == 1)
    return met.withColumn("swap", F.when(F.col("every"), F.expr("(shiftright(mask, bit) & 1) = 1")).otherwise(drawn))


def judged(null: DataFrame, *keys: str) -> DataFrame:
    """Keys, first_score, second_score, effect, p, floor, p_adjusted, verdict: all tests of a null distribution as one family."""
    moved = null.withColumn("difference", F.col("second_score") - F.col("first_score"))
    seen = moved.filter("mask = 0").select(*keys, "first_score", "second_score", F.col("difference").alias("effect"))
    met = moved.select(*keys, "mask", "difference", "n_clusters").join(seen, list(keys))
    extreme = F.avg((F.abs("difference") >= F.abs("effect") - 1e-12).cast("double"))
    n, every = F.count(F.lit(1)), F.pow(F.lit(2), F.first("n_clusters")) <= EXHAUSTIVE
    tests = met.groupBy(*keys, "first_score", "second_score", "effect").agg(extreme.alias("p"), (F.when(every, F.lit(2)).otherwise(F.lit(1)) / n).alias("floor"))
    return benjamini_hochberg(tests, "p", *keys).withColumn("verdict", verdict(F.col("p_adjusted"), F.col("floor"), F.col("effect")))


def all_pairs(rows: DataFrame, observed: DataFrame, cluster: str, engines: list[str], slices: dict[str, Column]) -> DataFrame:
    """pair, test and what ``judged`` gives: every pair of engines by macro-F1 on each slice and by precision and recall of each
    finding code, corrected together. The family is the whole set, never a pair's own."""
    out = []
    for k, first in enumerate(engines):
        for second in engines[k + 1 :]:
            labels = macro_f1_null(rows, cluster, first, second, slices).withColumn("test", F.concat(F.lit("macro_f1/"), "slice"))
            both = labels.select("test", "mask", "first_score", "second_score", "n_clusters").unionByName(finding_null(observed, cluster, first, second))
            out.append(both.withColumn("pair", F.lit(f"{first}_vs_{second}")))
    return judged(reduce(DataFrame.unionByName, out), "pair", "test")


def p_value(null: DataFrame) -> DataFrame:
    """observed, p, floor (the least p possible) of a null distribution."""
    observed = null.filter("mask = 0").select(F.col("difference").alias("observed"))
    met = null.crossJoin(F.broadcast(observed))
    exact = F.count(F.lit(1)) <= EXHAUSTIVE
    extreme = F.sum((F.abs("difference") >= F.abs("observed") - 1e-12).cast("long"))
    return met.groupBy("observed").agg((extreme / F.count(F.lit(1))).alias("p"), F.when(exact, 2 / F.count(F.lit(1))).otherwise(1 / F.count(F.lit(1))).alias("floor"))


def benjamini_hochberg(tests: DataFrame, p: str = "p", *order: str) -> DataFrame:
    """Tests with p_adjusted. A family of tests is small: one window over it."""
    m = F.count(F.lit(1)).over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(p, *order))
    ranked = tests.withColumn("_m", m).withColumn("_rank", rank)
    down = Window.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("p_adjusted", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(down))).drop("_m", "_rank")


VERDICTS = ("UNDERPOWERED", "IMPROVEMENT", "REGRESSION", "BELOW_THRESHOLD", "NO_CHANGE")


def verdict(p_adjusted: Column, floor: Column, effect: Column) -> Column:
    return (
        F.when(floor > ALPHA, "UNDERPOWERED")
        .when((p_adjusted < ALPHA) & (effect >= PRACTICAL), "IMPROVEMENT")
        .when((p_adjusted < ALPHA) & (effect <= -PRACTICAL), "REGRESSION")
        .when(p_adjusted < ALPHA, "BELOW_THRESHOLD")
        .otherwise("NO_CHANGE")
    )
