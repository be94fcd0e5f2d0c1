"""Measuring classifiers: run logs (form_id, engine, true_label, pred_label, confidence, ...) to metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A cell with fewer rows reports no metric.
LEAST_ROWS = 30


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def label_report(rows: DataFrame, *keys: str) -> DataFrame:
    """Per key and label, over the union of true and predicted labels: counts, precision, recall, F1. One shuffle."""
    hit = (F.col("true_label") == F.col("pred_label")).cast("long")
    sides = F.array(
        F.struct(F.col("true_label").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), hit.alias("tp")),
        F.struct(F.col("pred_label").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).cast("long").alias("tp")),
    )
    counts = (
        rows.select(*keys, F.explode(sides).alias("s"))
        .groupBy(*keys, F.col("s.label").alias("label"))
        .agg(F.sum("s.tp").alias("true_positives"), F.sum("s.t").alias("support"), F.sum("s.p").alias("predicted"))
    )
    precision, recall = ratio(F.col("true_positives"), F.col("predicted")), ratio(F.col("true_positives"), F.col("support"))
    scored = counts.withColumn("precision", precision).withColumn("recall", recall)
    return scored.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def slices(rows: DataFrame, *keys: str, least: int = LEAST_ROWS) -> DataFrame:
    """Per key: rows, macro-F1 over the labels of that slice and accuracy; null below ``least`` rows."""
    macro = label_report(rows, *keys).groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))
    micro = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("true_label") == F.col("pred_label")).cast("double")).alias("micro_f1"))
    both = micro.join(macro, list(keys))
    enough = F.col("n") >= least
    return both.select(*keys, "n", *(F.when(enough, F.round(c, 6)).alias(c) for c in ("macro_f1", "micro_f1")), (~enough).alias("suppressed"))


def calibration_bins(rows: DataFrame, *keys: str, bins: int = 10) -> DataFrame:
    """Reliability by equal-width bins (low, high], the first closed below; abstentions take no part. Empty bins appear with 0."""
    spark = rows.sparkSession
    used = rows.filter("pred_label <> 'UNKNOWN'")
    k = F.greatest(F.lit(1), F.ceil(F.round(F.col("confidence") * bins, 9))).cast("int")
    own = used.groupBy(*keys, k.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg((F.col("true_label") == F.col("pred_label")).cast("double")).alias("accuracy")
    )
    grid = rows.select(*keys).distinct().crossJoin(F.broadcast(spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))))
    return grid.join(own, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def expected_calibration_error(rows: DataFrame, *keys: str) -> DataFrame:
    gap = F.col("n") * F.abs(F.coalesce("mean_confidence", F.lit(0.0)) - F.coalesce("accuracy", F.lit(0.0)))
    return calibration_bins(rows, *keys).groupBy(*keys).agg(F.round(ratio(F.sum(gap), F.sum("n")), 6).alias("ece"))


def threshold_curve(rows: DataFrame, *keys: str) -> DataFrame:
    """Per observed confidence (and 0 and 1): accusations at or above it, correct ones, precision (1 without accusations), recall.

    Rows: eligible, needs, correct, confidence. Counts per confidence come first, so the running sums see one row a value."""
    spark = rows.sparkSession
    ends = rows.select(*keys).distinct().crossJoin(F.broadcast(spark.createDataFrame([(0.0,), (1.0,)], "confidence double")))
    zero = F.lit(0).cast("long")
    counted = (
        rows.filter("eligible").select(*keys, "confidence", F.lit(1).cast("long").alias("a"), F.col("correct").cast("long").alias("c"))
        .union(ends.select(*keys, "confidence", zero, zero))
        .groupBy(*keys, "confidence").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))
    )
    down = Window.partitionBy(*keys).orderBy(F.desc("confidence"))
    needs = rows.groupBy(*keys).agg(F.sum(F.col("needs").cast("long")).alias("needs"))
    curve = counted.withColumn("accusations", F.sum("a").over(down)).withColumn("right", F.sum("c").over(down)).join(needs, list(keys))
    precision = F.when(F.col("accusations") > 0, F.col("right") / F.col("accusations")).otherwise(1.0)
    return curve.select(*keys, F.col("confidence").alias("tau"), "accusations", "right", "needs", precision.alias("precision"), ratio(F.col("right"), F.col("needs")).alias("recall"))


def tau_high(curve: DataFrame, *keys: str, target: float = 0.98) -> DataFrame:
    """The smallest threshold that reaches the target precision, else the smallest of the best precision."""
    some = curve.filter("accusations > 0").groupBy(*keys).agg(
        F.min(F.when(F.col("precision") >= target, F.col("tau"))).alias("met_at"), F.min(F.struct((-F.col("precision")).alias("p"), "tau")).alias("best")
    )
    found = curve.select(*keys).distinct().join(some, list(keys), "left")
    return found.select(*keys, F.coalesce("met_at", "best.tau", F.lit(1.0)).alias("tau_high"), F.col("met_at").isNotNull().alias("met"))


def tau_low(curve: DataFrame, high: DataFrame, *keys: str, fraction: float = 0.5) -> DataFrame:
    """The greatest threshold below tau_high whose band holds the fraction of the recall that tau_high gives up."""
    at = curve.join(high.select(*keys, "tau_high"), list(keys))
    ends = at.groupBy(*keys, "tau_high").agg(F.max("right").alias("all"), F.max(F.when(F.col("tau") == F.col("tau_high"), F.col("right"))).alias("kept"), F.max("needs").alias("needs"))
    given_up = (F.col("all") - F.coalesce("kept", F.lit(0))) / F.col("needs")
    band = at.join(ends.select(*keys, "all", "kept"), list(keys)).filter(F.col("tau") < F.col("tau_high"))
    holds = F.try_divide(F.col("right") - F.coalesce("kept", F.lit(0)), F.col("needs")) >= fraction * F.try_divide(F.col("all") - F.coalesce("kept", F.lit(0)), F.col("needs"))
    best = band.groupBy(*keys).agg(F.max(F.when(holds, F.col("tau"))).alias("best"))
    found = ends.join(best, list(keys), "left")
    return found.select(*keys, F.when((F.col("needs") == 0) | (given_up <= 0), F.col("tau_high")).otherwise(F.coalesce("best", F.lit(0.0))).alias("tau_low"))


#: Relative rank error of the bounds between which exact percentiles are looked for, and the rows up to which a group is looked through whole.
BOUND_ERROR, WHOLE_GROUP = 1e-4, 100_000


def exact_percentiles(rows: DataFrame, value: str, at: dict[str, float], *keys: str) -> DataFrame:
    """Per key the interpolated percentiles ``at`` (name to share) of ``value``; nulls take no part. Exact, without a buffer a group.

    A sketch bounds where each percentile lies; one pass counts what is below and keeps, added up by value, what is between the
    bounds (a few ten thousandths of the group), and the two neighbours of the rank are picked there."""
    used = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("x"))
    shares = [s for p in at.values() for s in (max(0.0, p - 3 * BOUND_ERROR), min(1.0, p + 3 * BOUND_ERROR))]
    near = F.percentile_approx("x", shares, int(1 / BOUND_ERROR))
    whole = used.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), near.alias("near"))
    few = F.col("n") <= WHOLE_GROUP
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("n") - 1)).alias("rank"), F.when(few, F.col("least")).otherwise(F.col("near")[2 * k]).alias("low"), F.when(few, F.col("most")).otherwise(F.col("near")[2 * k + 1]).alias("high")) for k, (name, p) in enumerate(at.items())))
    targets = whole.select(*keys, wanted.alias("wanted"))
    joined = used.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("m")).join(targets, list(keys)).select(*keys, "x", "m", F.explode("wanted").alias("t"))
    below = F.when(F.col("x") < F.col("t.low"), F.col("m")).otherwise(0)
    inside = joined.withColumn("slot", F.when(F.col("x").between(F.col("t.low"), F.col("t.high")), F.col("x"))).filter(F.col("slot").isNotNull() | (F.col("x") < F.col("t.low")))
    counted = inside.groupBy(*keys, "t.name", "t.rank", "slot").agg(F.sum("m").alias("m"), F.sum(below).alias("below"))  # all that is below is one row
    place = Window.partitionBy(*keys, "name")
    upto = F.sum("m").over(place.orderBy(F.col("slot").asc_nulls_first()))
    ranked = counted.withColumn("upto", upto).withColumn("from", upto - F.col("m")).filter("slot IS NOT NULL")
    pick = lambda r: F.max(F.when((F.col("from") <= r) & (r < F.col("upto")), F.col("slot")))
    low, high = pick(F.floor("rank")), pick(F.ceil("rank"))
    found = ranked.groupBy(*keys, "name").agg((low + (high - low) * (F.first("rank") - F.floor(F.first("rank")))).alias("y"))
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name, F.col("y"))).alias(name) for name in at))
