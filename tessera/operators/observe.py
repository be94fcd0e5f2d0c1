"""Judging findings: what a page needed, what was said, and whether the advice was right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import dims
from tessera.operators.decide import advice, primary
from tessera.operators.metrics import LEAST_ROWS, ratio

#: Labels that ask for no declaration.
NO_CLAIM = ("UNKNOWN", "NOT_AUTOFILLABLE", "COMPOSITE_UNSPLIT")


def _alike(declared: Column, label: Column) -> Column:
    return F.coalesce(F.concat(declared, F.lit("|"), label).isin(*(f"{d}|{i}" for d, i in dims.equivalent_pairs())), F.lit(False))


def observations(predicted: DataFrame, truth: str = "true_label", thresholds: tuple[float, float] = dims.RULE_THRESHOLDS) -> DataFrame:
    """Two rows a control with a known label (blind spots have none): code, needed, emitted, correct. In the control's own row."""
    declared, label, true = F.col("declared"), F.col("label"), F.col(truth)
    said = F.coalesce(primary(*thresholds), F.lit(""))
    given = F.when(~label.isin(*NO_CLAIM), advice(label))
    token = F.when(declared["token"].isin(*dims.SPEC_LABELS) & ~declared["is_off"] & ~declared["is_off_spec"], declared["token"])
    nothing = declared["token"].isNull() & ~declared["is_off"] & ~declared["is_off_spec"]
    correct = given.isNotNull() & _alike(given, true)
    made = lambda code, needed: F.struct(F.lit(code).alias("code"), needed.alias("needed"), (said == code).alias("emitted"), correct.alias("correct"))
    rows = F.array(made("MISSING_AUTOCOMPLETE", nothing & advice(true).isNotNull()), made("WRONG_AUTOCOMPLETE", token.isNotNull() & ~_alike(token, true)))
    return predicted.filter(F.col("undetectable_reason").isNull() & true.isNotNull()).select("page_id", "selector", F.inline(rows))


def finding_metrics(seen: DataFrame, *keys: str, least: int = LEAST_ROWS) -> DataFrame:
    """Per code: precision over accusations, recall over what was needed, each null below ``least`` of its own."""
    n = seen.groupBy(*keys, "code").agg(F.count_if("emitted").alias("accusations"), F.count_if(F.col("emitted") & F.col("correct")).alias("correct_accusations"), F.count_if("needed").alias("fields_needing_one"))
    precision, recall = ratio(F.col("correct_accusations"), F.col("accusations")), ratio(F.col("correct_accusations"), F.col("fields_needing_one"))
    said, due = F.col("accusations") >= least, F.col("fields_needing_one") >= least
    return n.select(
        "*", F.when(said, precision).alias("precision"), F.when(due, recall).alias("recall"), F.when(said & due, ratio(2 * precision * recall, precision + recall)).alias("f1")
    )


def codes_by_control(controls: DataFrame, found: DataFrame) -> DataFrame:
    """page_id, selector, codes: each control's distinct codes in order; none is an empty list."""
    own = found.groupBy("page_id", "selector").agg(F.sort_array(F.collect_set("code")).alias("codes"))
    return controls.select("page_id", "selector").join(own, ["page_id", "selector"], "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
