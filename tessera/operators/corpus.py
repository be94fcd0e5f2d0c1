"""A corpus of forms and its answer keys: digests, manifest and split checks, reconciliation with what was extracted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import dims

PARTITIONS = ("train", "dev", "test", "excluded")


def digests(forms: DataFrame) -> DataFrame:
    """form_id, html_sha256 and n_bytes of forms (form_id, html)."""
    raw = F.coalesce("html", F.lit("")).cast("binary")
    return forms.select("form_id", F.sha2(raw, 256).alias("html_sha256"), F.octet_length(raw).cast("long").alias("n_bytes"))


def manifest_problems(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """form_id, problem of a manifest (form_id, html_sha256, n_fields) against what is there (the same columns, a null digest
    for a form without a file). One shuffle by form; a form may have several problems."""
    a, b = (t.select("form_id", F.struct(F.lit(1).alias("here"), "html_sha256", "n_fields").alias(n)) for t, n in ((manifest, "a"), (present, "b")))
    both = a.join(b, "form_id", "full")
    listed, there, digest = F.col("a").isNotNull(), F.col("b").isNotNull(), F.col("b.html_sha256")
    problems = F.array(
        F.when(listed & ~there, "no answer key"),
        F.when(there & ~listed, "not in the manifest"),
        F.when(listed & there & digest.isNull(), "no file"),
        F.when(listed & there & (digest != F.col("a.html_sha256")), "another digest"),
        F.when(listed & there & ~F.col("a.n_fields").eqNullSafe(F.col("b.n_fields")), "another number of fields"),
    )
    return both.select("form_id", F.explode(F.array_compact(problems)).alias("problem"))


def partition_due(template_partition: Column, locale: Column) -> Column:
    """Where a form belongs: where its template does, but the held-out locale never trains."""
    return F.when((locale == dims.HELD_OUT_LOCALE) & (template_partition == "train"), "excluded").otherwise(template_partition)


def split_problems(forms: DataFrame, assigned: DataFrame, templates: DataFrame) -> DataFrame:
    """subject, problem of a split: forms (form_id, template_id, locale) against assigned (form_id, partition) and
    templates (template_id, template_partition). Templates are joined by key; nothing is collected."""
    met = forms.join(assigned.select("form_id", "partition", F.lit(True).alias("dealt")), "form_id", "full").withColumn("known", F.col("template_id").isNotNull())
    met = met.join(templates, "template_id", "left")
    due, part = partition_due(F.col("template_partition"), F.col("locale")), F.col("partition")
    dealt = F.coalesce("dealt", F.lit(False))
    problems = F.array(
        F.when(F.col("known") & ~dealt, "no partition"),
        F.when(~F.col("known"), "no answer key"),
        F.when(dealt & ~part.isin(*PARTITIONS), "unknown partition"),
        F.when(F.col("known") & dealt & F.col("template_partition").isNull(), "template without partition"),
        F.when(F.col("known") & dealt & (part != due), "not where its template is"),
        F.when(F.col("known") & dealt & (part == "train") & (F.col("locale") == dims.HELD_OUT_LOCALE), "held-out locale in train"),
    )
    of_forms = met.select(F.col("form_id").cast("string").alias("subject"), F.explode(F.array_compact(problems)).alias("problem"))
    parts = met.filter(F.col("known") & dealt & (part != "excluded")).groupBy("template_id").agg(F.count_distinct("partition").alias("n")).filter("n > 1")
    return of_forms.unionByName(parts.select(F.col("template_id").cast("string").alias("subject"), F.lit("in several partitions").alias("problem")))


def reconcile(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Per form: expected and found controls, those on one side only, and whether the order differs.

    expected: form_id, selector, ordinal, injected; found: form_id, selector, ordinal. Repeats of a selector count as
    found or expected but make no control missing. One shuffle by form and selector, one by form."""
    sides = expected.select("form_id", "selector", "ordinal", F.lit(1).alias("e"), F.coalesce("injected", F.lit(False)).alias("injected"))
    sides = sides.unionByName(found.select("form_id", "selector", "ordinal", F.lit(0).alias("e"), F.lit(False).alias("injected")))
    own = Window.partitionBy("form_id", "e").orderBy("ordinal", "selector")
    placed = sides.withColumn("nth", F.row_number().over(own))
    by_selector = placed.groupBy("form_id", "selector").agg(
        F.sum("e").alias("n_e"), F.sum(1 - F.col("e")).alias("n_f"), F.bool_or("injected").alias("injected"),
        F.sort_array(F.collect_list(F.when(F.col("e") == 1, F.col("nth")))).alias("at_e"), F.sort_array(F.collect_list(F.when(F.col("e") == 0, F.col("nth")))).alias("at_f"),
    )
    count = lambda c: F.count_if(c)
    here, there = F.col("n_f") > 0, F.col("n_e") > 0
    return by_selector.groupBy("form_id").agg(
        F.sum("n_e").alias("expected"), F.sum("n_f").alias("found"), count(there & ~here).alias("missing"), count(here & ~there).alias("unexpected"),
        count(F.col("injected")).alias("injected_expected"), count(F.col("injected") & here).alias("injected_found"), F.bool_or(F.col("at_e") != F.col("at_f")).alias("order_differs"),
    )


def sweep_totals(reconciled: DataFrame) -> DataFrame:
    """One row over all forms."""
    sums = (F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("expected", "found", "missing", "unexpected", "injected_expected", "injected_found"))
    return reconciled.agg(F.count(F.lit(1)).alias("forms"), *sums, F.count_if("order_differs").alias("order_differs"), F.count_if(F.col("missing") + F.col("unexpected") > 0).alias("failures"))


def label_gaps(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """label, n of labels that groups (label) do not name exactly once, unknown ones included."""
    n = groups.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return labels.select("label").distinct().join(n, "label", "full").select("label", F.coalesce("n", F.lit(0)).alias("n")).filter("n <> 1")


#: Of a family's templates, in their shuffled order, so many are for training, choosing and judging.
DEAL = (("train", 5), ("dev", 1), ("test", 2))


def deal_templates(templates: DataFrame, seed: int = 7) -> DataFrame:
    """family, template, place, part: each family's templates in an order of their own, dealt 5, 1 and 2; what is beyond is for judging.

    The order is a hash of seed, family and template, so it is the same wherever and however often it is drawn."""
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), "family", F.col("template").cast("string")))
    place = F.row_number().over(Window.partitionBy("family").orderBy(drawn, "template"))  # a family has some templates
    part, upto = F.lit(DEAL[-1][0]), 0
    cases = []
    for name, n in DEAL:
        upto += n
        cases.append((upto, name))
    for most, name in reversed(cases[:-1]):
        part = F.when(F.col("place") <= most, name).otherwise(part)
    return templates.select("family", "template").distinct().withColumn("place", place).withColumn("part", part)
