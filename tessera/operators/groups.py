"""Groups of neighbouring controls: split expiries, address runs, choice groups; and option lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera import dims

def page() -> WindowSpec:
    """A page's controls in document order."""
    return Window.partitionBy("page_id").orderBy("document_index")


def _names(words: tuple[str, ...]) -> Column:
    """Whether a token of the label or the identifiers contains one of the words."""
    return F.concat_ws(" ", "label_stream", "identifier_stream").rlike("|".join(words))


def _half(controls: DataFrame, words: tuple[str, ...], listed) -> Column:
    """Whether a control is one half of an expiry: a select by its options, a plain input by its words."""
    lists = [F.coalesce(listed(F.col(c)), F.lit(False)) for c in ("option_values", "option_labels") if c in controls.columns]
    options = F.greatest(*lists, F.lit(False), F.lit(False))  # what is sent or what is shown
    plain = (F.col("tag") == "input") & F.coalesce("input_type", F.lit("text")).isin("text", "number", "tel")
    return F.when(F.col("tag") == "select", F.coalesce(options, F.lit(False))).otherwise(plain & _names(words))


def expiry_pairs(controls: DataFrame, now_year: int = 2026) -> DataFrame:
    """Controls with expiry_role ('month', 'year' or null), starts, and pair: the number of its pair on the page.

    A pair is two neighbours in one fieldset or parent, one of them a select, one a month and one a year; pairs are taken
    greedily from the left. Blind spots take no part, so that their neighbours may meet across them.
    """
    blind = F.col("undetectable_reason").isNotNull()
    seen = Window.partitionBy("page_id", "blind").orderBy("document_index")
    rows = controls.withColumn("blind", blind).withColumn("month", ~blind & _half(controls, dims.MONTH_WORDS, is_month_list))
    rows = rows.withColumn("year", ~blind & _half(controls, dims.YEAR_WORDS, lambda v: is_year_list(v, now_year)))
    after = lambda c: F.lead(c).over(seen)
    near = F.coalesce(after("fieldset_key") == F.col("fieldset_key"), F.lit(False)) if "fieldset_key" in controls.columns else F.lit(False)
    near = near | F.coalesce((after("parent_key") == F.col("parent_key")) & (F.col("parent_key") != ""), F.lit(False))
    forth, back = F.col("month") & after("year"), F.col("year") & after("month")
    edge = near & ((F.col("tag") == "select") | (after("tag") == "select")) & (forth | back)
    rows = rows.withColumn("edge", F.coalesce(edge, F.lit(False))).withColumn("first", F.when(forth, "month").otherwise("year"))
    # Greedy matching on a run of edges takes every other one.
    rows = rows.withColumn("run", F.sum(F.when(F.col("edge"), 0).otherwise(1)).over(seen))
    nth = F.row_number().over(Window.partitionBy("page_id", "blind", "run", "edge").orderBy("document_index"))
    rows = rows.withColumn("starts", F.col("edge") & (nth % 2 == 1))
    rows = rows.withColumn("ends", F.coalesce(F.lag("starts").over(seen), F.lit(False))).withColumn("before", F.lag("first").over(seen))
    rows = rows.withColumn("pair", F.sum(F.col("starts").cast("int")).over(seen).cast("int"))
    other = F.when(F.col("before") == "month", "year").otherwise("month")
    role = F.when(F.col("starts"), F.col("first")).when(F.col("ends"), other)
    rows = rows.withColumn("expiry_role", role).withColumn("pair", F.when(role.isNotNull(), F.col("pair")))
    return rows.drop("blind", "month", "year", "edge", "first", "run", "ends", "before")


def _like_address_line(controls: DataFrame) -> Column:
    """A declared address line, or a plain text input that names an address word and an ordinal."""
    words = F.split(F.concat_ws(" ", "label_stream", "identifier_stream"), " ")
    has = lambda known: F.arrays_overlap(words, F.array(*map(F.lit, known)))
    plain = (F.col("tag") == "input") & F.coalesce("input_type", F.lit("text")).isin("text")
    named = plain & has(dims.ADDRESS_WORDS) & has(dims.ORDINALS)
    declared = F.coalesce(F.col("declared.token").isin(*dims.ADDRESS_LINES), F.lit(False)) if "declared" in controls.columns else F.lit(False)
    return declared | F.coalesce(named, F.lit(False))


def address_runs(controls: DataFrame, most: int = 3) -> DataFrame:
    """Controls with address_run: the index of the first control of a run of 2 to 3 neighbours of one form that are address lines."""
    blind = F.col("undetectable_reason").isNotNull()
    seen = Window.partitionBy("page_id", "blind").orderBy("document_index")
    rows = controls.withColumn("blind", blind).withColumn("like", ~blind & _like_address_line(controls))
    breaks = ~F.col("like") | ~F.lag("form_key").over(seen).eqNullSafe(F.col("form_key")) | ~F.coalesce(F.lag("like").over(seen), F.lit(False))
    rows = rows.withColumn("breaks", breaks).withColumn("run", F.sum(F.col("breaks").cast("int")).over(seen))
    nth = F.row_number().over(Window.partitionBy("page_id", "blind", "run").orderBy("document_index")) - 1
    rows = rows.withColumn("chunk", F.floor(nth / most))
    own = Window.partitionBy("page_id", "blind", "run", "chunk")
    run = F.when(F.col("like") & (F.count(F.lit(1)).over(own) >= 2), F.min("document_index").over(own))
    return rows.withColumn("address_run", run).drop("blind", "like", "breaks", "run", "chunk")


def choice_groups(controls: DataFrame) -> DataFrame:
    """Controls with choice_group: the first index of two or more checkboxes or radios of one form and name, blind spots left out."""
    choice = F.col("input_type").isin("radio", "checkbox") & F.col("name").isNotNull() & F.col("undetectable_reason").isNull()
    own = Window.partitionBy("page_id", "form_key", "input_type", "name", choice)
    return controls.withColumn("choice_group", F.when(choice & (F.count(F.lit(1)).over(own) >= 2), F.min("document_index").over(own)))


def detect_groups(controls: DataFrame, now_year: int = 2026) -> DataFrame:
    """Controls (with signals) and group_role, group_id: an expiry pair before a choice group before an address run.

    Groups are numbered on their page by their first controls. One shuffle by page.
    """
    rows = choice_groups(address_runs(expiry_pairs(controls, now_year)))
    numbered = lambda first, *kind: F.dense_rank().over(Window.partitionBy("page_id", *kind).orderBy(F.col(first).asc_nulls_last()))
    choice = F.concat_ws("-", "input_type", numbered("choice_group", "input_type"))
    address = F.concat_ws("-", F.lit("address-lines"), numbered("address_run"))
    cases = (
        (F.col("expiry_role").isNotNull(), F.concat(F.lit("cc_exp_"), "expiry_role"), F.concat_ws("-", F.lit("expiry"), "pair")),
        (F.col("choice_group").isNotNull(), F.concat("input_type", F.lit("_member")), choice),
        (F.col("address_run").isNotNull(), F.lit("address_line_member"), address),
    )
    role = F.coalesce(*(F.when(found, name) for found, name, _ in cases))
    number = F.coalesce(*(F.when(found, name) for found, _, name in cases))
    rows = rows.withColumn("group_role", role).withColumn("group_id", number)
    return rows.drop("starts", "pair", "expiry_role", "choice_group", "address_run")


def option_lists(options: DataFrame) -> DataFrame:
    """Option values of each control by its kind. (Eleven padded months, kind 3, read as the years 2001 to 2011.)"""
    pad = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.lpad(m.cast("string"), 2, "0"))
    plain = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: m.cast("string"))
    years = F.transform(F.sequence(F.col("size") + 1980, F.col("size") + 1990), lambda y: y.cast("string"))
    kind = F.col("kind")
    return options.withColumn(
        "values",
        F.when(kind == 0, pad).when(kind == 1, plain).when(kind == 2, years).when(kind == 3, F.slice(pad, 1, 11)).when(kind == 4, F.reverse(years)).otherwise(F.array(F.lit("a"), F.col("size").cast("string"))),
    )


def is_month_list(values: Column) -> Column:
    """Exactly the twelve numbers 1 to 12 in order."""
    numbers = F.transform(values, lambda v: F.expr("try_cast(1 as int)") * v.try_cast("int"))
    return (F.size(values) == 12) & F.coalesce(F.forall(F.zip_with(numbers, F.sequence(F.lit(1), F.lit(12)), lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False))), F.lit(False))


def is_year_list(values: Column, now_year: int) -> Column:
    """Three or more consecutive years that begin between five years back and twenty ahead."""
    numbers = F.transform(values, lambda v: F.when(v.rlike(r"^(\d{2}|\d{4})$"), F.when(F.length(v) == 2, v.try_cast("int") + 2000).otherwise(v.try_cast("int"))))
    first = F.get(numbers, F.lit(0))
    runs = F.forall(F.transform(numbers, lambda n, k: n == first + k), lambda x: F.coalesce(x, F.lit(False)))
    return F.coalesce((F.size(values) >= 3) & runs & first.between(now_year - 5, now_year + 20), F.lit(False))
