"""Answers of a language model against what was asked: tolerant decoding, a list of problems, one retry, nothing dropped.

An answer is text. A fence around it is taken off; then it must be a JSON object with an array ``fields`` of objects that carry a
string ``selector`` and a string ``label``. What it answers beyond the request is named, what it leaves out is asked again, and
what stays open is UNKNOWN. All of it is decided in the answer's own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import dims

# Attempts of a request, and the longest reason kept.
MOST_ATTEMPTS, MOST_REASON = 2, 120
_LABELS = [label for own in dims.LABELS.values() for label in own]
_ENTRY = "array<struct<selector:string,label:string,confidence:double,reason:string>>"


def unfenced(content: Column) -> Column:
    text = F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), r"^\s+|\s+$", ""))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "^```json", ""), "^```", ""), "```$", "")
    return F.when(text.startswith("```"), F.regexp_replace(bare, r"^\s+|\s+$", "")).otherwise(text)


def decoded(answers: DataFrame) -> DataFrame:
    """``answers`` (.., content) with ``entries`` and ``problem``: not_json, not_object, no_fields, bad_entry or null."""
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    text = lambda v, name: F.try_variant_get(v, f"$.{name}", "variant")
    rows = answers.withColumn("document", F.try_parse_json(unfenced(F.col("content"))))
    rows = rows.withColumn("fields", F.when(kind(F.col("document")).startswith("OBJECT"), F.try_variant_get("document", "$.fields", "variant")))
    rows = rows.withColumn("each", F.when(kind(F.col("fields")).startswith("ARRAY"), F.try_variant_get("fields", "$", "array<variant>")))
    whole = lambda e: kind(e).startswith("OBJECT") & (kind(text(e, "selector")) == "STRING") & (kind(text(e, "label")) == "STRING")
    problem = (
        F.when(F.col("document").isNull(), "not_json")
        .when(~kind(F.col("document")).startswith("OBJECT"), "not_object")
        .when(F.col("each").isNull(), "no_fields")
        .when(~F.forall("each", whole), "bad_entry")
    )
    number = lambda e: F.when(kind(text(e, "confidence")).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(e, "$.confidence", "double"))
    reason = lambda e: F.when(kind(text(e, "reason")) == "STRING", F.nullif(F.substring(F.trim(F.try_variant_get(e, "$.reason", "string")), 1, MOST_REASON), F.lit("")))
    entry = lambda e: F.struct(
        F.try_variant_get(e, "$.selector", "string").alias("selector"), F.try_variant_get(e, "$.label", "string").alias("label"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(number(e), F.lit(0.0)))).alias("confidence"), reason(e).alias("reason"),
    )
    rows = rows.withColumn("problem", problem)
    return rows.withColumn("entries", F.when(F.col("problem").isNull(), F.transform("each", entry)).cast(_ENTRY)).drop("document", "fields", "each")


def checked(answers: DataFrame) -> DataFrame:
    """``answers`` (.., selectors, content) with answered (the first good entry of each asked selector), missing, extra, problem and ok.

    A selector that was not asked, or that comes again after its answer, is extra; a label outside the vocabulary answers nothing."""
    rows = decoded(answers)
    good = lambda e: F.array_contains("selectors", e["selector"]) & e["label"].isin(*_LABELS)
    rows = rows.withColumn("good", F.filter("entries", good))
    first = F.transform("selectors", lambda s: F.get(F.filter("good", lambda e: e["selector"] == s), F.lit(0)))
    rows = rows.withColumn("answered", F.when(F.col("problem").isNull(), F.filter(first, lambda e: e.isNotNull())))
    beyond = F.filter("entries", lambda e, i: ~F.array_contains("selectors", e["selector"]) | F.exists(F.slice("entries", 1, i), lambda x: (x["selector"] == e["selector"]) & good(x)))
    rows = rows.withColumn("extra", F.array_distinct(F.transform(beyond, lambda e: e["selector"])))
    named = F.transform("answered", lambda e: e["selector"])
    rows = rows.withColumn("missing", F.when(F.col("problem").isNull(), F.filter("selectors", lambda s: ~F.array_contains(named, s))))
    return rows.withColumn("ok", F.col("problem").isNull() & (F.size("missing") == 0) & (F.size("extra") == 0)).drop("good", "entries")


def resolved(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """request_id, attempts, failure, answered, unresolved: each request's last readable answer; the second attempt counts only where
    the first was not whole. ``requests``: request_id, selectors; ``answers``: request_id, attempt, content."""
    of = lambda k: checked(requests.join(answers.filter(F.col("attempt") == k).select("request_id", "content"), "request_id", "left"))
    first = of(1).select("request_id", "selectors", *(F.col(c).alias(f"{c}_1") for c in ("answered", "missing", "extra", "problem", "ok")))
    again = answers.filter("attempt = 2").select("request_id", "content").join(first.filter("NOT ok_1").select("request_id", "selectors"), "request_id")
    second = checked(again).select("request_id", *(F.col(c).alias(f"{c}_2") for c in ("answered", "missing", "extra", "problem", "ok")))
    both = first.join(second, "request_id", "left")
    told = lambda k: F.coalesce(F.col(f"problem_{k}"), F.concat(F.size(f"missing_{k}").cast("string"), F.lit(" missing, "), F.size(f"extra_{k}").cast("string"), F.lit(" invented")))
    tried = F.col("ok_2").isNotNull()
    answered = F.coalesce(F.when(tried & F.col("problem_2").isNull(), F.col("answered_2")), F.when(F.col("problem_1").isNull(), F.col("answered_1")), F.array().cast(_ENTRY))
    done = both.select(
        "request_id", F.when(tried, 2).otherwise(1).alias("attempts"), answered.alias("answered"), "selectors",
        F.when(tried, F.when(~F.col("ok_2"), told(2))).otherwise(F.when(~F.col("ok_1"), told(1))).alias("failure"),
    )
    named = F.transform("answered", lambda e: e["selector"])
    return done.withColumn("unresolved", F.filter("selectors", lambda s: ~F.array_contains(named, s)))


def labels(done: DataFrame) -> DataFrame:
    """request_id, selector, label, confidence: one row a selector that was asked; what stayed open is UNKNOWN at 0."""
    own = F.transform("selectors", lambda s: F.coalesce(F.get(F.filter("answered", lambda e: e["selector"] == s), F.lit(0)), F.struct(s.alias("selector"), F.lit("UNKNOWN").alias("label"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("reason"))))
    return done.select("request_id", F.explode(own).alias("e")).select("request_id", "e.selector", "e.label", "e.confidence")


def accounting(done: DataFrame) -> DataFrame:
    """Requests, attempts, retries, fields asked and left open, failures: one row."""
    return done.agg(
        F.count(F.lit(1)).alias("requests"), F.sum("attempts").alias("attempts"), F.count_if(F.col("attempts") > 1).alias("retried"), F.sum(F.size("selectors")).alias("fields"),
        F.sum(F.size("unresolved")).alias("unresolved"), F.count_if(F.col("failure").isNotNull()).alias("failed"),
    )
