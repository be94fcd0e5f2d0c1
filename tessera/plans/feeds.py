"""Inputs derived from the given tables. The SQL text prepares inputs only, and serves Spark and DuckDB alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _pick(key: str, *values: str | None) -> str:
    """CASE over key modulo the number of values."""
    own = " ".join(f"WHEN {k} THEN " + ("CAST(NULL AS VARCHAR(80))" if v is None else "'" + v.replace("'", "''") + "'") for k, v in enumerate(values))
    return f"CASE {key} % {len(values)} {own} END"


_LABELS = ("First name", "Last name", "E-mail address", "Phone", "Street address", "City", "Expiry year", "Country", "Card number", "Name on card", "Security code", "Password", "Username", "Company", "Promo code", "Expiry month", "ZIP code", "Address line 2", "Your message", "Date of birth", "", None)
_NAMES = ("firstName", "last_name", "email", "ctl00$phone", "addr1", "city", "expYear", "country", "ccNumber", "cardHolderName", "cvc", "password", "userName", "company", "promoCode", "expMonth", "zipCode", "address2", "field_7", "input3", "a1b2c3d4e5", None)
#: What each wording asks for: the answer key.
_TRUE = ("given-name", "family-name", "email", "tel", "street-address", "address-level2", "cc-exp-year", "country", "cc-number", "cc-name", "cc-csc", "new-password", "username", "organization", "NOT_AUTOFILLABLE", "cc-exp-month", "postal-code", "address-line2", "NOT_AUTOFILLABLE", "bday", None, None)
_TYPES = ("text", "text", "email", "tel", "text", "password", "text", "checkbox", "url", "number", "search", None)
_DECLARED = (None, "given-name", "off", None, "shipping street-address", "zipcode", None, "", "section-a billing postal-code", "cc-number", "on", None, "email tel", "work email webauthn", None, "billing", "organization-title", None, "family-name")

#: One control a row of orders; key arithmetic spreads wordings, types, declarations and structure over each other.
CONTROLS = f"""
    SELECT CAST(floor(o_orderkey / 8.0) AS BIGINT) AS page_id, CAST(o_orderkey % 8 AS INT) AS document_index,
           CASE WHEN o_orderkey % 8 < 5 THEN 'e1' WHEN o_orderkey % 8 < 7 THEN 'e2' END AS form_key,
           CASE WHEN o_orderkey % 8 < 3 THEN 'p1' ELSE 'p2' END AS parent_key,
           CASE WHEN o_orderkey % 16 >= 8 THEN 's1' END AS fieldset_key,
           {_pick("o_orderkey", "input", "input", "select", "input", "input", "textarea", "input")} AS tag,
           CASE WHEN o_orderkey % 16 IN (1, 2) THEN 'radio' ELSE {_pick("(o_orderkey * 5 + 1)", *_TYPES)} END AS input_type,
           {_pick("(o_orderkey * 3)", None, "tel", "numeric", None, "text")} AS inputmode,
           CASE WHEN o_orderkey % 16 IN (1, 2) THEN 'plan' ELSE {_pick("(o_orderkey * 13 + 2)", *_NAMES)} END AS name,
           {_pick("(o_orderkey * 13 + 5)", *_NAMES)} AS element_id,
           {_pick("(o_orderkey * 13 + 2)", *_LABELS)} AS label_for,
           {_pick("(o_orderkey * 17)", None, None, None, "City", None)} AS label_ancestor,
           {_pick("(o_orderkey * 19)", None, None, "Search", None, None, None, "")} AS aria_label,
           {_pick("(o_orderkey * 23)", None, None, None, "Billing country", None, None, None, None, None)} AS aria_labelledby_text,
           {_pick("(o_orderkey * 29)", None, "Gender", None, None)} AS title,
           {_pick("(o_orderkey * 31 + 3)", None, "Enter city", "MM/YY", None, "you@example.com")} AS placeholder,
           {_pick("(o_orderkey * 37)", None, "Payment", "Delivery address", "Your account")} AS section_heading,
           {_pick("(o_orderkey * 11 + 4)", *_DECLARED)} AS autocomplete_raw,
           CAST(CASE o_orderkey % 9 WHEN 0 THEN 5 WHEN 1 THEN 40 END AS INT) AS maxlength,
           CASE WHEN o_orderkey % 7 = 2 THEN CASE o_orderkey % 4 WHEN 0 THEN '01|02|03|04|05|06|07|08|09|10|11|12' WHEN 1 THEN '2026|2027|2028|2029' WHEN 2 THEN '1|2|3|4|5|6|7|8|9|10|11|12' ELSE '|AT|CH|DE' END END AS option_text,
           CASE o_orderkey % 41 WHEN 7 THEN 'closed_shadow_root' WHEN 19 THEN 'cross_origin_frame' END AS undetectable_reason,
           o_orderkey % 23 = 5 AS style_hidden, o_orderkey % 29 = 11 AS zero_size, o_orderkey % 31 = 13 AS offscreen,
           {_pick("(o_orderkey * 13 + 2)", *_TRUE)} AS true_label,
           '#c' || CAST(o_orderkey AS VARCHAR(20)) AS selector,
           o_orderkey
    FROM orders
"""

#: Two engines' predictions for each labelled document; truth is the quality label.
RUNLOG = """
    SELECT d.doc_id AS form_id, d.lang AS locale, d.source AS template_id, CAST(d.doc_id % 10 AS BIGINT) AS cluster,
           CASE d.doc_id % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'partial' WHEN 2 THEN 'mixed' ELSE 'hostile' END AS tier,
           e.engine, CASE WHEN l.quality = 1 THEN 'good' ELSE 'bad' END AS true_label,
           CASE WHEN (d.doc_id * 7 + e.k) % 13 = 0 THEN 'UNKNOWN'
                WHEN (d.doc_id * 5 + e.k * 3) % (9 + 4 * e.k) = 0 THEN 'other'
                WHEN d.n_chars > 300 * (1 + e.k) THEN 'good' ELSE 'bad' END AS pred_label,
           CASE WHEN (d.doc_id * 7 + e.k) % 13 = 0 THEN 0.0 ELSE CAST(((d.doc_id * 31 + e.k * 17) % 97 + 3) AS DOUBLE) / 100 END AS confidence,
           CAST((d.doc_id * 37 + e.k * 11) % 1000 AS DOUBLE) / 7 AS latency_us
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id
    CROSS JOIN (SELECT 0 AS k, 'rules' AS engine UNION ALL SELECT 1 AS k, 'ngram' AS engine) e
"""

#: Option lists of controls.
OPTIONS = """
    SELECT p_partkey AS control, CAST(p_size AS BIGINT) AS size, CAST(p_partkey % 6 AS INT) AS kind FROM part
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """Given tables by name."""
    return {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names}


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A table of fewer partitions than there are cores, dealt to all of them by key before long work on its rows; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *map(F.expr, keys)) if df.rdd.getNumPartitions() < cores else df


def bound(sql: str, given: dict[str, DataFrame]) -> DataFrame:
    """The SQL over tables that are bound to this query and leave the session's views alone."""
    for name in given:
        sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", sql)
    return next(iter(given.values())).sparkSession.sql(sql, **given)


def prepared(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """The SQL over given tables."""
    return bound(sql, tables(spark, sf_dir, *names))


def by_page(spark: SparkSession, sf_dir: str, sql: str, dealt: bool = False) -> DataFrame:
    """The SQL over orders, the rows of a page in one partition of a small table. ``dealt``: of larger ones too, so that keys are
    dealt to pages before the SQL makes them wide, and the pages lie in as many partitions as the keys were read in."""
    orders, page = tables(spark, sf_dir, "orders")["orders"].select("o_orderkey"), "CAST(floor(o_orderkey / 8.0) AS BIGINT)"
    parts = orders.rdd.getNumPartitions()
    if dealt and parts >= spark.sparkContext.defaultParallelism:
        return bound(sql, {"orders": orders.repartition(4 * parts, F.expr(page))})
    return bound(sql, {"orders": spread(orders, page)})


def feed_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_page(spark, sf_dir, CONTROLS).withColumn("option_values", F.split("option_text", r"\|"))


def feed_runlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir, RUNLOG, "documents", "labels")


def feed_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir, OPTIONS, "part")
