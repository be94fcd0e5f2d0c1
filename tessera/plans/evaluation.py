"""Queries that measure findings and check a corpus, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import dims
from tessera.functions import text as T
from tessera.operators import report, corpus, decide, observe, rules, statistics
from tessera.plans import feeds
from tessera.plans.catalogue import _AGREE, _ADVICE, _FOUND, _PREDICT, _TRAP, C, R, _findings, _predicted, _visible_predicted, query, rendered
from tessera.sources import html

_SPEC = ", ".join(f"'{t}'" for t in dims.SPEC_LABELS)

# ---- findings against the answer key ----------------------------------------------------------------------------

_OBSERVED = f"""{_FOUND},
    agree AS (SELECT declared || '|' || inferred AS pair FROM {_AGREE}),
    o AS (SELECT pr.page_id, pr.selector, pr.form_key, t.declared_as IS NOT NULL AND token IS NULL AND NOT coalesce(is_off, false) AND NOT is_off_spec AS needs_missing,
                 coalesce(token IN ({_SPEC}) AND NOT is_off AND NOT is_off_spec AND token || '|' || true_label NOT IN (SELECT pair FROM agree), false) AS needs_wrong,
                 coalesce(code, '') AS said, coalesce(pr.label NOT IN ('UNKNOWN', 'NOT_AUTOFILLABLE', 'COMPOSITE_UNSPLIT') AND pr.declared_as || '|' || true_label IN (SELECT pair FROM agree), false) AS correct
          FROM pr LEFT JOIN {_ADVICE.replace('advice(', 't(')} ON pr.true_label = t.label WHERE undetectable_reason IS NULL AND true_label IS NOT NULL),
    ob AS (SELECT page_id, selector, 'MISSING_AUTOCOMPLETE' AS code, needs_missing AS needed, said = 'MISSING_AUTOCOMPLETE' AS emitted, correct FROM o
           UNION ALL SELECT page_id, selector, 'WRONG_AUTOCOMPLETE', needs_wrong, said = 'WRONG_AUTOCOMPLETE', correct FROM o)"""


@query(f"WITH {_OBSERVED} SELECT selector, code, needed, emitted, correct FROM ob")
def finding_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.observations(_visible_predicted(spark, sf_dir)).drop("page_id")


@query(f"""WITH {_OBSERVED}, n AS (SELECT code, count(*) FILTER (WHERE emitted) AS accusations, count(*) FILTER (WHERE emitted AND correct) AS correct_accusations, count(*) FILTER (WHERE needed) AS fields_needing_one FROM ob GROUP BY 1)
    SELECT *, CASE WHEN accusations >= 30 THEN round(correct_accusations::DOUBLE / accusations, 6) END AS precision, CASE WHEN fields_needing_one >= 30 THEN round(correct_accusations::DOUBLE / fields_needing_one, 6) END AS recall,
           CASE WHEN accusations >= 30 AND fields_needing_one >= 30 THEN round(2.0::DOUBLE * correct_accusations / (accusations + fields_needing_one), 6) END AS f1 FROM n""")
def finding_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = observe.finding_metrics(observe.observations(_visible_predicted(spark, sf_dir)))
    return m.select("code", "accusations", "correct_accusations", "fields_needing_one", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"WITH {_FOUND} SELECT c.selector, coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') AS codes FROM c LEFT JOIN found ON c.selector = found.selector AND c.page_id = found.page_id GROUP BY c.page_id, c.selector")
def codes_by_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = observe.codes_by_control(feeds.feed_controls(spark, sf_dir), _findings(spark, sf_dir))
    return seen.select("selector", F.array_join("codes", ",").alias("codes"))


@query(f"""WITH {_PREDICT}, last AS (SELECT selector, coalesce(min(tier_no) FILTER (WHERE m.tier = p.tier), 9) AS tier_no FROM p LEFT JOIN m USING (selector) WHERE undetectable_reason IS NULL GROUP BY 1),
    sig AS (SELECT m.selector, m.tier || ':' || m.label AS signal, min(m.tier_no * 10000 + pos) AS nth FROM m JOIN last ON m.selector = last.selector AND m.tier_no <= last.tier_no GROUP BY 1, 2),
    lst AS (SELECT selector, list(signal ORDER BY nth) AS signals FROM sig GROUP BY 1)
    SELECT p.selector, CASE WHEN undetectable_reason IS NOT NULL THEN 'undetectable:' || undetectable_reason WHEN signals IS NULL THEN '' ELSE array_to_string(signals[1:2], ', ') || CASE WHEN len(signals) > 2 THEN ' and ' || (len(signals) - 2) || ' more' ELSE '' END END AS evidence
    FROM p LEFT JOIN lst USING (selector)""")
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each classification rests on, in words; at most two signals, so that the rest is counted."""
    return rules.with_evidence(_predicted(spark, sf_dir)).select("selector", rules.shown(F.col("signals"), 2).alias("evidence"))


@query(f"""WITH {_PREDICT} SELECT selector, 'rule tier ' || tier AS by_tier, 'self-reported ' || printf('%.2f', confidence) || ', not calibrated' AS by_claim, 'confidence ' || printf('%.2f', confidence) AS calibrated,
    CASE WHEN tag <> 'textarea' AND coalesce(maxlength, 99) <= 7 THEN 'cc-exp' ELSE 'street-address' END AS composite FROM p""")
def confidence_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One confidence by each of the three scales, and what a composite control should declare."""
    shown = lambda kind: decide.confidence_shown(F.lit(kind), F.col("confidence"), F.col("tier"))
    p = _predicted(spark, sf_dir)
    return p.select("selector", shown("tier").alias("by_tier"), shown("self-reported").alias("by_claim"), shown("calibrated").alias("calibrated"), decide.composite_token().alias("composite"))


# ---- comparisons ------------------------------------------------------------------------------------------------

_TIERS = ("clean", "partial", "mixed", "hostile")
_SLICES = {"all": "true", "seen_locales": "coalesce(locale <> 'fr', true)", "unseen_locale": "locale = 'fr'", **{f"tier:{t}": f"tier = '{t}'" for t in _TIERS}}
_FAMILY = f"""WITH {R}, x AS ({' UNION ALL '.join(f"SELECT '{n}' AS slice, * FROM r WHERE {k}" for n, k in _SLICES.items())}),
    l AS (SELECT slice, cluster, engine, true_label AS label, CASE WHEN true_label = pred_label THEN 1 ELSE 0 END AS tp FROM x UNION ALL SELECT slice, cluster, engine, pred_label, 0 FROM x),
    k AS (SELECT slice, cluster, label, sum(tp) FILTER (WHERE engine = 'rules') AS tp_a, count(*) FILTER (WHERE engine = 'rules') AS w_a, sum(tp) FILTER (WHERE engine = 'ngram') AS tp_b, count(*) FILTER (WHERE engine = 'ngram') AS w_b FROM l GROUP BY 1, 2, 3),
    z AS (SELECT *, dense_rank() OVER (PARTITION BY slice ORDER BY cluster) - 1 AS bit FROM k), q AS (SELECT slice, max(bit) + 1 AS n FROM z GROUP BY 1),
    m AS (SELECT slice, unnest(range(0, (2 ** n)::BIGINT)) AS mask FROM q),
    y AS (SELECT slice, mask, label, sum(CASE WHEN (mask >> bit::INT) & 1 = 1 THEN tp_b ELSE tp_a END) AS tp_a, sum(CASE WHEN (mask >> bit::INT) & 1 = 1 THEN w_b ELSE w_a END) AS w_a,
                 sum(CASE WHEN (mask >> bit::INT) & 1 = 1 THEN tp_a ELSE tp_b END) AS tp_b, sum(CASE WHEN (mask >> bit::INT) & 1 = 1 THEN w_a ELSE w_b END) AS w_b FROM m JOIN z USING (slice) GROUP BY 1, 2, 3),
    d AS (SELECT slice, mask, avg(2.0::DOUBLE * tp_a / nullif(w_a, 0)) AS first_score, avg(2.0::DOUBLE * tp_b / nullif(w_b, 0)) AS second_score FROM y GROUP BY 1, 2),
    o AS (SELECT *, second_score - first_score AS effect FROM d WHERE mask = 0),
    t AS (SELECT o.slice, any_value(o.first_score) AS first_score, any_value(o.second_score) AS second_score, any_value(o.effect) AS effect, 2.0::DOUBLE / count(*) AS floor,
                 avg(CASE WHEN abs(d.second_score - d.first_score) >= abs(o.effect) - 1e-12 THEN 1.0::DOUBLE ELSE 0.0 END) AS p FROM d JOIN o USING (slice) GROUP BY 1),
    i AS (SELECT *, row_number() OVER (ORDER BY p, slice) AS nth, count(*) OVER () AS size FROM t),
    a AS (SELECT i.*, least(1.0, (SELECT min(b.p * b.size / b.nth) FROM i b WHERE b.nth >= i.nth)) AS p_adjusted FROM i),
    v AS (SELECT *, CASE WHEN floor > 0.05 THEN 'UNDERPOWERED' WHEN p_adjusted < 0.05 AND effect >= 0.02 THEN 'IMPROVEMENT' WHEN p_adjusted < 0.05 AND effect <= -0.02 THEN 'REGRESSION' WHEN p_adjusted < 0.05 THEN 'BELOW_THRESHOLD' ELSE 'NO_CHANGE' END AS verdict FROM a)"""


def _family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.comparison_family(feeds.feed_runlog(spark, sf_dir), "cluster", "rules", "ngram", {n: F.expr(k) for n, k in _SLICES.items()})


@query(_FAMILY + " SELECT slice, round(first_score, 6) AS first_score, round(second_score, 6) AS second_score, round(effect, 6) AS effect, round(p, 6) AS p, round(floor, 6) AS floor, round(p_adjusted, 6) AS p_adjusted, verdict FROM v")
def comparison_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro-F1 of two engines on all forms, on seen and unseen locales and by tier, tested as one family."""
    return _family(spark, sf_dir).select("slice", *(F.round(c, 6).alias(c) for c in ("first_score", "second_score", "effect", "p", "floor", "p_adjusted")), "verdict")


@query(_FAMILY + ", s(verdict) AS (VALUES ('UNDERPOWERED'), ('IMPROVEMENT'), ('REGRESSION'), ('BELOW_THRESHOLD'), ('NO_CHANGE')) SELECT s.verdict, count(v.slice) AS n FROM s LEFT JOIN v USING (verdict) GROUP BY 1")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _family(spark, sf_dir).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([(v,) for v in statistics.VERDICTS], "verdict string").join(n, "verdict", "left").select("verdict", F.coalesce("n", F.lit(0)).alias("n"))


#: A third engine beside the two of the run log.
_ENGINES = ("rules", "ngram", "model")
_THREE = feeds.RUNLOG.replace("SELECT 1 AS k, 'ngram' AS engine)", "SELECT 1 AS k, 'ngram' AS engine UNION ALL SELECT 2 AS k, 'model' AS engine)")
_SAID = "CASE WHEN form_id % 2 = 0 THEN 'MISSING_AUTOCOMPLETE' ELSE 'WRONG_AUTOCOMPLETE' END"
_PAIRS = ", ".join(f"('{a}', '{b}')" for k, a in enumerate(_ENGINES) for b in _ENGINES[k + 1 :])
_SWAP = lambda c: f"sum(CASE WHEN (mask >> bit::INT) & 1 = 1 THEN {c}_b ELSE {c}_a END) AS {c}_a, sum(CASE WHEN (mask >> bit::INT) & 1 = 1 THEN {c}_a ELSE {c}_b END) AS {c}_b"
_BOTH = lambda c, own: f"coalesce(sum({own}) FILTER (WHERE engine = first), 0) AS {c}_a, coalesce(sum({own}) FILTER (WHERE engine = second), 0) AS {c}_b"
_ALL_PAIRS = f"""WITH r AS ({_THREE}), pairs(first, second) AS (VALUES {_PAIRS}), x AS ({' UNION ALL '.join(f"SELECT '{n}' AS slice, * FROM r WHERE {k}" for n, k in _SLICES.items())}),
    l AS (SELECT slice, cluster, engine, true_label AS label, CASE WHEN true_label = pred_label THEN 1 ELSE 0 END AS tp FROM x UNION ALL SELECT slice, cluster, engine, pred_label, 0 FROM x),
    k AS (SELECT first, second, slice, cluster, label, {_BOTH("tp", "tp")}, {_BOTH("w", "1")} FROM l JOIN pairs ON engine IN (first, second) GROUP BY ALL),
    z AS (SELECT *, dense_rank() OVER (PARTITION BY first, second, slice ORDER BY cluster) - 1 AS bit FROM k), q AS (SELECT first, second, slice, max(bit) + 1 AS n FROM z GROUP BY ALL),
    m AS (SELECT first, second, slice, unnest(range(0, (2 ** n)::BIGINT)) AS mask FROM q),
    y AS (SELECT first, second, slice, mask, label, {_SWAP("tp")}, {_SWAP("w")} FROM m JOIN z USING (first, second, slice) GROUP BY ALL),
    fk AS (SELECT first, second, {_SAID} AS slice, cluster, {_BOTH("c", "CASE WHEN pred_label = 'good' AND true_label = 'good' THEN 1 ELSE 0 END")}, {_BOTH("e", "CASE WHEN pred_label = 'good' THEN 1 ELSE 0 END")}, {_BOTH("n", "CASE WHEN true_label = 'good' THEN 1 ELSE 0 END")}
           FROM r JOIN pairs ON engine IN (first, second) GROUP BY ALL),
    fz AS (SELECT *, row_number() OVER (PARTITION BY first, second, slice ORDER BY cluster) - 1 AS bit FROM fk), fq AS (SELECT first, second, slice, max(bit) + 1 AS n FROM fz GROUP BY ALL),
    fm AS (SELECT first, second, slice, unnest(range(0, (2 ** n)::BIGINT)) AS mask FROM fq),
    fy AS (SELECT first, second, slice, mask, {_SWAP("c")}, {_SWAP("e")}, {_SWAP("n")} FROM fm JOIN fz USING (first, second, slice) GROUP BY ALL),
    d AS (SELECT first, second, 'macro_f1/' || slice AS test, mask, avg(2.0::DOUBLE * tp_a / nullif(w_a, 0)) AS first_score, avg(2.0::DOUBLE * tp_b / nullif(w_b, 0)) AS second_score FROM y GROUP BY ALL
          UNION ALL SELECT first, second, slice || '/precision', mask, coalesce(c_a::DOUBLE / nullif(e_a, 0), 0), coalesce(c_b::DOUBLE / nullif(e_b, 0), 0) FROM fy
          UNION ALL SELECT first, second, slice || '/recall', mask, coalesce(c_a::DOUBLE / nullif(n_a, 0), 0), coalesce(c_b::DOUBLE / nullif(n_b, 0), 0) FROM fy),
    o AS (SELECT *, second_score - first_score AS effect FROM d WHERE mask = 0),
    t AS (SELECT first || '_vs_' || second AS pair, test, any_value(o.first_score) AS first_score, any_value(o.second_score) AS second_score, any_value(o.effect) AS effect, 2.0::DOUBLE / count(*) AS floor,
                 avg(CASE WHEN abs(d.second_score - d.first_score) >= abs(o.effect) - 1e-12 THEN 1.0::DOUBLE ELSE 0.0 END) AS p FROM d JOIN o USING (first, second, test) GROUP BY first, second, test),
    i AS (SELECT *, row_number() OVER (ORDER BY p, pair, test) AS nth, count(*) OVER () AS size FROM t),
    a AS (SELECT i.*, least(1.0, (SELECT min(b.p * b.size / b.nth) FROM i b WHERE b.nth >= i.nth)) AS p_adjusted FROM i),
    v AS (SELECT *, CASE WHEN floor > 0.05 THEN 'UNDERPOWERED' WHEN p_adjusted < 0.05 AND effect >= 0.02 THEN 'IMPROVEMENT' WHEN p_adjusted < 0.05 AND effect <= -0.02 THEN 'REGRESSION' WHEN p_adjusted < 0.05 THEN 'BELOW_THRESHOLD' ELSE 'NO_CHANGE' END AS verdict FROM a)"""


@query(_ALL_PAIRS + " SELECT pair, test, round(first_score, 6) AS first_score, round(second_score, 6) AS second_score, round(effect, 6) AS effect, round(p, 6) AS p, round(floor, 6) AS floor, round(p_adjusted, 6) AS p_adjusted, verdict FROM v")
def all_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three engines, eleven tests a pair, one family."""
    rows = feeds.prepared(spark, sf_dir, _THREE, "documents", "labels")
    good = lambda c: F.col(c) == "good"
    observed = rows.select("engine", "cluster", F.expr(_SAID).alias("code"), good("true_label").alias("needed"), good("pred_label").alias("emitted"), good("true_label").alias("correct"))
    tests = statistics.all_pairs(rows, observed, "cluster", list(_ENGINES), {n: F.expr(k) for n, k in _SLICES.items()})
    return tests.select("pair", "test", *(F.round(c, 6).alias(c) for c in ("first_score", "second_score", "effect", "p", "floor", "p_adjusted")), "verdict")


@query(f"WITH {R}, e AS (SELECT engine, sum(latency_us) AS spent, count(*) AS n FROM r GROUP BY 1) SELECT engine, round(spent / n, 6) AS us_per_field, round(spent / sum(spent) OVER (), 6) AS share FROM e")
def phase_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time a field and share of all time, an engine standing for a phase; one row a phase meets the total."""
    spent = feeds.feed_runlog(spark, sf_dir).groupBy("engine").agg(F.sum("latency_us").alias("spent"), F.count(F.lit(1)).alias("n"))
    whole = spent.agg(F.sum("spent").alias("whole"))
    return spent.join(F.broadcast(whole)).select("engine", F.round(F.col("spent") / F.col("n"), 6).alias("us_per_field"), F.round(F.try_divide("spent", "whole"), 6).alias("share"))


# ---- the corpus -------------------------------------------------------------------------------------------------

_SQL_ATTRIBUTE = lambda name, x: f"coalesce(' {name}=\"' || replace(replace({x}, '&', '&amp;'), '\"', '&quot;') || '\"', '')"
_FORMS = f"""WITH {C}, f AS (SELECT o_orderkey - o_orderkey % 8 AS form_id, count(*) AS n_fields, '<form>' || string_agg('<' || tag || CASE WHEN tag = 'input' THEN {_SQL_ATTRIBUTE('type', 'input_type')} ELSE '' END
    || {_SQL_ATTRIBUTE('name', 'name')} || {_SQL_ATTRIBUTE('placeholder', 'placeholder')} || {_SQL_ATTRIBUTE('autocomplete', 'autocomplete_raw')} || '>' || CASE WHEN tag <> 'input' THEN '</' || tag || '>' ELSE '' END, chr(10) ORDER BY document_index) || '</form>' AS html FROM c GROUP BY 1)"""


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(feeds.feed_controls(spark, sf_dir)).withColumnRenamed("page_id", "form_id")


@query(_FORMS + " SELECT form_id, sha256(html) AS html_sha256, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes FROM f")
def corpus_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.digests(_forms(spark, sf_dir))


@query(_FORMS + """, a AS (SELECT form_id, form_id % 7 AS k FROM f) SELECT form_id, 'no answer key' AS problem FROM a WHERE form_id % 11 = 3 AND form_id % 13 <> 5
    UNION ALL SELECT form_id, 'not in the manifest' FROM a WHERE form_id % 13 = 5 AND form_id % 11 <> 3 UNION ALL SELECT form_id, 'no file' FROM a WHERE k = 2 AND form_id % 11 <> 3 AND form_id % 13 <> 5
    UNION ALL SELECT form_id, 'another digest' FROM a WHERE k = 4 AND form_id % 11 <> 3 AND form_id % 13 <> 5""")
def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of the rendered forms against a later state, in which some forms are gone, new, empty or edited."""
    forms, n = _forms(spark, sf_dir), F.lit(8)
    key = F.col("form_id")
    recorded = corpus.digests(forms.filter(key % 13 != 5)).select("form_id", "html_sha256", n.alias("n_fields"))
    edited = forms.filter(key % 11 != 3).withColumn("html", F.when(key % 7 == 4, F.concat("html", F.lit("<!-- edited -->"))).otherwise(F.col("html")))
    present = corpus.digests(edited).select("form_id", F.when(key % 7 != 2, F.col("html_sha256")).alias("html_sha256"), n.alias("n_fields"))
    return corpus.manifest_problems(recorded, present)


_SPLIT = """WITH f AS (SELECT c_custkey AS form_id, c_custkey % 24 AS template_id, CASE c_custkey % 5 WHEN 0 THEN 'fr-FR' ELSE 'en-US' END AS locale, CASE WHEN c_custkey % 24 < 15 THEN 'train' WHEN c_custkey % 24 < 18 THEN 'dev' WHEN c_custkey % 24 < 23 THEN 'test' END AS due FROM customer),
    a AS (SELECT *, CASE WHEN c_custkey_odd THEN 'test' WHEN template_id = 23 THEN 'dev' WHEN locale = 'fr-FR' AND due = 'train' AND form_id % 3 > 0 THEN 'excluded' ELSE due END AS partition FROM (SELECT *, form_id % 97 = 11 AS c_custkey_odd FROM f))"""


@query(_SPLIT + """ SELECT form_id::VARCHAR AS subject, 'no partition' AS problem FROM a WHERE form_id % 89 = 7
    UNION ALL SELECT form_id::VARCHAR, 'template without partition' FROM a WHERE due IS NULL AND form_id % 89 <> 7
    UNION ALL SELECT form_id::VARCHAR, 'not where its template is' FROM a WHERE form_id % 89 <> 7 AND partition <> CASE WHEN locale = 'fr-FR' AND due = 'train' THEN 'excluded' ELSE due END
    UNION ALL SELECT form_id::VARCHAR, 'held-out locale in train' FROM a WHERE form_id % 89 <> 7 AND partition = 'train' AND locale = 'fr-FR'
    UNION ALL SELECT template_id::VARCHAR, 'in several partitions' FROM a WHERE form_id % 89 <> 7 AND partition <> 'excluded' GROUP BY template_id HAVING count(DISTINCT partition) > 1""")
def split_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split of customers' forms by template, with forms that were left out, misplaced or of the held-out locale."""
    key = F.col("c_custkey")
    template = key % 24
    due = F.when(template < 15, "train").when(template < 18, "dev").when(template < 23, "test")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.alias("form_id"), template.alias("template_id"), F.when(key % 5 == 0, "fr-FR").otherwise("en-US").alias("locale"), due.alias("due"))
    held = (F.col("locale") == "fr-FR") & (F.col("due") == "train") & (F.col("form_id") % 3 > 0)
    dealt = F.when(F.col("form_id") % 97 == 11, "test").when(F.col("template_id") == 23, "dev").when(held, "excluded").otherwise(F.col("due"))
    assigned = c.filter("form_id % 89 <> 7").select("form_id", dealt.alias("partition"))
    templates = c.filter("due is not null").select("template_id", F.col("due").alias("template_partition")).distinct()
    return corpus.split_problems(c.drop("due"), assigned, templates)


_RECONCILED = f"""WITH {C}, x AS (SELECT page_id AS form_id, selector, document_index AS at, o_orderkey % 6 = 1 AS injected, o_orderkey % 17 = 4 AS gone, o_orderkey % 19 = 3 AS renamed FROM c),
    g AS (SELECT form_id, count(*) AS expected, count(*) FILTER (WHERE NOT gone) AS found, count(*) FILTER (WHERE gone OR renamed) AS missing, count(*) FILTER (WHERE renamed AND NOT gone) AS unexpected,
          count(*) FILTER (WHERE injected) AS injected_expected, count(*) FILTER (WHERE injected AND NOT gone AND NOT renamed) AS injected_found, bool_or(gone OR renamed) AS order_differs FROM x GROUP BY 1)"""


def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, key = feeds.feed_controls(spark, sf_dir), F.col("o_orderkey")
    expected = c.select(F.col("page_id").alias("form_id"), "selector", F.col("document_index").alias("ordinal"), (key % 6 == 1).alias("injected"))
    name = F.when(key % 19 == 3, F.concat("selector", F.lit("-new"))).otherwise(F.col("selector"))
    found = c.filter(key % 17 != 4).select(F.col("page_id").alias("form_id"), name.alias("selector"), F.col("document_index").alias("ordinal"))
    return corpus.reconcile(expected, found)


@query(_RECONCILED + " SELECT * FROM g")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer key against an extraction that lost some controls and renamed others."""
    return _reconciled(spark, sf_dir)


@query(_RECONCILED + """ SELECT count(*) AS forms, sum(expected)::BIGINT AS expected, sum(found)::BIGINT AS found, sum(missing)::BIGINT AS missing, sum(unexpected)::BIGINT AS unexpected, sum(injected_expected)::BIGINT AS injected_expected,
    sum(injected_found)::BIGINT AS injected_found, count(*) FILTER (WHERE order_differs) AS order_differs, count(*) FILTER (WHERE missing + unexpected > 0) AS failures FROM g""")
def sweep_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.sweep_totals(_reconciled(spark, sf_dir))


@query(f"WITH {C} SELECT true_label AS label, count(*) AS n, count(*) >= 20 AS enough FROM c WHERE page_id % 8 < 5 AND true_label IS NOT NULL GROUP BY 1")
def train_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows a label, and whether there are the 20 that a label needs."""
    n = feeds.feed_controls(spark, sf_dir).filter("page_id % 8 < 5 and true_label is not null").groupBy(F.col("true_label").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("enough", F.col("n") >= 20)


@query(f"""WITH {C} SELECT o_orderkey - o_orderkey % 8 AS form_id, document_index, 'html > form:nth-of-type(1) > ' || tag || ':nth-of-type(' || row_number() OVER (PARTITION BY page_id, tag ORDER BY document_index) || ')' AS selector FROM c""")
def form_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors of the controls of the rendered forms, which have no ids: paths."""
    found = html.controls(rendered(feeds.feed_controls(spark, sf_dir)))
    place = (F.row_number().over(Window.partitionBy("page_id").orderBy("ordinal")) - 1).alias("document_index")
    return found.select(F.col("page_id").alias("form_id"), place, "selector")


@query(f"""WITH {C}, x AS (SELECT o_orderkey - o_orderkey % 8 AS form_id, tag, coalesce(CASE WHEN tag = 'input' THEN input_type END, '') AS kind, coalesce(name, '') AS name, coalesce(placeholder, '') AS placeholder, coalesce(autocomplete_raw, '') AS raw FROM c)
    SELECT form_id, string_agg(tag || '|' || kind || '|' || name || '|' || placeholder || '|' || raw, ';' ORDER BY tag, kind, name, placeholder, raw) AS controls FROM x GROUP BY 1""")
def page_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rendered form's controls say, after the way through HTML."""
    blank = lambda x: F.coalesce(x, F.lit(""))
    parts = ("tag", "input_type", "name", "placeholder", "autocomplete_raw")
    item = F.struct(*(blank(p).alias(p) for p in parts))
    found = html.controls(rendered(feeds.feed_controls(spark, sf_dir)))
    own = found.groupBy(F.col("page_id").alias("form_id")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return own.select("form_id", F.array_join(F.transform("items", lambda x: F.concat_ws("|", *(x[p] for p in parts))), ";").alias("controls"))


# ---- features and reports ---------------------------------------------------------------------------------------

_BOUNDS = {"maxlength": (1, 3, 5, 9, 17, 33, 65), "document_index": (1, 2, 3, 5, 8, 12, 20)}
_BUCKET = {
    "maxlength": "CASE WHEN maxlength IS NULL THEN NULL WHEN maxlength < 1 THEN '0' WHEN maxlength <= 2 THEN '1to2' WHEN maxlength <= 4 THEN '3to4' WHEN maxlength <= 8 THEN '5to8' WHEN maxlength <= 16 THEN '9to16' WHEN maxlength <= 32 THEN '17to32' WHEN maxlength <= 64 THEN '33to64' ELSE '65plus' END",
    "document_index": "CASE WHEN document_index < 3 THEN document_index::VARCHAR WHEN document_index < 5 THEN '3to4' WHEN document_index < 8 THEN '5to7' ELSE '8to11' END",
}


@query(f"WITH {C} SELECT {_BUCKET['maxlength']} AS maxlength_bucket, {_BUCKET['document_index']} AS position_bucket, count(*) AS n FROM c GROUP BY 1, 2")
def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = [T.bucket(F.col(c), _BOUNDS[c]).alias(n) for c, n in (("maxlength", "maxlength_bucket"), ("document_index", "position_bucket"))]
    return feeds.feed_controls(spark, sf_dir).groupBy(*named).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_FOUND}, x AS (SELECT page_id, severity, severity_rank, document_index, code, '  ' || upper(severity) || ' ' || code || ' ' || selector AS line FROM found)
    SELECT page_id, 'Page ' || page_id || chr(10) || string_agg(line, chr(10) ORDER BY severity_rank, document_index, code) || chr(10) || count(*) FILTER (WHERE severity = 'critical') || ' critical, ' || count(*) FILTER (WHERE severity = 'warning') || ' warning, '
    || count(*) FILTER (WHERE severity = 'info') || ' info, ' || count(*) FILTER (WHERE severity = 'note') || ' note' AS report FROM x GROUP BY 1""")
def terminal_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's findings as text, the worst first, with the counts below."""
    line = F.concat(F.lit("  "), F.upper("severity"), F.lit(" "), "code", F.lit(" "), "selector")
    item = F.struct("severity_rank", "document_index", "code", line.alias("line"))
    page = _findings(spark, sf_dir).groupBy("page_id").agg(F.sort_array(F.collect_list(item)).alias("items"), *(F.count_if(F.col("severity") == s).alias(s) for s in dims.SEVERITIES))
    counts = F.array_join(F.array(*(F.concat(F.col(s).cast("string"), F.lit(f" {s}")) for s in dims.SEVERITIES)), ", ")
    head = F.concat(F.lit("Page "), F.col("page_id").cast("string"))
    return page.select("page_id", F.concat_ws("\n", head, F.array_join(F.transform("items", lambda x: x["line"]), "\n"), counts).alias("report"))


@query(f"WITH {_FOUND}, x AS (SELECT page_id, selector, label FROM p WHERE {_TRAP} AND undetectable_reason IS NULL) SELECT page_id, count(*) AS traps, count(*) FILTER (WHERE label NOT IN ('UNKNOWN', 'NOT_AUTOFILLABLE')) AS traps_that_read_as_data FROM x GROUP BY 1")
def honeypots_on_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden controls, classified like visible ones when they are asked for."""
    hidden = F.greatest(*(F.coalesce(c, F.lit(False)) for c in ("style_hidden", "zero_size", "offscreen")))
    traps = _predicted(spark, sf_dir).filter(hidden & F.col("undetectable_reason").isNull())
    return traps.groupBy("page_id").agg(F.count(F.lit(1)).alias("traps"), F.count_if(~F.col("label").isin("UNKNOWN", "NOT_AUTOFILLABLE")).alias("traps_that_read_as_data"))


_HTML = lambda x: f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_REPORT_FIX = f"""fix(code, said) AS {dims.values_sql(list(dims.FIXES.items()), "x(code, said)").replace("(VALUES", "(SELECT * FROM (VALUES") + ")"}"""
_REPORT_SAID = f"""replace(replace(replace(replace(said, '{{wanted}}', CASE WHEN confidence >= 0.7 THEN coalesce(declared_as, '{dims.OPEN}') ELSE '{dims.OPEN}' END),
                  '{{declared}}', coalesce(token, '')), '{{raw}}', coalesce(autocomplete_raw, '')), '{{selector}}', selector)"""


@query(f"""WITH {_FOUND}, {_REPORT_FIX}, x AS (SELECT page_id, severity, severity_rank, document_index, found.code, '<li class="' || severity || '"><code>' || {_HTML("selector")} || '</code> ' || found.code || ': ' || {_HTML(_REPORT_SAID)} || '</li>' AS item FROM found JOIN fix ON found.code = fix.code),
    y AS (SELECT page_id, severity, severity_rank, '<section><h2>' || severity || ' (' || count(*) || ')</h2><ul>' || string_agg(item, '' ORDER BY document_index, code) || '</ul></section>' AS part FROM x GROUP BY 1, 2, 3)
    SELECT page_id, '<!doctype html><html><head><meta charset="utf-8"><title>Page ' || page_id || '</title></head><body><h1>Page ' || page_id || '</h1>' || string_agg(part, '' ORDER BY severity_rank) || '</body></html>' AS report FROM y GROUP BY 1""")
def html_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's findings as an HTML document, a section a severity, with what to do about each."""
    return report.html_report(_findings(spark, sf_dir))
