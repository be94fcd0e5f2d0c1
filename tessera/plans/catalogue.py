"""Queries over the given tables, each with its SQL where SQL can express it.

The SQL states a result on its own terms (joins against inline tables, recursion, list functions), so
that a mistake on one side shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import dims
from tessera.functions import text as T
from tessera.operators import corpus, decide, features, groups, metrics, rules, statistics
from tessera.plans import feeds
from tessera.shared import stored
from tessera.sources import html
from tessera.streaming import live

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
C, R = f"c AS ({feeds.CONTROLS})", f"r AS ({feeds.RUNLOG})"


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


# ---- declarations, labels, tokens -------------------------------------------------------------------------------

_FIELDS = ", ".join(f"'{t}'" for t in dims.FIELD_NAMES)
_SPEC = ", ".join(f"'{t}'" for t in dims.SPEC_LABELS)
_MODS = ", ".join(f"'{t}'" for t in dims.MODIFIERS)
_WORDS = "list_filter(string_split_regex(lower(coalesce(autocomplete_raw, '')), '\\s+'), lambda t: t <> '')"
_REST = f"list_filter({_WORDS}, lambda t: NOT starts_with(t, 'section-') AND t NOT IN ({_MODS}, 'off', 'on'))"
_SWITCH = f"(list_contains({_WORDS}, 'off') OR list_contains({_WORDS}, 'on'))"
_OFF_SPEC = f"(autocomplete_raw IS NOT NULL AND CASE WHEN {_SWITCH} THEN len({_REST}) > 0 ELSE len({_REST}) <> 1 OR coalesce({_REST}[1] NOT IN ({_FIELDS}), true) END)"
_BASE = f"""
    SELECT *, {_REST}[1] AS token, list_contains({_WORDS}, 'off') AS is_off, {_OFF_SPEC} AS is_off_spec,
           CASE WHEN label_for IS NOT NULL THEN 'label_for' WHEN label_ancestor IS NOT NULL THEN 'label_ancestor' WHEN aria_label IS NOT NULL THEN 'aria_label'
                WHEN aria_labelledby_text IS NOT NULL THEN 'aria_labelledby_text' WHEN title IS NOT NULL THEN 'title' WHEN placeholder IS NOT NULL THEN 'placeholder' END AS label_source
    FROM c"""


def _stream(x: str) -> str:
    """Tokens of an ASCII text in SQL."""
    for pattern in ("([a-z])([A-Z])", "([A-Z])([A-Z][a-z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
        x = f"regexp_replace({x}, '{pattern}', '\\1 \\2', 'g')"
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def _identifier(x: str) -> str:
    noise = ", ".join(f"'{n}'" for n in dims.NOISE)
    kept = lambda t: f"array_to_string(list_filter(string_split({t}, ' '), lambda w: w <> '' AND lower(w) NOT IN ({noise})), ' ')"
    return kept(_stream(kept(f"regexp_replace(coalesce({x}, ''), '[^A-Za-z0-9]+', ' ', 'g')")))


@query(f"WITH {C} SELECT selector, token, CAST(len(list_filter({_WORDS}, lambda t: t IN ({_MODS}))) AS INT) AS n_modifiers, list_filter({_WORDS}, lambda t: starts_with(t, 'section-'))[1] AS section, is_off, is_off_spec FROM ({_BASE})")
def autocomplete_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = feeds.feed_controls(spark, sf_dir).select("selector", T.declaration(F.col("autocomplete_raw")).alias("d"))
    return d.select("selector", "d.token", F.size("d.modifiers").alias("n_modifiers"), "d.section", "d.is_off", "d.is_off_spec")


@query(f"WITH {C} SELECT label_source, count(*) AS n, count(*) FILTER (WHERE coalesce(label_for, label_ancestor, aria_label, aria_labelledby_text) IS NULL) AS n_unlabeled FROM ({_BASE}) GROUP BY 1")
def label_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = feeds.feed_controls(spark, sf_dir).withColumn("label_source", T.label_source(*rules.LABEL_SOURCES))
    return named.groupBy("label_source").agg(F.count(F.lit(1)).alias("n"), F.sum(decide.unlabeled().cast("long")).alias("n_unlabeled"))


@query(f"WITH {C} SELECT selector, {_stream('label_for')} AS label_tokens, {_stream('name')} AS name_tokens FROM c WHERE name IS NOT NULL AND label_for IS NOT NULL")
def ascii_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.feed_controls(spark, sf_dir).filter("name is not null and label_for is not null").select("selector", T.joined(F.col("label_for")).alias("label_tokens"), T.joined(F.col("name")).alias("name_tokens"))


@query(f"WITH {C} SELECT selector, {_identifier('name')} AS identifier_tokens FROM c")
def identifier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.feed_controls(spark, sf_dir).select("selector", F.array_join(T.identifier_tokens(F.col("name")), " ").alias("identifier_tokens"))


@query()
def unicode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = feeds.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select("doc_id", T.unicode_tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(f"WITH {C} SELECT name, element_id, coalesce(regexp_matches(lower(name), '^input\\d+$|^field[_-]?\\d+$|^txt\\d+$|^ctl\\d+|ctl\\d+\\$|^[0-9a-f]{{8,}}$'), false) AS generic_name, coalesce(regexp_matches(element_id, '[0-9]{{4}}|(^|[^0-9A-Za-z])[0-9a-f]{{8,}}([^0-9A-Za-z]|$)'), false) AS generated_id, count(*) AS n FROM c GROUP BY ALL")
def generic_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = feeds.feed_controls(spark, sf_dir)
    return c.select("name", "element_id", T.is_generic(F.col("name")).alias("generic_name"), T.looks_generated(F.col("element_id")).alias("generated_id")).groupBy("name", "element_id", "generic_name", "generated_id").agg(F.count(F.lit(1)).alias("n"))


# ---- rules and findings -----------------------------------------------------------------------------------------

_INTRINSIC = dims.values_sql([(k, a, v, label, w) for k, (a, v, label, w, _) in enumerate(dims.INTRINSIC) if a == "input_type"], "rule(pos, attribute, value, label, weight)")
_WORDING = dims.values_sql([(k, p, label, w) for k, p, label, w in dims.wording_rules()], "rule(pos, pattern, label, weight)")
_AGREE = dims.values_sql(dims.equivalent_pairs(), "pair(declared, inferred)")
_ADVICE = dims.values_sql([(x, d) for own in dims.LABELS.values() for x in own if (d := dims.declared_as(x))], "advice(label, declared_as)")
_FINDING = dims.values_sql([(c, s, dims.SEVERITIES.index(s)) for c, s in dims.FINDINGS.items()], "kind(code, severity, severity_rank)")
_WANTED = dims.values_sql([(k, v) for k, (_, v) in dims.WANTED_INPUT.items()], "wanted(label, value)")

_PREDICT = f"""{C},
    b AS ({_BASE}),
    s AS (SELECT *, {_stream("coalesce(label_for, label_ancestor, aria_label, aria_labelledby_text, title, placeholder, '')")} AS label_stream,
                 trim({_identifier('name')} || ' ' || {_identifier('element_id')}) AS identifier_stream, {_stream("coalesce(section_heading, '')")} AS context_stream FROM b),
    t AS (SELECT selector, 2 AS tier_no, 'label' AS tier, 0.9 AS confidence, CASE WHEN label_source = 'placeholder' THEN '' ELSE label_stream END AS stream FROM s
          UNION ALL SELECT selector, 3, 'identifier', 0.7, identifier_stream FROM s
          UNION ALL SELECT selector, 4, 'placeholder', 0.7, CASE WHEN label_source = 'placeholder' THEN label_stream ELSE '' END FROM s
          UNION ALL SELECT selector, 5, 'context', 0.4, context_stream FROM s),
    texts AS (SELECT DISTINCT stream FROM t WHERE stream <> ''),
    hits AS (SELECT stream, pos, label, weight FROM texts JOIN {_WORDING} ON regexp_matches(stream, pattern)),
    m AS (SELECT selector, 1 AS tier_no, 'intrinsic' AS tier, 0.9 AS confidence, pos, label, weight FROM s JOIN {_INTRINSIC} ON input_type = value
          UNION ALL SELECT selector, tier_no, tier, confidence, pos, label, weight FROM t JOIN hits USING (stream)),
    w AS (SELECT selector, tier_no, tier, confidence, label, max(weight) AS weight, min(pos) AS pos FROM m GROUP BY ALL),
    v AS (SELECT *, rank() OVER (PARTITION BY selector, tier_no ORDER BY weight DESC) AS place FROM w),
    u AS (SELECT selector, tier_no FROM v WHERE place = 1 GROUP BY 1, 2 HAVING count(*) = 1),
    f AS (SELECT selector, min(tier_no) AS tier_no FROM u GROUP BY 1),
    won AS (SELECT v.selector, v.tier_no, v.tier, v.confidence, v.label FROM v JOIN f USING (selector, tier_no) WHERE place = 1),
    p AS (SELECT s.*, CASE WHEN undetectable_reason IS NULL AND won.label IS NOT NULL THEN won.label ELSE 'UNKNOWN' END AS label,
                 CASE WHEN undetectable_reason IS NULL AND won.label IS NOT NULL THEN CAST(won.confidence AS DOUBLE) ELSE 0.0::DOUBLE END AS confidence,
                 CASE WHEN undetectable_reason IS NULL AND won.label IS NOT NULL THEN won.tier ELSE 'none' END AS tier FROM s LEFT JOIN won USING (selector))"""
_UNLABELED = "coalesce(label_for, label_ancestor, aria_label, aria_labelledby_text) IS NULL"
_FOUND = f"""{_PREDICT},
    q AS (SELECT p.*, declared_as, (token, p.label) IN (SELECT (declared, inferred) FROM {_AGREE}) AS agrees FROM p LEFT JOIN {_ADVICE} ON p.label = advice.label WHERE NOT (style_hidden OR zero_size OR offscreen)),
    pr AS (SELECT *, CASE
          WHEN undetectable_reason IS NOT NULL THEN 'UNDETECTABLE_FIELD'
          WHEN is_off AND label NOT IN ('UNKNOWN', 'NOT_AUTOFILLABLE') THEN 'AUTOCOMPLETE_OFF'
          WHEN is_off_spec THEN 'OFF_SPEC_TOKEN'
          WHEN token IS NOT NULL THEN CASE WHEN token IN ({_SPEC}) AND NOT agrees AND confidence >= 0.7 AND declared_as IS NOT NULL THEN 'WRONG_AUTOCOMPLETE' END
          WHEN label = 'UNKNOWN' THEN CASE WHEN {_UNLABELED} THEN 'UNLABELED_FIELD' END
          WHEN label = 'COMPOSITE_UNSPLIT' THEN CASE WHEN confidence >= 0.7 THEN 'COMPOSITE_FIELD' END
          WHEN declared_as IS NULL THEN NULL
          WHEN confidence >= 0.7 THEN 'MISSING_AUTOCOMPLETE' WHEN confidence >= 0.4 THEN 'LOW_CONFIDENCE' END AS code FROM q),
    sec AS (SELECT selector, CASE WHEN {_UNLABELED} AND label_source = 'placeholder' THEN 'PLACEHOLDER_AS_LABEL' WHEN {_UNLABELED} AND coalesce(code, '') <> 'UNLABELED_FIELD' THEN 'UNLABELED_FIELD' END AS code FROM pr WHERE undetectable_reason IS NULL
            UNION ALL SELECT selector, 'GENERIC_IDENTIFIER' FROM pr WHERE undetectable_reason IS NULL AND (regexp_matches(lower(name), '{T.GENERIC}') OR regexp_matches(lower(element_id), '{T.GENERIC}'))
            UNION ALL SELECT selector, 'WRONG_INPUT_TYPE' FROM pr JOIN {_WANTED} ON pr.label = wanted.label WHERE undetectable_reason IS NULL AND coalesce(input_type, '') <> value AND coalesce(inputmode, '') <> value
            UNION ALL SELECT selector, 'MISSING_NAME_ATTR' FROM pr WHERE undetectable_reason IS NULL AND form_key IS NOT NULL AND name IS NULL),
    found AS (SELECT pr.page_id, pr.document_index, pr.selector, pr.label, pr.token, pr.autocomplete_raw, pr.confidence, pr.declared_as, x.code, kind.severity, kind.severity_rank
              FROM (SELECT selector, code FROM pr UNION ALL SELECT selector, code FROM sec) x JOIN pr USING (selector) JOIN {_FINDING} ON x.code = kind.code)"""


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.predict(rules.signals(feeds.feed_controls(spark, sf_dir)))


def _visible_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.predict(rules.signals(rules.visible(feeds.feed_controls(spark, sf_dir))))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.findings(_visible_predicted(spark, sf_dir))


@query(f"WITH {C} SELECT selector, CASE WHEN count(*) = 1 THEN min(label) END AS label, CAST(count(*) AS INT) AS n_matches FROM c JOIN {_INTRINSIC} ON input_type = value GROUP BY 1")
def intrinsic_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = feeds.feed_controls(spark, sf_dir)
    m = rules.attribute_matches(c.columns)
    return c.select("selector", rules.verdict(m, "intrinsic")["label"].alias("label"), F.size(m).alias("n_matches")).filter("n_matches > 0")


@query(f"WITH {_PREDICT} SELECT stream, CAST(count(*) AS INT) AS n_matches, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM hits GROUP BY 1")
def vocab_tier_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rules.signals(feeds.feed_controls(spark, sf_dir))
    streams = s.select(F.explode(F.array("label_stream", "identifier_stream", "context_stream")).alias("stream")).filter("stream <> ''").distinct()
    found = streams.withColumn("m", rules.wording_matches("stream")).filter("size(m) > 0")
    return found.select("stream", F.size("m").alias("n_matches"), F.array_join(F.transform("m", lambda x: x["pos"].cast("string")), ",").alias("positions"))


@query(f"WITH {_PREDICT} SELECT selector, label, confidence, tier FROM p")
def rule_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir).select("selector", "label", "confidence", "tier")


@query(f"""WITH {_PREDICT}, lower_ones AS (SELECT v.selector, v.label, row_number() OVER (PARTITION BY v.selector ORDER BY v.weight DESC, v.pos) AS nth
           FROM v JOIN won USING (selector, tier_no) WHERE v.place > 1)
           SELECT p.label, l.label AS runner_up, count(*) AS n FROM p LEFT JOIN (SELECT * FROM lower_ones WHERE nth = 1) l ON p.selector = l.selector AND p.undetectable_reason IS NULL GROUP BY ALL""")
def rule_runner_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir).groupBy("label", "runner_up").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_FOUND} SELECT selector, label, code FROM pr WHERE code IS NOT NULL")
def primary_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visible_predicted(spark, sf_dir).withColumn("code", decide.primary(*dims.RULE_THRESHOLDS)).filter("code is not null").select("selector", "label", "code")


@query(f"WITH {_FOUND} SELECT selector, code FROM sec WHERE code IS NOT NULL")
def secondary_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _visible_predicted(spark, sf_dir).withColumn("primary", decide.primary(*dims.RULE_THRESHOLDS))
    return p.select("selector", F.explode(decide.secondary()).alias("code"))


@query(f"WITH {_FOUND} SELECT label, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM found WHERE severity = 'critical' GROUP BY 1")
def critical_findings_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).filter("severity = 'critical'").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("n_pages"))


@query(f"WITH {_FOUND} SELECT page_id, selector, code, CAST(row_number() OVER (PARTITION BY page_id ORDER BY document_index, severity_rank, code) AS INT) AS finding_ordinal FROM found")
def findings_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("page_id").orderBy("document_index", "severity_rank", "code", "fix")
    return _findings(spark, sf_dir).select("page_id", "selector", "code", F.row_number().over(order).alias("finding_ordinal"))


_FIX = f"""fix(code, said) AS {dims.values_sql(list(dims.FIXES.items()), "x(code, said)").replace("(VALUES", "(SELECT * FROM (VALUES") + ")"}"""
_SAID = f"""replace(replace(replace(replace(said, '{{wanted}}', CASE WHEN confidence >= 0.7 THEN coalesce(declared_as, '{dims.OPEN}') ELSE '{dims.OPEN}' END),
                  '{{declared}}', coalesce(token, '')), '{{raw}}', coalesce(autocomplete_raw, '')), '{{selector}}', selector)"""


@query(f"WITH {_FOUND}, {_FIX} SELECT selector, found.code, {_SAID} AS fix FROM found JOIN fix ON found.code = fix.code")
def finding_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do about each finding, in words."""
    return _findings(spark, sf_dir).select("selector", "code", "fix")


@query(f"""WITH {_FOUND}, rule(ordinal, code, sel, reason) AS (VALUES (0, 'GENERIC_IDENTIFIER', NULL, 'legacy names'), (1, 'MISSING_AUTOCOMPLETE', '#c8', 'by design'), (2, 'GENERIC_IDENTIFIER', '#c18', 'never reached'))
           SELECT page_id, found.selector, found.code, (SELECT reason FROM rule WHERE rule.code = found.code AND (sel IS NULL OR sel = found.selector) ORDER BY ordinal LIMIT 1) AS suppressed_by
           FROM found WHERE found.code IN ('GENERIC_IDENTIFIER', 'MISSING_AUTOCOMPLETE')""")
def suppressed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppressions by code and selector; the first that matches gives the reason, and the finding stays."""
    given = [("GENERIC_IDENTIFIER", None, "legacy names"), ("MISSING_AUTOCOMPLETE", "#c8", "by design"), ("GENERIC_IDENTIFIER", "#c18", "never reached")]
    found = _findings(spark, sf_dir).filter(F.col("code").isin("GENERIC_IDENTIFIER", "MISSING_AUTOCOMPLETE"))
    reason = F.lit(None).cast("string")
    for code, selector, why in reversed(given):
        reason = F.when((F.col("code") == code) & (F.lit(True) if selector is None else F.col("selector") == selector), why).otherwise(reason)
    return found.select("page_id", "selector", "code", reason.alias("suppressed_by"))


@query(f"WITH {_FOUND}, sev(severity) AS (VALUES ('critical'), ('warning'), ('info'), ('note')) SELECT severity, count(found.code) AS n FROM sev LEFT JOIN found USING (severity) GROUP BY 1")
def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _findings(spark, sf_dir).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return dims.dim_severity(spark).join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {C}, b AS ({_BASE}) SELECT page_id, count(*) FILTER (WHERE undetectable_reason IS NULL AND token IN ({_FIELDS}) AND NOT is_off_spec) AS declared, count(*) FILTER (WHERE undetectable_reason IS NULL) AS auditable FROM b GROUP BY 1")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = feeds.feed_controls(spark, sf_dir).withColumn("d", T.declaration(F.col("autocomplete_raw")))
    seen = F.col("undetectable_reason").isNull()
    good = seen & F.coalesce(F.col("d.token").isin(*dims.FIELD_NAMES), F.lit(False)) & ~F.col("d.is_off_spec")
    return c.groupBy("page_id").agg(F.count_if(good).alias("declared"), F.count_if(seen).alias("auditable"))


@query(f"WITH {_FOUND} SELECT page_id, CAST(max(CASE WHEN severity_rank <= 0 THEN 1 ELSE 0 END) AS INT) AS exit_code FROM found GROUP BY 1")
def exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).groupBy("page_id").agg(F.max(F.when(F.col("severity_rank") <= 0, 1).otherwise(0)).alias("exit_code"))


@query(f"WITH {C} SELECT page_id, count(*) FILTER (WHERE style_hidden OR zero_size OR offscreen) AS honeypots, count(*) FILTER (WHERE NOT (style_hidden OR zero_size OR offscreen)) AS visible FROM c GROUP BY 1")
def honeypot_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = F.expr("style_hidden or zero_size or offscreen")
    return feeds.feed_controls(spark, sf_dir).groupBy("page_id").agg(F.count_if(trap).alias("honeypots"), F.count_if(~trap).alias("visible"))


@query(f"WITH {C}, n AS (SELECT page_id, selector, (SELECT count(*) FROM c o WHERE o.page_id = c.page_id AND o.document_index <= c.document_index) AS nth FROM c) SELECT page_id, count(*) FILTER (WHERE nth <= 5) AS kept, max(nth) > 5 AS truncated FROM n GROUP BY 1")
def truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page limit with a small cap, so that it bites."""
    n = feeds.feed_controls(spark, sf_dir).withColumn("nth", F.row_number().over(groups.page()))
    return n.groupBy("page_id").agg(F.count_if(F.col("nth") <= 5).alias("kept"), (F.max("nth") > 5).alias("truncated"))


@query(f"WITH {C} SELECT selector, count(*) OVER (PARTITION BY page_id, form_key, name) = 1 AND name IS NOT NULL AS name_unique, CAST(count(*) OVER (PARTITION BY page_id, parent_key) - 1 AS INT) AS siblings, CAST(row_number() OVER (PARTITION BY page_id, form_key ORDER BY document_index) - 1 AS INT) AS form_ordinal FROM c")
def form_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, own = feeds.feed_controls(spark, sf_dir), F.count(F.lit(1))
    return c.select(
        "selector",
        ((own.over(Window.partitionBy("page_id", "form_key", "name")) == 1) & F.col("name").isNotNull()).alias("name_unique"),
        (own.over(Window.partitionBy("page_id", "parent_key")) - 1).cast("int").alias("siblings"),
        (F.row_number().over(Window.partitionBy("page_id", "form_key").orderBy("document_index")) - 1).alias("form_ordinal"),
    )


# ---- groups and options -----------------------------------------------------------------------------------------


def _half_sql(words: tuple[str, ...], *lists: str) -> str:
    named = f"regexp_matches(label_stream || ' ' || identifier_stream, '{'|'.join(words)}')"
    listed = ", ".join(f"'{x}'" for x in lists)
    return f"CASE WHEN tag = 'select' THEN coalesce(option_text IN ({listed}), false) ELSE tag = 'input' AND coalesce(input_type, 'text') IN ('text', 'number', 'tel') AND {named} END"


_MONTHS = ("01|02|03|04|05|06|07|08|09|10|11|12", "1|2|3|4|5|6|7|8|9|10|11|12")
_TRAP = "(style_hidden OR zero_size OR offscreen)"


def _groups_sql(kept: str = "true") -> str:
    """CTEs to ``pairs`` (selector, expiry_role, pair) and ``runs`` (selector, address_run) of the controls that are ``kept``."""
    words, ordinals = (", ".join(f"'{w}'" for w in own) for own in (dims.ADDRESS_WORDS, dims.ORDINALS))
    split = "string_split(label_stream || ' ' || identifier_stream, ' ')"
    return f"""WITH RECURSIVE {_PREDICT},
    h AS (SELECT *, {_half_sql(dims.MONTH_WORDS, *_MONTHS)} AS m, {_half_sql(dims.YEAR_WORDS, '2026|2027|2028|2029')} AS y,
                 coalesce(token IN ('address-line1', 'address-line2', 'address-line3'), false) OR tag = 'input' AND coalesce(input_type, 'text') = 'text' AND list_has_any({split}, [{words}]) AND list_has_any({split}, [{ordinals}]) AS line,
                 row_number() OVER (PARTITION BY page_id ORDER BY document_index) AS nth FROM s WHERE undetectable_reason IS NULL AND {kept}),
    e AS (SELECT a.page_id, a.nth, coalesce(a.m AND b.y, false) AS forth,
                 coalesce((a.fieldset_key = b.fieldset_key OR a.parent_key = b.parent_key) AND 'select' IN (a.tag, b.tag) AND (a.m AND b.y OR a.y AND b.m), false) AS edge
          FROM h a LEFT JOIN h b ON a.page_id = b.page_id AND b.nth = a.nth + 1),
    g AS (SELECT page_id, nth, edge AS starts, CAST(edge AS INT) AS pair, CASE WHEN line THEN 1 ELSE 0 END AS long, document_index AS head, form_key
          FROM e JOIN h USING (page_id, nth) WHERE nth = 1
          UNION ALL
          SELECT e.page_id, e.nth, e.edge AND NOT g.starts, g.pair + CAST(e.edge AND NOT g.starts AS INT),
                 CASE WHEN NOT h.line THEN 0 WHEN g.long BETWEEN 1 AND 2 AND g.form_key IS NOT DISTINCT FROM h.form_key THEN g.long + 1 ELSE 1 END,
                 CASE WHEN h.line AND g.long BETWEEN 1 AND 2 AND g.form_key IS NOT DISTINCT FROM h.form_key THEN g.head ELSE h.document_index END, h.form_key
          FROM g JOIN e ON e.page_id = g.page_id AND e.nth = g.nth + 1 JOIN h ON h.page_id = e.page_id AND h.nth = e.nth),
    pairs AS (SELECT h.selector, h.page_id, h.document_index, CASE WHEN a.starts = ea.forth AND a.starts THEN 'month' WHEN a.starts THEN 'year' WHEN eb.forth THEN 'year' ELSE 'month' END AS expiry_role, a.pair
              FROM h JOIN g a USING (page_id, nth) JOIN e ea USING (page_id, nth) LEFT JOIN g b ON b.page_id = h.page_id AND b.nth = h.nth - 1 LEFT JOIN e eb ON eb.page_id = h.page_id AND eb.nth = h.nth - 1
              WHERE a.starts OR b.starts),
    runs AS (SELECT h.selector, h.page_id, g.head AS address_run FROM h JOIN g USING (page_id, nth) WHERE g.long > 0 QUALIFY count(*) OVER (PARTITION BY h.page_id, g.head) >= 2)"""


def _kept_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.detect_groups(rules.signals(rules.visible(feeds.feed_controls(spark, sf_dir))))


@query(_groups_sql() + " SELECT selector, expiry_role, pair FROM pairs")
def expiry_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rules.signals(feeds.feed_controls(spark, sf_dir))
    return groups.expiry_pairs(s).filter("expiry_role is not null").select("selector", "expiry_role", "pair")


@query(_groups_sql() + " SELECT page_id, selector, address_run FROM runs")
def address_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rules.signals(feeds.feed_controls(spark, sf_dir))
    return groups.address_runs(s).filter("address_run is not null").select("page_id", "selector", "address_run")


_ROLES = _groups_sql(f"NOT {_TRAP}") + """,
    ch AS (SELECT selector, page_id, input_type, min(document_index) OVER (PARTITION BY page_id, form_key, input_type, name) AS head FROM h
           WHERE input_type IN ('radio', 'checkbox') AND name IS NOT NULL QUALIFY count(*) OVER (PARTITION BY page_id, form_key, input_type, name) >= 2),
    cn AS (SELECT selector, input_type, input_type || '-' || dense_rank() OVER (PARTITION BY page_id, input_type ORDER BY head) AS number FROM ch),
    rn AS (SELECT selector, 'address-lines-' || dense_rank() OVER (PARTITION BY page_id ORDER BY address_run) AS number FROM runs),
    roles AS (SELECT h.page_id, h.document_index, h.selector, h.token, coalesce('cc_exp_' || pairs.expiry_role, cn.input_type || '_member', CASE WHEN rn.number IS NOT NULL THEN 'address_line_member' END) AS group_role,
                     coalesce('expiry-' || pairs.pair, cn.number, rn.number) AS group_id
              FROM h LEFT JOIN pairs USING (selector) LEFT JOIN cn USING (selector) LEFT JOIN rn USING (selector))"""


@query(_ROLES + " SELECT selector, group_role, group_id FROM roles WHERE group_role IS NOT NULL")
def group_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All groups of a page's visible controls, each control in one at most."""
    return _kept_groups(spark, sf_dir).filter("group_role is not null").select("selector", "group_role", "group_id")


@query(_ROLES + """ SELECT selector, CASE WHEN group_role = 'cc_exp_month' THEN 'CC_EXP_SPLIT_MONTH' WHEN group_role = 'cc_exp_year' THEN 'CC_EXP_SPLIT_YEAR' ELSE p.label END AS label,
    CASE WHEN group_role LIKE 'cc_exp%' THEN 'intrinsic' ELSE p.tier END AS tier, group_role FROM roles JOIN p USING (selector) WHERE group_role IS NOT NULL""")
def grouped_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification of grouped controls; the half of an expiry counts as a statement of the control itself."""
    return rules.predict(_kept_groups(spark, sf_dir)).filter("group_role is not null").select("selector", "label", "tier", "group_role")


@query(_ROLES + """ SELECT page_id, min_by(selector, document_index) AS selector, group_id FROM roles WHERE group_role LIKE 'cc_exp%'
    GROUP BY page_id, group_id HAVING bool_or(coalesce(token, '') <> CASE group_role WHEN 'cc_exp_month' THEN 'cc-exp-month' ELSE 'cc-exp-year' END)""")
def split_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.split_findings(_kept_groups(spark, sf_dir)).select("page_id", "selector", "group_id")


@query(f"WITH {C} SELECT selector, min(document_index) OVER (PARTITION BY page_id, form_key, input_type, name) AS choice_group FROM c WHERE input_type IN ('radio', 'checkbox') AND name IS NOT NULL AND undetectable_reason IS NULL QUALIFY count(*) OVER (PARTITION BY page_id, form_key, input_type, name) >= 2")
def choice_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.choice_groups(feeds.feed_controls(spark, sf_dir)).filter("choice_group is not null").select("selector", "choice_group")


@query(f"SELECT control, kind IN (0, 1) AS is_months, (kind = 2 AND size + 1980 BETWEEN 1993 AND 2018) OR kind = 3 AS is_years FROM ({feeds.OPTIONS})")
def option_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = groups.option_lists(feeds.feed_options(spark, sf_dir))
    return o.select("control", groups.is_month_list(F.col("values")).alias("is_months"), (groups.is_year_list(F.col("values"), 1998) & ~groups.is_month_list(F.col("values"))).alias("is_years"))  # months are tried first


# ---- metrics ----------------------------------------------------------------------------------------------------

_REPORT = f"""WITH {R}, l AS (SELECT engine, true_label AS label FROM r UNION SELECT engine, pred_label FROM r),
    n AS (SELECT l.engine, l.label, count(*) FILTER (WHERE r.true_label = l.label AND r.pred_label = l.label) AS tp, count(*) FILTER (WHERE r.true_label = l.label) AS support, count(*) FILTER (WHERE r.pred_label = l.label) AS predicted
          FROM l JOIN r ON r.engine = l.engine GROUP BY 1, 2),
    f AS (SELECT *, CASE WHEN 2 * tp + (predicted - tp) + (support - tp) = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp / (predicted + support) END AS f1 FROM n)"""


@query(_REPORT + " SELECT engine, label, tp AS true_positives, support, predicted, round(f1, 6) AS f1 FROM f")
def per_label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.label_report(feeds.feed_runlog(spark, sf_dir), "engine")
    return rows.select("engine", "label", "true_positives", "support", "predicted", F.round("f1", 6).alias("f1"))


@query(_REPORT + f", a AS (SELECT engine, avg(CASE WHEN true_label = pred_label THEN 1.0::DOUBLE ELSE 0.0 END) AS micro, count(*) AS n_rows, count(DISTINCT form_id) AS n_forms, count(DISTINCT template_id) AS n_templates FROM r GROUP BY 1) SELECT engine, n_rows, n_forms, n_templates, round(avg(f1), 6) AS macro_f1, round(any_value(micro), 6) AS micro_f1, count(*) AS labels_observed FROM f JOIN a USING (engine) GROUP BY 1, 2, 3, 4")
def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = feeds.feed_runlog(spark, sf_dir)
    labels = metrics.label_report(r, "engine").groupBy("engine").agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.count(F.lit(1)).alias("labels_observed"))
    micro = F.round(F.avg((F.col("true_label") == F.col("pred_label")).cast("double")), 6).alias("micro_f1")
    return r.groupBy("engine").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("form_id").alias("n_forms"), F.count_distinct("template_id").alias("n_templates"), micro).join(labels, "engine")


def _slice_sql(key: str, name: str) -> str:
    return f"""WITH {R}, x AS (SELECT *, {key} AS cell FROM r), l AS (SELECT engine, cell, true_label AS label FROM x UNION SELECT engine, cell, pred_label FROM x),
        f AS (SELECT l.engine, l.cell, l.label, 2.0::DOUBLE * count(*) FILTER (WHERE x.true_label = l.label AND x.pred_label = l.label) / (count(*) FILTER (WHERE x.true_label = l.label) + count(*) FILTER (WHERE x.pred_label = l.label)) AS f1
              FROM l JOIN x ON x.engine = l.engine AND x.cell = l.cell GROUP BY 1, 2, 3),
        m AS (SELECT engine, cell, avg(f1) AS macro FROM f GROUP BY 1, 2),
        n AS (SELECT engine, cell, count(*) AS n, avg(CASE WHEN true_label = pred_label THEN 1.0::DOUBLE ELSE 0.0 END) AS micro FROM x GROUP BY 1, 2)
        SELECT engine, cell AS {name}, n, CASE WHEN n >= 30 THEN round(macro, 6) END AS macro_f1, CASE WHEN n >= 30 THEN round(micro, 6) END AS micro_f1, n < 30 AS suppressed FROM n JOIN m USING (engine, cell)"""


@query(_slice_sql("locale", "locale"))
def slice_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.slices(feeds.feed_runlog(spark, sf_dir), "engine", "locale")


@query(_slice_sql("locale || '/' || tier", "cell"))
def pair_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.slices(feeds.feed_runlog(spark, sf_dir).withColumn("cell", F.concat_ws("/", "locale", "tier")), "engine", "cell")


@query(f"WITH {R}, n AS (SELECT engine, locale || '/' || tier AS cell, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) < 30) SELECT engine, string_agg(cell, ',' ORDER BY cell) AS cells FROM n GROUP BY 1")
def suppressed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = feeds.feed_runlog(spark, sf_dir).groupBy("engine", F.concat_ws("/", "locale", "tier").alias("cell")).count().filter(f"count < {metrics.LEAST_ROWS}")
    return n.groupBy("engine").agg(F.array_join(F.sort_array(F.collect_list("cell")), ",").alias("cells"))


@query(f"WITH {R} SELECT engine, count(*) FILTER (WHERE pred_label = 'UNKNOWN') AS abstained, round(avg(CASE WHEN pred_label = 'UNKNOWN' THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS abstention_rate, round(avg(CASE WHEN pred_label <> 'UNKNOWN' THEN CASE WHEN true_label = pred_label THEN 1.0::DOUBLE ELSE 0.0 END END), 6) AS accuracy_when_committed FROM r GROUP BY 1")
def abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    unknown, right = F.col("pred_label") == "UNKNOWN", (F.col("true_label") == F.col("pred_label")).cast("double")
    return feeds.feed_runlog(spark, sf_dir).groupBy("engine").agg(F.count_if(unknown).alias("abstained"), F.round(F.avg(unknown.cast("double")), 6).alias("abstention_rate"), F.round(F.avg(F.when(~unknown, right)), 6).alias("accuracy_when_committed"))


@query(f"WITH {R} SELECT engine, true_label, pred_label, count(*) AS n FROM r GROUP BY 1, 2, 3")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.feed_runlog(spark, sf_dir).groupBy("engine", "true_label", "pred_label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {R} SELECT true_label, pred_label, count(*) AS n FROM r WHERE true_label <> pred_label GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20")
def confusion_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = feeds.feed_runlog(spark, sf_dir).filter("true_label <> pred_label").groupBy("true_label", "pred_label").agg(F.count(F.lit(1)).alias("n"))
    return wrong.orderBy(F.desc("n"), "true_label", "pred_label").limit(20)


_BINS = f"""WITH {R}, u AS (SELECT * FROM r WHERE pred_label <> 'UNKNOWN'), e AS (SELECT DISTINCT engine FROM r), k AS (SELECT unnest(range(1, 11))::INT AS bin),
    b AS (SELECT e.engine, k.bin, count(u.engine) AS n, avg(u.confidence) AS mean_confidence, avg(CASE WHEN u.engine IS NULL THEN NULL WHEN u.true_label = u.pred_label THEN 1.0::DOUBLE ELSE 0.0 END) AS accuracy
          FROM e CROSS JOIN k LEFT JOIN u ON u.engine = e.engine AND round(u.confidence, 9) > (k.bin - 1) / 10.0 - CASE WHEN k.bin = 1 THEN 1 ELSE 0 END AND round(u.confidence, 9) <= k.bin / 10.0 GROUP BY 1, 2)"""


@query(_BINS + " SELECT engine, bin, n, round(mean_confidence, 6) AS mean_confidence, round(accuracy, 6) AS accuracy FROM b")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = metrics.calibration_bins(feeds.feed_runlog(spark, sf_dir), "engine")
    return b.select("engine", "bin", "n", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("accuracy", 6).alias("accuracy"))


@query(_BINS + " SELECT engine, round(sum(n * abs(coalesce(mean_confidence, 0) - coalesce(accuracy, 0))) / sum(n), 6) AS ece FROM b GROUP BY 1")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.expected_calibration_error(feeds.feed_runlog(spark, sf_dir), "engine")


@query(f"WITH {R} SELECT engine, round(quantile_cont(latency_us, 0.5), 6) AS p50, round(quantile_cont(latency_us, 0.95), 6) AS p95, round(quantile_cont(latency_us, 0.99), 6) AS p99 FROM r GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = metrics.exact_percentiles(feeds.feed_runlog(spark, sf_dir), "latency_us", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, "engine")
    return p.select("engine", *(F.round(n, 6).alias(n) for n in ("p50", "p95", "p99")))


@query(f"WITH {R} SELECT a.form_id, a.pred_label AS first_label, b.pred_label AS second_label, a.form_id IS NULL OR b.form_id IS NULL AS unmatched FROM (SELECT * FROM r WHERE engine = 'rules') a FULL JOIN (SELECT * FROM r WHERE engine = 'ngram') b ON a.form_id = b.form_id WHERE a.pred_label IS DISTINCT FROM b.pred_label")
def run_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = feeds.feed_runlog(spark, sf_dir)
    a, b = (r.filter(F.col("engine") == e).select(F.col("form_id").alias(f"{e}_id"), F.col("pred_label").alias(f"{e}_label")) for e in ("rules", "ngram"))
    both = a.join(b, F.col("rules_id") == F.col("ngram_id"), "full").filter("not (rules_label <=> ngram_label)")
    return both.select(F.col("rules_id").alias("form_id"), F.col("rules_label").alias("first_label"), F.col("ngram_label").alias("second_label"), F.expr("rules_id is null or ngram_id is null").alias("unmatched"))


_T = f"""WITH {R}, x AS (SELECT engine, confidence, pred_label NOT IN ('UNKNOWN', 'other') AS eligible, true_label = 'good' AS needs, true_label = pred_label AS correct FROM r),
    c AS (SELECT DISTINCT engine, confidence AS tau FROM x WHERE eligible UNION SELECT DISTINCT engine, 0.0 FROM x UNION SELECT DISTINCT engine, 1.0 FROM x),
    q AS (SELECT c.engine, c.tau, count(*) FILTER (WHERE eligible AND confidence >= tau) AS accusations, count(*) FILTER (WHERE eligible AND confidence >= tau AND correct) AS right_ones, count(*) FILTER (WHERE needs) AS needs FROM c JOIN x ON x.engine = c.engine GROUP BY 1, 2)"""


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.feed_runlog(spark, sf_dir).select("engine", "confidence", (~F.col("pred_label").isin("UNKNOWN", "other")).alias("eligible"), (F.col("true_label") == "good").alias("needs"), (F.col("true_label") == F.col("pred_label")).alias("correct"))
    return metrics.threshold_curve(rows, "engine")


@query(_T + " SELECT engine, tau, accusations, round(CASE WHEN accusations = 0 THEN 1.0 ELSE right_ones::DOUBLE / accusations END, 6) AS precision, round(right_ones::DOUBLE / needs, 6) AS recall FROM q")
def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(spark, sf_dir).select("engine", "tau", "accusations", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(_T + """, o AS (SELECT *, right_ones::DOUBLE / accusations AS p FROM q WHERE accusations > 0), m AS (SELECT engine, max(p) AS best FROM o GROUP BY 1)
    SELECT engine, coalesce(min(tau) FILTER (WHERE p >= 0.98), min(tau) FILTER (WHERE p = best)) AS tau_high, count(*) FILTER (WHERE p >= 0.98) > 0 AS met FROM o JOIN m USING (engine) GROUP BY 1""")
def tau_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.tau_high(_curve(spark, sf_dir), "engine")


@query(_T + """, h AS (SELECT *, 0.6 AS tau_high FROM q), k AS (SELECT engine, max(right_ones) AS everything, max(CASE WHEN tau >= 0.6 THEN right_ones ELSE 0 END) AS kept, max(needs) AS needs FROM h GROUP BY 1)
    SELECT engine, CASE WHEN any_value(everything) = any_value(kept) THEN 0.6 ELSE coalesce(max(tau) FILTER (WHERE tau < 0.6 AND right_ones - kept >= 0.5 * (everything - kept)), 0.0) END::DOUBLE AS tau_low FROM h JOIN k USING (engine) GROUP BY 1""")
def tau_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower threshold below a fixed upper one of 0.6, which is an observed confidence."""
    curve = _curve(spark, sf_dir)
    kept = curve.filter("tau >= 0.6").groupBy("engine").agg(F.max("right").alias("right"), F.max("needs").alias("needs"), F.max("accusations").alias("accusations"))
    at = kept.select("engine", F.lit(0.6).alias("tau"), "accusations", "right", "needs", F.lit(0.0).alias("precision"), F.lit(0.0).alias("recall"))
    return metrics.tau_low(curve.filter("tau <> 0.6").unionByName(at), curve.select("engine").distinct().withColumn("tau_high", F.lit(0.6)), "engine")


# ---- statistics -------------------------------------------------------------------------------------------------

_NULL = f"""WITH {R}, k AS (SELECT cluster, count(*) FILTER (WHERE engine = 'rules' AND true_label = pred_label) AS a, count(*) FILTER (WHERE engine = 'ngram' AND true_label = pred_label) AS b, count(*) FILTER (WHERE engine = 'rules') AS n FROM r GROUP BY 1),
    o AS (SELECT *, row_number() OVER (ORDER BY cluster) - 1 AS bit FROM k), m AS (SELECT unnest(range(0, (SELECT 2 ** count(*) FROM k)::BIGINT)) AS mask),
    d AS (SELECT mask, sum(CASE WHEN (mask >> bit::INT) & 1 = 1 THEN a - b ELSE b - a END)::DOUBLE / sum(n) AS difference FROM m CROSS JOIN o GROUP BY 1)"""


@query(_NULL + " SELECT mask, round(difference, 9) AS difference FROM d")
def permutation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.null_distribution(feeds.feed_runlog(spark, sf_dir), "cluster", "rules", "ngram").select("mask", F.round("difference", 9).alias("difference"))


@query(_NULL + " SELECT round((SELECT difference FROM d WHERE mask = 0), 9) AS observed, round(avg(CASE WHEN abs(difference) >= abs((SELECT difference FROM d WHERE mask = 0)) - 1e-12 THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS p, round(2.0::DOUBLE / count(*), 9) AS floor FROM d")
def permutation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = statistics.p_value(statistics.null_distribution(feeds.feed_runlog(spark, sf_dir), "cluster", "rules", "ngram"))
    return p.select(*(F.round(c, 9).alias(c) for c in ("observed", "p", "floor")))


@query(f"""WITH {R}, t AS (SELECT template_id, avg(CASE WHEN true_label = pred_label THEN 0.0::DOUBLE ELSE 1.0 END) AS p FROM r GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY p, template_id) AS i, count(*) OVER () AS m FROM t)
    SELECT a.template_id, round(a.p, 9) AS p, round(least(1.0, min(b.p * b.m / b.i)), 9) AS p_adjusted FROM k a JOIN k b ON b.i >= a.i GROUP BY a.template_id, a.p""")
def bh_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjustment of one number a template (its error rate, read as a p value)."""
    t = feeds.feed_runlog(spark, sf_dir).groupBy("template_id").agg(F.avg((F.col("true_label") != F.col("pred_label")).cast("double")).alias("p"))
    return statistics.benjamini_hochberg(t, "p", "template_id").select("template_id", F.round("p", 9).alias("p"), F.round("p_adjusted", 9).alias("p_adjusted"))


# ---- features ---------------------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT p_partkey, ' ' || unnest(string_split_regex(lower(p_name), '\\s+')) || ' ' AS w FROM part), k AS (SELECT unnest([3, 4, 5]) AS n)
    SELECT gram, count(*) AS n FROM (SELECT substring(w, unnest(range(1, len(w) - n + 2))::INT, n) AS gram FROM w CROSS JOIN k WHERE len(w) >= n AND len(w) > 2) GROUP BY 1""")
def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.explode(T.char_ngrams(F.lower("p_name"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


_TERMS = """WITH w AS (SELECT p_partkey, string_split_regex(lower(p_name), '\\s+') AS w FROM part),
    g AS (SELECT p_partkey, unnest(w) AS term FROM w UNION ALL SELECT p_partkey, w[i] || ' ' || w[i + 1] FROM (SELECT p_partkey, w, unnest(range(1, len(w))) AS i FROM w)),
    d AS (SELECT term, count(DISTINCT p_partkey) AS df FROM g GROUP BY 1)"""


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", F.explode(T.word_ngrams(F.lower("p_name"))).alias("term"))


@query(_TERMS + " SELECT term, df FROM d")
def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query(_TERMS + ", v AS (SELECT term FROM d WHERE df >= 2 ORDER BY df DESC, term LIMIT 500) SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM v")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 terms of the greatest document frequency (2 at least), numbered by name."""
    df = _terms(spark, sf_dir).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter("df >= 2")
    top = df.orderBy(F.desc("df"), "term").limit(500)
    return top.select("term", (F.row_number().over(Window.orderBy("term")) - 1).cast("long").alias("idx"))


@query(_TERMS + ", c AS (SELECT p_partkey, term, count(*) AS n FROM g GROUP BY 1, 2) SELECT p_partkey, term, round(n / sqrt(sum(n * n) OVER (PARTITION BY p_partkey)), 6) AS weight FROM c")
def term_weights_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _terms(spark, sf_dir).groupBy("p_partkey", "term").agg(F.count(F.lit(1)).alias("n"))
    return c.select("p_partkey", "term", F.round(F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("p_partkey"))), 6).alias("weight"))


@query()
def lr_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear classifier over token and n-gram hashes of controls, fitted to the rule engine's sure labels on three of four pages."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, Normalizer, StringIndexerModel

    stream = F.concat_ws(" ", "label_stream", "identifier_stream", "context_stream").alias("stream")
    rows = _predicted(spark, sf_dir).select("selector", F.col("label").alias("true_label"), stream, F.expr("page_id % 4 <> 3").alias("train"))
    known = stored(rows.groupBy("stream", "true_label", "train").agg(F.count(F.lit(1)).cast("double").alias("n")), "streams")  # controls of one stream have one vector
    grams = known.select("stream").distinct().select("stream", T.char_ngrams(F.col("stream")).alias("grams"))
    hashed = Normalizer(inputCol="counts", outputCol="features").transform(HashingTF(inputCol="grams", outputCol="counts", numFeatures=4096).transform(grams)).select("stream", "features")
    train = known.filter("train and true_label <> 'UNKNOWN'")
    labels = [r[0] for r in train.groupBy("true_label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "true_label").collect()]  # one row a label
    indexer = StringIndexerModel.from_labels(labels, inputCol="true_label", outputCol="y")
    whole, squares = train.agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
    model = LogisticRegression(labelCol="y", weightCol="n", family="multinomial", regParam=features.merged_penalty(0.001, whole, squares), maxIter=30).fit(indexer.transform(train.join(hashed, "stream")))
    names = F.array(*map(F.lit, labels))
    asked = known.filter("not train").select("stream").distinct().join(hashed, "stream")
    told = stored(model.transform(asked).select("stream", names[F.col("prediction").cast("int")].alias("pred_label")), "told")
    return rows.filter("not train").join(told, "stream").select("selector", "true_label", "pred_label")


# ---- corpus -----------------------------------------------------------------------------------------------------

_GRID = f"""SELECT f.v AS family, l.v AS locale, t.v AS tier, CAST(p.p_partkey % 8 AS INT) AS template, count(*) AS n
    FROM part p CROSS JOIN {dims.values_sql([(x,) for x in dims.FAMILIES], 'f(v)')} CROSS JOIN {dims.values_sql([(x,) for x in dims.LOCALES], 'l(v)')} CROSS JOIN {dims.values_sql([(x,) for x in dims.MARKUP_TIERS], 't(v)')} GROUP BY 1, 2, 3, 4"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family x locale x tier x template cells; a part stands for a variant of the template that its key picks."""
    axis = lambda name, values: F.explode(F.array(*map(F.lit, values))).alias(name)
    templates = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy((F.col("p_partkey") % 8).cast("int").alias("template")).agg(F.count(F.lit(1)).alias("n"))
    return templates.select("*", axis("family", dims.FAMILIES)).select("*", axis("locale", dims.LOCALES)).select("*", axis("tier", dims.MARKUP_TIERS))


@query(_GRID)
def corpus_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir)


_DEALT = f"""WITH g AS ({_GRID}), t AS (SELECT family, template, CAST(row_number() OVER (PARTITION BY family ORDER BY md5('7|' || family || '|' || template), template) AS INT) AS place FROM (SELECT DISTINCT family, template FROM g)),
    d AS (SELECT *, CASE WHEN place <= 5 THEN 'train' WHEN place = 6 THEN 'dev' ELSE 'test' END AS part FROM t)"""


@query(_DEALT + " SELECT * FROM d")
def template_deal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each family's templates in a shuffled order, dealt to train, dev and test."""
    return corpus.deal_templates(_grid(spark, sf_dir))


@query(_DEALT + f" SELECT CASE WHEN part = 'train' AND locale = '{dims.HELD_OUT_LOCALE}' THEN 'excluded' ELSE part END AS part, count(*) AS cells, CAST(sum(n) AS BIGINT) AS forms FROM g JOIN d USING (family, template) GROUP BY 1")
def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _grid(spark, sf_dir).join(F.broadcast(corpus.deal_templates(_grid(spark, sf_dir)).select("family", "template", "part")), ["family", "template"])  # some rows a family
    part = F.when((F.col("part") == "train") & (F.col("locale") == dims.HELD_OUT_LOCALE), "excluded").otherwise(F.col("part"))
    return grid.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("forms"))


# ---- truth, prompts, calls --------------------------------------------------------------------------------------


@query(f"WITH {_PREDICT} SELECT selector, true_label AS expected, label FROM p WHERE true_label <> label AND NOT {_TRAP}")
def key_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible controls whose classification differs from the answer key, which is a table of its own."""
    key = feeds.feed_controls(spark, sf_dir).filter("true_label is not null").select("page_id", "selector", F.col("true_label").alias("expected"))
    return decide.key_mismatches(_visible_predicted(spark, sf_dir), key).select("selector", "expected", "label")


@query(f"WITH {_PREDICT}, a AS (SELECT label FROM {dims.values_sql([(x,) for own in dims.LABELS.values() for x in own], 'named(label)')}) SELECT a.label, count(p.selector) AS n FROM a LEFT JOIN p ON a.label = p.label GROUP BY 1")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _predicted(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return dims.dim_label(spark).select("label").join(n, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def _payload(c: DataFrame, *also: str) -> DataFrame:
    clip = lambda x: F.nullif(F.substring(F.trim(F.col(x)), 1, 40), F.lit("")).alias(x)
    return c.select("page_id", "document_index", *also, F.to_json(F.struct(clip("tag"), clip("input_type"), clip("name"), clip("element_id"), clip("label_for"), clip("placeholder"), clip("section_heading"))).alias("payload"))


_PAYLOAD = "'{' || concat_ws(',', " + ", ".join(f"""'"{c}":"' || nullif(substr(trim({c}), 1, 40), '') || '"'""" for c in ("tag", "input_type", "name", "element_id", "label_for", "placeholder", "section_heading")) + ") || '}'"


@query(f"""WITH {C}, p AS (SELECT page_id, document_index, {_PAYLOAD} AS payload, CAST(floor((row_number() OVER (PARTITION BY page_id ORDER BY document_index) - 1) / 40) AS BIGINT) AS chunk FROM c)
    SELECT page_id, chunk, string_agg(payload, chr(10) ORDER BY document_index, payload) AS prompt FROM p GROUP BY 1, 2""")
def prompt_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a language model would be asked, in chunks of at most 40 controls of a page, without declarations."""
    p = _payload(feeds.feed_controls(spark, sf_dir))
    chunk = F.floor((F.row_number().over(groups.page()) - 1) / 40)
    return p.withColumn("chunk", chunk).groupBy("page_id", "chunk").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("document_index", "payload"))), lambda x: x["payload"]), "\n").alias("prompt"))


_CLIPPED = ", ".join(f"nullif(substr(trim({c}), 1, 40), '')" for c in ("tag", "input_type", "name", "element_id", "label_for", "placeholder", "section_heading"))


@query(f"WITH {C}, b AS ({_BASE}) SELECT count(*) FILTER (WHERE autocomplete_raw <> '' AND list_contains([{_CLIPPED}], autocomplete_raw)) AS leaks, count(*) FILTER (WHERE token <> '' AND list_contains([{_CLIPPED}], token)) AS coincidences FROM b")
def declaration_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads, as text, that hold a control's declaration (leaks: none may), or its token where another attribute happens to say the same."""
    c = feeds.feed_controls(spark, sf_dir)
    p = _payload(c.select("*", T.declaration(F.col("autocomplete_raw"))["token"].alias("token")), "autocomplete_raw", "token")
    says = lambda x: F.coalesce((F.col(x) != "") & F.col("payload").contains(F.concat(F.lit(':"'), x, F.lit('"'))), F.lit(False))
    return p.agg(F.count_if(says("autocomplete_raw")).alias("leaks"), F.count_if(says("token")).alias("coincidences"))


@query("WITH t AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS follows FROM conversations) SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS calls, count(*) FILTER (WHERE role = 'user' AND follows IS DISTINCT FROM 'assistant') AS unresolved FROM t GROUP BY 1")
def call_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role")
    follows = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    asked = F.col("role") == "user"
    return t.withColumn("follows", follows).groupBy("conv_id").agg(F.count_if(asked).alias("calls"), F.count_if(asked & ~F.col("follows").eqNullSafe(F.lit("assistant"))).alias("unresolved"))


# ---- pages ------------------------------------------------------------------------------------------------------


@query("SELECT lower(tag) AS tag, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|(<(script|style)[^>]*>).*?(</(script|style)>)', '\\1', 'g'), '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages) GROUP BY 1")
def element_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = html.elements(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return e.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("n_pages"))


@query("SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a[ >]')) AS tag FROM pages) GROUP BY 1")
def links_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = html.elements(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return e.filter("tag = 'a'").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query()
def selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements under a heading with their nth-of-type step."""
    e = html.elements(spark.read.parquet(f"{sf_dir}/pages.parquet")).filter("heading is not null and not skipped")
    step = F.when(F.col("element_id").isNotNull(), F.concat(F.lit("#"), "element_id")).otherwise(F.concat("tag", F.lit(":nth-of-type("), "nth", F.lit(")")))
    return e.select("page_id", "ordinal", "heading", step.alias("step"))


def rendered(c: DataFrame) -> DataFrame:
    """page_id, html: the feed's controls as one form a page of eight."""
    quote = lambda x: F.replace(F.replace(F.col(x), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    attribute = lambda name, x: F.when(F.col(x).isNotNull(), F.concat(F.lit(f' {name}="'), quote(x), F.lit('"'))).otherwise("")
    kind = F.when(F.col("tag") == "input", F.coalesce(attribute("type", "input_type"), F.lit(""))).otherwise("")
    control = F.concat(F.lit("<"), "tag", kind, attribute("name", "name"), attribute("placeholder", "placeholder"), attribute("autocomplete", "autocomplete_raw"), F.lit(">"), F.when(F.col("tag") != "input", F.concat(F.lit("</"), "tag", F.lit(">"))).otherwise(""))
    rows = c.select((F.col("o_orderkey") - F.col("o_orderkey") % 8).alias("page_id"), "document_index", control.alias("control"))
    return rows.groupBy("page_id").agg(F.concat(F.lit("<form>"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("document_index", "control"))), lambda x: x["control"]), "\n"), F.lit("</form>")).alias("html"))


@query(f"SELECT c AS form_id, CAST(n AS BIGINT) AS n_controls FROM (SELECT o_orderkey - o_orderkey % 8 AS c, count(*) AS n FROM orders GROUP BY 1)")
def generated_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms written as HTML from the control feed and parsed again: every control must come back."""
    c = feeds.feed_controls(spark, sf_dir)
    pages = rendered(c)
    return html.controls(pages).groupBy(F.col("page_id").alias("form_id")).agg(F.count(F.lit(1)).alias("n_controls"))


@query(f"""WITH {_FOUND}, {_FIX}, x AS (SELECT page_id, severity, {{'document_index': document_index, 'severity_rank': severity_rank, 'code': found.code, 'selector': selector, 'severity': severity, 'label': label,
        'confidence': CASE WHEN found.code IN ({", ".join(f"'{k}'" for k in dims.CLASSIFIED)}) THEN confidence END, 'fix': {_SAID}}} AS item FROM found JOIN fix ON found.code = fix.code)
    SELECT page_id, CAST(to_json({{'page_id': page_id, 'findings': list(item ORDER BY item.document_index, item.severity_rank, item.code), {", ".join(f"'{k}': count(*) FILTER (WHERE severity = '{k}')" for k in dims.SEVERITIES)}}}) AS VARCHAR) AS report FROM x GROUP BY page_id""")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document a page: its findings in order and their count by severity."""
    f = _findings(spark, sf_dir)
    item = F.struct("document_index", "severity_rank", "code", "selector", "severity", "label", "confidence", "fix")
    page = f.groupBy("page_id").agg(F.sort_array(F.collect_list(item)).alias("findings"), *(F.count_if(F.col("severity") == s).alias(s) for s in dims.SEVERITIES))
    return page.select("page_id", F.to_json(F.struct("page_id", "findings", *dims.SEVERITIES), {"ignoreNullFields": "false"}).alias("report"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
    SELECT user_id, min(ts) AS started, count(*) AS n_events, max(ts) <= min(ts) + INTERVAL 6 HOUR AS settled FROM s GROUP BY user_id, n""")
def settled_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.settled_sessions(spark.read.parquet(f"{sf_dir}/events.parquet"))
