"""Queries from HTML pages to findings. The pages are written from the feed of controls: forms, fieldsets, labels of every kind,
headings, shadow roots, frames, blind spots, canvases and hidden controls; the SQL derives what must be found from the feed itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import dims
from tessera.operators import pages as page_audit
from tessera.operators import resolve
from tessera.plans import feeds
from tessera.plans.catalogue import _FOUND, _stream, query
from tessera.shared import stored
from tessera.sources import descriptors, forest

_PAIR = "page_id % 4 = 2 AND k IN (3, 4) AND halves = 2"
#: A page's controls as the page says them: what the markup cannot hold is left out of the feed's columns.
CONTROLS = f"""
    SELECT page_id, k, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INT) AS document_index, o_orderkey, reason AS undetectable_reason,
           CASE WHEN reason IS NULL THEN CASE WHEN pair THEN 'select' ELSE tag END WHEN reason = 'cross_origin_frame' THEN 'iframe' ELSE 'x-field' END AS tag,
           CASE WHEN reason IS NULL AND NOT pair AND tag = 'input' THEN coalesce(input_type, 'text') END AS input_type,
           CASE WHEN reason IS NULL AND NOT pair THEN inputmode END AS inputmode,
           CASE WHEN reason IS NOT NULL THEN NULL WHEN pair THEN CASE k WHEN 3 THEN 'mm' ELSE 'yy' END ELSE name END AS name,
           CASE WHEN reason IS NOT NULL THEN NULL WHEN pair THEN CASE k WHEN 3 THEN 'mm' ELSE 'yy' END ELSE element_id END AS element_id,
           CASE WHEN reason IS NULL AND NOT pair AND element_id IS NOT NULL THEN label_for END AS label_for,
           CASE WHEN reason IS NULL AND NOT pair THEN label_ancestor END AS label_ancestor,
           CASE WHEN reason IS NULL AND NOT pair THEN aria_label END AS aria_label,
           CASE WHEN reason IS NULL AND NOT pair THEN aria_labelledby_text END AS aria_labelledby_text,
           CASE WHEN reason IS NULL AND NOT pair THEN title END AS title,
           CASE WHEN reason IS NULL AND NOT pair THEN placeholder END AS placeholder,
           CASE WHEN reason IS NOT NULL THEN NULL WHEN pair THEN CASE k WHEN 3 THEN 'Card expiry' ELSE '010203040506070809101112' END ELSE label_ancestor END AS preceding_text,
           CASE WHEN pair THEN 'Card expiry' END AS legend,
           CASE WHEN reason IS NOT NULL THEN NULL WHEN pair THEN 'Checkout' ELSE coalesce(section_heading, 'Checkout') END AS section_heading,
           CASE WHEN NOT pair THEN section_heading END AS own_heading,
           CASE WHEN reason IS NOT NULL THEN NULL WHEN pair THEN CASE WHEN page_id % 8 = 2 THEN CASE k WHEN 3 THEN 'cc-exp-month' ELSE 'cc-exp-year' END END ELSE autocomplete_raw END AS autocomplete_raw,
           CASE WHEN reason IS NULL AND NOT pair THEN maxlength END AS maxlength,
           CASE WHEN pair THEN CASE k WHEN 3 THEN 'cc_exp_month' ELSE 'cc_exp_year' END END AS group_role,
           CASE WHEN reason IS NULL THEN form_key END AS form_key, form_key AS form_of, true_label,
           reason IS NULL AND NOT pair AND style_hidden AS style_hidden, reason IS NULL AND NOT pair AND zero_size AS zero_size, reason IS NULL AND NOT pair AND offscreen AS offscreen,
           reason IS NULL AND k = 7 AND page_id % 3 = 0 AS framed, reason IS NULL AND k = 5 AND page_id % 3 = 1 AS shadowed, pair
    FROM (SELECT *, CASE WHEN pair THEN NULL ELSE undetectable_reason END AS reason
          FROM (SELECT *, {_PAIR} AS pair FROM (SELECT *, document_index AS k, sum(CASE WHEN document_index IN (3, 4) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id) AS halves FROM ({feeds.CONTROLS}) c0) c1) c2) c3
"""
_GENERATED = f"regexp_matches(element_id, '{'[0-9]' * 4}|(^|[^0-9A-Za-z]){'[0-9a-f]' * 8}+([^0-9A-Za-z]|$)')"
#: Where each control lies: the div of its form that holds it, the uniqueness of its name, and so its selector.
_PLACED = f"""
    d AS ({CONTROLS}),
    e AS (SELECT *, count(CASE WHEN NOT shadowed AND NOT (pair AND k = 4) THEN 1 END) OVER (PARTITION BY page_id, form_of ORDER BY k) AS row_of_form,
                 CASE WHEN form_key IS NOT NULL AND name IS NOT NULL THEN count(CASE WHEN form_key IS NOT NULL THEN 1 END) OVER (PARTITION BY page_id, form_of, name) END AS same_name FROM d),
    c AS (SELECT e.*, CASE
            WHEN undetectable_reason = 'cross_origin_frame' THEN 'frame[#b' || k || ']' WHEN undetectable_reason IS NOT NULL THEN '#b' || k
            ELSE CASE WHEN framed THEN 'frame[#pay] >> ' WHEN shadowed THEN '#h5 >>> ' ELSE '' END || CASE
              WHEN element_id IS NOT NULL AND NOT {_GENERATED} THEN '#' || element_id
              WHEN form_key IS NOT NULL AND NOT shadowed AND same_name = 1 THEN 'form[name="' || form_key || '"] [name="' || name || '"]'
              ELSE CASE WHEN shadowed THEN 'div:nth-of-type(1)' WHEN form_key IS NULL THEN 'html > body:nth-of-type(1) > div:nth-of-type(1)' ELSE 'form[name="' || form_key || '"] > div:nth-of-type(' || row_of_form || ')' END
                   || ' > div:nth-of-type(1) > ' || CASE WHEN label_ancestor IS NULL THEN '' WHEN label_for IS NULL THEN 'label:nth-of-type(1) > ' ELSE 'label:nth-of-type(2) > ' END || tag || ':nth-of-type(1)' END END AS selector FROM e)"""


def written(c: DataFrame) -> DataFrame:
    """page_id, html: the controls of each page as its markup."""
    lit = F.lit
    quote = lambda x: F.replace(F.replace(F.replace(x, lit("&"), lit("&amp;")), lit('"'), lit("&quot;")), lit("<"), lit("&lt;"))
    attribute = lambda name, x: F.coalesce(F.concat(lit(f' {name}="'), quote(F.col(x) if isinstance(x, str) else x), lit('"')), lit(""))
    k = F.col("k").cast("string")
    tagged = lambda tag, text: F.coalesce(F.concat(lit(f"<{tag}>"), text, lit(f"</{tag}>")), lit(""))
    style = F.when(F.col("style_hidden"), "display: none").when(F.col("zero_size"), "width: 0; border: 0").when(F.col("offscreen"), "position: absolute; left: -9999px")
    described = F.when(F.col("aria_labelledby_text").isNotNull(), F.concat(lit("n"), k))
    months, years = ("".join(f'<option value="{v}">{v}</option>' for v in values) for values in ([f"{m:02d}" for m in range(1, 13)], range(2026, 2031)))
    inner = F.when(F.col("pair"), F.when(F.col("k") == 3, months).otherwise(years)).otherwise("")
    control = F.concat(
        lit("<"), "tag", attribute("id", "element_id"), attribute("type", F.when(F.col("input_type") != "text", F.col("input_type"))), attribute("inputmode", "inputmode"), attribute("name", "name"), attribute("aria-label", "aria_label"),
        attribute("aria-labelledby", described), attribute("title", "title"), attribute("placeholder", "placeholder"), attribute("autocomplete", "autocomplete_raw"),
        attribute("maxlength", F.col("maxlength").cast("string")), attribute("style", style), lit(">"), F.when(F.col("tag") == "input", "").otherwise(F.concat(inner, lit("</"), "tag", lit(">"))),
    )
    wrapped = F.when(F.col("label_ancestor").isNotNull(), F.concat(lit("<label>"), "label_ancestor", control, lit("</label>"))).otherwise(control)
    label = F.coalesce(F.concat(lit('<label for="'), quote(F.col("element_id")), lit('">'), "label_for", lit("</label>")), lit(""))
    named = F.coalesce(F.concat(lit('<span id="n'), k, lit('">'), "aria_labelledby_text", lit("</span>")), lit(""))
    row = F.concat(lit("<div>"), tagged("h3", F.col("own_heading")), lit("<div>"), label, wrapped, lit("</div>"), named, lit("</div>"))
    blind = F.when(F.col("undetectable_reason") == "cross_origin_frame", F.concat(lit('<iframe id="b'), k, lit('" src="https://pay.example/"></iframe>'))).otherwise(F.concat(lit('<x-field id="b'), k, lit('" name="card"></x-field>')))
    half = F.when(F.col("k") == 3, F.concat(lit("<div><fieldset><legend>Card expiry</legend>"), control)).otherwise(F.concat(control, lit("</fieldset></div>")))
    part = (
        F.when(F.col("undetectable_reason").isNotNull(), F.concat(lit("<div>"), blind, lit("</div>")))
        .when(F.col("pair"), half)
        .when(F.col("framed"), F.concat(lit('<iframe id="pay" srcdoc="'), quote(row), lit('"></iframe>')))
        .when(F.col("shadowed"), F.concat(lit('<x-host id="h5"><template shadowrootmode="open">'), row, lit("</template></x-host>")))
        .otherwise(row)
    )
    own = c.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("k", part.alias("part"), "framed"))).alias("parts"))

    def form(name: str | None, keep) -> Column:
        parts = F.array_join(F.transform(F.filter("parts", keep), lambda x: x["part"]), "\n")
        return parts if name is None else F.when(parts != "", F.concat(lit(f'<form name="{name}">'), parts, lit("</form>"))).otherwise("")

    canvas = F.when(F.col("page_id") % 5 == 0, '<canvas id="sign" width="400" height="100"></canvas><canvas width="20" height="20"></canvas>').otherwise("")
    html = F.concat(
        lit("<!doctype html><html><head><title>Checkout</title></head><body><h1>Checkout</h1>"),
        form("e1", lambda x: x["k"] < 5), form("e2", lambda x: x["k"].isin(5, 6)), form(None, lambda x: (x["k"] == 7) & ~x["framed"]), canvas, form(None, lambda x: x["framed"]), lit("</body></html>"),
    )
    return own.select("page_id", html.alias("html"))


def feed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(feeds.by_page(spark, sf_dir, CONTROLS, dealt=True))


@query(f"""WITH {_PLACED} SELECT page_id, document_index, selector, tag, undetectable_reason, label_for, label_ancestor, aria_labelledby_text, placeholder, nullif(preceding_text, '') AS preceding_text, legend, section_heading,
           CASE WHEN framed THEN 'frame[#pay]' ELSE '' END AS frames, CASE WHEN shadowed THEN '#h5' ELSE '' END AS hosts, coalesce(style_hidden OR zero_size OR offscreen, false) AS hidden
           FROM c UNION ALL SELECT page_id, CAST(count(*) AS INT), '#sign', 'canvas', 'canvas_region', NULL, NULL, NULL, NULL, NULL, NULL, NULL, '', '', false FROM c WHERE page_id % 5 = 0 GROUP BY 1""")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every control, blind spot and canvas of the pages: selectors through frames and shadow roots, texts, context, hiding."""
    hidden = F.greatest(*(F.coalesce(c, F.lit(False)) for c in ("style_hidden", "zero_size", "offscreen")))
    joined = lambda c: F.array_join(c, " ")
    return page_audit.fields(feed_pages(spark, sf_dir)).select(
        "page_id", "document_index", "selector", "tag", "undetectable_reason", "label_for", "label_ancestor", "aria_labelledby_text", "placeholder", "preceding_text", "legend", "section_heading",
        joined("frame_path").alias("frames"), joined("shadow_path").alias("hosts"), hidden.alias("hidden"),
    )


MORE = '{more}'
_GROUPED = dims.values_sql([(k, v, label, w) for k, (a, v, label, w, _) in enumerate(dims.INTRINSIC) if a == "group_role"], "role(pos, value, label, weight)")
_INTRINSIC_SQL = "m AS (SELECT selector, 1 AS tier_no, 'intrinsic' AS tier, 0.9 AS confidence, pos, label, weight FROM s JOIN"
_CONTEXT = "concat_ws(' ', preceding_text, legend, section_heading)"


def _page_sql() -> str:
    """The rules' and decisions' SQL over the pages' controls, which a page and selector tell apart."""
    sql = _FOUND.replace(f"c AS ({feeds.CONTROLS})", _PLACED.replace("AS selector FROM e)", "AS own_selector, CAST(o_orderkey AS VARCHAR) AS selector FROM e)"))
    sql = sql.replace(_stream("coalesce(section_heading, '')"), _stream(_CONTEXT))
    return sql.replace(_INTRINSIC_SQL, f"m AS (SELECT selector, 1 AS tier_no, 'intrinsic' AS tier, 0.9 AS confidence, pos, label, weight FROM s JOIN {_GROUPED} ON group_role = value UNION ALL SELECT{_INTRINSIC_SQL.split('SELECT', 1)[1]}")


_ALL_FOUND = f"""{_page_sql()},
    every_one AS (
        SELECT found.page_id, found.document_index, c.own_selector AS selector, code, severity_rank FROM found JOIN c USING (selector)
        UNION ALL SELECT page_id, min(document_index), '#mm', 'SPLIT_FIELD', {dims.SEVERITIES.index(dims.FINDINGS["SPLIT_FIELD"])} FROM c WHERE pair AND page_id % 8 <> 2 GROUP BY 1
        UNION ALL SELECT page_id, CAST(count(*) AS INT), '#sign', 'UNDETECTABLE_FIELD', {dims.SEVERITIES.index(dims.FINDINGS["UNDETECTABLE_FIELD"])} FROM c WHERE page_id % 5 = 0 GROUP BY 1
        {{more}})
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY document_index, severity_rank, code, selector) AS INT) AS finding_ordinal, selector, code FROM every_one"""


@query(f"WITH {_ALL_FOUND.replace(MORE, '')}")
def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of the pages, from HTML, in one order: controls, blind spots, canvases, split expiries."""
    return page_audit.audit_pages(feed_pages(spark, sf_dir)).select("page_id", "finding_ordinal", "selector", "code")


_MISMATCH = f"UNION ALL SELECT q.page_id, q.document_index, q.own_selector, 'KEY_MISMATCH', {dims.SEVERITIES.index(dims.FINDINGS['KEY_MISMATCH'])} FROM q WHERE q.true_label <> q.label AND NOT q.pair AND q.undetectable_reason IS NULL"


@query(f"WITH {_ALL_FOUND.replace(MORE, _MISMATCH)}")
def page_findings_with_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same list with what differs from an answer key (the feed's own wording of each control)."""
    pages = feed_pages(spark, sf_dir)
    placed = _PLACED.replace("regexp_matches", "regexp_like")
    key = feeds.prepared(spark, sf_dir, f"WITH {placed} SELECT page_id, selector, true_label AS expected FROM c WHERE true_label IS NOT NULL AND NOT pair AND undetectable_reason IS NULL", "orders")
    return page_audit.audit_pages(pages, key).select("page_id", "finding_ordinal", "selector", "code")


@query(f"""WITH {_PLACED} SELECT page_id, CAST(count(*) FILTER (WHERE undetectable_reason IS NULL) AS INT) AS controls_seen, CAST(1 + max(CASE WHEN framed THEN 1 ELSE 0 END) AS INT) AS roots, false AS truncated,
           coalesce(string_agg(selector, ' ' ORDER BY k) FILTER (WHERE undetectable_reason = 'cross_origin_frame'), '') AS unreadable FROM c GROUP BY 1""")
def page_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page's audit could not read, and how much it read."""
    notes = page_audit.page_notes(feed_pages(spark, sf_dir))
    return notes.select("page_id", "controls_seen", "roots", "truncated", F.array_join("unreadable_frames", " ").alias("unreadable"))


@query(f"""WITH {_PLACED} SELECT page_id, selector, 1::BIGINT AS n_elements, tag, CASE WHEN undetectable_reason IS NOT NULL THEN 'b' || k ELSE element_id END AS element_id FROM c
           UNION ALL SELECT page_id, '#sign', 1, 'canvas', 'sign' FROM c WHERE page_id % 5 = 0 GROUP BY 1""")
def selector_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every selector that the pages' fields got, looked up in the pages again: it names one element, the right one."""
    pages = stored(feed_pages(spark, sf_dir), "pages")  # read twice
    return resolve.resolution(forest.elements(pages), forest.nodes(pages, "page_id", "kind", "selector").filter("kind <> 'page'").select("page_id", "selector"))


_BREAKS = ("{0}", "replace({0}, '\"document_index\":', '\"document_index\":\"x\",\"was\":')", "replace({0}, '\"tag\":', '\"gat\":')", "substr({0}, 1, 40)", "replace({0}, '\"text\":', '\"text\":null,\"more\":')", "concat('[', {0}, ']')")
_BROKEN = "CASE page_id % 6 " + " ".join(f"WHEN {k} THEN {b.format('content')}" for k, b in enumerate(_BREAKS)) + " END"
_DOCUMENT = lambda index, tag, texts: f"""to_json({{'autocomplete_raw': {{keep}}autocomplete_raw END, 'css_classes': []::VARCHAR[], 'data_keys': []::VARCHAR[], 'disabled': false, 'document_index': {index}, 'element_id': {{keep}}element_id END,
    'fieldset_index': {{keep}}CASE WHEN pair THEN k - 3 END END, 'form_index': {{keep}}form_index END, 'frame_path': CASE WHEN framed AND {{here}} THEN ['frame[#pay]'] ELSE []::VARCHAR[] END, 'group_id': {{keep}}NULL::VARCHAR END, 'group_role': {{keep}}NULL::VARCHAR END,
    'input_type': {{keep}}input_type END, 'inputmode': {{keep}}inputmode END, 'maxlength': {{keep}}maxlength END, 'name': {{keep}}name END, 'option_labels': {{options}}, 'option_values': {{options}}, 'pattern': NULL::VARCHAR, 'readonly': false, 'required': false,
    'selector': CASE WHEN {{here}} THEN selector ELSE '' END, 'shadow_path': CASE WHEN shadowed AND {{here}} THEN ['#h5'] ELSE []::VARCHAR[] END, 'tag': {tag}, 'text': {texts}, 'undetectable_reason': {{keep}}undetectable_reason END}})"""  # noqa: E731
_TEXTS = lambda keep: "{" + ", ".join(f"'{n}': CASE WHEN {keep} THEN {x} END" for n, x in (("aria_describedby_text", "NULL::VARCHAR"), ("aria_label", "aria_label"), ("aria_labelledby_text", "aria_labelledby_text"), ("form_accessible_name", "NULL::VARCHAR"), ("label_ancestor", "label_ancestor"), ("label_for", "label_for"), ("legend", "legend"), ("placeholder", "placeholder"), ("preceding_text", "nullif(preceding_text, '')"), ("section_heading", "section_heading"), ("title", "title"))) + "}"
_HERE = "page_id % 6 NOT IN (3, 5)"
_LENIENT = (
    _DOCUMENT("CASE WHEN page_id % 6 IN (1, 3, 5) THEN 0 ELSE document_index END", "CASE WHEN page_id % 6 IN (2, 3, 5) THEN '' ELSE tag END", _TEXTS("page_id % 6 NOT IN (3, 4, 5)"))
    .replace("{keep}", f"CASE WHEN {_HERE} THEN ").replace("{here}", _HERE)
    .replace("{options}", f"CASE WHEN pair AND {_HERE} THEN CASE k WHEN 3 THEN [lpad(i::VARCHAR, 2, '0') FOR i IN range(1, 13)] ELSE [i::VARCHAR FOR i IN range(2026, 2031)] END ELSE []::VARCHAR[] END")
)


@query(f"""WITH {_PLACED.replace("count(CASE WHEN NOT shadowed", "CASE WHEN form_key IS NOT NULL THEN CAST(count(form_key) OVER (PARTITION BY page_id, form_of ORDER BY k) - 1 AS INT) END AS form_index, count(CASE WHEN NOT shadowed")}
    SELECT page_id, c.selector AS of, CASE page_id % 6 WHEN 1 THEN 'document_index: int expected' WHEN 2 THEN 'tag: missing' WHEN 3 THEN 'not_json' WHEN 4 THEN 'text: object expected' WHEN 5 THEN 'not_object' END AS problem,
           md5({_LENIENT}::VARCHAR) AS read_md5 FROM c WHERE undetectable_reason IS NULL""")
def descriptor_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' controls as JSON documents, some of them broken: what a strict reader says, and what a lenient one reads."""
    rows = forest.nodes(feed_pages(spark, sf_dir)).filter("kind = 'control'")
    rows = rows.withColumns({"group_id": F.lit(None).cast("string"), "group_role": F.lit(None).cast("string")}).select("page_id", F.col("selector").alias("of"), descriptors.written().alias("content"))
    read = descriptors.read(rows.withColumn("content", F.expr(_BROKEN)))
    return read.select("page_id", "of", "problem", F.md5(F.to_json("document", {"ignoreNullFields": "false"})).alias("read_md5"))
