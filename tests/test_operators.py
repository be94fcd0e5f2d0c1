"""Operators on small tables of their own: branches, ties, nulls, empty tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera import dims
from tessera.functions import text as T
from tessera.operators import decide, groups, metrics, rules, statistics
from tessera.sources import html
from tessera.streaming import live

CONTROL = "page_id long, document_index int, form_key string, parent_key string, tag string, input_type string, inputmode string, name string, element_id string, label_for string, label_ancestor string, aria_label string, aria_labelledby_text string, title string, placeholder string, section_heading string, autocomplete_raw string, maxlength int, undetectable_reason string, selector string"
NAMES = [c.split()[0] for c in CONTROL.split(", ")]


def controls(spark, *rows):
    full = [tuple({"page_id": 1, "document_index": k, "tag": "input", "name": "x", "form_key": "f", "parent_key": "p", "selector": f"#s{k}", **r}.get(n) for n in NAMES) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, CONTROL)


BRANCHES = [
    (dict(label_for="E-mail", input_type="email"), ["MISSING_AUTOCOMPLETE"]),
    (dict(label_for="E-mail", input_type="email", autocomplete_raw="email"), []),
    (dict(label_for="E-mail", input_type="email", autocomplete_raw="off"), ["AUTOCOMPLETE_OFF"]),
    (dict(label_for="E-mail", input_type="email", autocomplete_raw="mailbox"), ["OFF_SPEC_TOKEN"]),
    (dict(label_for="E-mail", input_type="email", autocomplete_raw=""), ["OFF_SPEC_TOKEN"]),
    (dict(label_for="E-mail", input_type="email", autocomplete_raw="tel"), ["WRONG_AUTOCOMPLETE"]),
    (dict(label_for="E-mail", input_type="email", autocomplete_raw="photo"), []),
    (dict(label_for="Name", autocomplete_raw="given-name"), []),
    (dict(label_for="Search"), []),
    (dict(label_for="Frobnicate"), []),
    (dict(), ["UNLABELED_FIELD"]),
    (dict(label_for="City, state and zip"), ["COMPOSITE_FIELD"]),
    (dict(section_heading="Phone", label_for="Zzz"), ["LOW_CONFIDENCE", "WRONG_INPUT_TYPE"]),
    (dict(undetectable_reason="closed_shadow_root", input_type="email"), ["UNDETECTABLE_FIELD"]),
    (dict(placeholder="E-mail"), ["MISSING_AUTOCOMPLETE", "PLACEHOLDER_AS_LABEL", "WRONG_INPUT_TYPE"]),
    (dict(label_for="", title="E-mail", input_type="email"), ["MISSING_AUTOCOMPLETE"]),
    (dict(label_for="Company", name="field_7"), ["GENERIC_IDENTIFIER", "MISSING_AUTOCOMPLETE"]),
    (dict(label_for="Company", name=None), ["MISSING_AUTOCOMPLETE", "MISSING_NAME_ATTR"]),
]


def test_branches(spark):
    found = live.audit(controls(spark, *(row for row, _ in BRANCHES))).groupBy("document_index").agg(F.sort_array(F.collect_list("code")).alias("codes")).collect()
    codes = {r.document_index: list(r.codes) for r in found}
    assert [codes.get(k, []) for k in range(len(BRANCHES))] == [expected for _, expected in BRANCHES]


def test_password_alone_is_a_tie(spark):
    p = rules.predict(rules.signals(controls(spark, dict(input_type="password"), dict(input_type="password", label_for="New password")))).orderBy("document_index").collect()
    assert [(r.label, r.confidence) for r in p] == [("UNKNOWN", 0.0), ("new-password", 0.9)]


def test_empty_table(spark):
    assert live.audit(controls(spark).limit(0)).count() == 0


def test_declaration(spark):
    rows = [(None,), ("",), ("OFF",), ("section-x Shipping  postal-code",), ("email tel",), ("billing",), ("on",)]
    d = spark.createDataFrame(rows, "raw string").select(T.declaration(F.col("raw")).alias("d")).collect()
    assert [(r.d.token, r.d.modifiers, r.d.section, r.d.is_off, r.d.is_off_spec) for r in d] == [
        (None, [], None, False, False), (None, [], None, False, True), (None, [], None, True, False), ("postal-code", ["shipping"], "section-x", False, False),
        ("email", [], None, False, True), (None, ["billing"], None, False, True), (None, [], None, False, False),
    ]


def test_tokens(spark):
    cases = [("firstName", ["first", "name"]), ("ZIPCode", ["zip", "code"]), ("addr1b", ["addr", "1", "b"]), ("郵便番号zip", ["郵便番号", "zip"]), (None, []), ("__", []), ("a a", ["a", "a"])]
    rows = spark.createDataFrame([(k, raw) for k, (raw, _) in enumerate(cases)], "k int, x string").select("k", T.tokens(F.col("x")).alias("a"), T.unicode_tokens(F.col("x")).alias("b")).orderBy("k").collect()
    assert [(list(r.a), list(r.b)) for r in rows] == [(e, e) for _, e in cases]


def test_identifier_noise_goes_and_repeats_stay(spark):
    row = spark.createDataFrame([("ctl00$form_email_email",)], "x string").select(T.identifier_tokens(F.col("x"))).first()
    assert row[0] == ["email", "email"]


MONTHS, YEARS = [f"{m:02}" for m in range(1, 13)], ["2026", "2027", "2028"]


def with_options(spark, *rows):
    """Controls with signals, option values and fieldsets."""
    more = spark.createDataFrame([(k, r.get("option_values"), r.get("fieldset_key")) for k, r in enumerate(rows)], "document_index int, option_values array<string>, fieldset_key string")
    return rules.signals(controls(spark, *rows).join(more, "document_index"))


def test_expiry_pairs_are_greedy(spark):
    kinds = random.Random(4).choices(["month", "year", "city"], k=40)
    rows = [dict(tag="select", option_values={"month": MONTHS, "year": YEARS, "city": ["Ulm"]}[k]) for k in kinds]
    found = groups.expiry_pairs(with_options(spark, *rows)).filter("starts").select("document_index").collect()
    expected, k = set(), 0
    while k < len(kinds) - 1:
        if {kinds[k], kinds[k + 1]} == {"month", "year"}:
            expected.add(k)
            k += 1
        k += 1
    assert {r[0] for r in found} == expected


def test_expiry_pairs_need_a_select_and_a_common_parent(spark):
    month, text = dict(tag="select", option_values=MONTHS), dict(label_for="Expiry year")
    cases = [
        ([month, text], ["month", "year"]),
        ([text, month], ["year", "month"]),
        ([dict(label_for="Expiry month"), text], [None, None]),
        ([month, text | {"parent_key": "q"}], [None, None]),
        ([month | {"fieldset_key": "s"}, text | {"parent_key": "q", "fieldset_key": "s"}], ["month", "year"]),
        ([month, dict(undetectable_reason="closed_shadow_root"), text], ["month", None, "year"]),
        ([month, text | {"input_type": "email"}], [None, None]),
    ]
    for rows, roles in cases:
        found = groups.expiry_pairs(with_options(spark, *rows)).orderBy("document_index").collect()
        assert [r.expiry_role for r in found] == roles, rows


def test_address_runs_break_after_three_and_with_the_form(spark):
    line = dict(label_for="Address line 1")
    rows = [line] * 5 + [dict(label_for="City 1"), dict(label_for="Street")] + [line, line | {"form_key": "g"}, dict(autocomplete_raw="address-line2", form_key="g", tag="textarea"), line | {"input_type": "tel", "form_key": "g"}]
    found = groups.address_runs(rules.signals(controls(spark, *rows))).orderBy("document_index").collect()
    assert [r.address_run for r in found] == [0, 0, 0, 3, 3, None, None, None, 8, 8, None]


def test_groups_take_precedence_and_split_expiries_are_found_once(spark):
    rows = [
        dict(tag="select", option_values=MONTHS, autocomplete_raw="cc-exp-month"),
        dict(label_for="Expiry year", autocomplete_raw="cc-exp-year"),
        dict(label_for="City"),
        dict(tag="select", option_values=YEARS),
        dict(label_for="Expiry month", input_type="text"),
        dict(input_type="radio", name="plan"),
        dict(input_type="radio", name="plan"),
        dict(input_type="radio", name="plan", undetectable_reason="closed_shadow_root"),
        dict(label_for="Address line 1"),
        dict(label_for="Address line 2"),
    ]
    grouped = groups.detect_groups(with_options(spark, *rows))
    found = grouped.orderBy("document_index").collect()
    assert [r.group_id for r in found] == ["expiry-1", "expiry-1", None, "expiry-2", "expiry-2", "radio-1", "radio-1", None, "address-lines-1", "address-lines-1"]
    assert [(r.code, r.selector, r.group_id) for r in decide.split_findings(grouped).collect()] == [("SPLIT_FIELD", "#s3", "expiry-2")]
    labels = {r.document_index: r.label for r in rules.predict(grouped).collect()}
    assert labels[3] == "CC_EXP_SPLIT_YEAR" and labels[4] == "CC_EXP_SPLIT_MONTH"


def test_page_findings_and_key_mismatches(spark):
    pages = spark.createDataFrame([(1, "u", True), (2, "v", None)], "page_id long, url string, incomplete boolean")
    canvases = spark.createDataFrame([(1, "#a"), (1, "#b"), (2, "#a")], "page_id long, selector string")
    audited = spark.createDataFrame([(1, "#a")], "page_id long, selector string")
    found = decide.page_findings(pages, canvases, audited).collect()
    assert sorted((r.page_id, r.code, r.selector) for r in found) == [(1, "EXTRACTION_INCOMPLETE", "u"), (1, "UNDETECTABLE_FIELD", "#b"), (2, "UNDETECTABLE_FIELD", "#a")]
    p = rules.predict(rules.signals(controls(spark, dict(input_type="email"), dict(input_type="tel"))))
    key = spark.createDataFrame([(1, "#s0", "email"), (1, "#s1", "email"), (1, "#none", "tel")], "page_id long, selector string, expected string")
    assert [(r.selector, r.label) for r in decide.key_mismatches(p, key).collect()] == [("#s1", "tel")]


def test_metrics_against_plain_python(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.choice("abcd"), rng.random()) for _ in range(400)]
    df = spark.createDataFrame(rows, "true_label string, pred_label string, confidence double")
    got = {r.label: round(r.f1, 9) for r in metrics.label_report(df).collect()}
    for label in "abcd":
        tp = sum(t == p == label for t, p, _ in rows)
        total = sum(t == label for t, _, _ in rows) + sum(p == label for _, p, _ in rows)
        assert got[label] == round(2 * tp / total, 9)


def test_permutation_against_plain_python(spark):
    rng = random.Random(2)
    rows = [(f, f % 4, e, "x", rng.choice("xy")) for f in range(60) for e in ("a", "b")]
    df = spark.createDataFrame(rows, "form_id int, cluster int, engine string, true_label string, pred_label string")
    null = {r.mask: r.difference for r in statistics.null_distribution(df, "cluster", "a", "b").collect()}
    assert len(null) == 16
    for mask, difference in null.items():
        score = {"a": 0, "b": 0}
        for _, c, e, t, p in rows:
            swapped = {"a": "b", "b": "a"}[e] if mask >> c & 1 else e
            score[swapped] += t == p
        assert abs(difference - (score["b"] - score["a"]) / 60) < 1e-12


def test_html(spark):
    page = '<h1>Pay <b>now</b></h1><form><label for=a>Card <i>number</i></label><input id=a name=n><input type=hidden><p><select name=s><option>1</select><div role=textbox contenteditable=false></div></form><script>"<input>"</script>'
    rows = html.controls(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")).orderBy("ordinal").collect()
    assert [(r.tag, r.name, r.label_for, r.section_heading) for r in rows] == [("input", "n", "Card number", "Pay now"), ("select", "s", None, "Pay now"), ("div", None, None, "Pay now")]


def resolve(rows, selector):
    """The elements that a selector of ids, attributes and nth-of-type steps names."""
    steps = re.split(r" > | (?=\[)", selector)
    at = [r["ordinal"] for r in rows if r["tag"] == "html" and r["parent"] < 0] or [-1] if steps[0] == "html" else None
    for k, step in enumerate(steps[at is not None :]):
        if step.startswith("#"):
            at = [r["ordinal"] for r in rows if r["element_id"] == step[1:]]
        elif step.startswith("form["):
            at = [r["ordinal"] for r in rows if r["tag"] == "form" and f'form[name="{r["attributes"].get("name")}"]' == step]
        elif step.startswith("["):
            up = lambda r: {r["parent"]} | (up(rows[r["parent"]]) if r["parent"] >= 0 else set())
            at = [r["ordinal"] for r in rows if f'[name="{r["attributes"].get("name")}"]' == step and up(r) & set(at)]
        else:
            tag, nth = re.fullmatch(r"(\w+):nth-of-type\((\d+)\)", step).groups()
            at = [r["ordinal"] for r in rows if r["parent"] in at and r["tag"] == tag and r["nth"] == int(nth)]
    return at


def test_selectors_name_their_own_element():
    page = (
        "<html><body><form name=pay><p><input name=a><input name=b><input name=b></p><input id=c1><input id=dup></form><div id=box><p><select></select></p><textarea id=dup></textarea></div>"
        "<input id=x12345><form><input name=a><canvas></canvas></form><div role=textbox></div></body></html>"
    )
    rows = html.parse(page)
    selectors = {r["ordinal"]: r["selector"] for r in rows if r["selector"]}
    assert list(selectors.values()) == [
        'form[name="pay"] [name="a"]', 'form[name="pay"] > p:nth-of-type(1) > input:nth-of-type(2)', 'form[name="pay"] > p:nth-of-type(1) > input:nth-of-type(3)', "#c1",
        'form[name="pay"] > input:nth-of-type(2)', "#box > p:nth-of-type(1) > select:nth-of-type(1)", "#box > textarea:nth-of-type(1)", "html > body:nth-of-type(1) > input:nth-of-type(1)",
        "html > body:nth-of-type(1) > form:nth-of-type(2) > input:nth-of-type(1)", "html > body:nth-of-type(1) > form:nth-of-type(2) > canvas:nth-of-type(1)", "html > body:nth-of-type(1) > div:nth-of-type(2)",
    ]
    for ordinal, selector in selectors.items():
        assert resolve(rows, selector) == [ordinal], selector


def test_stream_equals_batch(spark, tmp_path):
    c = controls(spark, dict(label_for="E-mail", input_type="email"), dict(label_for="Phone"))
    c.write.parquet(str(tmp_path / "in"))
    live.audit_stream(spark, str(tmp_path / "in"), c.schema, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, live.audit(c).collect()))


def test_equivalence_is_reflexive_and_covers_splits():
    pairs = set(dims.equivalent_pairs())
    assert ("cc-exp-month", "CC_EXP_SPLIT_MONTH") in pairs and ("tel", "tel-national") in pairs and ("email", "tel") not in pairs
    assert decide.advice is not None
