"""Pages as forests: hand-written pages with the rows that must come out."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import pages
from tessera.sources import forest


def rows(html, kind=None):
    return [r for r in forest.page_nodes("1", html) if r["kind"] != "page" and (kind is None or r["kind"] == kind)]


def one(html):
    (row,) = rows(html, "control")
    return row


def selectors(html):
    return [r["selector"] for r in sorted(rows(html), key=lambda r: r["document_index"])]


def test_frames_are_roots_after_the_page_that_holds_them():
    inner = "<form name='f'><label for='pan'>Number</label><input id='pan'></form><iframe id='deep' srcdoc='&lt;input name=x&gt;'></iframe><input id='last'>"
    html = f"<input id='a'><iframe id='pay' srcdoc=\"{inner.replace('&', '&amp;')}\"></iframe><iframe src='https://x.example/'></iframe><input id='b'>"
    assert selectors(html) == [
        "#a", "frame[html > body:nth-of-type(1) > iframe:nth-of-type(2)]", "#b", "frame[#pay] >> #pan", "frame[#pay] >> #last",
        "frame[#pay] >> frame[frame[#pay] >> #deep] >> html > body:nth-of-type(1) > input:nth-of-type(1)",
    ]
    assert [r["label_for"] for r in rows(html, "control")] == [None, None, "Number", None, None]
    page = forest.page_nodes("1", html)[-1]
    assert (page["roots"], page["controls_seen"], len(page["unreadable_frames"])) == (3, 5, 1)


def test_frames_end_at_the_depth_limit():
    html = "<input id='x'>"
    for _ in range(12):
        html = "<input id='x'><iframe id='f' srcdoc=\"" + html.replace("&", "&amp;").replace('"', "&quot;") + '"></iframe>'
    assert forest.page_nodes("1", html)[-1]["roots"] == forest.FRAME_DEPTH + 1


def test_open_shadow_roots_are_read_in_place():
    html = """<h1>Top</h1><form name="f"><input id="a"><my-field id="h"><template shadowrootmode="open"><label for="a">Inner</label><input id="a"><div><input></div>
    <x-in><template shadowrootmode="open"><input name="n"></template></x-in></template><input name="light"></my-field><input id="b"></form>"""
    assert selectors(html) == [
        "#a", "#h >>> #a", "#h >>> div:nth-of-type(1) > input:nth-of-type(1)", "#h >>> html > x-in:nth-of-type(1) >>> input:nth-of-type(1)", 'form[name="f"] [name="light"]', "#b",
    ]
    found = rows(html)
    assert [r["label_for"] for r in found] == [None, "Inner", None, None, None, None]
    assert {r["form_key"] for r in found} == {found[0]["form_key"]} and [r["form_index"] for r in found] == [0, 1, 2, 3, 4, 5]
    assert {r["section_heading"] for r in found} == {"Top"}


def test_blind_spots():
    html = """<x-icon id="i"></x-icon><x-card id="c" name="n"><template shadowrootmode="closed"><input></template></x-card><x-wrap name="w"><input id="in"></x-wrap>
    <x-tab tabindex="0" id="t"></x-tab><x-no tabindex="-1"></x-no><iframe id="f" src="data:text/html,x"></iframe><iframe></iframe><canvas id="big" width="200" height="50"></canvas><canvas width="10"></canvas>"""
    assert [(r["selector"], r.get("undetectable_reason"), r["document_index"]) for r in rows(html)] == [
        ("#c", "closed_shadow_root", 0), ("#in", None, 1), ("#t", "closed_shadow_root", 2), ("frame[#f]", "cross_origin_frame", 3), ("#big", "canvas_region", 4),
    ]


@pytest.mark.parametrize(
    "html, heading",
    [
        ("<h1>Page</h1><div><div><h3>Card</h3></div></div><input>", "Page"),  # a closed block's heading is not this one's
        ("<h1>Page</h1><section><h2>A</h2><h2>B</h2><div><input></div><h2>C</h2></section>", "B"),
        ("<section><p>x</p><input></section>", None),
        ("<h1>Page <b>two</b></h1><section><h2></h2><input></section>", ""),
    ],
)
def test_headings_by_rising_ancestors(html, heading):
    assert one(html)["section_heading"] == heading


@pytest.mark.parametrize(
    "html, text",
    [
        ("<div>Your  name <span><input></span></div>", "Your name"),
        ("<div>Above</div><div><input></div>", None),  # the block's bound
        ("<div><b>first</b> <i>near</i><input></div>", "near"),
        ("<div><label>skipped</label><script>no</script><input></div>", None),
        ("<span>far" + "<span>" * 9 + "<input>", None),  # eight rises
        ("<span>far" + "<span>" * 6 + "<input>", "far"),
        ("<p>before <x-h><template shadowrootmode='open'><input></template></x-h></p>", "before"),
        ("<div>up<div style='display: inline'><input></div></div>", "up"),
    ],
)
def test_preceding_text(html, text):
    assert one(html)["preceding_text"] == text


def test_texts_that_name():
    row = one("""<form title="T"><fieldset><legend>Pay <i>now</i></legend><label>Card <select><option>a</option></select> no</label></fieldset></form>""")
    assert (row["legend"], row["label_ancestor"], row["form_accessible_name"]) == ("Pay now", "Card no", "T")
    row = one('<form aria-labelledby="x" title="T"><h2 id="x">Named</h2><fieldset><input aria-labelledby="missing" aria-describedby="x y"></fieldset></form><p id="y">more</p>')
    assert (row["aria_labelledby_text"], row["aria_describedby_text"], row["form_accessible_name"], row["legend"]) == ("", "Named more", "Named", None)
    first, second = rows('<label for="d">D</label><input id="d"><input id="d">')
    assert (first["label_for"], second["label_for"]) == ("D", None)
    assert one('<form id="far"></form><input form="far" data-field-kind="v" data- v-model="m" class="a b">')["data_keys"] == ["field-kind"]


def test_hidden_controls():
    html = """<style>.off{position:absolute;left:-9999px} .gone{display:none} #z{width:0;height:0;border:0}</style>
    <input id="a"><div class="off"><input id="b"></div><div class="gone"><input id="c"></div><input id="z"><input id="d" style="opacity:0"><input id="e" hidden><div style="visibility:hidden"><input id="g"><input id="h" style="visibility:visible"></div>"""
    hidden = [r["element_id"] for r in rows(html) if r["style_hidden"] or r["zero_size"] or r["offscreen"]]
    assert hidden == ["b", "c", "z", "d", "e", "g"]


def test_what_html_implies():
    html = "<table><tr><td>Name<td><input></table><ul><li>a<li><input id='two'></ul><p>one<div><select><option value=1>x<option>y</select></div>"
    path, two, select = rows(html, "control")
    assert path["selector"] == "html > body:nth-of-type(1) > table:nth-of-type(1) > tbody:nth-of-type(1) > tr:nth-of-type(1) > td:nth-of-type(2) > input:nth-of-type(1)"
    assert two["preceding_text"] is None and select["option_values"] == ["1", "y"] and select["preceding_text"] is None


def test_limits():
    many = "<select>" + "".join(f"<option>{k}" for k in range(40)) + "</select>"
    assert (len(one(many)["option_values"]), one(many)["option_count"]) == (forest.MOST_OPTIONS, 40)
    page = forest.page_nodes("1", "<input>" * (forest.MOST_CONTROLS + 3))[-1]
    assert page["truncated"] and page["controls_seen"] == forest.MOST_CONTROLS + 1


@pytest.mark.parametrize("html", [None, "", "text only", "<", "<input", "</div></p>", "<!-- x", "<template><input></template>", "<svg><input></svg>", "\x00<b>", "<iframe srcdoc>"])
def test_pages_without_controls(html):
    assert rows(html) == [] and forest.page_nodes(None, html)[-1]["truncated"] is False


def test_audit_of_pages(spark):
    html = """<h1>Pay</h1><form name="f"><div><label for="e">E-mail address</label><input id="e" name="e"></div>
    <div><select name="mm">{m}</select><select name="yy">{y}</select></div><x-card name="n" id="c"></x-card><input name="trap" style="display:none"></form><canvas id="s" width="300" height="100"></canvas>""".format(
        m="".join(f"<option>{m:02d}" for m in range(1, 13)), y="".join(f"<option>{y}" for y in range(2026, 2032))
    )
    table = spark.createDataFrame([(1, html, "clash"), (2, None, "x"), (None, "<input name='email'>", "y")], "page_id long, html string, code string")
    key = spark.createDataFrame([(1, "#e", "tel"), (1, "#e2", "tel")], "page_id long, selector string, expected string")
    got = [(r.page_id, r.finding_ordinal, r.selector, r.code) for r in pages.audit_pages(table, key).orderBy("page_id", "finding_ordinal").collect()]
    assert got == [
        (None, 1, "html > body:nth-of-type(1) > input:nth-of-type(1)", "MISSING_AUTOCOMPLETE"), (None, 2, "html > body:nth-of-type(1) > input:nth-of-type(1)", "UNLABELED_FIELD"),
        (None, 3, "html > body:nth-of-type(1) > input:nth-of-type(1)", "WRONG_INPUT_TYPE"),
        (1, 1, "#e", "MISSING_AUTOCOMPLETE"), (1, 2, "#e", "WRONG_INPUT_TYPE"), (1, 3, "#e", "KEY_MISMATCH"),
        (1, 4, 'form[name="f"] [name="mm"]', "MISSING_AUTOCOMPLETE"), (1, 5, 'form[name="f"] [name="mm"]', "SPLIT_FIELD"), (1, 6, 'form[name="f"] [name="mm"]', "UNLABELED_FIELD"),
        (1, 7, 'form[name="f"] [name="yy"]', "MISSING_AUTOCOMPLETE"), (1, 8, 'form[name="f"] [name="yy"]', "UNLABELED_FIELD"),
        (1, 9, "#c", "UNDETECTABLE_FIELD"), (1, 10, "#s", "UNDETECTABLE_FIELD"),
    ]
    asked = pages.audit_pages(table, honeypots=True).filter(F.col("selector").contains("trap")).count()
    assert asked > 0
    notes = {r.page_id: (r.controls_seen, r.roots) for r in pages.page_notes(table).collect()}
    assert notes == {1: (4, 1), 2: (0, 1), None: (1, 1)}


def test_months_by_what_is_shown(spark):
    months = "".join(f"<option value='m{m}'>{m:02d}" for m in range(1, 13))
    html = f"<div><select id='a'>{months}</select><input id='b' name='expiry-year'></div>"
    rows = pages.fields(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert [r.group_role for r in rows.orderBy("document_index").collect()] == ["cc_exp_month", "cc_exp_year"]


def test_html_report_escapes(spark):
    from tessera.operators import report

    row = (1, 0, "warning", 1, 'a[x="1"]', "UNLABELED_FIELD", "say <b> & \"more\"")
    found = spark.createDataFrame([row], "page_id long, document_index int, severity string, severity_rank int, selector string, code string, fix string")
    text = report.html_report(found).first().report
    assert "a[x=&quot;1&quot;]" in text and "&lt;b&gt; &amp; &quot;more&quot;" in text and "<h2>warning (1)</h2>" in text
