"""Labels around a control and those it names by id; both were null before."""

from tessera.sources import html


def test_ancestor_and_labelledby(spark):
    page = """<p id=a>Billing <b>street</b></p><p id=b>line 1</p><label>Your <i>city</i> <input name=c></label>
        <label>Land <select name=s><option>AT</option></select></label><input name=l aria-labelledby="b a none">
        <label for=x>Other <input name=o></label><label><input name=e></label><input name=n>"""
    rows = html.controls(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()
    assert {r.name: (r.label_ancestor, r.aria_labelledby_text) for r in rows} == {
        "c": ("Your city", None), "s": ("Land", None), "l": (None, "line 1 Billing street"), "o": (None, None), "e": (None, None), "n": (None, None)
    }
