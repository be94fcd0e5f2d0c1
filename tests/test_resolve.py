"""Selectors looked up in their pages, by hand and against every generated one."""

from pyspark.sql import functions as F

from tessera.operators import resolve
from tessera.sources import forest

HTML = """<body><form name="f"><div><input name="a"><p><input name="a" id="x"></p></div><div><section><input></section><input></div></form><div id="d"><span><input></span><b><span><input></span></b></div>
<x-h id="h"><template shadowrootmode="open"><input id="x"><div><input></div></template></x-h><iframe id="pay" srcdoc="<input id='x'><form name='f'><input name='q'></form>"></iframe><iframe id="blind" src="https://x.example/"></iframe></body>"""
WANTED = {
    "#x": 1, "#h >>> #x": 1, "frame[#pay] >> #x": 1, 'form[name="f"] [name="a"]': 2, 'frame[#pay] >> form[name="f"] [name="q"]': 1, 'form[name="f"] > div:nth-of-type(2) > input:nth-of-type(1)': 1,
    'form[name="f"] input': 4, "#d span > input": 2, "#d > span > input": 1, "html > body:nth-of-type(1) > div:nth-of-type(1) > b:nth-of-type(1)": 1, "#h >>> div:nth-of-type(1) > input:nth-of-type(1)": 1,
    "#none": 0, "body > input": 0, "#d div": 0, "frame[#none] >> #x": 0, "frame[#blind]": 1,
}


def test_selectors_by_hand(spark):
    pages = spark.createDataFrame([(1, HTML, "clash"), (2, None, "clash")], "page_id long, html string, root string")
    asked = spark.createDataFrame([(1, s, "x") for s in WANTED] + [(2, "#x", "x"), (1, "#x", "x")], "page_id long, selector string, key string")
    got = {(r.page_id, r.selector): r.n_elements for r in resolve.resolution(forest.elements(pages), asked).collect()}
    assert got == {(1, s): n for s, n in WANTED.items()} | {(2, "#x"): 0}


def test_generated_selectors_name_their_control(spark):
    nested = "<form><table><tr><td><input><td><input id='a1b2c3d4e5'></table><x-o><template shadowrootmode='open'><p><input name=z></p><x-i id=i><template shadowrootmode='open'><input></template></x-i></template></x-o></form>"
    html = nested + "<iframe srcdoc=\"" + (nested + "<iframe id='deep' srcdoc='&lt;input&gt;'></iframe>").replace("&", "&amp;").replace('"', "&quot;") + '"></iframe>'
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    fields = forest.nodes(pages).filter("kind = 'control'")
    got = resolve.resolution(forest.elements(pages), fields)
    assert fields.count() == 9 and got.filter((F.col("n_elements") == 1) & (F.col("tag") == "input")).count() == 9
