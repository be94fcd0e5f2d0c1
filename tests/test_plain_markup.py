"""Plainly written markup is read without the tolerant parser, to the same tree; places among siblings are counted once."""

import time

import pytest
from pyspark.sql import functions as F

from tessera.sources import forest


def told(e):
    return (e.tag, e.at, [n if isinstance(n, str) else told(n) for n in e.nodes], e.shadow and told(e.shadow), e.closed)


def both(html):
    plain, tolerant = forest._Parser(), forest._Parser()
    read = forest._plain(html, plain)
    tolerant.feed(html)
    tolerant.close()
    return read, told(plain.root), told(tolerant.root)


@pytest.mark.parametrize(
    "html",
    [
        "<!DOCTYPE html><html><body class=\"a\n b\"><p>x &amp; y<p>z &copy; &notit; 2 > 1</BODY></html> ", "<input required NAME=\"A\" name=\"b\" data-x value=\"a&gt;b &copy=1 'q'\"  >t", "text only &lt;", "",
        "<textarea name=\"t\"></textarea><title>A > b</title><iframe srcdoc=\"<p>&quot;&lt;x\"></iframe><select><option value=\"\">1<option>2</select>", "<table><tr><td>1<td>2<tr><th>3</table><ul><li>a<li>b</ul></x></p>",
    ],
)
def test_plain_markup_gives_the_same_tree(html):
    read, plain, tolerant = both(html)
    assert read and plain == tolerant


@pytest.mark.parametrize("html", ["<a href=x>", "<a b='c'>", "<br/>", "<!-- c -->", "<p", "a < b", "<textarea><b></textarea>", "<script>a && b</script>", "<title>a &amp; b</title>", "<?x?>", "</p >", "<p a=\"b\"c>", "<iframe>"])
def test_other_markup_goes_to_the_tolerant_parser(html):
    assert not both(html)[0] and told(forest.tree(html)) == both(html)[2]


def test_siblings_are_counted_once():
    def seconds(n):
        began = time.process_time()
        assert sum(1 for _ in forest.page_elements("1", "<p><i>x</i>" * n)) == 2 * n + 2
        return time.process_time() - began

    seconds(500)
    assert seconds(8000) < 10 * seconds(2000) + 0.1


def test_asked_columns_only(spark):
    html = '<form name="f"><input name="a"><input name="b" id="x"></form><iframe srcdoc="<input name=\'a\'>"></iframe><iframe src="https://x.example/"></iframe><canvas id="c"></canvas>'
    pages = spark.createDataFrame([(k, html) for k in range(40)] + [(99, None)], "page_id long, html string")
    names = ["page_id", "kind", "selector", "roots", "controls_seen"]
    few, whole = forest.nodes(pages, *names), forest.nodes(pages)
    assert sorted(few.columns) == sorted(names) and few.count() == 40 * 6 + 1
    assert few.select(names).exceptAll(whole.select(names)).isEmpty() and whole.filter(F.col("parent_key").isNotNull()).count() == 120
