"""Controls as documents: canonical, read strictly and with defaults."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import descriptors, forest

PAGE = "<form name='f'><label for='a'>A \"b\" é</label><input id='a' name='n' class='x y' data-k='1' required maxlength='3'><select name='s'><option>1</select></form>"


@pytest.fixture(scope="module")
def documents(spark):
    nodes = forest.nodes(spark.createDataFrame([(1, PAGE)], "page_id long, html string")).filter("kind = 'control'")
    return nodes.withColumns({"group_id": F.lit(None).cast("string"), "group_role": F.lit("none")}).select("document_index", descriptors.written().alias("content"))


def test_canonical_and_round_trip(documents):
    for r in documents.collect():
        assert r.content == json.dumps(json.loads(r.content), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    read = descriptors.read(documents).select("problem", "content", F.to_json("document", {"ignoreNullFields": "false"}).alias("again")).collect()
    assert len(read) == 2 and all(r.problem is None and r.again == r.content for r in read)
    assert json.loads(read[0].content)["text"]["label_for"] == 'A "b" é'


MEMBERS = {"a": "int", "b": "string?", "c": "strings", "d": {"e": "bool", "f": "int?"}}


@pytest.mark.parametrize(
    "content, problem, document",
    [
        ('{"a":1,"b":null,"c":["x"],"d":{"e":true,"f":2}}', None, (1, None, ["x"], (True, 2))), ('{"b":"x","c":[],"d":{"e":true,"f":null}}', "a: missing", (0, "x", [], (True, None))),
        ('{"a":"1","b":2,"c":[1],"d":{"e":0,"f":"x"}}', "a: int expected", (0, None, [], (False, None))), ('{"a":1,"b":"","c":["x",1],"d":{"e":true,"f":2}}', "c: strings expected", (1, "", [], (True, 2))),
        ('{"a":1,"b":"","c":[],"d":3}', "d: object expected", (1, "", [], (False, None))), ('{"a":1,"b":"","c":[],"d":{"e":true}}', "d.f: missing", (1, "", [], (True, None))),
        ('{"a":1,"b":"","c":[],"d":{"e":true,"f":1,"g":1}}', "d.g: unknown", (1, "", [], (True, 1))), ('{"a":1,"b":"","c":[],"d":{"e":true,"f":1},"z":1,"y":2}', "y: unknown", (1, "", [], (True, 1))),
        ("", "not_json", (0, None, [], (False, None))), (None, "not_json", (0, None, [], (False, None))), ("[1]", "not_object", (0, None, [], (False, None))), ("null", "not_object", (0, None, [], (False, None))),
    ],
)
def test_readers(spark, content, problem, document):
    row = descriptors.read(spark.createDataFrame([(content, 1)], "content string, document int"), MEMBERS).first()
    assert row.problem == problem and (row.document.a, row.document.b, row.document.c, (row.document.d.e, row.document.d.f)) == document
    strict = descriptors.refused(descriptors.read(spark.createDataFrame([(content,)], "content string"), MEMBERS))
    if problem:
        with pytest.raises(Exception, match=problem.split(":")[0]):
            strict.collect()
    else:
        assert strict.count() == 1
