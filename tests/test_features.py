"""The linear engine against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import features
from tessera.plans import model, registry


def test_option_shapes(spark):
    lists = {"months": [f"{m:02d}" for m in range(1, 13)], "months and a blank": ["", *map(str, range(1, 13))], "two more": [*map(str, range(0, 14))], "years": ["2026", "2028", "2027", "2029"], "gap": ["2026", "2027", "2029", "2030"], "few": ["2026", "2027", "2028"], "words": ["a", "b"], "none": []}
    rows = spark.createDataFrame([(k, v) for k, v in lists.items()], "k string, v array<string>")
    got = {r.k: (r.m, r.y) for r in rows.select("k", features.lists_months(F.col("v")).alias("m"), F.coalesce(features.lists_years(F.col("v")), F.lit(False)).alias("y")).collect()}
    assert [k for k, (m, _) in got.items() if m] == ["months", "months and a blank"] and [k for k, (_, y) in got.items() if y] == ["years"]


def test_features_of_a_control(spark):
    row = {"page_id": 1, "selector": "#a", "tag": "select", "label_stream": "zip", "identifier_stream": "", "context_stream": None, "maxlength": 5, "document_index": 4, "frame_path": ["f"], "required": True}
    c = spark.createDataFrame([row], "page_id long, selector string, tag string, label_stream string, identifier_stream string, context_stream string, maxlength int, document_index int, frame_path array<string>, required boolean")
    got = {r.name: r.value for r in features.features(c).collect()}
    grams = [" L:", "L:z", ":zi", "zip", "ip ", " L:z", "L:zi", ":zip", "zip ", " L:zi", "L:zip", ":zip "]
    want = {f"c:{g}": 1 / math.sqrt(len(grams)) for g in grams} | {"w:L:zip": 1.0}
    want |= dict.fromkeys(("t:tag=select", "t:type=absent", "t:inputmode=absent", "t:role=none", "t:maxlength=5to8", "t:required", "s:position=3to4", "s:siblings=0", "s:inframe"), 1.0)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_space_is_capped_by_block_and_unseen_names_are_dropped(spark):
    rows = spark.createDataFrame([(k, "s", n, 1.0) for k, names in enumerate((("c:a", "c:b", "w:x", "t:q"), ("c:a", "c:b", "c:c"), ("c:a", "c:c", "c:d", "o:z"), ("w:never",))) for n in names], "page_id long, selector string, name string, value double")
    space = features.fit_space(rows.filter("page_id < 3"), least=2, most_char=2, most_word=5)
    assert [(r.name, r.idx, r.n_controls) for r in space.orderBy("idx").collect()] == [("c:a", 0, 3), ("c:b", 1, 2), ("t:q", 2, 1), ("o:z", 3, 1)]
    matrix = {r.page_id: (r.indices, r["values"]) for r in features.design_matrix(rows, space).collect()}
    assert matrix == {0: ([0, 1, 2], [1.0] * 3), 1: ([0, 1], [1.0] * 2), 2: ([0, 3], [1.0] * 2), 3: ([], [])}


def calibrators(spark, *rows):
    return spark.createDataFrame(rows, features.CALIBRATORS)


@pytest.mark.parametrize(
    "one, raw, want",
    [
        (("a", "identity", 1, None, None, None, None), [-0.5, 0.25, 0.75, 1.5], [0.0, 0.25, 0.75, 1.0]),
        (("a", "isotonic", 120, [0.2, 0.6], [0.1, 0.9], None, None), [0.0, 0.2, 0.4, 0.6, 1.0], [0.1, 0.1, 0.5, 0.9, 0.9]),
        (("a", "isotonic", 120, [0.5, 0.5, 0.7], [0.1, 0.4, 2.0], None, None), [0.4, 0.5, 0.9], [0.1, 0.4, 1.0]),
        (("a", "sigmoid", 8, None, None, 1.0, 0.0), [0.0, 0.5, 1.0], [1e-12, 0.5, 1 - 1e-12]),
    ],
)
def test_one_calibrator(spark, one, raw, want):
    rows = spark.createDataFrame([(x,) for x in raw], "p double")
    got = rows.crossJoin(calibrators(spark, one).select(F.struct("*").alias("c"))).select(features._calibrated(F.col("p"), F.col("c")).alias("y"))
    assert [r.y for r in got.collect()] == pytest.approx(want)


def test_rows_sum_to_one_and_vanished_ones_keep_their_own(spark):
    cals = calibrators(spark, ("b", "identity", 0, None, None, None, None), ("a", "isotonic", 100, [0.0, 1.0], [0.0, 0.5], None, None))
    rows = spark.createDataFrame([([0.4, 0.6],), ([0.0, 0.0],)], "probabilities array<double>")
    got = [r.calibrated for r in features.calibrate(rows, cals, ["a", "b"]).collect()]
    assert got[0] == pytest.approx([0.2 / 0.8, 0.6 / 0.8]) and got[1] == [0.0, 0.0]


def monotone(points):
    """Pool adjacent violators on (x, y), plainly."""
    blocks = []
    for x, y in sorted(points):
        blocks.append([y, 1, [x]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            y2, n2, x2 = blocks.pop()
            y1, n1, x1 = blocks.pop()
            blocks.append([(y1 * n1 + y2 * n2) / (n1 + n2), n1 + n2, x1 + x2])
    return {x: y for y, _, xs in blocks for x in xs}


def test_fitted_calibrators(spark):
    rng = random.Random(2)
    rows = [((p := (k + 1) / 402), "a" if rng.random() < p else "b") for k in range(400)] + [(0.5001, "c"), (0.5002, "c"), (0.5003, "d")]
    scored = spark.createDataFrame([(label, [p, 1 - p, 0.1, 0.1]) for p, label in rows], "label string, probabilities array<double>")
    got = {r.label: r for r in features.fit_calibration(scored, ["a", "b", "c", "d"]).collect()}
    assert [got[x].method for x in "abcd"] == ["isotonic", "isotonic", "sigmoid", "identity"]
    want = monotone([(p, float(label == "a")) for p, label in rows])
    one = spark.createDataFrame([got["a"]], features.CALIBRATORS).select(F.struct("*").alias("c"))
    table = spark.createDataFrame([(p,) for p, _ in rows], "p double").crossJoin(one).select("p", features._calibrated(F.col("p"), F.col("c")).alias("y"))
    assert all(abs(r.y - want[r.p]) < 1e-9 for r in table.collect())


def test_sweep_takes_the_first_best_and_refuses_the_test_split(spark):
    rng = random.Random(1)
    rows = [("ab"[k % 2], "train" if k % 4 < 2 else "dev", [k % 2, 2], [1.0, rng.random()]) for k in range(60)]
    matrix = spark.createDataFrame(rows, "label string, split string, indices array<int>, values array<double>")
    got = features.sweep(matrix, 3, (1.0, 10.0), iterations=20).collect()
    assert [(r.c, r.dev_macro_f1, r.chosen) for r in got] == [(1.0, 1.0, True), (10.0, 1.0, False)]
    with pytest.raises(ValueError):
        features.sweep(matrix.unionAll(spark.createDataFrame([("a", "test", [0], [1.0])], matrix.schema)), 3, (1.0,))


def test_macro_f1_and_weights(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "d")], "label string, predicted string")
    assert features.macro_f1(rows) == pytest.approx((2 / 3 + 2 / 3 + 0 + 0) / 4)
    weights = {r.label: r.weight for r in features.class_weights(rows).collect()}
    assert weights == pytest.approx({"a": 4 / 6, "b": 4 / 3, "c": 4 / 3})


def test_evidence_order_and_limits(spark):
    rows = spark.createDataFrame([(1, "s", f"w:{k}", 1.0) for k in range(12)] + [(2, "s", "c:x", 0.5)], "page_id long, selector string, name string, value double")
    weights = spark.createDataFrame([("a", f"w:{k}", float(k % 5) - 0.5) for k in range(12)] + [("b", "w:4", 9.0), ("b", "w:1", 8.0), ("b", "w:2", 7.0), ("UNKNOWN", "c:x", 1.0)], "label string, name string, weight double")
    predicted = spark.createDataFrame([(1, "s", "a", "b"), (2, "s", "UNKNOWN", None), (3, "s", "a", None)], "page_id long, selector string, label string, second string")
    got = {r.page_id: r.signals for r in features.evidence(rows, predicted, weights).collect()}
    assert got[1] == [f"ngram:word:{k}" for k in (4, 9, 3, 8, 2, 7, 1)] and got[2] == ["ngram:abstain:unknown-class", "ngram:char:x"] and got[3] == []


def test_linear_engine_learns_the_answer_key(spark, small):
    rows = model.linear_engine(spark, small).collect()
    right = sum(r.label == r.true_label for r in rows) / len(rows)
    assert right > 0.9 and all(0 <= r.confidence <= 1 and 0 < len(r.signals) <= 8 for r in rows)
    assert "linear_engine" in registry.QUERIES
