"""Shapes of controls: what is made once a shape equals what is made once a control."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import features

SCHEMA = "page_id long, selector string, tag string, label_stream string, identifier_stream string, context_stream string, document_index int, label string, second string"


@pytest.fixture(scope="module")
def controls(spark):
    rng = random.Random(3)
    rows = [(k, f"#c{k}", rng.choice(("input", "select")), rng.choice(("zip code", "", "first name", "e mail")), rng.choice(("zip", "")), None, rng.randrange(3), rng.choice(("a", "b", "UNKNOWN")), rng.choice(("a", "b", None))) for k in range(160)]
    return spark.createDataFrame(rows, SCHEMA)


def test_names_and_rows_by_shape(controls):
    rows = features.features(controls)
    shapes = features.shapes(features.described(controls))
    grams = features.text_features(shapes.select("text").distinct())
    space, by_shape = features.fit_space(rows), features.capped(features.count_names(shapes, grams))
    assert shapes.count() < 60 and sorted(space.collect()) == sorted(by_shape.collect())
    want = {r.selector: (r.indices, r["values"]) for r in features.design_matrix(rows, space).collect()}
    met = features.described(controls, "selector").join(features.shape_matrix(shapes, grams, space), ["text", "marks"])
    assert {r.selector: (r.indices, r["values"]) for r in met.collect()} == want and len(want) == 160


def test_evidence_by_shape(spark, controls):
    rows = features.features(controls)
    names = sorted(r.name for r in rows.select("name").distinct().collect())
    weights = spark.createDataFrame([(label, n, ((k * step) % 7 - 2) / 4) for label, step in (("a", 3), ("b", 5), ("UNKNOWN", 2)) for k, n in enumerate(names)], "label string, name string, weight double")
    want = {r.selector: r.signals for r in features.evidence(rows, controls, weights).collect()}
    described = features.described(controls, "selector", "label", "second")
    grams = features.text_features(described.select("text").distinct())
    told = features.shape_evidence(described.select("text", "marks", "label", "second").distinct(), grams, weights)
    got = {(r.text, tuple(r.marks), r.label, r.second): r.signals for r in told.collect()}
    assert {r.selector: got[r.text, tuple(r.marks), r.label, r.second] for r in described.collect()} == want


def test_a_row_counts_for_its_controls(spark):
    rng = random.Random(5)
    once = [("ab"[p < rng.random()], [p, 1 - p], rng.randrange(1, 9)) for p in (k / 60 for k in range(1, 60))]
    times = spark.createDataFrame(once, "label string, probabilities array<double>, n long")
    each = times.select("label", "probabilities", F.explode(F.sequence(F.lit(1), "n")).alias("k")).drop("k")
    assert features.fit_calibration(times, ["a", "b"]).collect() == features.fit_calibration(each, ["a", "b"]).collect()
    predicted = F.when(F.col("probabilities")[0] > 0.5, "a").otherwise("b").alias("predicted")
    assert features.macro_f1(times.select("label", predicted, "n")) == features.macro_f1(each.select("label", predicted))
    matrix = lambda df: df.withColumns({"indices": F.array(F.lit(0), F.lit(1)), "values": F.col("probabilities")})
    (a, _), (b, _) = (features.fit_linear(matrix(df), 2, 1.0) for df in (times, each))
    assert abs(a.coefficientMatrix.toArray() - b.coefficientMatrix.toArray()).max() < 1e-4


def test_merged_rows_weigh_as_single_ones(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rng = random.Random(9)
    rows = [(float(k % 3), [rng.random(), 5 * rng.random()], float(rng.randrange(1, 30))) for k in range(12)]
    times = spark.createDataFrame(rows, "y double, x array<double>, n double").withColumn("features", array_to_vector("x"))
    each = times.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    whole, squares = sum(n for *_, n in rows), sum(n * n for *_, n in rows)
    fit = lambda df, penalty, **more: LogisticRegression(labelCol="y", family="multinomial", regParam=penalty, maxIter=300, tol=1e-10, **more).fit(df).coefficientMatrix.toArray()
    single, merged = fit(each, 0.1), fit(times, features.merged_penalty(0.1, whole, squares), weightCol="n")
    assert abs(single - merged).max() < 1e-5 < abs(single - fit(times, 0.1, weightCol="n")).max()
