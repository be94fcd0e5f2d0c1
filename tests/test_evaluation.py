"""Observations, comparisons and corpus checks on small tables against plain Python."""

import random

from pyspark.sql import functions as F

from tessera.operators import corpus, observe, rules, statistics
from tests.test_operators import controls


def f1(pairs):
    labels = {x for pair in pairs for x in pair}
    of = lambda x: 2 * sum(t == p == x for t, p in pairs) / (sum(t == x for t, _ in pairs) + sum(p == x for _, p in pairs))
    return sum(map(of, labels)) / len(labels)


def test_macro_f1_under_every_swap(spark):
    rng = random.Random(5)
    rows = [(k, k % 5, e, rng.choice("ab"), rng.choice("abc"), k % 2) for k in range(40) for e in ("x", "y")]
    df = spark.createDataFrame(rows, "form_id int, cluster int, engine string, true_label string, pred_label string, half int")
    null = statistics.macro_f1_null(df, "cluster", "x", "y", {"all": F.lit(True), "half": F.col("half") == 1}).collect()
    assert len(null) == 64
    for r in null:
        kept = [x for x in rows if r.slice == "all" or x[5] == 1]
        order = sorted({x[1] for x in kept})
        scores = {"x": [], "y": []}
        for _, c, e, t, p, _ in kept:
            scores[{"x": "y", "y": "x"}[e] if r.mask >> order.index(c) & 1 else e].append((t, p))
        assert abs(r.first_score - f1(scores["x"])) < 1e-12 and abs(r.second_score - f1(scores["y"])) < 1e-12


def test_many_clusters_are_sampled(spark):
    rows = [(k, k, e, "a", "a" if e == "y" or k % 2 else "b") for k in range(40) for e in ("x", "y")]
    df = spark.createDataFrame(rows, "form_id int, cluster int, engine string, true_label string, pred_label string")
    r = statistics.comparison_family(df, "cluster", "x", "y", {"all": F.lit(True)}).first()
    assert r.floor == 1 / (statistics.SAMPLED + 1) and r.p < 0.001 and r.verdict == "IMPROVEMENT"


def test_verdicts(spark):
    cases = [(0.01, 0.2, 0.5, "UNDERPOWERED"), (0.01, 0.01, 0.02, "IMPROVEMENT"), (0.01, 0.01, -0.02, "REGRESSION"), (0.01, 0.01, 0.019, "BELOW_THRESHOLD"), (0.05, 0.01, 0.5, "NO_CHANGE")]
    df = spark.createDataFrame([c[:3] for c in cases], "p double, floor double, effect double")
    assert [r[0] for r in df.select(statistics.verdict(F.col("p"), F.col("floor"), F.col("effect"))).collect()] == [c[3] for c in cases]


def test_observations(spark):
    rows = [dict(input_type="email"), dict(input_type="email", autocomplete_raw="tel"), dict(input_type="email", autocomplete_raw="off"), dict(input_type="email", undetectable_reason="closed_shadow_root"), dict()]
    p = rules.predict(rules.signals(controls(spark, *rows))).withColumn("true_label", F.lit("email"))
    seen = {(r.selector, r.code[0]): (r.needed, r.emitted, r.correct) for r in observe.observations(p).collect()}
    assert seen == {
        ("#s0", "M"): (True, True, True), ("#s0", "W"): (False, False, True), ("#s1", "M"): (False, False, True), ("#s1", "W"): (True, True, True),
        ("#s2", "M"): (False, False, True), ("#s2", "W"): (False, False, True), ("#s4", "M"): (True, False, False), ("#s4", "W"): (False, False, False),
    }
    m = {r.code: r for r in observe.finding_metrics(observe.observations(p), least=2).collect()}
    assert m["MISSING_AUTOCOMPLETE"].recall == 0.5 and m["MISSING_AUTOCOMPLETE"].precision is None and m["WRONG_AUTOCOMPLETE"].f1 is None


def test_evidence(spark):
    p = rules.with_evidence(rules.predict(rules.signals(controls(spark, dict(input_type="password", label_for="New password"), dict(undetectable_reason="closed_shadow_root"), dict(label_for="Frobnicate"))))).orderBy("document_index")
    signals = [list(r.signals) for r in p.collect()]
    assert signals == [["intrinsic:new-password", "intrinsic:current-password", "label:new-password", "label:current-password"], ["undetectable:closed_shadow_root"], []]
    assert p.select(rules.shown(F.col("signals"), 3)).first()[0] == "intrinsic:new-password, intrinsic:current-password, label:new-password and 1 more"


def test_reconcile_against_sets(spark):
    rng = random.Random(6)
    e = [(f, f"#{rng.randrange(9)}", k, rng.random() < 0.3) for f in range(12) for k in range(rng.randrange(6))]
    g = [(f, f"#{rng.randrange(9)}", k) for f in range(12) for k in range(rng.randrange(6))] + [(0, None, 9)]
    got = {r.form_id: r for r in corpus.reconcile(spark.createDataFrame(e, "form_id int, selector string, ordinal int, injected boolean"), spark.createDataFrame(g, "form_id int, selector string, ordinal int")).collect()}
    for f in {x[0] for x in (*e, *g)}:
        a, b = [x[1] for x in e if x[0] == f], [x[1] for x in g if x[0] == f]
        injected = {x[1] for x in e if x[0] == f and x[3]}
        r = got[f]
        assert (r.expected, r.found, r.missing, r.unexpected) == (len(a), len(b), len({*a} - {*b}), len({*b} - {*a}))
        assert (r.injected_expected, r.injected_found, r.order_differs) == (len(injected), len(injected & {*b}), a != b)


def test_empty_corpus(spark):
    empty = spark.createDataFrame([], "form_id int, selector string, ordinal int, injected boolean")
    assert corpus.sweep_totals(corpus.reconcile(empty, empty)).first().forms == 0
    manifest = spark.createDataFrame([], "form_id int, html_sha256 string, n_fields int")
    assert corpus.manifest_problems(manifest, manifest).count() == 0


def test_label_gaps(spark):
    labels = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    groups = spark.createDataFrame([("a",), ("a",), ("b",), ("z",), ("z",)], "label string")
    assert {(r.label, r.n) for r in corpus.label_gaps(groups, labels).collect()} == {("a", 2), ("c", 0), ("z", 2)}
