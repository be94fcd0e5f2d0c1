"""Model answers by hand, and exact percentiles against sorting."""

import json
import random

import pytest

from tessera.operators import answers, metrics

FENCED = "```json\n{}\n```"
ENTRY = {"selector": "#a", "label": "email", "confidence": 0.5}


@pytest.mark.parametrize(
    "content, problem, answered, missing, extra",
    [
        (json.dumps({"fields": [ENTRY, {"selector": "#b", "label": "tel"}]}), None, [("#a", "email", 0.5), ("#b", "tel", 0.0)], [], []),
        (FENCED.format(json.dumps({"fields": [ENTRY]})), None, [("#a", "email", 0.5)], ["#b"], []),
        (json.dumps({"fields": [ENTRY, ENTRY, {"selector": "#x", "label": "tel"}, {"selector": "#x", "label": "tel"}]}), None, [("#a", "email", 0.5)], ["#b"], ["#a", "#x"]),
        (json.dumps({"fields": [{"selector": "#a", "label": "phone"}, {**ENTRY, "confidence": 7}, {"selector": "#b", "label": "tel", "confidence": True}]}), None, [("#a", "email", 1.0), ("#b", "tel", 0.0)], [], []),
        (json.dumps({"fields": [{**ENTRY, "confidence": "0.9"}], "more": 1}), None, [("#a", "email", 0.0)], ["#b"], []),
        ("no", "not_json", None, None, None), (None, "not_json", None, None, None), ("[]", "not_object", None, None, None), ("3", "not_object", None, None, None),
        ("{}", "no_fields", None, None, None), ('{"fields": "x"}', "no_fields", None, None, None), ('{"fields": [1]}', "bad_entry", None, None, None),
        ('{"fields": [{"selector": "#a"}]}', "bad_entry", None, None, None), ('{"fields": []}', None, [], ["#a", "#b"], []),
    ],
)
def test_one_answer(spark, content, problem, answered, missing, extra):
    row = answers.checked(spark.createDataFrame([(content, ["#a", "#b"])], "content string, selectors array<string>")).first()
    assert row.problem == problem and row.missing == missing and row.extra == extra
    assert (row.answered and [tuple(e)[:3] for e in row.answered] or row.answered) == answered
    assert row.ok == (problem is None and not missing and not extra)


def test_attempts(spark):
    good = json.dumps({"fields": [ENTRY, {"selector": "#b", "label": "tel", "confidence": 1}]})
    part = json.dumps({"fields": [ENTRY]})
    given = {1: (good, "never read"), 2: (part, good), 3: (part, "x"), 4: ("x", part), 5: ("x", "y"), 6: ("x", None), 7: (None, None)}
    rows = [(k, n + 1, c) for k, pair in given.items() for n, c in enumerate(pair) if c is not None]
    asked = spark.createDataFrame([(k, ["#a", "#b"]) for k in given], "request_id long, selectors array<string>")
    done = answers.resolved(asked, spark.createDataFrame(rows, "request_id long, attempt int, content string"))
    got = {r.request_id: (r.attempts, r.failure, r.unresolved) for r in done.collect()}
    assert got == {
        1: (1, None, []), 2: (2, None, []), 3: (2, "not_json", ["#b"]), 4: (2, "1 missing, 0 invented", ["#b"]), 5: (2, "not_json", ["#a", "#b"]), 6: (1, "not_json", ["#a", "#b"]), 7: (1, "not_json", ["#a", "#b"]),
    }
    assert answers.labels(done).filter("label = 'UNKNOWN' and confidence = 0").count() == 8 and answers.labels(done).count() == 14
    assert tuple(answers.accounting(done).first()) == (7, 11, 4, 14, 8, 5)


@pytest.mark.parametrize("whole", [metrics.WHOLE_GROUP, 1000])
def test_percentiles_by_sorting(spark, whole, monkeypatch):
    monkeypatch.setattr(metrics, "WHOLE_GROUP", whole)
    rng = random.Random(3)
    groups = {"one": [4.5], "two": [1.0, 2.0], "same": [7.0] * 500, "many": [rng.choice((rng.random(), rng.randint(0, 5), -1e9)) for _ in range(60_000)], "few": [rng.random() for _ in range(37)]}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("one", None), ("none", None)], "k string, v double")
    at = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r.k: r for r in metrics.exact_percentiles(rows, "v", at, "k").collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        ordered = sorted(vs)
        for name, p in at.items():
            r = p * (len(vs) - 1)
            a, b = ordered[int(r)], ordered[min(len(vs) - 1, int(r) + (r > int(r)))]
            assert got[k][name] == pytest.approx(a + (b - a) * (r - int(r))), (k, name)
