"""Files of runs: round trips, strictness, suppressions."""

import json

import pytest

from tessera.sources import runlog


def test_rows_round_trip_and_are_strict(spark, tmp_path):
    rows = spark.createDataFrame([(1, "e", None, "clean", "t", "a", "b", 0.5, 1.0, ["X"]), (2, "e", "de", None, None, None, None, None, None, None)], runlog.ROWS)
    path = str(tmp_path / "log")
    runlog.write_rows(rows, path)
    assert sorted(map(str, runlog.read_rows(spark, path).collect())) == sorted(map(str, rows.collect()))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        runlog.write_rows(rows, path)
    (tmp_path / "bad").write_text('{"form_id": 1, "engine": "e"}\n\n  \n{"form_id": "x"\n')
    with pytest.raises(Exception, match="no row of a run log"):
        runlog.read_rows(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "blank").write_text('\n{"form_id": 1}\n \n')
    assert [r.form_id for r in runlog.read_rows(spark, str(tmp_path / "blank")).collect()] == [1]


def test_manifest(spark, tmp_path):
    path = str(tmp_path / "m")
    runlog.write_manifest(spark, path, run_id="r", rows=3)
    r = runlog.read_manifest(spark, path).first()
    assert (r.run_id, r.rows, r.engine) == ("r", 3, None)
    with pytest.raises(Exception):
        runlog.write_manifest(spark, path, run_id="r")
    with pytest.raises(ValueError):
        runlog.write_manifest(spark, str(tmp_path / "n"), other=1)


def test_keys(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"form_id": name, "template_id": "t", "locale": "de", "fields": [{"selector": "#x", "label": "email"}, {"selector": "#y", "label": "tel"}]}, indent=1))
    rows = runlog.read_keys(spark, str(tmp_path)).orderBy("file", "ordinal").collect()
    assert [(r.file, r.selector, r.label) for r in rows] == [("a.json", "#x", "email"), ("a.json", "#y", "tel"), ("b.json", "#x", "email"), ("b.json", "#y", "tel")]


def test_suppressions(spark, tmp_path):
    config = tmp_path / "audit.toml"
    config.write_text('[[suppress]]\ncode = "A"\nselector = "#x"\nreason = "one"\n[[suppress]]\ncode = "A"\nreason = "all"\n')
    (tmp_path / "deep" / "er").mkdir(parents=True)
    assert runlog.find_config(str(tmp_path / "deep" / "er"), "audit.toml") == str(config)
    rules = runlog.suppressions(spark, str(config))
    findings = spark.createDataFrame([("A", "#x"), ("A", "#y"), ("B", "#x"), ("A", None)], "code string, selector string")
    assert [r.suppressed_by for r in runlog.suppress(findings, rules).collect()] == ["one", "all", None, "all"]
    config.write_text('[[suppress]]\ncode = "A"\nreason = " "\n')
    with pytest.raises(ValueError):
        runlog.suppressions(spark, str(config))
