"""Run logs, manifests, answer keys and suppressions as files: strict where a wrong line must not pass."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "form_id long, engine string, locale string, tier string, template_id string, true_label string, pred_label string, confidence double, latency_us double, finding_codes array<string>"
MANIFEST = "run_id string, engine string, corpus_sha256 string, rows long, created string"
KEY = "form_id string, template_id string, locale string, fields array<struct<selector: string, label: string, expected_modifiers: array<string>>>"


def write_rows(rows: DataFrame, path: str) -> None:
    """A run log as JSON lines with nulls spelled out; an existing log is never overwritten."""
    rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def read_rows(spark: SparkSession, path: str, schema: str = ROWS) -> DataFrame:
    """Rows of a run log; blank lines are skipped, and a line that is no row of the schema ends the job with its text."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    row = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    parsed = lines.select("value", row.alias("row"))
    wrong = F.col("row").isNull() | F.col("row._corrupt").isNotNull()
    said = F.raise_error(F.concat(F.lit("no row of a run log: "), F.substring("value", 1, 200)))
    checked = parsed.select(F.when(wrong, said.cast(parsed.schema["row"].dataType)).otherwise(F.col("row")).alias("row"))
    return checked.select("row.*").drop("_corrupt")


def write_manifest(spark: SparkSession, path: str, **values) -> None:
    """One manifest; a path that holds one already is an error."""
    names = [c.split()[0] for c in MANIFEST.split(", ")]
    if unknown := set(values) - set(names):
        raise ValueError(f"no part of a manifest: {', '.join(sorted(unknown))}")
    spark.createDataFrame([tuple(values.get(n) for n in names)], MANIFEST).coalesce(1).write.mode("errorifexists").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path)


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """form_id, template_id, locale, selector, label, ordinal, file: one row a field of a folder of answer keys, one document a file."""
    keys = spark.read.schema(KEY).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("file", F.col("_metadata.file_name"))
    return keys.select("form_id", "template_id", "locale", "file", F.posexplode("fields").alias("ordinal", "f")).select("form_id", "template_id", "locale", "file", "ordinal", "f.*")


def suppressions(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, code, selector, reason of the [[suppress]] entries of a TOML file; code and reason are mandatory."""
    found = []
    for k, entry in enumerate(tomllib.loads(Path(path).read_text(encoding="utf-8")).get("suppress", [])):
        if not entry.get("code") or not str(entry.get("reason", "")).strip():
            raise ValueError(f"suppression {k} needs a code and a reason")
        found.append((k, entry["code"], entry.get("selector"), entry["reason"]))
    return spark.createDataFrame(found, "ordinal int, code string, selector string, reason string")


def find_config(start: str, name: str) -> str | None:
    """The nearest file of that name in a folder or above it."""
    here = Path(start).resolve()
    return next((str(d / name) for d in (here, *here.parents) if (d / name).is_file()), None)


def suppress(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings with suppressed_by: the reason of the first rule for their code whose selector is theirs or null. The rules are a
    config file's, read on the driver, so they are broadcast; each finding keeps its row."""
    given = [r.asDict() for r in rules.orderBy(F.desc("ordinal")).collect()]
    reason = F.lit(None).cast("string")
    for rule in given:
        met = F.col("code") == rule["code"]
        if rule["selector"] is not None:
            met = met & (F.col("selector") == rule["selector"])
        reason = F.when(met, rule["reason"]).otherwise(reason)
    return findings.withColumn("suppressed_by", reason)
