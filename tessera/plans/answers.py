"""Queries of model answers and their SQL. Every conversation stands for a request of three fields with an answer and a second one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import dims
from tessera.operators import answers
from tessera.plans import feeds
from tessera.plans.catalogue import query

_GOOD = '{"fields": [{"selector": "#a", "label": "email", "confidence": 0.9}, {"selector": "#b", "label": "tel", "confidence": 1}, {"selector": "#c", "label": "UNKNOWN", "confidence": 0.25, "reason": "no words"}]}'
#: First answers by what is wrong with them.
_FIRST = (
    _GOOD, "```json\n" + _GOOD + "\n```", '{"fields": [{"selector": "#a", "label": "email"}, {"selector": "#c", "label": "tel", "confidence": 1.5}]}', "I think #a is an e-mail address.",
    '{"fields": [{"selector": "#a", "label": "email", "confidence": -1}, {"selector": "#a", "label": "tel"}, {"selector": "#z", "label": "tel"}, {"selector": "#b", "label": "tel"}, {"selector": "#c", "label": "tel"}]}',
    '[{"selector": "#a"}]', '{"answers": []}', '{"fields": [{"selector": 7, "label": "email"}]}', '{"fields": [{"selector": "#a", "label": "phone-number"}, {"selector": "#a", "label": "tel", "confidence": "high"}]}', "```\n" + _GOOD + "```", "",
)
_SECOND = (_GOOD, '{"fields": [{"selector": "#b", "label": "tel", "confidence": 0.5}]}', "still no JSON", '{"fields": []}')


def _cases(key: str, values: tuple[str, ...]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN '" + v.replace("'", "''") + "'" for k, v in enumerate(values)) + " END"


_REQUESTS = "SELECT conv_id AS request_id, count(*) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id"
_ANSWERS = f"SELECT request_id, 1 AS attempt, {_cases('request_id', _FIRST)} AS content FROM q UNION ALL SELECT request_id, 2, {_cases('(request_id + turns)', _SECOND)} FROM q WHERE turns > 2"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = feeds.prepared(spark, sf_dir, _REQUESTS, "conversations")
    asked = q.select("request_id", F.array(*map(F.lit, ("#a", "#b", "#c"))).alias("selectors"))
    given = [q.select("request_id", F.lit(k + 1).alias("attempt"), F.array(*map(F.lit, texts))[(key % len(texts)).cast("int")].alias("content"), "turns") for k, (texts, key) in enumerate(((_FIRST, F.col("request_id")), (_SECOND, F.col("request_id") + F.col("turns"))))]
    return answers.resolved(asked, given[0].unionByName(given[1].filter("turns > 2")))


_LABELS = ", ".join(f"'{x}'" for own in dims.LABELS.values() for x in own)
_CHECKED = f"""WITH q AS ({_REQUESTS}), a AS ({_ANSWERS}),
    bare AS (SELECT request_id, attempt, CASE WHEN starts_with(content, '```') THEN trim(regexp_replace(regexp_replace(content, '^```(json)?', ''), '```$', ''), chr(10) || ' ') ELSE content END AS text FROM a),
    doc AS (SELECT *, CASE WHEN text <> '' AND json_valid(text) THEN text::JSON END AS j FROM bare),
    entry AS (SELECT request_id, attempt, i, json_type(e, '$.selector') AS st, json_type(e, '$.label') AS lt, e->>'$.selector' AS selector, e->>'$.label' AS label,
                     CASE WHEN json_type(e, '$.confidence') IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN least(1.0, greatest(0.0, (e->>'$.confidence')::DOUBLE)) ELSE 0.0 END AS confidence
              FROM (SELECT request_id, attempt, unnest(range(json_array_length(j, '$.fields')::INT)) AS i, j FROM doc WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.fields') = 'ARRAY') x, LATERAL (SELECT json_extract(j, '$.fields[' || i || ']') AS e)),
    problem AS (SELECT request_id, attempt, CASE WHEN j IS NULL THEN 'not_json' WHEN json_type(j) <> 'OBJECT' THEN 'not_object' WHEN json_type(j, '$.fields') IS DISTINCT FROM 'ARRAY' THEN 'no_fields'
                WHEN EXISTS (SELECT 1 FROM entry e WHERE e.request_id = doc.request_id AND e.attempt = doc.attempt AND (st IS DISTINCT FROM 'VARCHAR' OR lt IS DISTINCT FROM 'VARCHAR')) THEN 'bad_entry' END AS problem FROM doc),
    fine AS (SELECT e.* FROM entry e JOIN problem p USING (request_id, attempt) WHERE problem IS NULL),
    good AS (SELECT *, row_number() OVER (PARTITION BY request_id, attempt, selector ORDER BY i) AS nth FROM fine WHERE selector IN ('#a', '#b', '#c') AND label IN ({_LABELS})),
    extra AS (SELECT request_id, attempt, count(DISTINCT selector) AS n FROM fine f WHERE selector NOT IN ('#a', '#b', '#c') OR EXISTS (SELECT 1 FROM good g WHERE g.request_id = f.request_id AND g.attempt = f.attempt AND g.selector = f.selector AND g.i < f.i) GROUP BY 1, 2),
    state AS (SELECT p.request_id, p.attempt, problem, 3 - coalesce(g.n, 0) AS missing, coalesce(x.n, 0) AS extra, problem IS NULL AND coalesce(g.n, 0) = 3 AND coalesce(x.n, 0) = 0 AS ok
              FROM problem p LEFT JOIN (SELECT request_id, attempt, count(*) AS n FROM good WHERE nth = 1 GROUP BY 1, 2) g USING (request_id, attempt) LEFT JOIN extra x USING (request_id, attempt)),
    used AS (SELECT q.request_id, CASE WHEN NOT s1.ok AND s2.ok IS NOT NULL THEN 2 ELSE 1 END AS attempts, s1.problem AS p1, s2.problem AS p2 FROM q JOIN state s1 ON s1.request_id = q.request_id AND s1.attempt = 1 LEFT JOIN state s2 ON s2.request_id = q.request_id AND s2.attempt = 2),
    last AS (SELECT u.request_id, u.attempts, CASE WHEN attempts = 2 AND p2 IS NULL THEN 2 WHEN p1 IS NULL THEN 1 END AS from_attempt, CASE WHEN NOT s.ok THEN coalesce(s.problem, s.missing || ' missing, ' || s.extra || ' invented') END AS failure
             FROM used u JOIN state s ON s.request_id = u.request_id AND s.attempt = u.attempts),
    field AS (SELECT l.request_id, w.selector, coalesce(g.label, 'UNKNOWN') AS label, coalesce(g.confidence, 0.0) AS confidence, g.label IS NULL AS open
              FROM last l CROSS JOIN (VALUES ('#a'), ('#b'), ('#c')) w(selector) LEFT JOIN good g ON g.request_id = l.request_id AND g.attempt = l.from_attempt AND g.selector = w.selector AND g.nth = 1)"""


@query(_CHECKED + """ SELECT l.request_id, attempts, failure, string_agg(selector, ' ' ORDER BY selector) FILTER (WHERE open) AS unresolved FROM last l JOIN field USING (request_id) GROUP BY 1, 2, 3""")
def answer_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request's way through its answers: attempts, the last failure, what stayed open."""
    return _calls(spark, sf_dir).select("request_id", "attempts", "failure", F.nullif(F.array_join("unresolved", " "), F.lit("")).alias("unresolved"))


@query(_CHECKED + " SELECT request_id, selector, label, confidence FROM field")
def answer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label a field that was asked; nothing is dropped."""
    return answers.labels(_calls(spark, sf_dir))


@query(_CHECKED + """ SELECT count(*) AS requests, sum(attempts)::BIGINT AS attempts, count(*) FILTER (WHERE attempts > 1) AS retried, (count(*) * 3)::BIGINT AS fields, (SELECT count(*) FROM field WHERE open) AS unresolved, count(failure) AS failed FROM last""")
def answer_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the calls came to."""
    return answers.accounting(_calls(spark, sf_dir))
