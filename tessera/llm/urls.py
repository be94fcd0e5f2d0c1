"""URL filters in DataFrame functions only: ordered host and path rules first, a logistic regression for the rest.

The regression sees the hashed character n-grams of host and path, each once. It is fitted by full-batch gradient descent to a
small labelled table of URLs: the table becomes one row (examples with their features, features with their examples), over
which the steps are a fold of SQL functions. Each feature's step is as long as the separable bound of the loss allows (a
quarter of the sum of its examples' sizes), so every step descends. The weights, a number a bucket, reach the scored rows as a
scalar subquery, so a URL is judged in its own row, without a shuffle.

Defined results: a null url, or one without ``://``, has an empty host and path, which no rule fits; ties between rules of one
length go to the longer host; repeated rows each get a row; an empty table gives no rows; other columns are ignored. Without
labelled URLs everything scores 0.5 and is allowed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table

#: Rules as (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Lengths of the n-grams, and the buckets they are hashed to.
GRAMS, BUCKETS = (3, 4, 5), 8192
#: Labelled URLs that the regression is fitted to, at most (those that come first in order).
MOST_LABELLED = 5000
#: Gradient steps, their length as a share of what the bound allows, and the decay of weights a step.
STEPS, RATE, DECAY = 120, 1.0, 1e-3
#: Beyond this probability a URL is blocked.
THRESHOLD = 0.5

#: The labelled table: words of hosts and paths that are blocked, and of ordinary ones.
BLOCKED_WORDS = (
    "casino casinos jackpot slots roulette poker gambling bets betting bookmaker lottery winnings pills viagra cialis pharma meds steroids adult porn xxx sexcam "
    "escort hookup ads adserver adclick banner popunder tracker track tracking pixel clickbait payday loans quickcash freemoney prize giveaway warez keygen torrent "
    "malware phishing spam replica counterfeit miracle-diet cheap-pills free-bets casino-win ad-track bigwin"
).split()
ORDINARY_WORDS = (
    "news wiki docs library school museum history science garden recipes kitchen weather travel music film theatre books poetry city river mountain university college research "
    "health hospital clinic family children teacher student language grammar dictionary maps railway airport harbour bridge village market bakery coffee tea bread cheese "
    "football tennis cycling running hiking sailing chess puzzle photo camera painting drawing design fashion furniture house home office work career finance banking insurance "
    "law court council government election parliament economy energy solar climate ocean forest animals birds insects flowers trees farm weather-report physics chemistry biology "
    "mathematics astronomy space rocket robot computer software hardware network database security privacy developer code python java linux open-source tutorial course lecture "
    "article story essay journal magazine press radio podcast video archive gallery events calendar tickets hotel restaurant menu shop store delivery repair tools paper letters "
    "contact about search forum community support help faq download update release notes trackday additive address betterment better cheapest winner window winter freedom"
).split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, label (1: block): every word stands once in a host and once in a path, under turning prefixes, ends, schemes and languages."""
    return spark.createDataFrame(_labelled(), "url string, label int")


def _labelled() -> list[tuple[str, int]]:
    before, ends, paths, tails = ("www.", "m.", "blog.", ""), ("example.com", "example.org", "example.net"), ("en", "de", "fr", "es"), ("", ".html", "/", "?page=2", "#top")
    rows = []
    for label, words in ((1, BLOCKED_WORDS), (0, ORDINARY_WORDS)):
        for k, word in enumerate(words):
            scheme, end, path, tail = ("http", "https")[k % 2], ends[k % 3], paths[k // 2 % 4], tails[k % 5]
            rows.append((f"{scheme}://{before[k % 4]}{word}.{end}/{path}/{1000 + 37 * k}{tail}", label))
            rows.append((f"{scheme}://{before[k // 3 % 4]}site{k}.{end}/{path}/{word}/{10 + k}{tail}", label))
    return rows


def with_host_and_path(urls: DataFrame) -> DataFrame:
    """The rows with ``host`` and ``path`` of their ``url``."""
    at = F.locate("://", "url")
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return urls.withColumns({"host": F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, upper.lower()), "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


#: What n-grams are taken of, in SQL.
_TEXTS = tuple(f"translate({text}, '123456789', '000000000')" for text in ("concat('.', host, '.')", "path"))


def buckets() -> Column:
    """The distinct buckets of the n-grams of ``host`` (with its ends marked) and ``path``; all digits are one sign."""

    def of(text: str, n: int) -> str:
        return f"transform(sequence(1, greatest(char_length({text}) - {n - 1}, 0), 1), i -> substring({text}, i, {n}))"

    def tagged(tag: str, text: str) -> str:
        grams = ", ".join(f"IF(char_length({text}) < {n}, array(), {of(text, n)})" for n in GRAMS)
        return f"transform(concat({grams}), g -> concat('{tag}', g))"

    both = f"concat({tagged('h', _TEXTS[0])}, {tagged('p', _TEXTS[1])})"
    return F.expr(f"array_distinct(transform({both}, g -> cast(conv(substring(md5(cast(g AS binary)), 1, 8), 16, 10) AS bigint) % {BUCKETS}))")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def fit(labelled: DataFrame) -> DataFrame:
    """One row ``weights``: the bias, then a weight a bucket; of a table (url, label) with a bounded number of rows."""
    rows = with_host_and_path(labelled.select("url", F.col("label").cast("double").alias("y"))).filter("y IS NOT NULL").orderBy("url", "y").limit(MOST_LABELLED)
    examples = rows.groupBy().agg(F.sort_array(F.collect_list(F.struct("url", "y", buckets().alias("buckets")))).alias("all")).select(F.posexplode("all").alias("example", "e"))
    long = examples.select("example", "e.y", F.size("e.buckets").alias("size"), F.explode("e.buckets").alias("bucket"))
    long = long.withColumn("feature", F.dense_rank().over(Window.orderBy("bucket")))  # of the bounded table
    by_example = long.groupBy("example").agg(F.first("y").alias("y"), F.sort_array(F.collect_list("feature")).alias("features"))
    by_feature = long.groupBy("feature").agg(F.first("bucket").alias("bucket"), (F.sum(F.col("size") + 1) / 4).alias("bound"), F.sort_array(F.collect_list("example")).alias("examples"))
    one = by_example.groupBy().agg(F.sort_array(F.collect_list(F.struct("example", "y", "features"))).alias("by_example"))
    other = by_feature.groupBy().agg(F.sort_array(F.collect_list(F.struct("feature", "bucket", "bound", "examples"))).alias("by_feature"))
    both = one.withColumn("k", F.lit(1)).join(other.withColumn("k", F.lit(1)), "k")

    def step(w: Column, _: Column) -> Column:
        def total(values: Column, at: Column) -> Column:
            return F.aggregate(at, F.lit(0.0), lambda s, k: s + values[k])

        def error(e: Column) -> Column:
            return 1 / (1 + F.exp(-(w[0] + total(w, e["features"])))) - e["y"]

        def moved(r: Column) -> Column:
            bias = w[0] - RATE * F.aggregate(r, F.lit(0.0), lambda s, x: s + x) / F.col("bound")
            others = F.transform("by_feature", lambda f: w[f["feature"]] * (1 - DECAY) - RATE * total(r, f["examples"]) / f["bound"])
            return F.concat(F.array(bias), others)

        return _let(F.transform("by_example", error), moved)

    start = F.array_repeat(F.lit(0.0), F.size("by_feature") + 1)
    both = both.withColumn("bound", F.greatest(F.lit(1.0), F.aggregate("by_example", F.lit(0.0), lambda s, e: s + (F.size(e["features"]) + 1) / 4)))
    fitted = both.select("by_feature", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step).alias("w"))
    pairs = fitted.select(F.explode(F.concat(F.array(F.struct(F.lit(-1).cast("long").alias("bucket"), F.col("w")[0].alias("w"))), F.transform("by_feature", lambda f: F.struct(f["bucket"].alias("bucket"), F.col("w")[f["feature"]].alias("w"))))).alias("p")).select("p.*")
    every = labelled.sparkSession.range(-1, BUCKETS).withColumnRenamed("id", "bucket").join(pairs, "bucket", "left").fillna(0.0)
    return every.groupBy().agg(F.sort_array(F.collect_list(F.struct("bucket", "w"))).alias("all")).select(F.transform("all", lambda x: x["w"]).alias("weights"))


def score() -> Column:
    """The probability that a row's ``host`` and ``path`` are to be blocked, by its ``weights``."""

    def margin(own: Column) -> Column:
        return F.col("weights")[0] + F.aggregate(own, F.lit(0.0), lambda s, b: s + F.col("weights")[(b + 1).cast("int")])

    return 1 / (1 + F.exp(-_let(buckets(), margin)))


def matching_rule(rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest rule that fits a row's ``host`` and ``path``: a struct of rule and verdict, or null. Rules are a short list."""
    fits = [
        F.when(((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path), F.struct(F.lit(f"{host}{path}").alias("rule"), F.lit(verdict).alias("verdict")))
        for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def judge(urls: DataFrame, weights: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """The rows of ``urls`` with url_host, url_path, url_rule, url_score (the regression's, for every row) and url_verdict."""
    parts = with_host_and_path(urls.select(F.struct(*urls.columns).alias("row"), "url"))
    judged = parts.withColumn("weights", weights.select("weights").scalar()).withColumns({"fit": matching_rule(rules), "score": score()})
    learned = F.when(F.col("score") > THRESHOLD, "block").otherwise("allow")
    return judged.select(
        "row.*", F.col("host").alias("url_host"), F.col("path").alias("url_path"), F.col("fit.rule").alias("url_rule"), F.col("score").alias("url_score"), F.coalesce("fit.verdict", learned).alias("url_verdict")
    )


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "pages").select("page_id", "url"), fit(labelled_urls(spark)))
    return judged.select("page_id", *(F.col(f"url_{c}").alias(c) for c in ("host", "path", "rule", "verdict")))


QUERIES = {"op11_url_filter": op11_url_filter}


def _oracle() -> str:
    def bucketed(source: str, extra: str) -> str:
        parts = [f"[('{tag}' || substr({text}, i, {n})) FOR i IN range(1, length({text}) - {n} + 2)]" for tag, text in zip("hp", _TEXTS, strict=True) for n in GRAMS]
        joined = reduce(lambda a, b: f"list_concat({a}, {b})", parts)
        return f"SELECT {extra}, host, path, list_sort(list_distinct([('0x' || substr(md5(g), 1, 8))::BIGINT % {BUCKETS} FOR g IN {joined}])) AS buckets FROM {source}"

    def split(source: str, extra: str) -> str:
        rest = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
        upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        return f"SELECT {extra}, translate(regexp_extract({rest}, '^[^/?#]*'), '{upper}', '{upper.lower()}') AS host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path FROM {source}"

    values = ", ".join(f"('{u}', {y})" for u, y in _labelled())
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    fits = lambda h, p: f"(host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered)
    return f"""
        WITH RECURSIVE seeds(url, y) AS (VALUES {values}),
        seed_parts AS ({split("seeds", "url, y")}),
        seed_rows AS (SELECT *, row_number() OVER (ORDER BY url, y) AS example FROM ({bucketed("seed_parts", "url, y")})),
        long AS (SELECT example, bucket, dense_rank() OVER (ORDER BY bucket) AS feature FROM (SELECT example, unnest(buckets) AS bucket FROM seed_rows)),
        x AS MATERIALIZED (SELECT list({{'y': y::DOUBLE, 'f': f}} ORDER BY example) AS e, sum((len(f) + 1) / 4) AS bound
              FROM seed_rows JOIN (SELECT example, list(feature ORDER BY feature) AS f FROM long GROUP BY 1) USING (example)),
        p AS MATERIALIZED (SELECT list({{'examples': e, 'bound': bound}} ORDER BY feature) AS f, list(bucket ORDER BY feature) AS buckets
              FROM (SELECT feature, any_value(bucket) AS bucket, list(example ORDER BY example) AS e, sum((len(buckets) + 1) / 4) AS bound
                    FROM long JOIN seed_rows USING (example) GROUP BY 1)),
        fit(t, b, w) AS (
            SELECT 0, 0.0::DOUBLE, list_transform(p.f, lambda q: 0.0::DOUBLE) FROM p
            UNION ALL
            SELECT t + 1, b - {RATE} * list_sum(r) / x.bound,
                   list_transform(p.f, lambda q, i: w[i] * (1 - {DECAY}) - {RATE} * list_sum(list_transform(q.examples, lambda k: r[k])) / q.bound)
            FROM (SELECT t, b, w, list_transform(x.e, lambda v: 1 / (1 + exp(-(b + list_sum(list_transform(v.f, lambda k: w[k]))))) - v.y) AS r FROM fit, x WHERE t < {STEPS}), p, x
        ),
        model AS (SELECT b, unnest(p.buckets) AS bucket, unnest(w) AS weight FROM fit, p WHERE t = {STEPS}),
        page_parts AS ({split("pages", "page_id, row_number() OVER () AS n")}),
        page_rows AS ({bucketed("page_parts", "page_id, n")}),
        scored AS (
            SELECT n, sum(weight) AS total FROM (SELECT n, unnest(buckets) AS bucket FROM page_rows) JOIN model USING (bucket) GROUP BY n
        )
        SELECT page_id, host, path, CASE {rule} END AS rule,
               CASE {verdict} WHEN (SELECT any_value(b) FROM model) + coalesce(total, 0) > 0 THEN 'block' ELSE 'allow' END AS verdict
        FROM page_rows LEFT JOIN scored USING (n)
    """


ORACLES = {"op11_url_filter": _oracle()}
