"""The linear engine: named features of controls, a fitted vocabulary, sparse rows, weighted fits, calibration, evidence.

A feature's name begins with its block: character and word n-grams of the token streams (each block scaled to length one), and
the indicators of attributes, option lists and structure. Features are rows (a control, a name, a value) until the vocabulary
numbers them; the vocabulary is capped by block, so it may be sent to all tasks.

Forms repeat their wordings. Two controls of one text (the streams) and the same marks (the indicators) have the same features:
they are one shape. N-grams are counted once a text, rows are made, fitted and scored once a shape, with the number of its controls
as ``n``, and controls meet their shape's result at the end.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import bucket, char_ngrams, word_ngrams

# Blocks in order and how evidence names them; limits of the vocabulary; bounds of buckets and option lists.
BLOCKS = {"c": "ngram:char", "w": "ngram:word", "t": "ngram:attr", "o": "ngram:options", "s": "ngram:structure"}
LEAST_CONTROLS, MOST_CHAR, MOST_WORD = 2, 100_000, 50_000
MAXLENGTH, OPTION_COUNT, POSITION, SIBLINGS = (1, 3, 5, 9, 17, 33, 65), (1, 2, 4, 7, 13, 31, 100), (1, 2, 3, 5, 8, 12, 20), (1, 2, 4, 7, 13, 21)
YEARS, LEAST_YEARS, LEAST_COUNTRIES, SHORT_LIST = (1990, 2100), 4, 40, 6
# Positives on the dev split from which a class is fitted by steps, and by a sigmoid; signals shown, those of the second label among them; coefficients kept a label.
STEPS_FROM, SIGMOID_FROM, MOST_SIGNALS, SECOND_SIGNALS, KEPT_WEIGHTS = 100, 2, 8, 2, 40
EPSILON = 1e-12
KEYS = ("page_id", "selector")


def text_blob() -> Column:
    """The three streams as one text; a letter before each token names its stream."""
    of = lambda letter, stream: F.array_join(F.transform(F.filter(F.split(F.coalesce(stream, F.lit("")), " "), lambda t: t != ""), lambda t: F.concat(F.lit(f"{letter}:"), t)), " ")
    streams = F.array(of("L", F.col("label_stream")), of("I", F.col("identifier_stream")), of("C", F.col("context_stream")))
    return F.array_join(F.filter(streams, lambda s: s != ""), " ")


def _numbers(values: Column) -> Column:
    plain = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v.rlike(r"^\d+$"))
    return F.filter(F.transform(plain, lambda v: v.try_cast("int")), lambda n: n.isNotNull())


def lists_months(values: Column) -> Column:
    """All of the numbers 1 to 12, and at most one other."""
    numbers = F.array_distinct(_numbers(values))
    return (F.size(numbers) <= 13) & F.forall(F.sequence(F.lit(1), F.lit(12)), lambda m: F.array_contains(numbers, m))


def lists_years(values: Column) -> Column:
    """Four or more years without a gap."""
    years = F.array_distinct(F.filter(_numbers(values), lambda n: n.between(*YEARS)))
    return (F.size(years) >= LEAST_YEARS) & (F.array_max(years) - F.array_min(years) == F.size(years) - 1)


def indicators(columns: Sequence[str]) -> Column:
    """Names of the attribute, option and structure blocks; columns that a table lacks count as absent."""
    get = lambda name, kind="string": F.col(name) if name in columns else F.lit(None).cast(kind)
    said = lambda prefix, value, absent="absent": F.concat(F.lit(prefix), F.coalesce(value, F.lit(absent)))
    flag = lambda name, held: F.when(F.coalesce(held, F.lit(False)), name)
    labels, values = (F.coalesce(get(c, "array<string>"), F.array().cast("array<string>")) for c in ("option_labels", "option_values"))
    labels = F.when(F.size(labels) > 0, labels).otherwise(values) if "option_labels" not in columns else labels
    any_options = (F.size(labels) > 0) | (F.size(values) > 0)
    countries = (F.size(labels) >= LEAST_COUNTRIES) | (F.size(values) >= LEAST_COUNTRIES // 2) & (F.size(F.filter(values, lambda v: F.length(F.trim(v)) == 2)) >= F.size(values) - 1)
    hidden = reduce(lambda a, b: a | b, (F.coalesce(get(c, "boolean"), F.lit(False)) for c in ("style_hidden", "zero_size", "offscreen")))
    names = F.array(
        said("t:tag=", get("tag")), said("t:type=", F.nullif(get("input_type"), F.lit(""))), said("t:inputmode=", F.nullif(get("inputmode"), F.lit(""))), said("t:role=", get("group_role"), "none"),
        said("t:maxlength=", bucket(get("maxlength", "int"), MAXLENGTH)), flag("t:required", get("required", "boolean")), flag("t:readonly", get("readonly", "boolean")), flag("t:haspattern", get("pattern") != ""),
        F.when(any_options, F.concat(F.lit("o:count="), bucket(F.size(labels), OPTION_COUNT))), flag("o:months", lists_months(values) | lists_months(labels)),
        flag("o:years", lists_years(values) | lists_years(labels)), flag("o:countries", countries), flag("o:shortenum", F.size(labels).between(1, SHORT_LIST)),
        said("s:position=", bucket(get("document_index", "int"), POSITION)), said("s:siblings=", bucket(F.coalesce(get("sibling_controls", "int"), F.lit(0)), SIBLINGS)),
        flag("s:inform", get("form_key").isNotNull()), flag("s:infieldset", get("fieldset_key").isNotNull()), flag("s:inshadowroot", F.size(get("shadow_path", "array<string>")) > 0),
        flag("s:inframe", F.size(get("frame_path", "array<string>")) > 0), flag("s:hidden", hidden),
    )
    return F.array_compact(names)


def described(controls: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns, text, marks: what the features of controls with signals are made of."""
    return controls.select(*columns, text_blob().alias("text"), indicators(controls.columns).alias("marks"))


def text_features(texts: DataFrame) -> DataFrame:
    """text, name, value: the n-grams of ``texts`` (text, each once). One shuffle, by the text."""
    tagged = lambda block, grams: F.transform(grams, lambda g: F.concat(F.lit(f"{block}:"), g))
    names = texts.repartition("text").select("text", F.explode(F.concat(tagged("c", char_ngrams(F.col("text"))), tagged("w", word_ngrams(F.col("text"))))).alias("name"))
    counted = names.groupBy("text", "name").agg(F.count(F.lit(1)).alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("text", F.substring("name", 1, 1))))
    return counted.select("text", "name", (F.col("n") / length).alias("value"))


def mark_features(shapes: DataFrame) -> DataFrame:
    """marks, name, value: the indicators of each set of marks."""
    return shapes.select("marks").distinct().select("marks", F.explode("marks").alias("name"), F.lit(1.0).alias("value"))


def features(controls: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys, name, value: the features of controls with signals, which the keys tell apart."""
    rows = described(controls, *keys)
    grams = rows.join(text_features(rows.select("text").distinct()), "text").select(*keys, "name", "value")
    return grams.unionByName(rows.select(*keys, F.explode("marks").alias("name"), F.lit(1.0).alias("value")))


def shapes(rows: DataFrame, *by: str) -> DataFrame:
    """by, text, marks, n: described controls that are alike, and how many they are."""
    return rows.groupBy(*by, "text", "marks").agg(F.count(F.lit(1)).alias("n"))


def count_names(shapes: DataFrame, grams: DataFrame, *by: str) -> DataFrame:
    """by, name, n_controls: how many controls have each feature. ``grams``: text_features() of the texts."""
    texts = shapes.groupBy(*by, "text").agg(F.sum("n").alias("n")).join(grams.select("text", "name"), "text").select(*by, "name", "n")
    marks = shapes.groupBy(*by, "marks").agg(F.sum("n").alias("n")).select(*by, F.explode("marks").alias("name"), "n")
    return texts.unionByName(marks).groupBy(*by, "name").agg(F.sum("n").alias("n_controls"))


def fit_space(rows: DataFrame, least: int = LEAST_CONTROLS, most_char: int = MOST_CHAR, most_word: int = MOST_WORD) -> DataFrame:
    """name, n_controls, idx: the n-grams that the most controls have (``least`` at least), and all indicators, numbered by block and name."""
    return capped(rows.groupBy("name").agg(F.count(F.lit(1)).alias("n_controls")), least, most_char, most_word)


def capped(counted: DataFrame, least: int = LEAST_CONTROLS, most_char: int = MOST_CHAR, most_word: int = MOST_WORD) -> DataFrame:
    """fit_space() from names that are counted (name, n_controls)."""
    of = lambda *blocks: counted.filter(F.substring("name", 1, 1).isin(*blocks))
    top = lambda block, most: of(block).filter(F.col("n_controls") >= least).orderBy(F.desc("n_controls"), "name").limit(most)
    kept = top("c", most_char).unionByName(top("w", most_word)).unionByName(of("t", "o", "s"))
    place = F.array_position(F.array(*map(F.lit, BLOCKS)), F.substring("name", 1, 1))
    return kept.withColumn("idx", (F.row_number().over(Window.orderBy(place, "name")) - 1).cast("int"))  # of a capped vocabulary


def block_counts(space: DataFrame) -> DataFrame:
    return space.groupBy(F.substring("name", 1, 1).alias("block")).agg(F.count(F.lit(1)).alias("n_features"))


def design_matrix(rows: DataFrame, space: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys, indices, values: a control's features that the space has, by number. Names it lacks are dropped, controls are not."""
    met = rows.join(F.broadcast(space.select("name", "idx")), "name", "left")  # capped by block
    own = met.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("idx", "value")))).alias("own"))
    return own.select(*keys, F.transform("own", lambda x: x["idx"]).alias("indices"), F.transform("own", lambda x: x["value"]).alias("values"))


def shape_matrix(shapes: DataFrame, grams: DataFrame, space: DataFrame) -> DataFrame:
    """text, marks, indices, values: the sparse row of each shape. Blocks of texts have lower numbers than those of marks."""
    texts = design_matrix(grams, space, ["text"]).select("text", F.struct("indices", "values").alias("a"))
    marks = design_matrix(mark_features(shapes), space, ["marks"]).select("marks", F.struct("indices", "values").alias("b"))
    both = lambda name, kind: F.concat(*(F.coalesce(F.col(side)[name], F.array().cast(f"array<{kind}>")) for side in "ab")).alias(name)
    met = shapes.select("text", "marks").distinct().join(marks, "marks", "left").join(texts, "text", "left")
    return met.select("text", "marks", both("indices", "int"), both("values", "double"))


def _controls(rows: DataFrame) -> Column:
    """How many controls a row stands for."""
    return F.col("n") if "n" in rows.columns else F.lit(1)


# ---- fits -------------------------------------------------------------------------------------------------------


def class_weights(labels: DataFrame) -> DataFrame:
    """label, weight: balanced, so that every label weighs as much as another."""
    n = labels.groupBy("label").agg(F.sum(_controls(labels)).alias("n"))
    whole = n.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"))
    return n.join(F.broadcast(whole)).select("label", (F.col("all") / (F.col("k") * F.col("n"))).alias("weight"))  # one row a label


def vectors(matrix: DataFrame, width: int) -> DataFrame:
    """The matrix with a column ``features`` of sparse vectors."""
    from pyspark.ml.linalg import Vectors, VectorUDT

    sparse = F.udf(lambda indices, values: Vectors.sparse(width, indices, values), VectorUDT())
    return matrix.withColumn("features", sparse("indices", "values"))


def fit_linear(train: DataFrame, width: int, c: float, iterations: int = 60):
    """A multinomial regression with balanced classes on (label, indices, values; n: controls that a row stands for, else one);
    returns the model and its labels in order."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer

    rows = vectors(train.join(F.broadcast(class_weights(train)), "label").withColumn("weight", F.col("weight") * _controls(train)), width)
    whole = train.agg(F.sum(_controls(train))).first()[0]
    indexer = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(rows)
    indexed = indexer.transform(rows).select("y", "weight", "features")
    model = LogisticRegression(labelCol="y", weightCol="weight", family="multinomial", regParam=1 / (c * whole), standardization=False, maxIter=iterations).fit(indexed)
    return model, list(indexer.labels)


def merged_penalty(penalty: float, whole: float, squares: float) -> float:
    """The penalty of a fit with standardization on rows that stand for several controls (``whole``: the sum of their numbers,
    ``squares``: that of the squares), so that it weighs as on single rows: there the variance has the divisor n - 1, here a smaller one."""
    return penalty * (whole - squares / whole) / (whole - 1)


def score_linear(model, labels: Sequence[str], matrix: DataFrame, width: int) -> DataFrame:
    """The matrix with ``probabilities`` (in the order of the labels)."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(vectors(matrix, width))
    return scored.withColumn("probabilities", vector_to_array("probability")).drop("features", "rawPrediction", "probability", "prediction")


def macro_f1(predicted: DataFrame) -> float:
    """Of (label, predicted; n: controls that a row stands for): the mean F1 over every label that either side names."""
    sides = predicted.groupBy("label", "predicted").agg(F.sum(_controls(predicted)).alias("n"))
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    each = sides.select(F.explode(F.array(F.struct(F.col("label").alias("of"), "n", F.lit(0).alias("m"), hit.alias("hits")), F.struct(F.col("predicted").alias("of"), F.lit(0).alias("n"), F.col("n").alias("m"), F.lit(0).alias("hits")))).alias("x")).select("x.*")
    f1 = each.groupBy("of").agg((2 * F.sum("hits") / (F.sum("n") + F.sum("m"))).alias("f1"))
    return f1.agg(F.avg("f1")).first()[0]


def sweep(matrix: DataFrame, width: int, grid: Sequence[float], iterations: int = 60) -> DataFrame:
    """c, dev_macro_f1, chosen: each strength fitted on the train split and judged on dev; the first of the best is chosen.

    ``matrix``: label, split, indices, values; n: controls that a row stands for. Rows of another split than train and dev are refused."""
    if not matrix.filter(~F.col("split").isin("train", "dev") | F.col("split").isNull()).isEmpty():
        raise ValueError("a choice of strength reads train and dev only")
    train, dev = (matrix.filter(F.col("split") == s).drop("split") for s in ("train", "dev"))
    results = []
    for c in grid:
        model, labels = fit_linear(train, width, c, iterations)
        scored = score_linear(model, labels, dev, width)
        results.append((float(c), macro_f1(scored.withColumn("predicted", named_best(labels)[0]))))
    best = max(range(len(results)), key=lambda k: (results[k][1], -k))
    return matrix.sparkSession.createDataFrame([(c, f, k == best) for k, (c, f) in enumerate(results)], "c double, dev_macro_f1 double, chosen boolean")


def named_best(labels: Sequence[str], probabilities: str = "probabilities") -> tuple[Column, Column, Column]:
    """The best label, its probability and the second label of a row's probabilities; ties go to the earlier label."""
    ranked = F.array_sort(F.transform(probabilities, lambda p, k: F.struct((-p).alias("p"), k.alias("k"))))
    names = F.array(*map(F.lit, labels))
    return F.get(names, ranked[0]["k"]), -ranked[0]["p"], F.get(names, F.get(ranked, F.lit(1))["k"])


# ---- calibration ------------------------------------------------------------------------------------------------

CALIBRATORS = "label string, method string, positives long, thresholds array<double>, knots array<double>, slope double, intercept double"


def fit_calibration(scored: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One calibrator a label from dev rows (label, probabilities; n: controls that a row stands for): monotone steps where it has enough positives, a sigmoid of the
    log-odds below that, the identity where there is nothing to fit."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import IsotonicRegression

    counts = dict(scored.groupBy("label").agg(F.sum(_controls(scored)).alias("n")).collect())  # one row a label
    whole, out = sum(counts.values()), []
    for k, label in enumerate(labels):
        n = counts.get(label, 0)
        rows = scored.select(F.col("probabilities")[k].alias("p"), (F.col("label") == label).cast("double").alias("y"), _controls(scored).cast("double").alias("w"))
        if n < SIGMOID_FROM or n == whole:
            out.append((label, "identity", n, None, None, None, None))
        elif n >= STEPS_FROM:
            model = IsotonicRegression(featuresCol="p", labelCol="y").fit(rows.groupBy("p").agg((F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("y"), F.sum("w").alias("w")), {IsotonicRegression.weightCol: "w"})
            out.append((label, "isotonic", n, [float(x) for x in model.boundaries], [float(x) for x in model.predictions], None, None))
        else:
            p = F.least(F.greatest("p", F.lit(EPSILON)), F.lit(1 - EPSILON))
            fitted = LogisticRegression(labelCol="y", weightCol="w", regParam=1 / whole, standardization=False).fit(rows.select("y", "w", array_to_vector(F.array(F.log(p / (1 - p)))).alias("features")))
            out.append((label, "sigmoid", n, None, None, float(fitted.coefficients[0]), float(fitted.intercept)))
    return scored.sparkSession.createDataFrame(out, CALIBRATORS)


def _calibrated(p: Column, c: Column) -> Column:
    """One probability by one calibrator: interpolated between knots, by the sigmoid of its log-odds, or clipped."""
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    i = F.size(F.filter(c["thresholds"], lambda t: t <= p))
    x0, x1, y0, y1 = (F.get(c[name], k) for name, k in (("thresholds", i - 1), ("thresholds", i), ("knots", i - 1), ("knots", i)))
    between = F.when(i == 0, c["knots"][0]).when(i == F.size(c["thresholds"]), y0).otherwise(y0 + (p - x0) * (y1 - y0) / (x1 - x0))
    inside = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))
    sigmoid = 1 / (1 + F.exp(-(c["slope"] * F.log(inside / (1 - inside)) + c["intercept"])))
    return F.when((c["method"] == "isotonic") & (F.size(c["thresholds"]) > 0), clip(between)).when(c["method"] == "sigmoid", sigmoid).otherwise(clip(p))


def calibrate(scored: DataFrame, calibrators: DataFrame, labels: Sequence[str]) -> DataFrame:
    """``scored`` with ``calibrated``: each probability by its label's calibrator, one against the rest, scaled to a sum of one;
    a row whose values all vanish keeps its raw ones."""
    order = F.array_position(F.array(*map(F.lit, labels)), F.col("label"))
    one = calibrators.groupBy().agg(F.array_sort(F.collect_list(F.struct(order.alias("place"), "method", "thresholds", "knots", "slope", "intercept"))).alias("calibrators"))
    rows = scored.withColumn("calibrators", one.scalar())
    each = rows.withColumn("each", F.zip_with("probabilities", "calibrators", _calibrated)).withColumn("total", F.aggregate("each", F.lit(0.0), lambda s, x: s + x))
    scaled = F.when(F.col("total") > EPSILON, F.transform("each", lambda x: x / F.col("total"))).otherwise(F.col("probabilities"))
    return each.withColumn("calibrated", scaled).drop("calibrators", "each", "total")


# ---- evidence ---------------------------------------------------------------------------------------------------


def top_weights(coefficients: DataFrame, most: int = KEPT_WEIGHTS) -> DataFrame:
    """The greatest coefficients (label, name, weight) of each label; ties by name. A label has at most a vocabulary of them."""
    order = Window.partitionBy("label").orderBy(F.desc("weight"), "name")
    return coefficients.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def linear_coefficients(model, labels: Sequence[str], space: DataFrame, most: int = KEPT_WEIGHTS) -> DataFrame:
    """label, name, weight, place: the model's greatest coefficients a label (labels x vocabulary, both bounded)."""
    import numpy as np

    spark, matrix = space.sparkSession, model.coefficientMatrix.toArray()
    rows = [(label, int(i), float(matrix[k, i])) for k, label in enumerate(labels) for i in np.argsort(-matrix[k], kind="stable")[: 2 * most]]
    named = spark.createDataFrame(rows, "label string, idx int, weight double").join(F.broadcast(space.select("idx", "name")), "idx")
    return top_weights(named.select("label", "name", "weight"), most)


def signal_name(name: Column) -> Column:
    """How evidence names a feature: where it comes from, and what it is."""
    prefix = F.create_map(*(F.lit(x) for pair in BLOCKS.items() for x in pair))[F.substring(name, 1, 1)]
    return F.concat(prefix, F.substring(name, 2, 1 << 20))


def _told(first: Column, second: Column, label: Column) -> Column:
    """The signals of ranked pulls (loss, name) to the first and second label; null ones are none."""
    names = lambda ranked, most: F.coalesce(F.slice(F.transform(ranked, lambda x: signal_name(x["name"])), 1, most), F.array().cast("array<string>"))
    signals = F.array_distinct(F.concat(names(first, MOST_SIGNALS - SECOND_SIGNALS), names(second, SECOND_SIGNALS)))
    own = F.when(label == "UNKNOWN", F.concat(F.array(F.lit("ngram:abstain:unknown-class")), signals)).otherwise(signals)
    return F.slice(own, 1, MOST_SIGNALS)


def _pulls(rows: DataFrame, asked: DataFrame, weights: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Keys, of, and the strongest (loss, name) that draw a row to the label ``of``, as many as may be shown. ``asked``: keys, of, each once."""
    kept = weights.select(F.col("label").alias("of"), "name", "weight")  # some tens a label
    met = rows.join(F.broadcast(kept), "name").withColumn("loss", -(F.col("value") * F.col("weight"))).filter("loss < 0").join(asked, [*keys, "of"])
    return met.groupBy(*keys, "of").agg(F.slice(F.array_sort(F.collect_list(F.struct("loss", "name"))), 1, MOST_SIGNALS - SECOND_SIGNALS).alias(name))


def evidence(rows: DataFrame, predicted: DataFrame, weights: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys and ``signals``: the features that drew a row to its label, the strongest first (six), then those that drew it to the
    second one (two, each name once), eight at most. A contribution is value times weight; only positive ones count.

    ``predicted``: keys, label, second. An abstention (UNKNOWN) says so first."""
    sides = predicted.select(*keys, F.explode(F.array("label", "second")).alias("of")).distinct()
    pulls = _pulls(rows, sides, weights, keys, "pulls")
    own = predicted.select(*keys, "label", "second")
    for side in ("label", "second"):
        own = own.join(pulls.select(*keys, F.col("of").alias(side), F.col("pulls").alias(f"{side}_pulls")), [*keys, side], "left")
    return own.select(*keys, _told(F.col("label_pulls"), F.col("second_pulls"), F.col("label")).alias("signals"))


def shape_evidence(cases: DataFrame, grams: DataFrame, weights: DataFrame) -> DataFrame:
    """``cases`` (text, marks, label, second, each once) with ``signals``, as evidence() has them: a shape's strongest features
    are among its text's strongest and its marks' strongest."""
    own, sides = cases, cases.select("text", "marks", F.explode(F.array("label", "second")).alias("of"))
    for key, rows in (("text", grams), ("marks", mark_features(cases))):
        pulls = _pulls(rows, sides.select(key, "of").distinct(), weights, [key], "pulls")
        for side in ("label", "second"):
            own = own.join(pulls.select(key, F.col("of").alias(side), F.col("pulls").alias(f"{key}_{side}")), [key, side], "left")
    none = F.array().cast("array<struct<loss:double,name:string>>")
    ranked = (F.array_sort(F.concat(*(F.coalesce(F.col(f"{key}_{side}"), none) for key in ("text", "marks")))) for side in ("label", "second"))
    return own.select(*cases.columns, _told(*ranked, F.col("label")).alias("signals"))
