"""Document fingerprints by I-Match, in DataFrame functions only.

Terms (lower-case runs of letters and digits) are counted over all documents. The lexicon holds the
terms whose document frequency lies in a band of shares of the corpus; a document's lexicon terms,
distinct and sorted, are dealt to randomised subsets that together are the lexicon, and each subset's
terms are hashed. Two fingerprints are alike by the share of their subset hashes that agree.

The band's lower edge bounds the lexicon: at most (mean distinct terms a document) / LOW terms reach
it, whatever the corpus size. So it may stand as a constant set in the plan, and a document is
fingerprinted in its own row: no term is joined, no document regrouped.

Defined results: null texts are empty; a fingerprint whose subsets are all empty is a row of zeros,
and two such are alike (1.0) only if the texts are equal; documents with one id follow each other by
text; null ids come after all others; the document after the last is the first, so a single document
follows itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table

#: Shares of the documents that hold a lexicon term: at least LOW (and two documents), at most HIGH.
LOW, HIGH = 0.005, 0.05
#: Randomised subsets: a hash deals each term to one of RARITY, and all of them are used, so that no lexicon term is left out.
SUBSETS = RARITY = 128
#: Rows that a range of document ids should hold, and the fewest and most ranges.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 1500, 256, 20_000
_LOWEST = -(2**63)


def terms(text: str) -> str:
    """SQL for the hashes of the distinct terms in the column ``text``."""
    return rf"array_distinct(transform(filter(split(lower({text}), r'[^\p{{L}}\p{{N}}]+'), w -> w <> ''), w -> xxhash64(w)))"


def lexicon(docs: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH) -> list[int]:
    """The term hashes within the document-frequency band, over all documents."""
    total = docs.count()
    found = docs.select(F.explode(F.expr(terms(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    band = found.filter(F.col("n").between(max(2, low * total), max(2, high * total)))
    return sorted(r["term"] for r in band.select("term").collect())


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, as the variable of a lambda."""
    return F.transform(F.array(value), use)[0]


def fingerprint(text: str, kept: list[int], subsets: int = SUBSETS, rarity: int = RARITY) -> Column:
    """For the column ``text``: one hash a subset of the lexicon, 0 where the text has none of its terms."""
    if not kept:
        return F.array_repeat(F.lit(0).cast("long"), subsets)
    own = F.expr(f"filter({terms(text)}, t -> t IN ({', '.join(f'{k}L' for k in kept)}))")  # one string: thousands of literals are slow to pass singly
    dealt = F.sort_array(F.transform(own, lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(rarity)).cast("int").alias("subset"), t.alias("term"))))

    def all_hashed(own: Column) -> Column:
        def hashed(m: Column) -> Column:  # a subset's terms lie side by side
            first, last = F.array_position(own["subset"], m), F.size(own["term"]) + 1 - F.array_position(own["back"], m)
            return F.when(first == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.slice(own["term"], first.cast("int"), (last - first + 1).cast("int"))))

        return F.transform(F.sequence(F.lit(0), F.lit(subsets - 1)), hashed)

    return _bound(dealt, lambda d: _bound(F.struct(d["subset"].alias("subset"), F.reverse(d["subset"]).alias("back"), d["term"].alias("term")), all_hashed))


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """Share of the subsets with terms in either fingerprint whose hashes agree; ``equal``: the texts are equal."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    used = F.size(F.filter(pairs, lambda p: (p["a"] != 0) | (p["b"] != 0)))
    same = F.size(F.filter(pairs, lambda p: (p["a"] == p["b"]) & (p["a"] != 0)))
    return F.when(equal, 1.0).when(used == 0, 0.0).otherwise(same / used)


def with_next(rows: DataFrame, columns: list[str], made: dict[str, Column] | None = None) -> DataFrame:
    """The rows (doc_id, text, ...) with ``next_<column>`` of the row after each by descending doc_id.

    Ids are dealt to ranges; the first rows of a range are copied to the end of the range before it,
    so that each range finds all its successors by itself. Columns of ``made`` follow from a row's own;
    they and their ``next_`` are made where the rows were dealt to, so that the shuffle does not carry them.
    """
    keyed = rows.withColumn("key", F.coalesce("doc_id", F.lit(_LOWEST)))
    n, least, most = keyed.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    ranges = min(MOST_RANGES, max(LEAST_RANGES, n // RANGE_ROWS))
    least, most = least or 0, most or 0
    even = F.when(F.col("doc_id").isNull(), 0).otherwise(F.floor((F.col("key") - F.lit(least).cast("double")) / (most - least + 1) * ranges).cast("int"))
    sizes = keyed.groupBy(even.alias("range")).agg(F.count(F.lit(1)).alias("n"))
    if n and sizes.agg(F.max("n")).first()[0] > 8 * n / min(n, ranges) + 8 * RANGE_ROWS:  # ids lie unevenly: cut them at their quantiles
        cuts = keyed.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 100_000)).first()[0]
        even = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col("key")))
    keyed = keyed.withColumn("range", even)
    firsts = [tuple(r) for r in keyed.groupBy("range").agg(F.max("key").alias("first")).orderBy(F.desc("range")).collect()]
    before = [(key, k, firsts[i - 1][0]) for i, (k, key) in enumerate(firsts)]  # of the last range for the first one
    edges = rows.sparkSession.createDataFrame(before, "edge long, range int, before int")
    at = lambda where, ghost: F.struct(where.alias("range"), F.lit(ghost).alias("ghost"))
    places = F.when(F.col("key") == F.col("edge"), F.array(at(F.col("range"), False), at(F.col("before"), True))).otherwise(F.array(at(F.col("range"), False)))
    dealt = keyed.join(F.broadcast(edges), "range").select(*rows.columns, "key", F.explode(places).alias("place"))
    dealt = dealt.select(*rows.columns, "key", "place.range", "place.ghost")  # plain columns: both windows are seen to be in one order
    order = Window.partitionBy("range").orderBy("ghost", F.desc("key"), "text")
    leads = lambda names: [F.lead(c).over(order).alias(f"next_{c}") for c in names]
    follow = dealt.select("*", *leads(columns))
    if made:
        follow = follow.withColumns(made).select("*", *leads(made))  # in the same order: no second shuffle or sort
    return follow.filter(~F.col("ghost")).drop("key", "range", "ghost")


def _text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda h: F.lower(F.hex(h))), ".")


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kept = lexicon(docs)
    rows = with_next(docs, ["text"], {"print": fingerprint("text", kept)})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", edited)
    rows = rows.withColumn("edited_print", fingerprint("edited", kept))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        _text(F.col("print")).alias("fingerprint"),
        _text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print"), F.col("text") == F.col("edited")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print"), F.col("text") == F.col("next_text")).alias("near_next"),
    )


QUERIES = {"op10_imatch": op10_imatch}
ORACLES: dict[str, str] = {}
