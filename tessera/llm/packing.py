"""Best-fit packing of token pieces into fixed-size sequences, in bulk-synchronous sweeps.

Documents longer than a sequence are cut; all pieces are then packed best fit, longest first. Pieces
of one length are interchangeable, and so are gaps of one size, so the range-sorted documents are a
rank within each length, and a sweep works on runs of ranks:

* a superstep takes the pieces of one length, from the longest down;
* the successor sweep goes up from that length through the sizes of open gaps: the smallest gap that
  fits is the best fit;
* conflicts are resolved by rank: a run of gaps takes the pieces of the lowest ranks, as many as fit
  into each, and the rest goes on to the next size or, at the end, to new sequences;
* the gaps shrink together, and the next superstep begins.

That is exactly best-fit decreasing. Ranks are counted by Spark in salted groups and matched to the
sweeps' runs by a join. Only the histogram of lengths (at most one number for each token count up to
the capacity) reaches the driver, and the runs, whose number depends on the capacity and not on the
documents, go back.

Defined results: null texts are empty and still hold their end token; repeated rows (equal doc_id and
text) are packed as separate pieces; an empty table packs nothing; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import released, stored, table
from tessera.llm.segments import REMEMBERED_WORDS, word_memory, word_parts

CAPACITY, END = 2048, b"\0\0\0\0"
#: Pieces that one salted rank group holds on average at most, and the fewest groups of a length.
RANK_GROUP, LEAST_SALTS = 500_000, 32
#: Texts that are looked up together.
TEXTS = 64
#: The runs are broadcast up to this number (some 40 bytes each).
BROADCAST_RUNS = 200_000


def _cutter(path: str, capacity: int, remembered: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = word_memory(path, remembered)
        for batch in batches:
            rows = []
            for at in range(0, len(batch), TEXTS):
                some = batch.iloc[at : at + TEXTS]
                parts = [word_parts(t) if t else [] for t in some["text"]]
                memory.learn(parts)
                for doc_id, own in zip(some["doc_id"], parts, strict=True):
                    ids = b"".join(map(memory.__getitem__, own)) + END
                    for k, begin in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[begin : begin + 4 * capacity]
                        rows.append((doc_id, k, begin // 4, len(piece) // 4, piece))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"])

    return cut


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, remembered: int = REMEMBERED_WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of every piece."""
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    schema = "doc_id string, piece int, start long, length long, ids binary"
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))  # pandas has no null integers
    return rows.mapInPandas(released(_cutter(path, capacity, remembered)), schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def sweep(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, rank_from, rank_to, first sequence, pieces a sequence, offset) of best-fit decreasing."""
    open_runs: dict[int, list[tuple[int, int]]] = {}  # gap size to runs of sequences (first, count)
    sizes: list[int] = []
    runs, opened = [], 0

    def free(size: int, first: int, count: int) -> None:
        if size and count:
            if size not in open_runs:
                open_runs[size] = []
                insort(sizes, size)
            open_runs[size].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                size = sizes[at]
                first, count = open_runs[size].pop()
                if not open_runs[size]:
                    del open_runs[size], sizes[at]
            else:
                size, first, count = capacity, opened, -(-left // (capacity // length))
                opened += count
            each = size // length
            full, rest = min(count, left // each), 0
            if full < count:
                rest = left - full * each
            for gaps, taken in ((full, each), (1 if rest else 0, rest)):
                if gaps:
                    runs.append((length, rank, rank + gaps * taken, first, taken, capacity - size))
                    free(size - taken * length, first, gaps)
                    rank, left, first, count = rank + gaps * taken, left - gaps * taken, first + gaps, count - gaps
            free(size, first, count)
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a stored table with doc_id, piece and length) with sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = max(LEAST_SALTS, -(-sum(histogram.values()) // RANK_GROUP))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    rows = sweep(histogram, capacity)
    plan = spark.createDataFrame(rows, "length long, rank_from long, rank_to long, first long, each long, base long")
    if len(rows) <= BROADCAST_RUNS:
        plan = F.broadcast(plan)
    matched = ranked.join(plan, (ranked["length"] == plan["length"]) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))).drop(plan["length"])
    nth = F.col("rank") - F.col("rank_from")
    return matched.select(
        *pieces.columns,
        (F.col("first") + F.floor(nth / F.col("each"))).alias("sequence_id"),
        (F.col("base") + F.pmod(nth, F.col("each")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    """Packed pieces with their ids."""
    return pack(stored(token_pieces(docs, capacity, tokenizer_path), "pieces"), capacity)


def packed_digests(docs: DataFrame, remembered: int = REMEMBERED_WORDS) -> DataFrame:
    """Packed pieces with a checksum in place of their ids; ``remembered``: words that a worker remembers."""
    pieces = token_pieces(docs, remembered=remembered).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(stored(pieces, "pieces"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
