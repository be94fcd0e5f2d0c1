"""Exact top-k by inner product: a Voronoi kNN join.

Inner products become distances by one more coordinate, sqrt(M^2 - |x|^2) for data (M: the greatest
norm) and 0 for queries: the nearest are then those with the greatest product. Data and queries are
dealt to the cells of pivots, whose number grows with the square root of the rows up to a bound.
Per-cell summaries (least and greatest distance to the pivot, the k + 1 least distances) bound how far
a query's k-th neighbour can be. Neighbouring query cells form groups of about a block of queries; a
data row is copied to a group only if the triangle inequality allows it within the bound of one of the
group's cells (a ring around the row's own pivot). Groups are solved locally in as many blocks as the
rows that reach them fill, and the blocks' k best are merged by rank.

Equal vectors can only take ranks by their least ids: of each distinct vector the k + 1 smallest ids
take part (its own query may be one of them), so a vector that fills the table costs a few rows.

Scores are exact integers: vectors are floor(256 * x); products are formed in doubles while they stay
below 2^53, else in Python integers.

Defined results: null vectors and vectors with null or non-finite components take no part; only
vectors of equal length are compared; ties go to the smaller vec_id; rows with the query's own id
are never candidates; null ids take no part; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored, table

K, QUERY_EVERY, SCALE = 5, 50, 256
#: Pivots are the square root of the rows, but at least and at most so many (those with the least hashed ids).
LEAST_PIVOTS, MOST_PIVOTS = 32, 1024
#: Rows of a block of data, and of a block of queries, in one local join.
BLOCK, QUERY_BLOCK = 8192, 2048
#: Queries whose products a local join holds at once.
STEP = 128
#: Bounds are widened by this share against rounding.
SLACK = 1e-6


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the vector in integers, of the rows that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter("vec_id is not null and x is not null and size(x) > 0")
    return rows.filter(F.coalesce(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))).select(
        "vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v")
    )


def _lifted(v: np.ndarray, reach2: float | None) -> np.ndarray:
    x = v.astype(float)
    last = np.zeros(len(x)) if reach2 is None else np.sqrt(np.maximum(reach2 - (x * x).sum(axis=1), 0))
    return np.column_stack([x, last])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T, 0))


def products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    bound = np.abs(queries).max(initial=0).astype(float) * np.abs(data).max(initial=0).astype(float) * queries.shape[1]
    if bound < 2.0**53:
        return (queries.astype(float) @ data.astype(float).T).astype(np.int64)
    return (queries.astype(object) @ data.astype(object).T).astype(np.int64)


def _assign(pivots: np.ndarray, reach2: float | None):
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                far = _distances(_lifted(np.stack(b["v"]), reach2), pivots)
                cell = far.argmin(axis=1)
                yield b.assign(cell=cell.astype(np.int32), far=far[np.arange(len(b)), cell])

    return assign


def _solve(k: int):
    def solve(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(data):
            data = data.sort_values("vec_id")
            ids, d = data["vec_id"].to_numpy(), np.stack(data["v"])
            asked = np.stack(queries["v"])
            steps = (products(asked[at : at + STEP], d) for at in range(0, len(asked), STEP))
            for query, row in zip(queries["vec_id"], (row for score in steps for row in score), strict=True):
                row = np.where(ids == query, np.iinfo(np.int64).min, row)
                best = np.lexsort((ids, -row))[:k] if len(row) <= 4 * k else None
                if best is None:  # all that reach the k-th score, then by id
                    least = np.partition(row, -k)[-k]
                    near = np.flatnonzero(row >= least)
                    best = near[np.lexsort((ids[near], -row[near]))[:k]]
                out += [(query, ids[i], row[i]) for i in best if ids[i] != query]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return solve


def groups_of(at: np.ndarray, sizes: dict[int, int], most: int) -> list[list[int]]:
    """Query cells (with their numbers of queries) in groups of about ``most`` queries: a walk to the nearest cell that is left, cut by size."""
    left, walk = sorted(sizes), []
    while left:
        near = left[0] if not walk else left[int(_distances(at[walk[-1:]], at[left])[0].argmin())]
        walk.append(near)
        left.remove(near)
    groups: list[list[int]] = []
    room = 0
    for cell in walk:
        if not groups or sizes[cell] > room:
            groups.append([])
            room = most
        groups[-1].append(cell)
        room -= sizes[cell]
    return groups


def rings(at: np.ndarray, cells: pd.DataFrame, reach: dict[int, float], groups: list[list[int]], k: int) -> pd.DataFrame:
    """cell, group, low, high: the rows of a cell, by their distance to its pivot, that a group of query cells may need.

    cells: cell, low, high (extent) and near (the k + 1 least distances); reach: the greatest distance of a query to its pivot.
    pivots x pivots numbers at most."""
    own, low, high = (cells[c].to_numpy() for c in ("cell", "low", "high"))
    near = np.array([list(n) + [np.inf] * (k + 1 - len(n)) for n in cells["near"]]).reshape(len(cells), k + 1)
    out = []
    for g, members in enumerate(groups):
        between = _distances(at[members], at[own])
        far = np.array([reach[q] for q in members])
        upper = (far[:, None, None] + between[:, :, None] + near[None]).reshape(len(members), -1)
        bound = np.partition(upper, k, axis=1)[:, k] if upper.shape[1] > k else np.full(len(members), np.inf)
        slack = (far + bound)[:, None]  # |q - x| >= |d(pivots) - far(x)| - reach, so far(x) must lie in a ring
        first, last = between - slack, between + slack
        first, last = first - SLACK * (1 + np.abs(first)), last + SLACK * (1 + np.abs(last))
        met = (first <= high) & (last >= low)  # cells that no ring of the group touches get no row
        first, last = np.where(met, first, np.inf).min(axis=0), np.where(met, last, -np.inf).max(axis=0)
        kept = met.any(axis=0)
        out.append(pd.DataFrame({"cell": own[kept], "group": np.int32(g), "low": first[kept], "high": last[kept]}))
    return pd.concat(out).astype({"cell": np.int32, "group": np.int32})


def _same_length(rows: DataFrame, queries: DataFrame, k: int, pivots: int | None) -> DataFrame:
    """Top k of queries against rows (vec_id, v), all of one length, both stored."""
    spark = rows.sparkSession
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    n, reach2 = rows.agg(F.count(F.lit(1)), F.max(square)).first()
    if n == 0:
        return spark.createDataFrame([], "query_id long, vec_id long, score long")
    pivots = pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, int(n**0.5)))
    centres = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("v").collect()])
    at = _lifted(centres, reach2)
    schema = "vec_id long, v array<long>, cell int, far double"
    data = stored(rows.mapInPandas(_assign(at, reach2), schema), "cells")
    asked = stored(queries.mapInPandas(_assign(at, None), schema), "query-cells")

    # Summaries: a cell has its extent and its k + 1 least distances (one of them may be the query itself).
    near = data.withColumn("nth", F.row_number().over(Window.partitionBy("cell").orderBy("far"))).filter(F.col("nth") <= k + 1)
    nearest = near.groupBy("cell").agg(F.sort_array(F.collect_list("far")).alias("near"))
    extent = data.groupBy("cell").agg(F.min("far").alias("low"), F.max("far").alias("high"))
    cells = pd.DataFrame([r.asDict() for r in extent.join(nearest, "cell").collect()])
    of_query = asked.groupBy("cell").agg(F.max("far").alias("reach"), F.count(F.lit(1)).alias("n")).collect()
    groups = groups_of(at, {r["cell"]: r["n"] for r in of_query}, QUERY_BLOCK)
    made = rings(at, cells, {r["cell"]: r["reach"] for r in of_query}, groups, k)
    ring = F.broadcast(spark.createDataFrame([tuple(r) for r in made.itertuples(index=False)], "cell int, group int, low double, high double"))
    spread = data.join(ring, "cell").filter(F.col("far").between(F.col("low"), F.col("high"))).drop("low", "high")
    reached = {r["group"]: r["count"] for r in spread.groupBy("group").count().collect()}  # a scan of two columns

    asks = {r["cell"]: r["n"] for r in of_query}
    shape = [(g, -(-sum(asks[c] for c in own) // QUERY_BLOCK), max(1, -(-reached.get(g, 0) // BLOCK))) for g, own in enumerate(groups)]
    shapes = F.broadcast(spark.createDataFrame(shape, "group int, parts int, blocks int"))  # at most one row a query cell, as the next
    place = F.broadcast(spark.createDataFrame([(c, g) for g, own in enumerate(groups) for c in own], "cell int, group int"))
    dealt = lambda by: F.pmod(F.xxhash64("vec_id"), F.col(by)).cast("int")
    every = lambda by: F.explode(F.sequence(F.lit(0), F.col(by) - 1))
    spread = spread.join(shapes, "group").withColumn("block", dealt("blocks")).withColumn("part", every("parts"))
    asked = asked.join(place, "cell").join(shapes, "group").withColumn("part", dealt("parts")).withColumn("block", every("blocks"))
    key = ["group", "part", "block"]
    left, right = asked.select(*key, "vec_id", "v").groupBy(*key), spread.select(*key, "vec_id", "v").groupBy(*key)
    return left.cogroup(right).applyInPandas(_solve(k), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of ``vectors`` (both vec_id, v)."""
    spark = vectors.sparkSession
    within = Window.partitionBy("v").orderBy("vec_id")
    distinct = vectors.dropDuplicates(["vec_id", "v"]).withColumn("nth", F.row_number().over(within)).filter(F.col("nth") <= k + 1)
    rows = stored(distinct.select("vec_id", "v", F.size("v").alias("length")), "vectors")
    asked = stored(queries.dropDuplicates(["vec_id"]).select("vec_id", "v", F.size("v").alias("length")), "queries")
    found = None
    for (length,) in asked.select("length").distinct().collect():  # one in a well-formed table
        own, ask = (t.filter(F.col("length") == length).select("vec_id", "v") for t in (rows, asked))
        part = _same_length(own, ask, k, pivots)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integers(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.filter(F.col("vec_id") % QUERY_EVERY == 0))


QUERIES = {"op3_topk": op3_topk}
ORACLES = {
    "op3_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """
}
