"""Token counts with a digest cache.

Counts are stored under (digest of the normalised content, digest of the tokenizer's file). Only
contents that the cache lacks are encoded, each once however many documents hold it, and then
appended to the cache, a Parquet table in the shared folder.

Digests, not texts, are grouped; texts move once, to be joined with the representatives of missing
contents. The headers and the cache are read from tables when they meet, so that adaptive execution
can split the key of a content that fills a third of the rows.

Defined results: null counts as the empty text (0 tokens); repeated rows each get their row; the
word start sign U+2581 is normalised to a blank, which the tokenizer cannot tell from it; null ids
are kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import released, scratch, stored, table
from tessera.llm.segments import piece_count_memory, piece_parts

LIMIT = 4096
CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def _counter(path: str):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = piece_count_memory(path)
        for batch in batches:
            parts = [piece_parts(t) for t in batch["content"]]
            memory.learn(parts)
            yield pd.DataFrame({"digest": batch["digest"], "n_tokens": [sum(map(memory.__getitem__, p)) for p in parts]})

    return count


def token_counts(docs: DataFrame, cache_path: str, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each row; the cache at ``cache_path`` grows by what it lacked."""
    spark = docs.sparkSession
    path = tokenizer_path or public_tokenizers.path("piece_bpe_32k.model")
    version = tokenizer_digest(path)
    text = F.coalesce(F.col("text"), F.lit(""))
    content = F.translate(text, "▁", " ")
    rows = docs.select("doc_id", F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), content.alias("content"))
    headers = stored(rows.drop("content"), "headers")

    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    cached = lambda: spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # noqa: E731  (appends that met or were repeated)
    missing = headers.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(cached(), "digest", "left_anti")
    same = rows["digest"].eqNullSafe(F.col("m.digest")) & rows["doc_id"].eqNullSafe(F.col("m.doc_id"))
    to_encode = rows.join(missing.alias("m"), same, "left_semi").select("digest", "content")
    encoded = to_encode.mapInPandas(released(_counter(path)), "digest binary, n_tokens long")
    encoded.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")).select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    return headers.join(cached(), "digest", "left").select("doc_id", "n_bytes", "n_tokens")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark, "token-cache"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLES: dict[str, str] = {}
