"""Auditing a stream of pages: a page's audit needs no state, so each micro-batch runs the batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.decide import findings
from tessera.operators.rules import predict, signals, visible


def audit(controls: DataFrame, honeypots: bool = False) -> DataFrame:
    """Findings of controls, of honeypots only on request; the same plan for tables and micro-batches."""
    return findings(predict(signals(controls if honeypots else visible(controls))))


def audit_stream(spark: SparkSession, path: str, schema, out: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Audit Parquet files of controls as they arrive below ``path``; findings are appended to ``out``."""
    arriving = spark.readStream.schema(schema).parquet(path)
    batch = lambda df, _: audit(prepare(df)).write.mode("append").parquet(out)
    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled_sessions(events: DataFrame, quiet: str = "30 minutes", budget: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Bursts of a user's events that end after a quiet time; those longer than the budget are marked as not settled.

    Works on streams (with a watermark) and tables alike."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    bursts = kept.groupBy("user_id", F.session_window("ts", quiet).alias("burst")).agg(F.count(F.lit(1)).alias("n_events"), F.max("ts").alias("last"))
    started = F.col("burst.start")
    return bursts.select("user_id", started.alias("started"), "n_events", (F.col("last") <= started + F.expr(f"interval {budget}")).alias("settled"))
