"""Table access and session settings of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.shared import dropped, scratch, shared_dir, stored  # noqa: F401

#: Rows an Arrow batch carries to a Python worker; a batch of ordinary documents stays near 1 MB.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released(function):
    """A batch function of mapInPandas that gives its memory back to the machine when a task ends.

    Python workers live on from one stage to the next; what earlier stages freed would else stay with them."""

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return run
