"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstore.plans.shared import fresh_path, join_counted, keep, shared_dir, with_keys, without_keys

__all__ = ["fresh_path", "join_counted", "keep", "lower_ascii", "map_arrow", "shared_dir", "only", "small_batches", "table", "with_keys", "without_keys"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what one Arrow batch holds, for tables with very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with ``fn(batch) -> dict of columns`` for each batch."""
    small_batches(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn(b)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in kind], schema=kind)

    return df.mapInArrow(run, schema)


_LIVE: dict = {}


def only(key, make):
    """What ``make`` gives for ``key``, kept in this worker process until another key is asked for.

    Workers outlive the stages of a pipeline; so the memo of one operator goes before that of the next fills.
    """
    if key not in _LIVE:
        _LIVE.clear()
        _give_back()  # also what stages without a memo have left
        _LIVE[key] = make()
    return _LIVE[key]


def _give_back() -> None:
    """Returns what was freed to the system: Arrow's pool, and the C library's where it can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass
