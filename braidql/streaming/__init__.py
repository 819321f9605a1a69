"""Structured Streaming with the same filters.

A filter that keeps rows one by one (projections, selections, assignments) runs
on a stream as it is; others run on each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..plans import compile_filter


def read_stream(spark: SparkSession, path: str, schema: Any, format: str = "parquet", files_per_batch: int | None = None, **options: Any) -> DataFrame:
    reader = spark.readStream.format(format).schema(schema).options(**options)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def apply(stream: DataFrame, text: str, params: dict[str, Any] | None = None) -> DataFrame:
    """A row-wise filter on a stream."""
    return compile_filter(text, stream, params)


def for_each_batch(stream: DataFrame, text: str, sink: Callable[[DataFrame, int], None], checkpoint: str, params: dict[str, Any] | None = None) -> StreamingQuery:
    """Any filter on every micro-batch; results go to ``sink``."""
    run = lambda batch, n: sink(compile_filter(text, batch, params), n)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stateful(stream: DataFrame, keys: list[str], fn: Callable[[tuple, Iterator, GroupState], Iterator], schema: str, state: str, mode: str = "append", timeout: str = "NoTimeout") -> DataFrame:
    """A Python function with a state of its own for each key.

    ``fn`` takes the key, pandas frames of its new rows and the state, which
    outlives batches and lost executors in the query's checkpoint.
    """
    return stream.groupBy(*keys).applyInPandasWithState(fn, schema, state, mode, timeout)


def tumbling(df: DataFrame, at: str, size: str, aggs: list, keys: tuple[str, ...] = (), late: str | None = None, slide: str | None = None) -> DataFrame:
    """Aggregates over event-time windows; ``late``: how long late rows are waited for."""
    df = df.withWatermark(at, late) if late else df
    return df.groupBy(F.window(at, size, slide), *keys).agg(*aggs).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "*").drop("window")


def sessions(df: DataFrame, at: str, gap: str, aggs: list, keys: tuple[str, ...] = (), late: str | None = None) -> DataFrame:
    """Aggregates over sessions that a pause of ``gap`` ends."""
    df = df.withWatermark(at, late) if late else df
    return df.groupBy(F.session_window(at, gap).alias("window"), *keys).agg(*aggs).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "*").drop("window")


def deduplicate(df: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Rows whose keys were not seen within the watermark."""
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
