"""The stored log as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..db import LOG
from ..operators.cow import FactTable


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """Facts of a ``ParquetStorage`` as they are committed; rename makes a transaction's files appear whole."""
    return spark.readStream.schema(LOG).option("basePath", path).option("pathGlobFilter", "*.parquet").parquet(f"{path}/tx=*")


def each_batch(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]):
    """Give what is there now to ``work`` in micro-batches, then end. A batch may come again after a failure, under the same number."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_facts(stream: DataFrame, checkpoint: str, table: FactTable):
    """Apply a stream of feed rows (e, a, v, t, seq, op) to a copy-on-write table. Applying a batch twice changes nothing."""
    return each_batch(stream, checkpoint, lambda batch, _: table.apply(batch) and None)
