"""Consecutive numbers and ranks for the rows of a DataFrame, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import cut


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """``df`` with ``name``: start, start + 1, ... in the order of ``order`` (rows that tie, in any order).

    Rows are range-partitioned, cut, counted by partition, and numbered inside partitions; the driver sees one count for
    each partition.
    """
    return ranked(df, [F.col(c) for c in order], name, start=start)


def ranked(df: DataFrame, order: list[Column], number: str, rank: str | None = None, dense: str | None = None, start: int = 1) -> DataFrame:
    """``df`` with its rows' numbers in the given order, and if named their ranks, with and without gaps. No order: any.

    Rows that tie share a partition, so ranks inside a partition and what the partitions before it hold add up.
    """
    placed = df.repartitionByRange(*order) if order else df
    parts = cut(placed.withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*(order or [F.lit(0)]))
    if dense is not None:
        parts = parts.withColumn("_dense", F.dense_rank().over(inside))
    counts = sorted(map(tuple, parts.groupBy("_part").agg(F.count(F.lit(1)), F.max("_dense") if dense is not None else F.lit(0)).collect()))
    before, rows, values = [], start, start
    for part, n, d in counts:
        before.append((part, rows, values))
        rows, values = rows + n, values + d
    offsets = df.sparkSession.createDataFrame(before, "_part int, _rows bigint, _values bigint")  # one row for each partition
    out = {number: F.col("_rows") + F.row_number().over(inside) - 1}
    if rank is not None:
        out[rank] = F.col("_rows") + F.rank().over(inside) - 1
    if dense is not None:
        out[dense] = F.col("_values") + F.col("_dense") - 1
    return parts.join(F.broadcast(offsets), "_part").withColumns(out).drop("_part", "_dense", "_rows", "_values")
