"""Windows over result frames: numbers in a group, the whole group, and the group up to a row."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def spec(part: list[str], order: list[Column]):
    return Window.partitionBy(*part).orderBy(*order)


def whole(frame: DataFrame, part: list[str], **columns: Column) -> DataFrame:
    """An aggregate of the row's whole group."""
    over = Window.partitionBy(*part)
    return frame.withColumns({n: c.over(over) for n, c in columns.items()})


def running(frame: DataFrame, part: list[str], order: list[Column], **columns: Column) -> DataFrame:
    """An aggregate of the group up to and including the row; rows that tie are taken one by one, so add a tie-break."""
    over = spec(part, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return frame.withColumns({n: c.over(over) for n, c in columns.items()})


def ranked(frame: DataFrame, part: list[str], order: list[Column], **columns: Column) -> DataFrame:
    """row_number, rank, dense_rank, lag and lead: several of one spec are computed in one pass."""
    over = spec(part, order)
    return frame.withColumns({n: c.over(over) for n, c in columns.items()})


def folded(frame: DataFrame, part: list[str], order: list[Column], name: str, fold: Callable, columns: list[str], kind: str, running: bool = True) -> DataFrame:
    """Any function of the group up to and including the row, or of the whole group: ``fold`` gets a pandas Series for each column.

    It runs in Python once for each row over all rows of its frame, so a group must fit in a task; what Columns can say
    belongs in ``whole`` and ``running``.
    """
    over = spec(part, order).rowsBetween(Window.unboundedPreceding, Window.currentRow if running else Window.unboundedFollowing)

    def work(*series: pd.Series) -> Any:
        return fold(*series)

    return frame.withColumn(name, F.pandas_udf(work, kind, F.PandasUDFType.GROUPED_AGG)(*columns).over(over))
