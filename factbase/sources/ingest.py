"""Frames for entities from files that have their own keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..db import Db
from ..operators.numbering import numbered
from ..schema import Entity


def keyed(frame: DataFrame, key: str, start: int) -> DataFrame:
    """eids from a whole-number key of one class: start + key. No job, no shuffle; the key must be unique and not negative."""
    return frame.withColumn("eid", F.lit(start) + F.col(key).cast("bigint"))


def counted(frame: DataFrame, order: list[str], start: int) -> DataFrame:
    """eids by counting, for classes without such a key."""
    return numbered(frame, order, "eid", start)


def to_ref(frame: DataFrame, column: str, start: int) -> DataFrame:
    """A foreign key into the eids that ``keyed`` gave the other class."""
    return frame.withColumn(column, F.lit(start) + F.col(column).cast("bigint"))


def database(spark, frames: dict[Entity, DataFrame], start: int = 1 << 50) -> Db:
    return Db.from_frames(spark, frames, start)


ROWS = 1 << 36  # rows of a file


def placed(frame: DataFrame, start: int) -> DataFrame:
    """eids from the place of a row in the Parquet files that ``frame`` scans, for classes without a key: no job, no shuffle,
    and pruned when unused. The files must not change; they count in the order of their names."""
    files = sorted(frame.inputFiles())
    number = F.create_map(*[F.lit(x) for i, f in enumerate(files) for x in (f.rsplit("/", 1)[1], i * ROWS)])
    return frame.withColumn("eid", F.lit(start) + number[F.regexp_extract(F.col("_metadata.file_path"), "[^/]*$", 0)] + F.col("_metadata.row_index"))
