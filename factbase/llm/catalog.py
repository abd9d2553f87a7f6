"""The queries of this subpackage and, where DuckDB can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.shared import table
from . import leakage, repetition, tokenize


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.encoded(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item"))


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every item with the number of documents it leaked into."""
    hits = p9_found(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    items = table(spark, folder, "eval_item").select("item_id", "task").join(hits, "item_id", "left")
    return items.select("item_id", "task", F.coalesce("documents", F.lit(0)).cast("bigint").alias("documents"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.flagged(table(spark, folder, "documents"), [repetition.REPEATS]).filter("repeats").select("doc_id")


def p10_measures(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.flagged(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p8_ids, p9_found, p9_items, p10_found, p10_measures)}
SQL: dict[str, str] = {}
