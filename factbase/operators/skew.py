"""Joins and running aggregates that survive keys holding a large part of all rows.

A *hot* key is one of the ``MOST`` largest groups, if it has at least ``least`` rows. By counting, every other
group holds at most ``1/MOST`` of the rows, so the list of hot keys is complete for the purpose and never longer
than ``MOST`` rows; only that list is broadcast or sent to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

MOST, LEAST, PIECES = 256, 200_000, 64


def hot_keys(df: DataFrame, keys: list[str], least: int = LEAST) -> DataFrame | None:
    """The hot keys of ``df`` with their counts as a small local table, or None. Null keys count as a key."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = counts.filter(F.col("_n") >= least).orderBy(F.desc("_n"), *keys).limit(MOST).collect()
    return df.sparkSession.createDataFrame(rows, counts.schema) if rows else None


def _same(a: DataFrame, b: DataFrame, left: list[str], right: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[x].eqNullSafe(b[y]) for x, y in zip(left, right)])


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", least: int = LEAST, rows: int | None = None) -> DataFrame:
    """``left.join(right, keys, how)`` for how in inner, left, left_semi, left_anti; hot keys of ``left`` are spread.

    Rows of a hot key get one of up to ``PIECES`` salts from a hash of the whole row (the same after a lost
    executor), and the right side's rows of that key are copied once for each salt. Null keys match nothing; they
    are kept by left and left_anti. Empty sides and repeated rows behave as in a plain join. rows: how many left has at
    most, if that is known; fewer than ``least`` can't hold a hot key, and aren't counted.
    """
    hot = hot_keys(left, keys, least) if rows is None or rows >= least else None
    if hot is None:
        return left.join(right, keys, how)
    names = [f"_h{i}" for i in range(len(keys))]
    hot = hot.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.least(F.lit(PIECES), F.ceil(F.col("_n") / least) + 1).cast("int").alias("_pieces"))
    whole = [c for c, kind in left.dtypes if not kind.startswith("map")]
    marked = left.join(F.broadcast(hot), _same(left, hot, keys, names), "left")
    marked = marked.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*whole), F.col("_pieces")), F.lit(0)).cast("int")).drop("_pieces", *names)
    copied = right.join(F.broadcast(hot), _same(right, hot, keys, names), "left")
    copied = copied.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_pieces") - 1, F.lit(0))))).drop("_pieces", *names)
    return marked.join(copied, [*keys, "_salt"], how).drop("_salt")


def with_chunks(df: DataFrame, keys: list[str], by: str, least: int = LEAST) -> DataFrame | None:
    """``df`` with ``_chunk``: hot groups cut at approximate quantiles of the number ``by``, others chunk 0. None: no hot group.

    Rows with equal ``by`` share a chunk, and chunks follow the order of ``by`` (null first).
    """
    hot = hot_keys(df, keys, least)
    if hot is None:
        return None
    names = [f"_h{i}" for i in range(len(keys))]
    hot = hot.select(*[F.col(k).alias(n) for k, n in zip(keys, names)])
    points = [i / MOST for i in range(1, MOST)]
    bounds = df.join(F.broadcast(hot), _same(df, hot, keys, names)).groupBy(*names).agg(F.percentile_approx(F.col(by).cast("double"), points, 2000).alias("_bounds"))
    df = df.join(F.broadcast(bounds), _same(df, bounds, keys, names), "left")
    inside = F.size(F.filter("_bounds", lambda b: b < F.col(by).cast("double")))
    return df.withColumn("_chunk", F.when(F.col("_bounds").isNull() | F.col(by).isNull(), 0).otherwise(inside)).drop("_bounds", *names)


AGGREGATES = {"max": (F.max, F.greatest), "min": (F.min, F.least), "sum": (F.sum, lambda a, b: a + b)}


def running(df: DataFrame, keys: list[str], by: str, outs: dict[str, tuple[str, Column]], descending: bool = False, before: bool = False, least: int | None = LEAST) -> DataFrame:
    """Running aggregates over ``keys`` in the order of the number ``by``; rows with equal ``by`` are taken together.

    outs: result column to (max | min | sum, column). before: without the row's own ``by``, which must be a bigint then.
    Hot groups are cut into chunks; each chunk runs by itself and gets the aggregate of the chunks before it, of which
    a key has at most ``MOST``. least None: the caller knows that no group is hot. Nulls in an aggregated column are
    passed over, and a result over nothing is null.
    """
    order = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_first()
    chunked = None if least is None else with_chunks(df, keys, by, least)
    groups = keys if chunked is None else [*keys, "_chunk"]
    df = df if chunked is None else chunked
    span = Window.partitionBy(*groups).orderBy(order).rangeBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    df = df.withColumns({o: AGGREGATES[f][0](c).over(span) for o, (f, c) in outs.items()})
    if chunked is None:
        return df
    names = [f"_k{i}" for i in range(len(keys))]
    sums = chunked.groupBy(*groups).agg(*[AGGREGATES[f][0](c).alias(f"_c_{o}") for o, (f, c) in outs.items()])
    carried = Window.partitionBy(*keys).orderBy(F.col("_chunk").desc() if descending else F.col("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    several = sums.withColumn("_many", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("_many > 1").drop("_many")
    carry = several.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_chunk").alias("_ck"), *[AGGREGATES[f][0](f"_c_{o}").over(carried).alias(f"_c_{o}") for o, (f, _) in outs.items()])
    # at most MOST chunks of each of MOST hot keys
    df = df.join(F.broadcast(carry), _same(df, carry, [*keys, "_chunk"], [*names, "_ck"]), "left")
    both = {o: F.when(F.col(f"_c_{o}").isNull(), F.col(o)).when(F.col(o).isNull(), F.col(f"_c_{o}")).otherwise(AGGREGATES[f][1](F.col(o), F.col(f"_c_{o}"))) for o, (f, _) in outs.items()}
    return df.withColumns(both).drop("_chunk", "_ck", *names, *[f"_c_{o}" for o in outs])
