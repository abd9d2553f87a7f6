"""The datom feed made regular: facts, their times, and the state they add up to.

Every operator that reads the feed starts here. Columns beyond those named are ignored, so extra or clashing names
do no harm. Rows whose e, a, v or t is null carry no fact, and neither do rows whose op is no spelling of assert or
retract; a null seq stands before all others of its transaction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import cut

POS = "decimal(30,0)"


def position(t: Column, seq: Column) -> Column:
    """(t, seq) as one number: it sorts alike, and a hash aggregate can hold it."""
    high = t.cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(10,0)")
    return (high + F.coalesce(seq, F.lit(-1)).cast("decimal(10,0)")).cast(POS)


def facts(feed: DataFrame, attrs: list[str] | None = None, *more: str) -> DataFrame:
    """Every delivery that carries a fact: e, a, v, t, pos, add (boolean) and the columns in ``more``. Repeats stay."""
    op = F.lower(F.trim("op"))
    rows = feed.filter(F.col("e").isNotNull() & F.col("a").isNotNull() & F.col("v").isNotNull() & F.col("t").isNotNull())
    if attrs is not None:
        rows = rows.filter(F.col("a").isin(attrs))
    return rows.filter(op.isin("+", "assert", "-", "retract")).select("e", "a", "v", "t", position(F.col("t"), F.col("seq")).alias("pos"), op.isin("+", "assert").alias("add"), *more)


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def commit_times(feed: DataFrame, reports: DataFrame) -> DataFrame:
    """(t, at): the time of each transaction in microseconds, from any row of it or its report; null where nobody knows it."""
    told = feed.select("t", "time").unionAll(reports.select(F.col("tx").alias("t"), "time"))
    return told.filter(F.col("t").isNotNull() & F.col("time").isNotNull()).groupBy("t").agg(F.max(micros(F.col("time"))).alias("at"))


def timed_facts(feed: DataFrame, reports: DataFrame, attrs: list[str] | None = None) -> DataFrame:
    """Distinct (e, a, v, t, pos, add) with ``at``, the time in microseconds; a fact of unknown time is in no state at an instant and is left out.

    The facts are taken from the feed once and written down. Those that no delivery has a time for look it up among the
    times of their transactions, for which the feed is read once more in two columns.
    """
    rows = facts(feed, attrs, "time").groupBy("e", "a", "v", "t", "pos", "add").agg(F.max(micros(F.col("time"))).alias("at"))
    rows = cut(rows)
    lost = rows.filter(F.col("at").isNull()).drop("at")
    wanted = lost.select("t").distinct()
    found = commit_times(feed.join(wanted, "t", "left_semi"), reports.join(wanted.withColumnRenamed("t", "tx"), "tx", "left_semi"))
    return rows.filter(F.col("at").isNotNull()).unionByName(cut(lost.join(found, "t").select(*lost.columns, "at")))


def fact_state(rows: DataFrame) -> DataFrame:
    """(e, a, v, la, lr): the last position at which each value was asserted and retracted.

    The pair is a maximum, so states of any parts of the feed add up to the state of the whole, in any order and
    however often a part is delivered. Keyed by the value as well, a hot entity or attribute spreads.
    """
    return rows.groupBy("e", "a", "v").agg(F.max(F.when(F.col("add"), F.col("pos"))).alias("la"), F.max(F.when(~F.col("add"), F.col("pos"))).alias("lr"))


def many_attrs(schema: DataFrame) -> list[str]:
    """The attributes of cardinality many (a schema is small: at most some thousands of rows)."""
    many = schema.filter((F.lower(F.trim("cardinality")) == "many") & F.col("attr").isNotNull()).select("attr").distinct()
    return sorted(r.attr for r in many.collect())


def live(state: DataFrame, many: list[str]) -> DataFrame:
    """(e, a, v, la): the facts that hold after all of ``state``.

    Cardinality many: asserted after the last retract. One: the value asserted last, unless that value was retracted
    later. Assert and retract of one value at one position: the assert holds; two values at one position: the greater.
    The maximum for cardinality one is combined before the shuffle, whatever the size of a group.
    """
    stands = F.col("lr").isNull() | (F.col("lr") <= F.col("la"))
    is_many = F.col("a").isin(many) if many else F.lit(False)
    several = state.filter(is_many & F.col("la").isNotNull() & stands).select("e", "a", "v", "la")
    last = state.filter(~is_many & F.col("la").isNotNull()).groupBy("e", "a").agg(F.max(F.struct("la", "v", "lr")).alias("x"))
    single = last.select("e", "a", "x.v", "x.la", "x.lr").filter(stands).drop("lr")
    return several.unionByName(single)
