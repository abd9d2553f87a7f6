"""Periods in which each value of an entity's attribute held, from presence bitmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .skew import LEAST, hot_keys, running

FIELD = ["e", "a"]
BITS = 64


def snapshots(rows: DataFrame, least: int = LEAST) -> tuple[DataFrame, int | None]:
    """The state of each (e, a) of cardinality one at each instant something is said of it: e, a, at, v, t, next.

    rows: distinct (e, a, v, t, pos, add, at), ``at`` a whole number; they are read several times, so give what is written down. v is null where (e, a) is empty; t is the
    transaction of the assert in force; next is the following instant, null at the last. At an instant all facts up
    to it count, in order of position, also where times and positions disagree: the assert in force is the greatest
    position so far, and it is over from the first instant at which a retract of its value with a greater position
    has taken effect. Also returns what to pass as ``least`` further on: None where no (e, a) is hot.
    """
    if hot_keys(rows, FIELD, least) is None:
        least, rows = None, rows.repartition(*FIELD)  # one exchange serves every window below
    ended = running(rows, ["e", "a", "v"], "pos", {"over": ("min", F.when(~F.col("add"), F.col("at")))}, descending=True, least=least)
    said = F.when(F.col("add"), F.struct("pos", "v", "t", "over"))
    force = running(ended, FIELD, "at", {"x": ("max", said)}, least=least)
    at = force.groupBy(*FIELD, "at").agg(F.max("x").alias("x"))
    holds = F.col("x.over").isNull() | (F.col("x.over") > F.col("at"))
    at = at.select(*FIELD, "at", F.when(holds, F.col("x.v")).alias("v"), F.when(holds, F.col("x.t")).alias("t"))
    return running(at, FIELD, "at", {"next": ("min", F.col("at"))}, descending=True, before=True, least=least), least


def presence(states: DataFrame, least: int | None) -> DataFrame:
    """Bitmaps: e, a, v, word, bits and the (bit, at, next) of the bits that are set.

    The snapshots of an (e, a) are numbered in order of time; number n is bit n % 64 of word n / 64 of the value that
    held. A word holds at most 64 snapshots, whatever the size of the group.
    """
    numbered = running(states, FIELD, "at", {"n": ("sum", F.lit(1))}, least=least).withColumn("n", F.col("n") - 1)
    set_ = numbered.filter(F.col("v").isNotNull()).withColumn("word", F.floor(F.col("n") / BITS)).withColumn("bit", (F.col("n") % BITS).cast("int"))
    return set_.groupBy(*FIELD, "v", "word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).alias("bits"), F.collect_list(F.struct("bit", "at", "next")).alias("seen"))


def _bit(bits, i):
    return F.call_function("getbit", bits, i) == 1


def runs(bitmaps: DataFrame) -> DataFrame:
    """Edges of the runs of consecutive bits: e, a, v, at, starts, ends; a run without an end is open."""
    bits = F.col("bits")
    first = F.filter("seen", lambda x: (x["bit"] == 0) | ~_bit(bits, F.greatest(x["bit"] - 1, F.lit(0))))
    last = F.filter("seen", lambda x: ((x["bit"] == BITS - 1) | ~_bit(bits, F.least(x["bit"] + 1, F.lit(BITS - 1)))) & x["next"].isNotNull())
    edges = F.concat(F.transform(first, lambda x: F.struct(x["at"].alias("at"), F.lit(1).alias("s"))), F.transform(last, lambda x: F.struct(x["next"].alias("at"), F.lit(-1).alias("s"))))
    return bitmaps.select(*FIELD, "v", F.explode(edges).alias("x")).select(*FIELD, "v", "x.at", "x.s")


def periods(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(e, a, v, start, stop): each longest period in which the state of (e, a) was v; stop null while it still is.

    Runs that touch, at the edge of a word or after the value was asserted anew, are one period: an edge at which one
    run ends and another begins is none. A period of no length can't arise, as each instant has one state. Empty input
    gives no rows.
    """
    states, least = snapshots(rows, least)
    edges = runs(presence(states, least)).groupBy(*FIELD, "v", "at").agg(F.sum("s").alias("s")).filter("s <> 0")
    paired = running(edges, [*FIELD, "v"], "at", {"stop": ("min", F.when(F.col("s") < 0, F.col("at")))}, descending=True, least=least)
    return paired.filter("s > 0").select(*FIELD, "v", F.col("at").alias("start"), "stop")


def in_millis(rows: DataFrame) -> DataFrame:
    """``at`` from microseconds to the first whole millisecond at which the fact is in the state."""
    return rows.withColumn("at", F.ceil(F.col("at") / 1000))
