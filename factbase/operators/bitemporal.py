"""Attributes as known at event time: bitemporal rectangles, a grid over them, and points located in it.

A rectangle is a region of valid time (when a value held) by recorded time (the transactions after which the log said
so) in which one version is current. Those of one (e, a) don't overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .history import FIELD, snapshots
from .shared import cut
from .skew import LEAST, salted_join


def rectangles(rows: DataFrame, superseded: bool = False, least: int = LEAST) -> DataFrame:
    """(e, a, v, valid_from, valid_to, known_from, known_to): ends are exclusive, null stands for without end.

    rows: distinct (e, a, v, t, pos, add, at). The rectangles without known_to are what the whole log says. With
    ``superseded`` also what it said before the next version was recorded: that the version would hold on; these are
    complete for logs whose times never fall as positions rise. A period in which (e, a) is empty has no rectangle.
    """
    states, least = snapshots(rows, least)
    now = states.filter(F.col("v").isNotNull()).select(*FIELD, "v", F.col("at").alias("valid_from"), F.col("next").alias("valid_to"), F.col("t").alias("known_from"), F.lit(None).cast("bigint").alias("known_to"))
    if not superseded:
        return now
    told = rows.groupBy(*FIELD, F.col("at").alias("valid_to")).agg(F.min("t").alias("known_to"))
    # only where the next instant brings another version, not where it leaves this one in force
    after = states.select(*FIELD, F.col("at").alias("valid_to"), F.col("t").alias("then"))
    before = now.filter(F.col("valid_to").isNotNull()).drop("known_to").join(after, [*FIELD, "valid_to"]).filter(~F.col("then").eqNullSafe(F.col("known_from"))).join(told, [*FIELD, "valid_to"])
    return now.unionByName(before.select(*FIELD, "v", F.col("valid_to").alias("valid_from"), F.lit(None).cast("bigint").alias("valid_to"), "known_from", "known_to"))


def grid(rects: DataFrame) -> DataFrame:
    """A grid over valid time for each entity: e, origin, width, cells.

    It has as many cells as the attribute of the entity with most rectangles has rectangles, so a rectangle lies in two
    cells on average and the index stays in proportion to the rectangles; an entity with many versions has many cells,
    over which its events spread.
    """
    each = rects.groupBy(*FIELD).agg(F.count(F.lit(1)).alias("n"), F.min("valid_from").alias("low"), F.max("valid_from").alias("high"))
    whole = each.groupBy("e").agg(F.max("n").alias("cells"), F.min("low").alias("origin"), F.max("high").alias("high"))
    return whole.select("e", "origin", (F.floor((F.col("high") - F.col("origin")) / F.col("cells")) + 1).alias("width"), "cells")


def _cell(at):
    return F.least(F.floor((at - F.col("origin")) / F.col("width")), F.col("cells") - 1)


def indexed(rects: DataFrame, cells: DataFrame, least: int = LEAST) -> DataFrame:
    """Each rectangle once for each cell of its entity's grid that it meets; the last cell reaches on without end."""
    last = F.when(F.col("valid_to").isNull(), F.col("cells") - 1).otherwise(_cell(F.col("valid_to") - 1))
    return salted_join(rects, cells, ["e"], least=least).withColumn("cell", F.explode(F.sequence(_cell(F.col("valid_from")), last))).drop("origin", "width", "cells")


def locate(points: DataFrame, rects: DataFrame, cells: DataFrame, key: str, owners: DataFrame, least: int = LEAST) -> DataFrame:
    """For each point the values of the rectangles it lies in: the columns of points, e, a and v.

    points: ``key``, valid (microseconds) and, if there is such a column, known (a transaction; without it: all that is
    known). owners: distinct (``key``, e), the entities that a key stands for. A null key or valid, a point before the
    first version and a point in an empty period get no row. Hot keys are salted, and so are hot cells. rects and cells are
    read several times, so give what is written down.
    """
    ours = owners.join(cells, "e")
    placed = salted_join(points.filter(F.col(key).isNotNull() & F.col("valid").isNotNull()), ours, [key], least=least).filter(F.col("valid") >= F.col("origin"))
    placed = placed.withColumn("cell", _cell(F.col("valid"))).drop("origin", "width", "cells")
    placed = cut(placed)
    hit = salted_join(placed, indexed(rects, cells, least), ["e", "cell"], least=least)
    hit = hit.filter((F.col("valid_from") <= F.col("valid")) & (F.col("valid_to").isNull() | (F.col("valid") < F.col("valid_to"))))
    if "known" in points.columns:
        hit = hit.filter((F.col("known_from") <= F.col("known")) & (F.col("known_to").isNull() | (F.col("known") < F.col("known_to"))))
    return hit.select(*points.columns, "e", "a", "v")
