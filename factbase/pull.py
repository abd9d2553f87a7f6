"""Nested output: entities with what they refer to, and with what refers to them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from .operators.shared import cut
from .schema import Entity


class Pull:
    """What to take from an entity: ``lambda p: {"name": p.name, "dept": p.dept(lambda d: d.name)}``.

    p.field a value, a set or an optional value. p.ref(spec) goes down a reference, null where there is none.
    p.refs.map(spec) gives an array, empty where there is none. p.reverse(E, "field", spec) gives an array of the E whose
    field refers here. p.value() is the whole entity with all that it refers to, however far, or with references followed to
    a depth and eids below. A spec gives a value or a dict.
    """

    def __init__(self, of: Entity, db=None):
        self._of, self._db = of, db

    def __getattr__(self, name: str) -> "Take":
        f = self._of.fields.get(name)
        if f is None:
            raise AttributeError(f"{self._of.name} has no field {name}")
        return Take(f)

    def reverse(self, of: Entity, field: str, spec: Callable) -> "Reverse":
        f = of.fields.get(field)
        if f is None or not f.ref or f.target is not self._of:
            raise TypeError(f"{of.name}.{field} doesn't refer to {self._of.name}")
        return Reverse(f, spec)

    def value(self, depth: int | None = None) -> dict:
        """Without a depth, classes that refer to themselves are followed as deep as the data goes; a loop among their entities is an error."""
        if depth is None:
            depth = _depth(self._db, self._of)
        return {n: (Down(f, (lambda p: p.value(depth - 1)) if depth > 0 else (lambda p: p._eid())) if f.ref else Take(f)) for n, f in self._of.fields.items()}

    def _eid(self) -> "Take":
        return Take(None)


class Take:
    def __init__(self, f):
        self.f = f

    def __call__(self, spec: Callable) -> "Down":
        if self.f is None or not self.f.ref:
            raise TypeError("only references are descended")
        return Down(self.f, spec)

    map = __call__


class Down:
    def __init__(self, f, spec):
        self.f, self.spec = f, spec


class Reverse:
    def __init__(self, f, spec):
        self.f, self.spec = f, spec


def _depth(db, of: Entity) -> int:
    """How many references follow each other at most, from any entity of the class or of those it leads to."""
    classes, todo = {}, [of]
    while todo:
        e = todo.pop()
        if e.name not in classes:
            classes[e.name] = e
            todo += [f.target for f in e.fields.values() if f.ref]
    refs = [f for e in classes.values() for f in e.fields.values() if f.ref]

    def longest(e: Entity, above: tuple) -> int | None:
        """By the classes alone; None if they go round in a circle."""
        below = [None if f.target.name in above else longest(f.target, (*above, f.target.name)) for f in e.fields.values() if f.ref]
        return None if None in below else max([n + 1 for n in below], default=0)

    static = longest(of, (of.name,))
    if static is not None:
        return static
    # what is still referred to after k steps: it only shrinks, and what doesn't go away is on or behind a loop
    last, before, depth = None, None, 0
    while True:
        parts = []
        for f in refs:
            df = db.frame(f.owner)
            if last is not None:
                df = df.join(last.filter(F.col("_c") == f.owner.name).select("eid"), "eid", "left_semi")
            parts.append(df.select(F.lit(f.target.name).alias("_c"), (F.explode(f.name) if f.many else F.col(f.name)).alias("eid")))
        last = cut(reduce(DataFrame.unionAll, parts).filter("eid is not null").distinct())
        n = last.count()
        if not n:
            return depth
        if n == before:
            raise RecursionError(f"entities of {', '.join(sorted(classes))} refer to themselves; give value a depth")
        depth, before = depth + 1, n


def pulled(db, of: Entity, frame: DataFrame, spec: Callable) -> DataFrame:
    shape = spec(Pull(of, db))
    df = _built(db, frame, shape, of)
    return df.select("out.*") if isinstance(shape, dict) else df.select(F.col("out").alias("value"))


def _referring(db, frame: DataFrame, x: Reverse, of: Entity) -> DataFrame:
    """(_at, _to, out): what refers to the entities of ``frame``, and no more; fields come from the scan that finds it."""
    f, spec = x.f, x.spec(Pull(x.f.owner, db))
    owner = db.frame(f.owner)
    wanted = None if frame is db.frame(of) else frame.select(F.col("eid").alias("_at"))
    if not f.many:
        owner = owner.withColumn("_at", F.col(f.name))
        owner = owner if wanted is None else owner.join(wanted, "_at", "left_semi")
        return _built(db, owner, spec, f.owner, "_at").withColumnRenamed("eid", "_to")
    pairs = owner.select(F.explode(f.name).alias("_at"), F.col("eid").alias("_to"))
    pairs = pairs if wanted is None else pairs.join(wanted, "_at", "left_semi")
    return pairs.join(_built(db, owner, spec, f.owner), F.col("_to") == F.col("eid"))


def _built(db, frame: DataFrame, shape: Any, of: Entity, *more: str) -> DataFrame:
    """(eid, out and the columns in ``more``): left joins all the way, so no entity is lost for want of something to pull."""
    parts: dict[str, Column] = {}
    df = frame
    for k, (name, x) in enumerate((shape if isinstance(shape, dict) else {"out": shape}).items()):
        if isinstance(x, dict):
            inner = _built(db, frame, x, of).select(F.col("eid").alias(f"_e{k}"), F.col("out").alias(f"_o{k}"))
            df, parts[name] = df.join(inner, F.col("eid") == F.col(f"_e{k}"), "left"), F.col(f"_o{k}")
        elif isinstance(x, Take):
            parts[name] = F.col("eid" if x.f is None else x.f.name)
        elif isinstance(x, Down) and not x.f.many:
            inner = _built(db, db.frame(x.f.target), x.spec(Pull(x.f.target, db)), x.f.target).select(F.col("eid").alias(f"_e{k}"), F.col("out").alias(f"_o{k}"))
            df, parts[name] = df.join(inner, F.col(x.f.name) == F.col(f"_e{k}"), "left"), F.col(f"_o{k}")
        else:
            if isinstance(x, Down):
                pairs = frame.select(F.col("eid").alias("_at"), F.explode(x.f.name).alias("_to"))
                inner = _built(db, db.frame(x.f.target), x.spec(Pull(x.f.target, db)), x.f.target)
                pairs = pairs.join(inner, F.col("_to") == F.col("eid"))
            else:
                pairs = _referring(db, frame, x, of)
            each = pairs.groupBy(F.col("_at").alias(f"_e{k}")).agg(F.sort_array(F.collect_list(F.struct("_to", "out"))).alias("_l"))
            each = each.select(f"_e{k}", F.transform("_l", lambda y: y["out"]).alias(f"_o{k}"))
            empty = F.array().cast(each.schema[f"_o{k}"].dataType)
            df, parts[name] = df.join(each, F.col("eid") == F.col(f"_e{k}"), "left"), F.coalesce(F.col(f"_o{k}"), empty)
    out = F.struct(*[c.alias(n) for n, c in parts.items()]) if isinstance(shape, dict) else parts["out"]
    return df.select("eid", out.alias("out"), *more)
