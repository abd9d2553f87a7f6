"""Queries over a database value: typed ones, and filters of one class as a collection."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from .plans.compile import compiled
from .schema import Datum, Entity, constant
from .terms import Shape

_marks = itertools.count()


class TypedQuery:
    """A typed query bound to a database value. Lazy: ``frame`` is the plan, iterating runs it."""

    def __init__(self, db, shape: Shape):
        self.db, self.shape = db, shape
        self._frame: DataFrame | None = None

    @property
    def frame(self) -> DataFrame:
        if self._frame is None:
            self._frame = compiled(self.db, self.shape)
        return self._frame

    def run(self) -> list:
        """The result on the driver: bare values for one unnamed term, else rows."""
        rows = self.frame.collect()
        return [r[0] for r in rows] if len(self.shape.names) == 1 else [tuple(r) for r in rows]

    def __iter__(self) -> Iterator:
        return iter(self.run())


class Fields:
    """The columns of a class frame, for predicates: ``lambda r: r.age > 3``. Refs are followed: ``r.dept.name``."""

    def __init__(self, query: "Query"):
        self._query = query

    def __getattr__(self, name: str):
        f = self._query.of.fields.get(name)
        if f is None:
            raise AttributeError(f"{self._query.of.name} has no field {name}")
        return RefField(self._query, (f,)) if f.ref and not f.many else SetField(self._query, f) if f.many else OptionField(self._query, f)


class OptionField:
    """A value field. It acts as a Column; constants are taken in their Python form."""

    def __init__(self, query, f):
        self._q, self._f = query, f

    @property
    def column(self) -> Column:
        return F.col(self._f.name)

    def _lit(self, v):
        if isinstance(v, OptionField):
            return v.column
        return v if isinstance(v, Column) or v is None else constant(self._f.form.spark, self._f.form.encode(v))

    def __eq__(self, v):  # type: ignore[override]
        return self.column.isNull() if v is None else self.column == self._lit(v)

    def __ne__(self, v):  # type: ignore[override]
        return self.column.isNotNull() if v is None else ~self.column.eqNullSafe(self._lit(v))

    __hash__ = None
    __gt__ = lambda self, v: self.column > self._lit(v)
    __ge__ = lambda self, v: self.column >= self._lit(v)
    __lt__ = lambda self, v: self.column < self._lit(v)
    __le__ = lambda self, v: self.column <= self._lit(v)
    __add__ = lambda self, v: Calculated(self, self.column + self._lit(v))
    __sub__ = lambda self, v: Calculated(self, self.column - self._lit(v))
    __mul__ = lambda self, v: Calculated(self, self.column * self._lit(v))
    __truediv__ = lambda self, v: Calculated(self, self.column / self._lit(v))
    __mod__ = lambda self, v: Calculated(self, self.column % self._lit(v))
    __neg__ = lambda self: Calculated(self, -self.column)

    def contains(self, v):
        """For an optional field whether it holds v; for text whether v is in it."""
        return self.column == self._lit(v) if self._f.optional else self.column.contains(v)

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self.column, name)  # startswith, rlike, isNull, isin, between ...


class Calculated(OptionField):
    """What arithmetic on a field gives; constants that it meets are taken as the field takes them."""

    def __init__(self, of: OptionField, column: Column):
        super().__init__(of._q, of._f)
        self._column = column

    @property
    def column(self) -> Column:
        return self._column


class SetField:
    def __init__(self, query, f):
        self._q, self._f = query, f

    def contains(self, v):
        if self._f.ref:
            found = self._q.db.eid_of(v)
            return F.array_contains(self._f.name, F.lit(found if found is not None else -1).cast("bigint"))
        return F.array_contains(self._f.name, constant(self._f.form.spark, self._f.form.encode(v)))

    __call__ = contains

    @property
    def column(self) -> Column:
        return F.col(self._f.name)


class RefField:
    """A reference; its own fields are compared at the target, found by a semi-join on the filtered target."""

    def __init__(self, query, path):
        self._q, self._path = query, path

    @property
    def column(self) -> Column:
        return F.col(self._path[0].name)

    def __eq__(self, v):  # type: ignore[override]
        if v is None:
            return self.column.isNull()
        if isinstance(v, (Column, OptionField)) and len(self._path) == 1:
            return self.column == (v if isinstance(v, Column) else v.column)
        found = v if isinstance(v, int) else self._q.db.eid_of(v)
        return self._walk(F.col("eid") == F.lit(found if found is not None else -1))

    __hash__ = None

    def _walk(self, at_target: Column) -> Column:
        """A column that marks the rows whose reference chain ends in a target that satisfies the condition."""
        targets = self._q.db.frame(self._path[-1].target).filter(at_target).select("eid")
        for f in reversed(self._path[1:]):
            owner = self._q.db.frame(f.owner)
            targets = owner.join(targets.withColumnRenamed("eid", "_t"), F.col(f.name) == F.col("_t"), "left_semi").select("eid")
        return self._q._mark(self._path[0], targets)

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        f = self._path[-1].target.fields.get(name)
        if f is None:
            raise AttributeError(f"{self._path[-1].target.name} has no field {name}")
        return RefField(self._q, (*self._path, f)) if f.ref and not f.many else LeafField(self, f)


class OuterFields:
    """The fields of the entity that a second query is run for; ``eid`` is the entity itself."""

    def __init__(self, of: Entity, mark: str):
        self._of, self._mark = of, mark
        self._joined, self._reads = False, 0  # whether columns are made above the join; how often a field was read

    def __getattr__(self, name: str) -> "OuterField":
        if name.startswith("_") or name not in {**self._of.fields, "eid": None}:
            raise AttributeError(f"{self._of.name} has no field {name}")
        return OuterField(self, name)


class OuterField(OptionField):
    def __init__(self, outer: OuterFields, name: str):
        super().__init__(None, outer._of.fields.get(name))
        self._outer, self._name = outer, outer._mark + name

    @property
    def column(self) -> Column:
        self._outer._reads += 1
        return F.col(self._name) if self._outer._joined else F.col(self._name).outer()


class LeafField(OptionField):
    """A field at the end of a reference chain."""

    def __init__(self, ref: RefField, f):
        super().__init__(ref._q, f)
        self._ref = ref

    def _at(self, condition: Column) -> Column:
        return self._ref._walk(condition)

    def __eq__(self, v):  # type: ignore[override]
        return self._at(super().__eq__(v))

    def __ne__(self, v):  # type: ignore[override]
        return self._at(super().__ne__(v))

    __hash__ = None
    __gt__ = lambda self, v: self._at(F.col(self._f.name) > self._lit(v))
    __ge__ = lambda self, v: self._at(F.col(self._f.name) >= self._lit(v))
    __lt__ = lambda self, v: self._at(F.col(self._f.name) < self._lit(v))
    __le__ = lambda self, v: self._at(F.col(self._f.name) <= self._lit(v))

    def startswith(self, p):
        return self._at(F.col(self._f.name).startswith(p))


class Query:
    """The entities of a class that satisfy predicates, lazily: a frame with eid and a column for each field.

    Predicates are functions of the fields that give a Column, which Spark pushes to the scan, or with ``opaque`` any
    function of a record, which runs in Python row by row.
    """

    def __init__(self, db, of: Entity, frame: DataFrame | None = None):
        self.db, self.of = db, of
        self.frame = db.frame(of) if frame is None else frame
        self._marks: list[tuple] = []

    def _mark(self, f, targets: DataFrame) -> Column:
        name = f"_m{len(self._marks)}"
        self._marks.append((name, f, targets))
        return F.coalesce(F.col(name), F.lit(False))

    def _with(self, frame: DataFrame) -> "Query":
        return Query(self.db, self.of, frame)

    def condition(self, predicate: Callable) -> tuple[DataFrame, Column]:
        self._marks = []
        c = predicate(Fields(self))
        c = c.column if isinstance(c, OptionField) else c
        df = self.frame
        for name, f, targets in self._marks:
            df = df.join(targets.select(F.col("eid").alias(f"{name}_t"), F.lit(True).alias(name)).distinct(), F.col(f.name) == F.col(f"{name}_t"), "left")
        return df, c

    def where(self, predicate: Callable | None = None, opaque: Callable[[Datum], bool] | None = None) -> "Query":
        out = self
        if predicate is not None:
            df, c = self.condition(predicate)
            out = self._with(df.filter(c).select("eid", *self.of.fields))
        if opaque is not None:
            of, names = self.of, list(self.of.fields)

            def keep(batches):
                for pdf in batches:
                    yield pdf[[bool(opaque(record(of, dict(zip(names, row))))) for row in pdf[names].astype(object).itertuples(index=False)]]

            out = out._with(out.frame.mapInPandas(keep, out.frame.schema))
        return out

    filter = where

    def filter_not(self, predicate: Callable) -> "Query":
        df, c = self.condition(predicate)
        return self._with(df.filter(~F.coalesce(c, F.lit(False))).select("eid", *self.of.fields))

    def map(self, **columns: Callable) -> DataFrame:
        """New columns, each a function of the fields."""
        out = self.frame.select(*[self._column(f).alias(n) for n, f in columns.items()])
        out._mapped = (self, columns)
        return out

    def _column(self, f: Callable) -> Column:
        c = f(Fields(self))
        return c if isinstance(c, Column) else c.column

    def flat_map(self, work: Callable, schema: str | None = None) -> DataFrame:
        """Any number of rows for each entity.

        Without a schema ``work`` gives, for the fields of one entity, a second query; its predicates and columns may use
        them: ``db.where(A).flat_map(lambda a: db.where(B, lambda b: b.of == a.name).map(x=lambda b: b.x, y=lambda b: a.y))``.
        It is one lateral join, which Catalyst turns into an equi-join where the predicate allows. Columns of a ``map`` that
        use the entity are made above the join where they can be: below it Catalyst crosses their values with the whole
        second class first. With a schema ``work`` is a function of pandas batches.
        """
        if schema is not None:
            return self.frame.mapInPandas(lambda batches: (work(b) for b in batches), schema)
        mark = f"_outer{next(_marks)}_"
        fields = OuterFields(self.of, mark)
        inner = work(fields)
        outer = self.frame.select(*[F.col(n).alias(mark + n) for n in ("eid", *self.of.fields)])
        above = None if isinstance(inner, Query) else self._above(outer, fields, *vars(inner).get("_mapped", (None, {})))
        if above is not None:
            return above
        joined = outer.lateralJoin(inner.frame if isinstance(inner, Query) else inner)
        return joined.drop(*outer.columns)

    @staticmethod
    def _above(outer: DataFrame, fields: OuterFields, query: "Query | None", columns: dict[str, Callable]) -> DataFrame | None:
        """A map of the second query with the columns that use the entity made above the join; others, with windows for
        instance, stay below. None if one of the former can't be told from a single joined row."""
        own, late, fields._joined = {}, {}, True
        try:
            for n, f in columns.items():
                before = fields._reads
                c = query._column(f)
                (late if fields._reads > before else own)[n] = c
            if not late:
                return None
            inner = query.frame.select("*", *[c.alias(f"{fields._mark}own_{n}") for n, c in own.items()])
            made = outer.lateralJoin(inner).select(*[late.get(n, F.col(f"{fields._mark}own_{n}")).alias(n) for n in columns])
            plan = made._jdf.queryExecution().analyzed()
            return made if plan.nodeName() == "Project" and plan.child().nodeName() == "LateralJoin" else None
        except AnalysisException:
            return None
        finally:
            fields._joined = False

    def run(self) -> list[Datum]:
        """The records, with the records that they refer to."""
        return self.db.records(self.of, self.frame)

    def __iter__(self) -> Iterator[Datum]:
        return iter(self.run())

    def one(self) -> Datum | None:
        return next(iter(self.db.records(self.of, self.frame.limit(1))), None)

    def count(self) -> int:
        return self.frame.count()

    def exists(self) -> bool:
        return not self.frame.isEmpty()

    def group_by(self, *keys: str) -> "Groups":
        return Groups(self, keys)

    def count_by(self, *keys: str) -> DataFrame:
        return self.frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))

    def _ordered(self, keys: tuple, how: str) -> "Query":
        """keys: names of fields, or functions of the fields; nulls come first in rising order."""
        df, by, self._marks = self.frame, [], []
        for k in keys:
            c = F.col(k) if isinstance(k, str) else k(Fields(self))
            by.append(getattr(c if isinstance(c, Column) else c.column, how)())
        return self._with(df.orderBy(*by))

    def order_by(self, *keys: str | Callable) -> "Query":
        return self._ordered(keys, "asc_nulls_first")

    def order_by_desc(self, *keys: str | Callable) -> "Query":
        return self._ordered(keys, "desc_nulls_last")

    def stored(self) -> list["Stored"]:
        """The records, each with its eid."""
        rows = self.frame.select("eid", *self.of.fields)
        return [Stored(e, d) for e, d in zip([r.eid for r in rows.collect()], self.db.records(self.of, rows))]

    def limit(self, n: int) -> "Query":
        return self._with(self.frame.limit(n))

    def offset(self, n: int) -> "Query":
        return self._with(self.frame.offset(n))

    def pull(self, spec: Callable) -> DataFrame:
        """Nested output: see ``pull.Pull``."""
        from .pull import pulled

        return pulled(self.db, self.of, self.frame, spec)

    def pull_one(self, spec: Callable) -> Any:
        from .pull import pulled

        return pulled(self.db, self.of, self.frame.limit(1), spec).first()


class Groups:
    def __init__(self, query: Query, keys: tuple[str, ...]):
        self.query, self.keys = query, keys

    def agg(self, **columns: Column) -> DataFrame:
        return self.query.frame.groupBy(*self.keys).agg(*[c.alias(n) for n, c in columns.items()])

    def fold(self, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        """Any function of a whole group. A group must fit in a task; where Columns can say it, use ``agg``."""
        return self.query.frame.groupBy(*self.keys).applyInPandas(work, schema)


@dataclass(frozen=True)
class Stored:
    """A record as it was read: fields are had from it directly, ``eid`` is what references to it hold."""

    eid: int
    record: Datum

    def __getattr__(self, name: str) -> Any:
        return getattr(self.record, name)


def record(of: Entity, values: dict[str, Any]) -> Datum:
    """A record from stored values, references left as eids."""
    out = {}
    for n, f in of.fields.items():
        if f.computed:
            continue
        v = values.get(n)
        if f.many:
            out[n] = frozenset() if v is None else frozenset(v if f.ref else map(f.form.decode, v))
        elif v is None or v is pd.NaT or (isinstance(v, float) and v != v and not str(f.type) == "DoubleType()"):
            out[n] = None
        else:
            out[n] = int(v) if f.ref else f.form.decode(v.item() if hasattr(v, "item") else v)
    return Datum(of, out)
