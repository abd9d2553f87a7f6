"""Transactions: values that describe writes, and their application to a database value, all or nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .db import FOLD, LOG, Db, row_texts, unpivoted
from .functions.dates import parse_time
from .operators.numbering import numbered
from .operators.shared import cut
from .query import Fields, OptionField, Query
from .schema import Datum, Entity


LOOKUPS = 50  # identities that one step looks up in a base frame one by one


def _few(of: Entity) -> int:
    """How many entities a step may change on the driver, so that their facts stay under ``FOLD``; beyond that it works on frames."""
    return max(1, FOLD // (2 * len(of.fields)))



class TxError(Exception):
    """A write that can't be done; nothing of its transaction is."""


class UniqueViolation(TxError):
    def __init__(self, entity: str, kind: str, value: Any):
        super().__init__(f"{entity}: {kind} {value!r} is taken")
        self.entity, self.kind, self.value = entity, kind, value


class UnknownIdentity(TxError):
    """A lookup that finds nothing."""


class UnknownEntity(TxError):
    """An eid that no live entity has."""


class Aborted(TxError):
    """A transaction that gave up by itself."""


class SinceView(TxError):
    """A write to a partial view."""


@dataclass(frozen=True)
class Add:
    """Assert records and what they refer to. An equal one that is there already stays; its key or unique with other values is an error."""

    data: tuple

    def __init__(self, data: Iterable[Datum]):
        object.__setattr__(self, "data", tuple(data))


@dataclass(frozen=True)
class Upsert:
    """Assert records; one with a key that is there replaces all values under the same eid. References are only added.

    diff_only: write the fields that change instead of retracting and asserting all of them.
    """

    data: tuple
    diff_only: bool = False

    def __init__(self, data: Iterable[Datum], diff_only: bool = False):
        object.__setattr__(self, "data", tuple(data))
        object.__setattr__(self, "diff_only", diff_only)


@dataclass(frozen=True)
class Retract:
    """Take out the entities equal to the records; one that isn't there is passed over."""

    data: tuple

    def __init__(self, data: Iterable[Datum]):
        object.__setattr__(self, "data", tuple(data))


@dataclass(frozen=True)
class RetractWhere:
    of: Entity
    predicate: Callable


@dataclass(frozen=True)
class UpsertWhere:
    """changes: field to a value or a function of the fields: ``{"n": lambda c: c.n + 1}``.

    The changed records are upserted, however many they are: one whose key changes is written under the new key, to the
    entity that has it or a new one, and the entity with the old key stays as it is. So are all of a class without a key.
    Two different records under one new key are an error, and uniques are checked against what holds after all changes.
    """

    of: Entity
    predicate: Callable
    changes: dict


@dataclass(frozen=True)
class AddFrame:
    """Add or upsert all rows of a frame with a column for each field; references are eids. Done without the driver.

    Rows that repeat, or equal an entity that is there, are no-ops. A key that the frame has with two different rows is an
    error, and so is one that is taken unless it upserts. Further columns are ignored.
    """

    of: Entity
    frame: DataFrame
    upsert: bool = False


@dataclass(frozen=True)
class SetField:
    """Set one field of an entity by eid; None takes an optional value out."""

    of: Entity
    eid: int
    name: str
    value: Any


@dataclass(frozen=True)
class Batch:
    steps: tuple


@dataclass(frozen=True)
class Fn:
    """A step computed from the state that the steps before have led to."""

    make: Callable[[Db], Any]


@dataclass(frozen=True)
class Block:
    build: Callable[["TxBuilder"], Any]


@dataclass(frozen=True)
class Lookup:
    """Stands for the entity whose key has the value, found when the transaction is applied."""

    of: Entity
    value: Any
    name: str | None = None


class TxBuilder:
    """Steps of one transaction, in order. ``db`` is the state at the block's start; the where steps see what came before."""

    def __init__(self, db: Db):
        self.db, self.steps = db, []

    def _put(self, step) -> "TxBuilder":
        self.steps.append(step)
        return self

    def add(self, *data):
        return self._put(Add(data))

    insert = add

    def upsert(self, *data, diff_only: bool = False):
        return self._put(Upsert(data, diff_only))

    def retract(self, *data):
        return self._put(Retract(data))

    def retract_where(self, of, predicate):
        return self._put(RetractWhere(of, predicate))

    def upsert_where(self, of, predicate, changes):
        return self._put(UpsertWhere(of, predicate, changes))

    def set_field(self, of, eid, name, value):
        return self._put(SetField(of, eid, name, value))

    def fn(self, make):
        return self._put(Fn(make))

    def abort(self, why: str = ""):
        raise Aborted(why)


@dataclass
class TxReport:
    tx: int
    time: datetime
    adds: list
    retracts: list
    added_eids: list
    datoms: DataFrame
    db_before: Db
    db_after: Db
    classes: frozenset = field(default=frozenset())


class Work:
    """A database value in the making: lookups, and facts written so far."""

    def __init__(self, db: Db, tx: int = 0, time: datetime | None = None):
        self.start, self.db, self.tx, self.time = db, db._next(), tx, time
        self.rows: list[tuple] = []
        self.frames: list[DataFrame] = []
        self.adds: list = []
        self.retracts: list = []
        self.eids: list[int] = []
        self.classes: set[str] = set()
        self.copied: set[str] = set()
        self.index: dict[tuple, dict] = {}
        self.fetched: dict[str, dict[int, tuple]] = {}
        self.known: dict[tuple, dict[tuple, list[int]]] = {}

    # lookups

    def _over(self, of: Entity) -> dict[int, tuple | None]:
        return self.db.over.get(of.name, {})

    def _ours(self, of: Entity, names: tuple[str, ...]) -> dict:
        """value of the fields -> eids, for what lies over the base."""
        at = (of.name, names)
        if at not in self.index:
            where = [list(of.fields).index(n) for n in names]
            out: dict = {}
            for e, r in self._over(of).items():
                if r is not None:
                    out.setdefault(tuple(r[i] for i in where), set()).add(e)
            self.index[at] = out
        return self.index[at]

    def _base(self, of: Entity, names: tuple[str, ...], values: tuple) -> list[int]:
        if of.name not in self.db.base:
            return []
        if values not in self.known.get((of.name, names), {}):
            self._ask(of, names, {values})
        over = self._over(of)
        return [e for e in self.known[of.name, names][values] if e not in over]

    def _ask(self, of: Entity, names: tuple[str, ...], values: set[tuple]) -> None:
        """Look many values up in the base at once, and keep what was found and what wasn't."""
        wanted = self.db.spark.createDataFrame(list(values), _schema(of, names)).select(*[F.col(n).alias(f"_w_{n}") for n in names])
        on = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_w_{n}")) for n in names])
        known = self.known.setdefault((of.name, names), {})
        known.update({v: [] for v in values})
        for r in self.db.base[of.name].join(F.broadcast(wanted), on).select("eid", *of.fields).collect():  # as many as the caller's values
            row = tuple(_tuples(x) for x in r[1:])
            self.fetched.setdefault(of.name, {})[r[0]] = row
            known.setdefault(self._part(of, names, row), []).append(r[0])

    def _prefetch(self, data: Iterable[Datum]) -> None:
        """One lookup for each class and identity that the records of a step and what they refer to will need."""
        found: dict[str, list[Datum]] = {}

        def walk(d) -> None:
            if isinstance(d, Datum):
                found.setdefault(d.entity.name, []).append(d)
                for f in d.entity.fields.values():
                    for x in (d.values[f.name] if f.many else [d.values[f.name]]) if f.ref else []:
                        walk(x)

        for d in data:
            walk(d)
        for name, ds in found.items():
            of = ds[0].entity
            if name not in self.db.base or len(ds) < 2:
                continue
            for names in [of.keys or tuple(of.fields), *[(u,) for u in of.uniques]]:
                fields = [of.fields[n] for n in names]
                if any(f.ref or f.computed for f in fields):
                    continue
                part = lambda d: tuple(tuple(sorted({_tuples(f.form.encode(x)) for x in d.values[f.name]})) if f.many else None if d.values[f.name] is None else _tuples(f.form.encode(d.values[f.name])) for f in fields)  # noqa: B023, E731
                self._ask(of, names, {part(d) for d in ds})

    def _find(self, of: Entity, names: tuple[str, ...], values: tuple) -> int | None:
        ours = self._ours(of, names).get(values)
        if ours:
            return min(ours)
        there = self._base(of, names, values)
        return min(there) if there else None

    def get(self, of: Entity, eid: int) -> tuple | None:
        over = self._over(of)
        if eid in over:
            return over[eid]
        if eid not in self.fetched.get(of.name, {}):
            base = self.db.base.get(of.name)
            r = base.filter(F.col("eid") == eid).select("eid", *of.fields).first() if base is not None else None
            if r is None:
                return None
            self.fetched.setdefault(of.name, {})[eid] = tuple(_tuples(x) for x in r[1:])
        return self.fetched[of.name][eid]

    def stored(self, d: Datum, reference: Callable) -> tuple | None:
        """The record's values as stored; None if a reference can't be had."""
        of, out = d.entity, []
        for n, f in of.fields.items():
            if f.computed:
                continue
            v = d.values[n]
            if f.ref:
                refs = [reference(x, f) for x in (v if f.many else [v]) if x is not None]
                if any(r is None for r in refs):
                    return None
                out.append(tuple(sorted(refs)) if f.many else refs[0] if refs else None)
            elif f.many:
                out.append(tuple(sorted({_tuples(f.form.encode(x)) for x in v})))
            else:
                out.append(None if v is None else _tuples(f.form.encode(v)))
        if not of.computed:
            return tuple(out)
        values = of.filled(dict(zip([n for n, f in of.fields.items() if not f.computed], out)))
        return tuple(values[n] for n in of.fields)

    def _existing(self, x, f) -> int | None:
        if isinstance(x, Lookup):
            return self.lookup(x)
        return x if isinstance(x, int) else self.find_equal(x)

    def find_equal(self, d: Datum) -> int | None:
        row = self.stored(d, self._existing)
        return None if row is None else self._equal(d.entity, row)

    def _equal(self, of: Entity, row: tuple) -> int | None:
        if of.keys:
            e = self._find(of, of.keys, self._part(of, of.keys, row))
            return e if e is not None and self.get(of, e) == row else None
        return self._find(of, tuple(of.fields), row)

    def lookup(self, x: Lookup) -> int:
        name = x.name or x.of.keys[0]
        e = self._find(x.of, (name,), (_tuples(x.of.fields[name].form.encode(x.value)),))
        if e is None:
            raise UnknownIdentity(f"no {x.of.name} with {name} {x.value!r}")
        return e

    @staticmethod
    def _part(of: Entity, names: tuple[str, ...], row: tuple) -> tuple:
        order = list(of.fields)
        return tuple(row[order.index(n)] for n in names)

    # writing

    def _touch(self, of: Entity) -> dict[int, tuple | None]:
        self.classes.add(of.name)
        self.db.entities.setdefault(of.name, of)
        if of.name not in self.copied:
            self.db.over[of.name] = dict(self.db.over.get(of.name, {}))
            self.copied.add(of.name)
        self.db._frames.pop(of.name, None)
        return self.db.over[of.name]

    def _write(self, eid: int, attr: str, v: str, op: str) -> None:
        self.rows.append((eid, attr, v, self.tx, len(self.rows), self.time, op))

    def _put(self, of: Entity, eid: int, row: tuple | None) -> None:
        over = self._touch(of)
        before = over.get(eid)
        for (name, names), index in self.index.items():
            if name != of.name:
                continue
            if before is not None:
                index.get(self._part(of, names, before), set()).discard(eid)
            if row is not None:
                index.setdefault(self._part(of, names, row), set()).add(eid)
        over[eid] = row

    def _check(self, of: Entity, row: tuple, own: int | None, old: tuple | None = None) -> None:
        for kind, names in ([("key", of.keys)] if of.keys else []) + [("unique", (u,)) for u in of.uniques]:
            value = self._part(of, names, row)
            if all(v is None for v in value) or old is not None and value == self._part(of, names, old):
                continue
            e = self._find(of, names, value)
            if e is not None and e != own:
                raise UniqueViolation(of.name, kind, value[0] if len(value) == 1 else value)

    def _check_moves(self, of: Entity, moves: list[tuple[int, tuple, tuple]]) -> None:
        """``_check`` for rows (eid, old, new) that change at once: what holds after all of them counts, as in a frame."""
        moved = {e for e, _, _ in moves}
        for kind, names in ([("key", of.keys)] if of.keys else []) + [("unique", (u,)) for u in of.uniques]:
            parts = [(self._part(of, names, old), self._part(of, names, new)) for _, old, new in moves]
            taken: set[tuple] = set()
            for before, value in parts if any(b != v for b, v in parts) else []:
                if all(v is None for v in value):
                    continue
                others = set() if value == before else {*self._ours(of, names).get(value, ()), *self._base(of, names, value)} - moved
                if value in taken or others:
                    raise UniqueViolation(of.name, kind, value[0] if len(value) == 1 else value)
                taken.add(value)

    def assert_(self, d: Datum, upsert: bool = False, diff_only: bool = False) -> int:
        if isinstance(d, Lookup):
            return self.lookup(d)
        of = d.entity
        row = self.stored(d, lambda x, f: x if isinstance(x, int) else self.assert_(x))
        same = self._equal(of, row)
        if same is not None:
            return same
        if upsert and of.keys and (e := self._find(of, of.keys, self._part(of, of.keys, row))) is not None:
            self._check(of, row, e, self.get(of, e))
            self._replace(of, e, self.get(of, e), row, diff_only)
            return e
        self._check(of, row, None)
        e = self.db.next_eid
        self.db.next_eid += 1
        for attr, v in row_texts(of, row):
            self._write(e, attr, v, "+")
        self._put(of, e, row)
        return e

    def _replace(self, of: Entity, e: int, old: tuple, row: tuple, diff_only: bool) -> None:
        before, after = row_texts(of, old), row_texts(of, row)
        for x in before:
            if not diff_only or x not in after:
                self._write(e, *x, "-")
        for x in after:
            if not diff_only or x not in before:
                self._write(e, *x, "+")
        self._put(of, e, row)

    def remove(self, of: Entity, e: int, row: tuple) -> None:
        for x in row_texts(of, row):
            self._write(e, *x, "-")
        self._put(of, e, None)

    # steps

    def apply(self, step) -> None:
        if isinstance(step, Batch):
            for s in step.steps:
                self.apply(s)
        elif isinstance(step, Block):
            b = TxBuilder(self.start)
            out = step.build(b)
            for s in b.steps:
                self.apply(s)
            if isinstance(out, (Add, Upsert, Retract, Batch)):
                self.apply(out)
        elif isinstance(step, Fn):
            self.apply(step.make(self.db._next()))
        elif isinstance(step, (Add, Upsert)):
            self._prefetch(step.data)
            for d in step.data:
                self.eids.append(self.assert_(d, isinstance(step, Upsert), getattr(step, "diff_only", False)))
                self.adds.append(d)
        elif isinstance(step, Retract):
            self._prefetch(step.data)
            for d in step.data:
                self.retracts.append(d)
                e = self.find_equal(d)
                if e is not None:
                    self.remove(d.entity, e, self.get(d.entity, e))
        elif isinstance(step, SetField):
            row = self.get(step.of, step.eid)
            if row is None:
                raise UnknownEntity(f"no {step.of.name} #{step.eid}")
            f, at = step.of.fields[step.name], list(step.of.fields).index(step.name)
            value = None if step.value is None else (self._existing(step.value, f) if f.ref and not f.many else _tuples(f.form.encode(step.value)) if not f.many else tuple(sorted({_tuples(f.form.encode(x)) for x in step.value})))
            new = (*row[:at], value, *row[at + 1 :])
            new = tuple(step.of.filled(dict(zip(step.of.fields, new))).values())
            if new != row:
                self._check(step.of, new, step.eid, row)
                self._replace(step.of, step.eid, row, new, True)
        elif isinstance(step, RetractWhere):
            self._retract_where(step)
        elif isinstance(step, UpsertWhere):
            self._upsert_where(step)
        elif isinstance(step, AddFrame):
            self._add_frame(step)
        else:
            raise TypeError(f"{step!r} is no step of a transaction")

    def _matched(self, of: Entity, predicate: Callable) -> DataFrame:
        return Query(self.db, of).where(predicate).frame

    def _retract_where(self, step: RetractWhere) -> None:
        of = step.of
        rows = self._matched(of, step.predicate).limit(_few(of) + 1).collect()
        if len(rows) <= _few(of):
            for r in rows:
                self.remove(of, r[0], tuple(_tuples(x) for x in r[1:]))
            return
        gone = cut(self._matched(of, step.predicate))
        self._rebase(of, self.db.frame(of).join(gone.select("eid"), "eid", "left_anti"), [(gone, "-")])

    def _upsert_where(self, step: UpsertWhere) -> None:
        of = step.of
        if unknown := set(step.changes) - set(of.fields) | set(step.changes) & set(of.computed):
            raise AttributeError(f"{of.name} has no field {sorted(unknown)[0]} to give")
        matched = self._matched(of, step.predicate)
        q = Query(self.db, of, matched)

        def changed(n: str, x: Any) -> Column:
            f = of.fields[n]
            v = x(Fields(q)) if callable(x) else x
            c = v.column if isinstance(v, OptionField) else v if isinstance(v, Column) else F.lit(v if v is None else self._existing(v, f) if f.ref else f.form.encode(v))
            return c.cast(f.type)

        after = matched.select("eid", *of.fields, *[changed(n, x).alias(f"_n_{n}") for n, x in step.changes.items()])
        after = after.withColumns({f"_n_{n}": c for n, c in of.computed_columns({n: F.col(f"_n_{n}" if n in step.changes else n) for n in of.fields}).items()})
        names = {*step.changes, *of.computed}
        if not of.keys or names & set(of.keys):
            new = after.select(*[F.col(f"_n_{n}" if n in names else n).alias(n) for n in of.fields])
            self._add_frame(AddFrame(of, new, upsert=bool(of.keys)))
            return
        # a changed unique is looked up row by row, so many of them go the way of frames
        most = _few(of) if of.name not in self.db.base or not names & set(of.uniques) else LOOKUPS
        rows = after.limit(most + 1).collect()
        if len(rows) <= most:
            order = list(of.fields)
            moves = []
            for r in rows:
                old = tuple(_tuples(r[n]) for n in order)
                new = tuple(_tuples(r[f"_n_{n}"]) if n in names else _tuples(r[n]) for n in order)
                if new != old:
                    moves.append((r.eid, old, new))
            self._check_moves(of, moves)
            for e, old, new in moves:
                self._replace(of, e, old, new, False)
            return
        pairs = cut(after.select("eid", F.struct(*of.fields).alias("old"), F.struct(*[F.col(f"_n_{n}" if n in names else n).alias(n) for n in of.fields]).alias("new")).filter(~F.col("old").eqNullSafe(F.col("new"))))
        old, new = pairs.select("eid", "old.*"), pairs.select("eid", "new.*")
        frame = self.db.frame(of).join(pairs.select("eid"), "eid", "left_anti").unionByName(new)
        self._rebase(of, frame, [(old, "-"), (new, "+")], names)

    def _unique(self, of: Entity, frame: DataFrame, changed: set[str] | None = None) -> None:
        for kind, names in ([("key", of.keys)] if of.keys else []) + [("unique", (u,)) for u in of.uniques]:
            if changed is not None and not changed & set(names):
                continue
            twice = frame.dropna("all", subset=list(names)).groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").first()
            if twice is not None:
                raise UniqueViolation(of.name, kind, twice[0] if len(names) == 1 else tuple(twice)[: len(names)])

    def _rebase(self, of: Entity, frame: DataFrame, facts: list[tuple[DataFrame, str]], changed: set[str] | None = None) -> None:
        """A new base for the class; facts go to the log as frames."""
        frame = cut(frame.select("eid", *of.fields))
        self._unique(of, frame, changed)
        if of.name in self.db.unlogged:
            self.db.log_base.insert(0, unpivoted(self.db.base[of.name], of, 0))
            self.db.unlogged = tuple(n for n in self.db.unlogged if n != of.name)
        self._touch(of)
        seq = len(self.rows)
        for df, op in facts:
            self.frames.append(unpivoted(df, of, self.tx, op, self.time, seq + len(self.frames) * len(of.fields)))
        self.db.base[of.name], self.db.over[of.name] = frame, {}
        self.index = {k: v for k, v in self.index.items() if k[0] != of.name}
        self.fetched.pop(of.name, None)
        self.known = {k: v for k, v in self.known.items() if k[0] != of.name}

    def _add_frame(self, step: AddFrame) -> None:
        of, names = step.of, list(step.of.fields)
        missing = [n for n, f in of.fields.items() if n not in step.frame.columns and not f.optional and not f.many and not f.computed]
        if missing:
            raise TypeError(f"{of.name} needs {missing[0]}")
        column = lambda n, f: F.array_sort(F.array_distinct(F.coalesce(F.col(n).cast(f.type), F.array().cast(f.type)))) if f.many else F.col(n).cast(f.type)
        rows = step.frame.select(*[(column(n, f) if n in step.frame.columns and not f.computed else F.lit(None).cast(f.type)).alias(n) for n, f in of.fields.items()])
        rows = rows.withColumns(of.computed_columns({n: F.col(n) for n in of.fields}))
        needed = [n for n, f in of.fields.items() if f.shape in ("value", "ref")]
        if needed and not rows.filter(reduce(lambda a, b: a | b, [F.col(n).isNull() for n in needed])).isEmpty():
            raise TypeError(f"{of.name}: a field that isn't optional is null")
        rows = rows.distinct()
        now = self.db.frame(of)
        same = reduce(lambda a, b: a & b, [rows[n].eqNullSafe(now[n]) for n in names])
        fresh = cut(rows.join(now, same, "left_anti"))
        if of.keys:
            keys = list(of.keys)
            taken = now.select("eid", *keys)
            if not step.upsert:
                clash = fresh.join(taken, keys, "left_semi").first()
                if clash is not None:
                    raise UniqueViolation(of.name, "key", clash[keys[0]] if len(keys) == 1 else tuple(clash[k] for k in keys))
                known, new = None, fresh
            else:
                known, new = fresh.join(taken, keys), fresh.join(taken, keys, "left_anti")
        else:
            known, new = None, fresh
        new = numbered(new, list(of.keys) or names, "eid", self.db.next_eid).select("eid", *names)
        n = new.count()
        facts = [(new, "+")]
        frame = now
        if known is not None:
            known = cut(known.select("eid", *names))
            old = now.join(known.select("eid"), "eid", "left_semi")
            facts = [(old, "-"), (known, "+"), (new, "+")]
            frame = now.join(known.select("eid"), "eid", "left_anti").unionByName(known)
        self.db.next_eid += n
        self._rebase(of, frame.unionByName(new), facts)


def _schema(of: Entity, names: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(n, of.fields[n].type) for n in names])


def _tuples(x: Any) -> Any:
    """Stored values as they compare and hash: arrays and structs as tuples, instants in UTC."""
    if isinstance(x, (list, tuple)):
        return tuple(map(_tuples, x))
    if isinstance(x, bytearray):
        return bytes(x)
    if isinstance(x, datetime):
        return x.replace(tzinfo=timezone.utc) if x.tzinfo is None else x
    return x


def commit(db: Db, tx, at: datetime | None = None) -> TxReport:
    """Apply a transaction. The time given is kept from falling behind the last one; an error leaves no trace."""
    if db.partial:
        raise SinceView("a since view can't be written to")
    time = parse_time(at if at is not None else datetime.now(timezone.utc))
    if db.last_time is not None:
        last = db.last_time.replace(tzinfo=timezone.utc) if db.last_time.tzinfo is None else db.last_time
        time = max(time, last)
    w = Work(db, db.basis + 1, time)
    w.apply(tx)
    out = w.db
    out.basis, out.last_time = w.tx, time
    out.log_rows = (*db.log_rows, *w.rows) if w.rows else db.log_rows
    out.log_base = [*out.log_base, *w.frames]
    recent = db.spark.createDataFrame(w.rows, LOG) if w.rows or not w.frames else None
    datoms = reduce(DataFrame.unionAll, [*([recent] if recent is not None else []), *w.frames])
    if len(out.log_rows) > FOLD or sum(map(len, out.over.values())) > FOLD:
        out = out.folded()
    return TxReport(w.tx, time, w.adds, w.retracts, w.eids, datoms, db, out, frozenset(w.classes))
