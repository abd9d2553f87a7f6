"""Databases as values: a log of facts and, for each class, a columnar frame that queries scan."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextvars import ContextVar
from dataclasses import dataclass
from datetime import date, datetime, timezone
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .functions.dates import parse_time
from .operators.shared import cut
from .query import Query, Stored, TypedQuery, record
from .schema import Datum, Entity, as_text, text_column, value_column
from .terms import Row, Shape

LOG = T.StructType([T.StructField("eid", T.LongType()), T.StructField("attr", T.StringType()), T.StructField("v", T.StringType()), T.StructField("tx", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("time", T.TimestampType()), T.StructField("op", T.StringType())])
FOLD = 10_000  # entities or log rows that a database value keeps on the driver before they go into frames

_reading: ContextVar[tuple[set[str], ...]] = ContextVar("reading", default=())  # class names read, one set for each watch that runs in this thread


@dataclass(frozen=True)
class Diff:
    """added: facts live only on the other side. retracted: facts live only on this one. Both log rows with op set so."""

    added: DataFrame
    retracted: DataFrame

    @property
    def is_empty(self) -> bool:
        return self.added.isEmpty() and self.retracted.isEmpty()


class Frames(dict):
    """Frames by class; one given as a function is made when it is first asked for."""

    def __getitem__(self, name: str) -> DataFrame:
        v = super().__getitem__(name)
        if callable(v):
            v = self[name] = v()
        return v

    def get(self, name: str, default=None):
        return self[name] if name in self else default


class Db:
    """An immutable database value. Writing gives a new one; the old stays as it was.

    A class frame is a base DataFrame with the few entities that recent transactions touched laid over it; these are kept
    on the driver, up to ``FOLD``, so that a small commit costs no job, and are folded into the base beyond.
    """

    def __init__(self, spark: SparkSession, entities: Iterable[Entity] = ()):
        self.spark = spark
        self.entities: dict[str, Entity] = {e.name: e for e in entities}
        self.base = Frames()
        self.over: dict[str, dict[int, tuple | None]] = {}
        self.log_base: list[DataFrame] = []
        self.log_rows: tuple = ()
        self.unlogged: tuple[str, ...] = ()  # classes whose base came as a frame; their facts belong to transaction 0
        self._counted = (1, 0, None)  # the next eid, the last transaction and its time
        self._tops: DataFrame | None = None  # where these come from, until they are asked for
        self.partial = False
        self._frames: dict[str, DataFrame] = {}
        self._part_of: tuple[Db, Column] | None = None  # the value whose log, filtered, is this one's

    # making

    def _counters(self) -> tuple:
        if self._tops is not None:
            eid, tx, time, ref = self._tops.first()
            self._counted, self._tops = (max(eid or 0, ref or 0) + 1, tx or 0, time), None
        return self._counted

    next_eid = property(lambda self: self._counters()[0], lambda self, x: setattr(self, "_counted", (x, *self._counters()[1:])))
    basis = property(lambda self: self._counters()[1], lambda self, x: setattr(self, "_counted", (self.next_eid, x, self.last_time)))
    last_time = property(lambda self: self._counters()[2], lambda self, x: setattr(self, "_counted", (*self._counters()[:2], x)))

    def _next(self) -> "Db":
        self._counters()
        out = Db(self.spark)
        out.__dict__.update({k: v for k, v in self.__dict__.items()}, entities=dict(self.entities), base=Frames(self.base), over=dict(self.over), log_base=list(self.log_base), _frames={}, _part_of=None)
        return out

    @classmethod
    def from_frames(cls, spark: SparkSession, frames: dict[Entity, DataFrame | Callable[[], DataFrame]], start: int = 1) -> "Db":
        """A database over frames, or functions that make them, with an eid column and one for each field. No log is made unless it is asked for.

        eids must be unique; ``sources.ingest`` gives them. Rows with a null in a field that isn't optional are an error of
        the caller's and stay as they are.
        """
        out = cls(spark, frames)
        for e, df in frames.items():
            out.base[e.name] = _picked(df, e) if callable(df) else df.select("eid", *e.fields)
        out.unlogged = tuple(out.base)
        out.next_eid = start
        return out

    @classmethod
    def from_log(cls, spark: SparkSession, log: DataFrame, entities: Iterable[Entity], keep: bool = False) -> "Db":
        """A database with the given log (columns of ``LOG``; further ones are dropped), derived from it class by class.

        Counters go on past every id seen, those that only references name too. keep: write the frame of a class down when
        it is first read, so that further queries don't derive it again.
        """
        out = cls(spark, entities)
        log = log.select(*LOG.names)
        refs = [f.attr for e in out.entities.values() for f in e.fields.values() if f.ref]
        named = F.max(F.when(F.col("attr").isin(refs), F.col("v").try_cast("bigint"))) if refs else F.lit(None).cast("bigint")
        out.log_base = [log]
        out._tops = log.agg(F.max("eid"), F.max("tx"), F.max("time"), named)
        make = lambda e: (lambda: cut(derived(log, e))) if keep else derived(log, e)
        out.base = Frames({e.name: make(e) for e in out.entities.values()})
        return out

    # reading

    def touch(self, name: str) -> None:
        for s in _reading.get():
            s.add(name)

    def frame(self, of: Entity) -> DataFrame:
        """eid and the fields of every live entity of the class. References are eids, sets sorted arrays."""
        self.touch(of.name)
        if of.name not in self._frames:
            over = self.over.get(of.name, {})
            rows = [(e, *r) for e, r in over.items() if r is not None]
            recent = self.spark.createDataFrame(rows, of.schema)
            base = self.base.get(of.name)
            if base is not None:
                if over:
                    gone = self.spark.createDataFrame([(e,) for e in over], "eid bigint")
                    base = base.join(F.broadcast(gone), "eid", "left_anti")  # at most FOLD rows
                recent = base.unionByName(recent) if rows else base
            if self.partial:
                needed = [n for n, f in of.fields.items() if not f.optional and not f.many]
                recent = recent.dropna(subset=needed) if needed else recent
            self._frames[of.name] = recent
        return self._frames[of.name]

    def query(self, *args) -> TypedQuery:
        """``db.query(E, D, lambda e, d: find(...).where(...))``, or a shape over rows made with ``E.row()``."""
        *of, build = args
        shape = build(*[Row(e) for e in of]) if callable(build) and not isinstance(build, Shape) else build
        return TypedQuery(self, shape)

    def pure(self, **values: Any) -> DataFrame:
        """One row of constants."""
        return self.spark.range(1).select(*[F.lit(v).alias(n) for n, v in values.items()])

    def where(self, of: Entity, predicate: Callable | None = None, opaque: Callable | None = None) -> Query:
        """The entities of a class that satisfy the predicate: ``db.where(Person, lambda p: p.age > 30)``."""
        return Query(self, of).where(predicate, opaque)

    def exists(self, of: Entity, predicate: Callable | None = None) -> bool:
        return self.where(of, predicate).exists()

    def count(self, of: Entity, predicate: Callable | None = None) -> int:
        return self.where(of, predicate).count()

    def by_eid(self, of: Entity, eid: int) -> Datum | None:
        """The entity, or None if there is none of that class."""
        return next(iter(self.records(of, self.frame(of).filter(F.col("eid") == eid))), None)

    def every(self, of: Entity) -> Query:
        """The entities of a class in the order of their creation, which is that of their eids."""
        return Query(self, of, self.frame(of).orderBy("eid"))

    def load(self, of: Entity, ref) -> Stored | None:
        """The entity with an eid, or that a ``Lookup`` stands for; None if there is none of that class."""
        from .tx import Lookup

        at = F.col(ref.name or ref.of.keys[0]) == F.lit(ref.of.fields[ref.name or ref.of.keys[0]].form.encode(ref.value)) if isinstance(ref, Lookup) else F.col("eid") == ref
        return next(iter(Query(self, of, self.decoded(of).filter(at)).stored()), None)

    def decoded(self, of: Entity, eids: DataFrame | None = None) -> DataFrame:
        """The class frame, or its part with the eids of a frame. An entity that lacks a field it must have is a LoadError
        when it is read; since views pass over those."""
        df = self.frame(of) if eids is None else self.frame(of).join(eids.select("eid").distinct(), "eid", "left_semi")
        needed = [n for n, f in of.fields.items() if not f.optional and not f.many]
        if self.partial or not needed:
            return df
        missing = reduce(lambda a, b: a | b, [F.col(n).isNull() for n in needed])
        text = F.concat(F.lit(f"LoadError: {of.name} #"), F.col("eid").cast("string"), F.lit(" lacks a field or has one that can't be read"))
        return df.filter(F.when(missing, F.raise_error(text).cast("boolean")).otherwise(True))

    def find(self, of: Entity, value: Any, field: str | None = None) -> Datum | None:
        """The entity whose key (or named unique field) has the value."""
        name = field or of.keys[0]
        return self.where(of, lambda r: getattr(r, name) == value).one()

    def pull_by_eid(self, of: Entity, eid: int, spec: Callable):
        return Query(self, of, self.frame(of).filter(F.col("eid") == eid)).pull_one(spec)

    def match_by(self, of: Entity, field: str, value: Any) -> Query:
        """Entities whose field (optional, set and reference too) is or contains the value."""
        f = of.fields[field]
        return self.where(of, lambda r: getattr(r, field).contains(value) if f.many else getattr(r, field) == value)

    def eid_of(self, datum: Datum) -> int | None:
        """The entity equal to the record, references by what they refer to."""
        from .tx import Work

        self.touch(datum.entity.name)
        return Work(self).find_equal(datum)

    def records(self, of: Entity, frame: DataFrame) -> list[Datum]:
        """Records on the driver with what they refer to, a class at a time; a dangling reference is an error, as is a loop."""
        names = list(of.fields)
        rows = frame.select("eid", *names).collect()
        plain = [record(of, dict(zip(names, r[1:]))) for r in rows]
        refs = [f for f in of.fields.values() if f.ref]
        if not refs:
            return plain
        known: dict[str, dict[int, Datum]] = {}
        todo: dict[str, set[int]] = {}

        def want(d: Datum) -> None:
            for f in d.entity.fields.values():
                if f.ref and d.values[f.name] is not None:
                    eids = d.values[f.name] if f.many else [d.values[f.name]]
                    todo.setdefault(f.target.name, set()).update(e for e in eids if e not in known.get(f.target.name, {}))

        for d in plain:
            want(d)
        while any(todo.values()):
            name, eids = next((n, e) for n, e in todo.items() if e)
            todo[name] = set()
            target = Entity.known[name] if name not in self.entities else self.entities[name]
            wanted = self.spark.createDataFrame([(e,) for e in sorted(eids)], "eid bigint")  # what the caller's own records refer to
            for r in self.frame(target).join(wanted, "eid", "left_semi").select("eid", *target.fields).collect():
                d = record(target, dict(zip(target.fields, r[1:])))
                known.setdefault(name, {})[r[0]] = d
                want(d)
            for e in eids - set(known.get(name, {})):
                raise LookupError(f"{name} #{e} is referred to but doesn't exist")

        def resolve(d: Datum, above: tuple) -> Datum:
            out = dict(d.values)
            for f in d.entity.fields.values():
                v = out[f.name]
                if not f.ref or v is None:
                    continue

                def get(e, f=f):
                    if (f.target.name, e) in above:
                        raise RecursionError(f"{f.target.name} #{e} refers to itself")
                    return resolve(known[f.target.name][e], (*above, (f.target.name, e)))

                out[f.name] = frozenset(map(get, v)) if f.many else get(v)
            return Datum(d.entity, out)

        return [resolve(d, ((of.name, r[0]),)) for d, r in zip(plain, rows)]

    # the log

    def log(self) -> DataFrame:
        """Every fact ever written, in the columns of ``LOG``. Order by tx, seq."""
        parts = [unpivoted(self.base[n], self.entities[n], 0) for n in self.unlogged]
        parts += self.log_base
        if self.log_rows or not parts:
            parts.append(self.spark.createDataFrame(list(self.log_rows), LOG))
        for n in self.entities:
            self.touch(n)
        return reduce(DataFrame.unionAll, parts)

    def history(self, eid: int) -> DataFrame:
        """All that was ever said of an entity; retracting it ends nothing here."""
        return self.log().filter(F.col("eid") == eid).orderBy("tx", "seq")

    def history_of(self, datum: Datum) -> DataFrame:
        found = self.eid_of(datum)
        return self.history(found if found is not None else -1)

    def datoms(self) -> DataFrame:
        """The live facts, each with the transaction that last asserted it."""
        return live_facts(self.log())

    def as_of(self, point: int | datetime | date | str) -> "Db":
        """The value after transaction ``point``, or after all transactions up to a time (ISO text is UTC; a date is its midnight)."""
        until = F.col("tx") <= point if isinstance(point, int) else F.col("time") <= F.lit(parse_time(point))
        return self._replayed(until)

    as_of_time = as_of

    def since(self, tx: int) -> "Db":
        """Only the facts of later transactions: a view that can't be written to; entities that lack a field are passed over."""
        out = self._replayed(F.col("tx") > tx)
        out.partial = True
        return out

    def _replayed(self, part: Column) -> "Db":
        out = Db.from_log(self.spark, self.log().filter(part), self.entities.values())
        out._part_of = (self, part)
        return out

    def tx_time(self, tx: int) -> datetime | None:
        r = self.log().filter(F.col("tx") == tx).agg(F.max("time")).first()
        return r[0]

    def diff(self, other: "Db") -> Diff:
        """What leads from this value to the other: one aggregate over both logs, or over the larger where one is a part of it."""
        every = F.lit(True)
        if self._part_of is not None and self._part_of[0] is other:
            log, mine, theirs = other.log(), self._part_of[1], every
        elif other._part_of is not None and other._part_of[0] is self:
            log, mine, theirs = self.log(), every, other._part_of[1]
        else:
            log = self.log().withColumn("_side", F.lit(1)).unionAll(other.log().withColumn("_side", F.lit(2)))
            mine, theirs = F.col("_side") == 1, F.col("_side") == 2
        last = log.groupBy("eid", "attr", "v").agg(*_last_word("m_", mine), *_last_word("t_", theirs))
        lives = lambda n: F.coalesce(F.col(f"{n}word") % 2 == 1, F.lit(False))
        said = lambda n, other, op: last.filter(lives(n) & ~lives(other)).select("eid", "attr", "v", *[F.col(n + x).alias(x) for x in ("tx", "seq", "time")], F.lit(op).alias("op"))
        return Diff(said("t_", "m_", "+"), said("m_", "t_", "-"))

    # writing

    def transact(self, tx, at: datetime | None = None) -> "TxReport":
        from .tx import commit

        return commit(self, tx, at)

    def add(self, *data: Datum) -> "Db":
        from .tx import Add

        return self.transact(Add(data)).db_after

    def upsert(self, *data: Datum) -> "Db":
        from .tx import Upsert

        return self.transact(Upsert(data)).db_after

    def retract(self, *data: Datum) -> "Db":
        from .tx import Retract

        return self.transact(Retract(data)).db_after

    def retract_where(self, of: Entity, predicate: Callable) -> "Db":
        from .tx import RetractWhere

        return self.transact(RetractWhere(of, predicate)).db_after

    def upsert_where(self, of: Entity, predicate: Callable, changes: dict[str, Any]) -> "Db":
        from .tx import UpsertWhere

        return self.transact(UpsertWhere(of, predicate, changes)).db_after

    def tx(self, build: Callable) -> "Db":
        from .tx import Block

        return self.transact(Block(build)).db_after

    def add_frame(self, of: Entity, frame: DataFrame) -> "Db":
        """Add every row of a frame; see ``tx.AddFrame``."""
        from .tx import AddFrame

        return self.transact(AddFrame(of, frame)).db_after

    def upsert_frame(self, of: Entity, frame: DataFrame) -> "Db":
        from .tx import AddFrame

        return self.transact(AddFrame(of, frame, upsert=True)).db_after

    def folded(self) -> "Db":
        """The same value with nothing kept on the driver."""
        out = self._next()
        for n, over in self.over.items():
            if over:
                out.base[n] = cut(self.frame(self.entities[n]))
        if self.log_rows:
            out.log_base.append(cut(self.spark.createDataFrame(list(self.log_rows), LOG)))
        # the facts of a base that came as a frame are written down before the base changes
        for n in self.unlogged:
            out.log_base.insert(0, unpivoted(self.base[n], self.entities[n], 0))
        out.unlogged, out.over, out.log_rows = (), {}, ()
        return out

    # text

    def pretty(self) -> str:
        """The live state by class and eid. For values that fit the driver."""
        rows = self.datoms().select("attr", "eid", "v").collect()
        eids = {r.eid for r in rows}
        classes: dict[str, dict[int, dict[str, list[str]]]] = {}
        for r in rows:
            cls, name = r.attr.split("/", 1)
            classes.setdefault(cls, {}).setdefault(r.eid, {}).setdefault(name, []).append(self._shown(r.attr, r.v, eids))
        if not classes:
            return "(empty db)\n"
        out = []
        for cls in sorted(classes):
            out.append(f"{cls} ({len(classes[cls])})")
            for eid in sorted(classes[cls]):
                fields = classes[cls][eid]
                width = max(map(len, fields))
                out.append(f"  #{eid}")
                out += [f"    {n:<{width}} = {vs[0] if len(vs) == 1 else '{' + ', '.join(sorted(vs)) + '}'}" for n, vs in sorted(fields.items())]
            out.append("")
        return "\n".join(out) + "\n"

    def _shown(self, attr: str, v: str, eids: set[int] = frozenset()) -> str:
        cls, name = attr.split("/", 1)
        f = self.entities[cls].fields.get(name) if cls in self.entities else None
        if f is not None and f.ref:
            return f"#{v}"
        return f'"{v}"' if f is None or isinstance(f.form.spark, T.StringType) else v

    def pretty_log(self, color: bool = False) -> str:
        """The log as an aligned table, asserts green and retracts red if coloured."""
        rows = self.log().orderBy("tx", "seq").collect()
        if not rows:
            return "(empty log)\n"
        cells = [["tx", "time", "eid", "attr", "value", "op"]]
        for r in rows:
            millis = int(r.time.replace(tzinfo=timezone.utc).timestamp() * 1000) if r.time is not None else 0
            cells.append([str(r.tx), str(millis), f"#{r.eid}", r.attr, self._shown(r.attr, r.v), r.op])
        widths = [max(len(c[i]) for c in cells) for i in range(6)]
        cells.insert(1, ["-" * w for w in widths])
        lines = ["  ".join(x.ljust(w) for x, w in zip(c, widths)) for c in cells]
        tint = {"+": "\x1b[32m", "-": "\x1b[31m"}
        return "".join(f"{tint[c[5]]}{x}\x1b[0m\n" if color and k > 1 else f"{x}\n" for k, (c, x) in enumerate(zip(cells, lines)))


def _picked(make: Callable[[], DataFrame], of: Entity) -> Callable[[], DataFrame]:
    return lambda: make().select("eid", *of.fields)


def _last_word(prefix: str = "", side: Column | None = None) -> list[Column]:
    """Aggregates for what was said last, on one side if given: word, tx, seq and time; an odd word is an assert.

    A word is (tx, seq, op) as one number that sorts alike, so that a hash aggregate can hold it.
    """
    word = F.col("tx").cast("decimal(19,0)") * F.lit(1 << 62).cast("decimal(19,0)") + (F.coalesce("seq", F.lit(0)) * 2 + F.when(F.col("op") == "+", 1).otherwise(0)).cast("decimal(19,0)")
    word = word if side is None else F.when(side, word)
    return [F.max(word).alias(f"{prefix}word"), *[F.max_by(n, word).alias(prefix + n) for n in ("tx", "seq", "time")]]


def live_facts(log: DataFrame) -> DataFrame:
    """The facts whose last word is an assert, with that word's tx, seq and time."""
    last = log.groupBy("eid", "attr", "v").agg(*_last_word())
    return last.filter("word % 2 = 1").select("eid", "attr", "v", "tx", "seq", "time", F.lit("+").alias("op"))


def derived(log: DataFrame, of: Entity) -> DataFrame:
    """The frame of a class from the log, in one aggregate over the entity; of two live values of one field the later counts."""
    facts = live_facts(log.filter(F.col("attr").startswith(f"{of.name}/")))
    picks = []
    for n, f in of.fields.items():
        mine = F.col("attr") == f.attr
        if f.many:
            values = F.collect_set(F.when(mine, F.col("v")))
            picks.append(F.array_sort(_each(values, value_column, f.form.spark)).alias(n))
        else:
            picks.append(value_column(f.type, F.max(F.when(mine, F.struct("tx", "seq", "v")))["v"]).alias(n))
    return facts.groupBy("eid").agg(*picks)


def _each(values, change: Callable, *more):
    """``change(*more, x)`` for each element; the lambda keeps its own ``more``."""
    return F.transform(values, lambda x: change(*more, x))


def _cell(attr: str, seq: int, v):
    return F.struct(F.lit(attr).alias("attr"), v.alias("v"), F.lit(seq).cast("bigint").alias("seq"))


def unpivoted(frame: DataFrame, of: Entity, tx: int, op: str = "+", time: datetime | None = None, start: int = 0) -> DataFrame:
    """The facts of a frame as log rows of one transaction. seq is the place of the field."""
    cells = []
    for k, (n, f) in enumerate(of.fields.items()):
        if f.many:
            texts = _each(F.coalesce(F.col(n), F.array().cast(f.type)), text_column, f.form.spark)
        else:
            texts = F.filter(F.array(text_column(f.type, F.col(n))), lambda x: x.isNotNull())
        cells.append(_each(texts, _cell, f.attr, start + k))
    rows = frame.select("eid", F.explode(F.concat(*cells)).alias("x"))
    return rows.select("eid", "x.attr", "x.v", F.lit(tx).cast("bigint").alias("tx"), "x.seq", F.lit(time).cast("timestamp").alias("time"), F.lit(op).alias("op"))


def row_texts(of: Entity, row: tuple) -> list[tuple[str, str]]:
    """(attr, text) for each fact of a stored row, in the order of the fields."""
    out = []
    for (n, f), v in zip(of.fields.items(), row):
        if v is None:
            continue
        for x in v if f.many else [v]:
            out.append((f.attr, as_text(f.form.spark, x)))
    return out
