"""Entities: classes of records, their fields, keys and unique fields, and how values are stored in the log."""

from __future__ import annotations

import base64
import dataclasses
import json
import sys
import types
import typing
from datetime import date, datetime, timezone
from decimal import Decimal
from enum import Enum
from typing import Annotated, Any, Callable
from uuid import UUID

from pyspark.sql import Column, functions as F, types as T


class Codec:
    """A user type stored as another: ``encode`` to a value of ``stored``, ``decode`` back."""

    def __init__(self, stored: Any, encode: Callable, decode: Callable):
        self.stored, self.encode, self.decode = stored, encode, decode


class Computed:
    """``Annotated[T, Computed(f)]``: a field whose value follows from the other fields, for keys and uniques of an expression.

    of: a function of the stored values (``r.name``; references are eids). column: the same for Columns, if one function
    can't serve both. The field is in frames and the log, not in records, which neither give nor hold it.
    """

    def __init__(self, of: Callable, column: Callable | None = None):
        self.of, self.column = of, column or of


class Key:
    """``Key[T]``: a field whose value belongs to one entity; adding it again is an error, upserting replaces."""

    def __class_getitem__(cls, t):
        return Annotated[t, "key"]


class Unique:
    """``Unique[T]``: a field of which no two entities of the class have the same value."""

    def __class_getitem__(cls, t):
        return Annotated[t, "unique"]


SCALARS = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), Decimal: T.DecimalType(38, 10), date: T.DateType(), datetime: T.TimestampType(), bytes: T.BinaryType(), UUID: T.StringType()}


def utc(x: datetime) -> datetime:
    return x.replace(tzinfo=timezone.utc) if x.tzinfo is None else x.astimezone(timezone.utc)


@dataclasses.dataclass(frozen=True)
class Form:
    """A value type: its Spark type, and how Python values come to it and back."""

    spark: T.DataType
    encode: Callable = lambda x: x
    decode: Callable = lambda x: x
    ordered: bool = True


def form(t: Any) -> Form:
    """The form of a Python type. Sets and maps inside a value are kept sorted, so equal values are stored alike."""
    if t in SCALARS:
        if t is UUID:
            return Form(T.StringType(), str, UUID)
        if t is datetime:
            return Form(T.TimestampType(), utc, utc)
        if t is float:
            return Form(T.DoubleType(), float)
        if t is Decimal:
            return Form(T.DecimalType(38, 10), Decimal)
        return Form(SCALARS[t])
    origin, args = typing.get_origin(t), typing.get_args(t)
    if origin is Annotated:
        for x in args[1:]:
            if isinstance(x, Codec):
                inner = form(x.stored)
                return Form(inner.spark, lambda v: inner.encode(x.encode(v)), lambda v: x.decode(inner.decode(v)))
            if isinstance(x, T.DataType):
                return Form(x)
        return form(args[0])
    if origin in (list, tuple) or t is list:
        inner = form(args[0])
        return Form(T.ArrayType(inner.spark), lambda v: [inner.encode(x) for x in v], lambda v: [inner.decode(x) for x in v])
    if origin in (set, frozenset):
        inner = form(args[0])
        return Form(T.ArrayType(inner.spark), lambda v: sorted({inner.encode(x) for x in v}), lambda v: frozenset(inner.decode(x) for x in v))
    if origin is dict:
        k, v = form(args[0]), form(args[1])
        pair = T.StructType([T.StructField("k", k.spark), T.StructField("v", v.spark)])
        return Form(T.ArrayType(pair), lambda m: sorted(((k.encode(a), v.encode(b)) for a, b in m.items()), key=lambda x: x[0]), lambda xs: {k.decode(x[0]): v.decode(x[1]) for x in xs})
    if origin in (typing.Union, types.UnionType) and type(None) in args:
        inner = form(next(x for x in args if x is not type(None)))
        return Form(inner.spark, lambda v: None if v is None else inner.encode(v), lambda v: None if v is None else inner.decode(v))
    if isinstance(t, type) and issubclass(t, Enum):
        return Form(T.StringType(), lambda v: v.name, lambda v: t[v])
    if dataclasses.is_dataclass(t):
        hints = typing.get_type_hints(t, include_extras=True)
        fields = [(f.name, form(hints[f.name])) for f in dataclasses.fields(t)]
        return Form(T.StructType([T.StructField(n, f.spark) for n, f in fields]), lambda v: tuple(f.encode(getattr(v, n)) for n, f in fields), lambda v: t(**{n: f.decode(x) for (n, f), x in zip(fields, v)}))
    raise TypeError(f"{t!r} can't be stored; give it a Codec")


class Field:
    """A field of an entity. shape: value, optional, many, ref, optional_ref or many_ref."""

    def __init__(self, owner: "Entity", name: str, hint: Any):
        self.owner, self.name = owner, name
        self.key = self.unique = False
        self.computed: Computed | None = None
        while typing.get_origin(hint) is Annotated:
            marks = typing.get_args(hint)[1:]
            self.computed = next((m for m in marks if isinstance(m, Computed)), self.computed)
            if any(isinstance(m, (Codec, T.DataType)) for m in marks):
                break
            self.key, self.unique = self.key or "key" in marks, self.unique or "unique" in marks
            hint = typing.get_args(hint)[0]
        many = typing.get_origin(hint) in (set, frozenset)
        if many:
            hint = typing.get_args(hint)[0]
        args = typing.get_args(hint)
        optional = typing.get_origin(hint) in (typing.Union, types.UnionType) and type(None) in args
        if optional:
            hint = next(a for a in args if a is not type(None))
        if isinstance(hint, typing.ForwardRef):
            hint = hint.__forward_arg__
        self.hint = hint
        self.ref = isinstance(hint, (Entity, str))
        self.shape = ("many" if many else "optional" if optional else "") + ("_ref" if self.ref and (many or optional) else "ref" if self.ref else "" if many or optional else "value")
        self.form = Form(T.LongType()) if self.ref else form(hint)

    @property
    def attr(self) -> str:
        return f"{self.owner.name}/{self.name}"

    @property
    def many(self) -> bool:
        return self.shape.startswith("many")

    @property
    def optional(self) -> bool:
        return self.shape.startswith("optional")

    @property
    def target(self) -> "Entity":
        t = self.hint if isinstance(self.hint, Entity) else Entity.known[self.hint]
        if not t.keys:
            raise TypeError(f"{self.attr} refers to {t.name}, which has no key")
        return t

    @property
    def type(self) -> T.DataType:
        return T.ArrayType(self.form.spark) if self.many else self.form.spark


class Entity:
    """A class of records. Make one with ``entity``; call it to make a record."""

    known: dict[str, "Entity"] = {}

    def __init__(self, name: str, hints: dict[str, Any], key: tuple[str, ...] | None = None, unique: tuple[str, ...] = ()):
        self.name = name
        Entity.known[name] = self
        self.fields = {n: Field(self, n, h) for n, h in hints.items()}
        marked = [n for n, f in self.fields.items() if f.key]
        if len(marked) > 1:
            raise TypeError(f"{name} has several keys: {marked}; a key of several fields is given as key=(...)")
        self.keys = tuple(key or marked)
        self.uniques = tuple(dict.fromkeys([*unique, *(n for n, f in self.fields.items() if f.unique)]))
        for n in [*self.keys, *self.uniques]:
            if n not in self.fields:
                raise AttributeError(f"{name} has no field {n}")

    def __call__(self, *args, **values) -> "Datum":
        given = {n: f for n, f in self.fields.items() if not f.computed}
        values = {**dict(zip(given, args)), **values}
        if unknown := set(values) - set(given):
            raise AttributeError(f"{self.name} has no field {sorted(unknown)[0]} to give")
        out = {}
        for n, f in given.items():
            if n not in values and not f.optional and not f.many:
                raise TypeError(f"{self.name} needs {n}")
            v = values.get(n)
            if v is None and not f.optional and not f.many:
                raise TypeError(f"{self.name}.{n} can't be None")
            out[n] = frozenset(v or ()) if f.many else v
        return Datum(self, out)

    @property
    def computed(self) -> dict[str, Computed]:
        return {n: f.computed for n, f in self.fields.items() if f.computed}

    def filled(self, values: dict[str, Any]) -> dict[str, Any]:
        """Stored values with those of the computed fields."""
        for n, c in self.computed.items():
            values[n] = c.of(types.SimpleNamespace(**values))
        return values

    def computed_columns(self, columns: dict[str, Column]) -> dict[str, Column]:
        return {n: c.column(types.SimpleNamespace(**columns)).cast(self.fields[n].type) for n, c in self.computed.items()}

    def __or__(self, other):
        """``Team | None`` in an annotation."""
        return typing.Optional[self] if other is None else NotImplemented

    def __repr__(self) -> str:
        return f"Entity({self.name})"

    def row(self):
        """A row variable of this class for typed queries."""
        from .terms import Row

        return Row(self)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("eid", T.LongType()), *[T.StructField(n, f.type) for n, f in self.fields.items()]])


class Datum:
    """A record: an entity's values, compared by all of them. Refs hold records."""

    __slots__ = ("entity", "values", "_hash")

    def __init__(self, entity: Entity, values: dict[str, Any]):
        self.entity, self.values = entity, values
        self._hash = None

    def __getattr__(self, name):
        try:
            return self.values[name]
        except KeyError:
            raise AttributeError(f"{self.entity.name} has no field {name}") from None

    def with_(self, **values) -> "Datum":
        return self.entity(**{**self.values, **values})

    def _key(self):
        return (self.entity.name, tuple(_frozen(v) for v in self.values.values()))

    def __eq__(self, other):
        return isinstance(other, Datum) and self._key() == other._key()

    def __hash__(self):
        if self._hash is None:
            self._hash = hash(self._key())
        return self._hash

    def __repr__(self):
        return f"{self.entity.name}({', '.join(f'{k}={v!r}' for k, v in self.values.items())})"


def _frozen(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(_frozen, v))
    if isinstance(v, dict):
        return tuple(sorted((_frozen(k), _frozen(x)) for k, x in v.items()))
    return frozenset(map(_frozen, v)) if isinstance(v, (set, frozenset)) else v


def entity(cls=None, *, name: str | None = None, key: str | tuple[str, ...] | None = None, unique: tuple[str, ...] = ()):
    """Class decorator: the annotations become an ``Entity``. A class is referred to by the entity or, ahead of its definition, by name."""

    def make(c):
        space = dict(vars(sys.modules[c.__module__])) if c.__module__ in sys.modules else {}
        frame = sys._getframe(2 if cls is not None else 1)
        space = {**space, **frame.f_locals}
        hints = {}
        for n, h in c.__annotations__.items():
            if isinstance(h, str):
                try:
                    h = eval(h, space, {**Entity.known, c.__name__: c.__name__})  # noqa: S307 - the class's own annotations
                except (NameError, TypeError):
                    h = _ahead(h)
                h = _ahead(h) if isinstance(h, str) else h
            hints[n] = h
        return Entity(name or c.__name__, hints, (key,) if isinstance(key, str) else key, unique)

    return make(cls) if cls is not None else make


def _ahead(h: str) -> Any:
    """An annotation that names a class not defined yet: X, set[X] or X | None."""
    h = h.replace('"', "").replace("'", "").strip()
    if h.startswith(("set[", "frozenset[")):
        return set[typing.ForwardRef(h[h.index("[") + 1 : -1])]
    if h.endswith("| None"):
        return typing.Optional[typing.ForwardRef(h[: -len("| None")].strip())]
    return h


# Values in the log are text: what Spark's cast to string gives, epoch microseconds for instants, hexadecimal for bytes, JSON for what has parts.


def _double(x: float) -> str:
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        s = repr(float(x))
        return s if "e" not in s else f"{x:f}"
    digits, exp = f"{Decimal(repr(x)).normalize():E}".split("E")
    return f"{digits if '.' in digits else digits + '.0'}E{int(exp)}"


def as_text(t: T.DataType, v: Any) -> str:
    """An encoded value as it stands in the log."""
    if isinstance(t, T.DoubleType):
        return _double(v)
    if isinstance(t, T.BooleanType):
        return "true" if v else "false"
    if isinstance(t, T.TimestampType):
        return str(int(utc(v).timestamp()) * 1_000_000 + v.microsecond)
    if isinstance(t, T.DateType):
        return v.isoformat()
    if isinstance(t, T.BinaryType):
        return bytes(v).hex().upper()
    if isinstance(t, T.DecimalType):
        return f"{Decimal(v).quantize(Decimal(1).scaleb(-t.scale)):f}"
    if isinstance(t, (T.ArrayType, T.StructType)):
        return json.dumps(_json(t, v), separators=(",", ":"), ensure_ascii=False)
    return str(v)


def _json(t: T.DataType, v: Any) -> Any:
    if v is None:
        return None
    if isinstance(t, T.ArrayType):
        return [_json(t.elementType, x) for x in v]
    if isinstance(t, T.StructType):
        return {f.name: y for f, x in zip(t.fields, v) if (y := _json(f.dataType, x)) is not None}
    if isinstance(t, (T.StringType, T.LongType, T.IntegerType, T.BooleanType)):
        return v
    if isinstance(t, T.DoubleType):
        return v if v == v and abs(v) != float("inf") else _double(v)
    return base64.b64encode(v).decode() if isinstance(t, T.BinaryType) else as_text(t, v)


def constant(t: T.DataType, v: Any) -> Column:
    """An encoded value as a literal, also one with parts."""
    if v is not None and isinstance(t, T.ArrayType):
        return F.array(*[constant(t.elementType, x) for x in v]).cast(t)
    if v is not None and isinstance(t, T.StructType):
        return F.struct(*[constant(f.dataType, x).alias(f.name) for f, x in zip(t.fields, v)]).cast(t)
    return F.lit(v)


def text_column(t: T.DataType, c: Column) -> Column:
    """``as_text`` for a column."""
    if isinstance(t, T.TimestampType):
        return F.unix_micros(c).cast("string")
    if isinstance(t, T.BinaryType):
        return F.hex(c)
    if isinstance(t, (T.ArrayType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def value_column(t: T.DataType, c: Column) -> Column:
    """The value of a column of log texts; null where the text isn't of the type."""
    if isinstance(t, T.TimestampType):
        return F.timestamp_micros(c.try_cast("bigint"))
    if isinstance(t, T.BinaryType):
        return F.unhex(c)
    if isinstance(t, (T.ArrayType, T.StructType)):
        return F.from_json(c, t)
    return c.try_cast(t)
