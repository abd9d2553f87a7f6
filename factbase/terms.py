"""The language of typed queries: row variables, terms and constraints."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace
from typing import Any, Callable

from .schema import Datum, Entity, Field

_ids = itertools.count()


class Term:
    def __eq__(self, other):  # type: ignore[override]
        return Compare("=", self, other)

    def __ne__(self, other):  # type: ignore[override]
        return Compare("!=", self, other)

    def __gt__(self, other):
        return Compare(">", self, other)

    def __ge__(self, other):
        return Compare(">=", self, other)

    def __lt__(self, other):
        return Compare("<", self, other)

    def __le__(self, other):
        return Compare("<=", self, other)

    def startswith(self, prefix: str):
        return Compare("prefix", self, prefix)

    __hash__ = object.__hash__

    def asc(self):
        return Order(self, False)

    def desc(self):
        return Order(self, True)


class Row(Term):
    """A variable over the entities of a class. An attribute of it is a term for the field's value; so is an item, whatever its name."""

    def __init__(self, of: Entity, number: int | None = None):
        self._of, self._number = of, next(_ids) if number is None else number

    def __getitem__(self, name: str):
        if name not in self._of.fields:
            raise AttributeError(f"{self._of.name} has no field {name}")
        return FieldTerm(self, self._of.fields[name])

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def __bool__(self):
        raise TypeError("a row variable has no truth value; use & | not_")

    def __repr__(self):
        return f"{self._of.name}#{self._number}"


class FieldTerm(Term):
    def __init__(self, row: Row, of: Field):
        self.row, self.of = row, of

    @property
    def id(self):
        return (self.row._number, self.of.name)

    def __repr__(self):
        return f"{self.row}.{self.of.name}"


class Applied(Term):
    """A function of a field's value: ``change`` takes its Column, and the arguments."""

    def __init__(self, name: str, change: Callable, of: FieldTerm, *args: Any):
        if not isinstance(of, FieldTerm):
            raise TypeError(f"{name} takes a field")
        self.name, self.change, self.field, self.args = name, change, of, args

    @property
    def row(self) -> Row:
        return self.field.row

    @property
    def id(self):
        return ("fn", self.name, self.args, self.field.id)

    def __repr__(self):
        return f"{self.name}({self.field})"


def field_of(t: Any) -> Any:
    """The field that a function is applied to; other terms are themselves."""
    return t.field if isinstance(t, Applied) else t


class Constraint:
    def __and__(self, other):
        return And((self, other))

    def __or__(self, other):
        return Or((self, other))

    def __bool__(self):
        raise TypeError("a constraint has no truth value; combine with & | not_ and chain no comparisons")


class Compare(Constraint):
    def __init__(self, op: str, left: Term, right: Any):
        if isinstance(left, (Aggregate, Windowed)) or isinstance(right, (Aggregate, Windowed)):
            raise TypeError("aggregates and windows can't be compared in where")
        self.op, self.left, self.right = op, left, right


@dataclass(frozen=True, eq=False)
class Truth(Constraint):
    holds: bool


def guard(condition: Any) -> Constraint:
    """A condition that speaks of no row, such as a flag of the caller's; constraints are given back as they are."""
    return condition if isinstance(condition, Constraint) else Truth(bool(condition))


def empty() -> Truth:
    """The alternative that no binding satisfies."""
    return Truth(False)


@dataclass(frozen=True, eq=False)
class And(Constraint):
    parts: tuple


@dataclass(frozen=True, eq=False)
class Or(Constraint):
    parts: tuple


@dataclass(frozen=True, eq=False)
class Not(Constraint):
    part: Constraint


@dataclass(frozen=True, eq=False)
class Exists(Constraint):
    row: Row
    part: Constraint


@dataclass(frozen=True, eq=False)
class Call(Constraint):
    rule: Any
    left: Any
    right: Any


def _has(c: Constraint, kinds: tuple) -> bool:
    if isinstance(c, kinds):
        return True
    return any(_has(p, kinds) for p in getattr(c, "parts", ())) or (hasattr(c, "part") and _has(c.part, kinds))


def not_(c: Constraint) -> Not:
    """No binding of what ``c`` alone speaks of satisfies it. Not inside ``|`` and not inside another not_."""
    if _has(c, (Not,)):
        raise ValueError("nested not: not_ can't contain not_")
    return Not(c)


def exists(of: Entity, body: Callable[[Row], Constraint]) -> Exists:
    """At least one entity of the class satisfies the body; a semi-join, so it repeats no row."""
    r = Row(of)
    return Exists(r, body(r))


def dnf(c: Constraint | None) -> list[list[Constraint]]:
    """Alternatives, each a list of constraints that hold together. Duplicates are kept: | is a union of bags."""
    if c is None:
        return [[]]
    if isinstance(c, Or):
        for p in c.parts:
            if _has(p, (Not,)):
                raise ValueError("not_ cannot appear inside ||")
        return [d for p in c.parts for d in dnf(p)]
    if isinstance(c, And):
        out = [[]]
        for p in c.parts:
            out = [a + b for a in out for b in dnf(p)]
        return out
    return [[c]]


@dataclass(frozen=True, eq=False)
class Order:
    term: Any
    descending: bool


class Aggregate(Term):
    def __init__(self, fn: str, of: Term):
        if not isinstance(of, (Row, FieldTerm, Applied)):
            raise TypeError(f"{fn} takes a field or a row")
        self.fn, self.of = fn, of

    def over(self, spec: "Spec") -> "Windowed":
        """The aggregate of the whole partition; the spec's order has no effect on it."""
        return Windowed(self.fn, self.of, spec, 0)

    @property
    def id(self):
        return (self.fn, term_id(self.of))


class Ranking:
    def __init__(self, fn: str, of: Term | None = None, offset: int = 0):
        self.fn, self.of, self.offset = fn, of, offset

    def over(self, spec: "Spec") -> "Windowed":
        return Windowed(self.fn, self.of, spec, self.offset)


@dataclass(frozen=True, eq=False)
class Spec:
    keys: tuple = ()
    orders: tuple = ()

    def order_by(self, *orders):
        return replace(self, orders=tuple(o if isinstance(o, Order) else Order(o, False) for o in orders))


class Windowed(Term):
    def __init__(self, fn: str, of: Term | None, spec: Spec, offset: int):
        for k in spec.keys:
            if not isinstance(k, (Row, FieldTerm, Applied)):
                raise TypeError("partition keys are fields or rows")
        self.fn, self.of, self.spec, self.offset = fn, of, spec, offset

    @property
    def id(self):
        return ("over", self.fn, term_id(self.of) if self.of is not None else None, tuple(map(term_id, self.spec.keys)), tuple((term_id(o.term), o.descending) for o in self.spec.orders), self.offset)


def term_id(t):
    return ("row", t._number) if isinstance(t, Row) else t.id


count = lambda t: Aggregate("count", t)
count_distinct = lambda t: Aggregate("count_distinct", t)
sum_ = lambda t: Aggregate("sum", t)
avg = lambda t: Aggregate("avg", t)
min_ = lambda t: Aggregate("min", t)
max_ = lambda t: Aggregate("max", t)
row_number = lambda: Ranking("row_number")
rank = lambda: Ranking("rank")
dense_rank = lambda: Ranking("dense_rank")
lag = lambda t, n=1: Ranking("lag", t, n)
lead = lambda t, n=1: Ranking("lead", t, n)
partition_by = lambda *keys: Spec(tuple(keys))


@dataclass(frozen=True, eq=False)
class Shape:
    """What a typed query gives: ``find(...)`` and what follows it."""

    names: tuple
    terms: tuple
    constraint: Constraint | None = None
    orders: tuple = ()
    limited: int | None = None
    skipped: int = 0
    is_distinct: bool = False
    rows: tuple = field(default=())

    def where(self, c: Constraint) -> "Shape":
        return replace(self, constraint=c if self.constraint is None else And((self.constraint, c)))

    def order_by(self, *orders) -> "Shape":
        return replace(self, orders=tuple(o if isinstance(o, Order) else Order(o, False) for o in orders))

    def limit(self, n: int) -> "Shape":
        return replace(self, limited=n)

    def offset(self, n: int) -> "Shape":
        return replace(self, skipped=n)

    def distinct(self) -> "Shape":
        return replace(self, is_distinct=True)


def find(*terms, **named) -> Shape:
    """The columns of the result, in order. Unnamed ones are called after their field, with a number if that repeats."""
    names = []
    for t in terms:
        base = t.of.name if isinstance(t, FieldTerm) else t._of.name.lower() if isinstance(t, Row) else t.fn if isinstance(t, (Aggregate, Windowed)) else t.name if isinstance(t, Applied) else "value"
        name, k = base, 2
        while name in names or name in named:
            name, k = f"{base}_{k}", k + 1
        names.append(name)
    every = (*terms, *named.values())
    if not every:
        raise ValueError("find needs a term")
    for t in every:
        if not isinstance(t, (Row, FieldTerm, Applied, Aggregate, Windowed)):
            raise TypeError(f"find takes fields, rows, aggregates and windows, not {t!r}")
    if any(isinstance(t, Aggregate) for t in every) and any(isinstance(t, Windowed) for t in every):
        raise ValueError("find mixes aggregations and window functions")
    return Shape((*names, *named), every)


__all__ = [n for n in dir() if not n.startswith("_")] + ["Datum"]
