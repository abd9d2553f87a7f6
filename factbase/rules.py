"""Rules: named relations between entities, recursive ones by semi-naive rounds or path doubling."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .operators.shared import cut
from .operators.skew import salted_join
from .plans.compile import Plan, eid, row_of, terms_of
from .schema import Entity
from .terms import And, Call, Constraint, Exists, Not, Or, Row, _has, dnf

_ids = itertools.count()
PAIR = "src bigint, dst bigint"


def _calls(c: Constraint) -> list[Call]:
    if isinstance(c, Call):
        return [c]
    if isinstance(c, (And, Or)):
        return [x for p in c.parts for x in _calls(p)]
    return _calls(c.part) if isinstance(c, (Exists, Not)) else []


class Rule:
    """``Rule(A, B, body, ...)``: pairs (a, b) that satisfy one of the bodies, each a function of two row variables.

    Call a rule with rows or records to use it as a constraint. Facts are a set of pairs.
    """

    def __init__(self, a: Entity, b: Entity, *bodies: Callable):
        self.a, self.b, self.key = a, b, next(_ids)
        self.bodies = []
        for body in bodies:
            self.add(body)

    def add(self, body: Callable) -> "Rule":
        """One more body; it may call this rule and rules that call this one."""
        x, y = Row(self.a), Row(self.b)
        c = body(x, y)
        if _has(c, (Not,)):
            raise ValueError("not_ cannot appear in a rule body")
        self.bodies += [(x, y, d) for d in dnf(c)]
        return self

    @classmethod
    def recursive(cls, a: Entity, b: Entity, make: Callable[["Rule"], list[Callable]]) -> "Rule":
        out = cls(a, b)
        for body in make(out):
            out.add(body)
        return out

    @classmethod
    def reaches(cls, a: Entity, field: str, include_start: bool = False) -> "Reaches":
        return Reaches(a, field, include_start)

    def __call__(self, left, right) -> Call:
        return Call(self, left, right)

    def rules(self) -> dict[int, "Rule"]:
        """This rule and all that it calls."""
        out, todo = {}, [self]
        while todo:
            r = todo.pop()
            if r.key in out:
                continue
            out[r.key] = r
            todo += [c.rule for _, _, d in getattr(r, "bodies", []) for p in d for c in _calls(p)]
        return out

    def relation(self, db, sources: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
        """(src, dst), distinct, cut down to the given ends.

        Where every body hands an end on to the rules that it calls, only pairs with the ends given there are made at all.
        """
        ends = {"src": sources, "dst": targets}
        kept = {k: e for k, e in ends.items() if e is not None and self._keeps(k)}
        facts = self._facts(db, kept)
        for k, e in ends.items():
            facts = facts if e is None or k in kept else facts.join(e.withColumnRenamed("eid", k), k, "left_semi")
        return facts.select("src", "dst")

    def _keeps(self, end: str) -> bool:
        """Whether a pair only comes from pairs with the same end."""
        rules = {k: r for k, r in self.rules().items() if not isinstance(r, Reaches)}
        for r in rules.values():
            for x, y, d in r.bodies:
                for p in d:
                    for c in _calls(p):
                        side, head = (c.left, x) if end == "src" else (c.right, y)
                        if c.rule.key in rules and (c is not p or side is not head):
                            return False
        return True

    def _body(self, db, body, relations) -> DataFrame:
        x, y, parts = body
        df = Plan(db, relations).bindings(list(parts), [x, y])
        return df.select(F.col(eid(x)).alias("src"), F.col(eid(y)).alias("dst"))

    def _steps(self, db, end: str, fixed: dict) -> DataFrame | None:
        """If each body that calls this rule is the call and a step further from its other end: the steps. Else None."""
        out = []
        for x, y, d in self.bodies:
            calls = [(p, c) for p in d for c in _calls(p) if c.rule is self]
            if not calls:
                continue
            (p, c), rest = calls[0], [q for q in d if q is not calls[0][1]]
            near, far, head, other = (c.left, c.right, x, y) if end == "src" else (c.right, c.left, y, x)
            alone = lambda row: all(row._number not in {row_of(t)._number for t in terms_of(q)} for q in rest)
            if not rest or len(calls) > 1 or p is not c or near is not head or not isinstance(far, Row) or far is head or not alone(head):
                return None
            ends = (far, other) if end == "src" else (other, far)
            df = Plan(db, fixed).bindings(rest, list(ends))
            out.append(df.select(F.col(eid(ends[0])).alias("src"), F.col(eid(ends[1])).alias("dst")))
        return reduce(DataFrame.unionAll, out).distinct()

    def _facts(self, db, ends: dict[str, DataFrame]) -> DataFrame:
        every = self.rules()
        fixed = {k: r.relation(db) for k, r in every.items() if isinstance(r, Reaches)}
        rules = {k: r for k, r in every.items() if k not in fixed}
        empty = db.spark.createDataFrame([], PAIR)
        inner = lambda d: [c for p in d for c in _calls(p) if c.rule.key in rules]

        def cut_down(df: DataFrame) -> DataFrame:
            for k, e in ends.items():
                df = df.join(e.withColumnRenamed("eid", k), k, "left_semi")
            return df.select("src", "dst")

        base = {k: cut_down(reduce(DataFrame.unionAll, [r._body(db, b, fixed) for b in r.bodies if not inner(b[2])] or [empty]).distinct()) for k, r in rules.items()}
        if not any(inner(d) for r in rules.values() for _, _, d in r.bodies):
            return base[self.key]
        known = {k: Parts(f) for k, f in base.items()}
        if set(rules) == {self.key} and not ends:
            for end in ("src", "dst"):
                steps = self._steps(db, end, fixed)
                # many pairs to go on from: paths of steps are doubled; few: they are followed
                if steps is not None and known[self.key].n * SEARCH >= (steps := cut(steps)).count():
                    first, paths = known[self.key].all(), doubled(steps)
                    a, b = (first, paths) if end == "src" else (paths, first)
                    longer = salted_join(a.withColumnRenamed("dst", "mid"), b.withColumnRenamed("src", "mid"), ["mid"])
                    return first.unionAll(longer.select("src", "dst")).distinct()
        while any(p.n for p in known.values()):
            found = {}
            for k, r in rules.items():
                parts = []
                for b in r.bodies:
                    calls = inner(b[2])
                    top = [c for c in b[2] if any(c is x for x in calls)]
                    everything = {**fixed, **{j: p.all() for j, p in known.items()}}
                    if len(top) < len(calls):  # a call inside an exists is looked at whole
                        parts.append(r._body(db, b, everything))
                    else:
                        # what is new has something new in one of its calls
                        parts += [r._body(db, b, {**everything, id(c): known[c.rule.key].last}) for c in top if known[c.rule.key].n]
                if parts:
                    found[k] = reduce(DataFrame.unionAll, parts).distinct().join(known[k].all(), ["src", "dst"], "left_anti")
            found = {k: cut(f) for k, f in found.items()}
            for k, p in known.items():
                p.add(found.get(k))
        return known[self.key].all()


SEARCH = 8  # from fewer ends than one in so many of the steps pairs are searched, else all are made by doubling


class Parts:
    """Pairs found so far, as the parts that rounds added: a round writes what is new and no more, but for rare mergers."""

    def __init__(self, first: DataFrame):
        self.parts: list[DataFrame] = []
        self.add(cut(first))

    def add(self, new: DataFrame | None) -> None:
        self.last, self.n = new, new.count() if new is not None else 0
        if self.n or not self.parts:
            self.parts.append(new)
        if len(self.parts) > 16:
            self.parts = [cut(self.all())]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionAll, self.parts)


class Reaches(Rule):
    """Pairs joined by one or more steps along a field that refers to its own class.

    From given ends it searches outward in rounds; over all pairs it doubles paths, so rounds are the logarithm of the
    longest. A start on a cycle reaches itself only with ``include_start``.
    """

    def __init__(self, a: Entity, field: str, include_start: bool = False):
        f = a.fields.get(field)
        if f is None:
            raise AttributeError(f"{a.name} has no field {field}")
        if not f.ref or f.target is not a:
            raise TypeError(f"{f.attr} doesn't refer to {a.name}")
        super().__init__(a, a)
        self.field, self.include_start = f, include_start

    def edges(self, db) -> DataFrame:
        to = F.explode(self.field.name) if self.field.many else F.col(self.field.name)
        return db.frame(self.a).select(F.col("eid").alias("src"), to.alias("dst")).filter("dst is not null").distinct()

    def _without_start(self, pairs: DataFrame) -> DataFrame:
        return pairs if self.include_start else pairs.filter("src <> dst")

    def _keeps(self, end: str) -> bool:
        return True

    def relation(self, db, sources=None, targets=None) -> DataFrame:
        edges = cut(self.edges(db))
        given = {k: (e, e.count()) for k, e in (("src", sources), ("dst", targets)) if e is not None}
        if not given:
            return self._without_start(doubled(edges))
        # of two ends given the search goes from the smaller
        near = min(given, key=lambda k: given[k][1])
        starts, n = given.pop(near)
        turned = lambda df: df if near == "src" else df.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        if n * SEARCH < edges.count():
            pairs = turned(closure(turned(edges), starts).select("src", "dst"))
        else:
            pairs = doubled(edges).join(starts.withColumnRenamed("eid", near), near, "left_semi")
        for k, (e, _) in given.items():
            pairs = pairs.join(e.withColumnRenamed("eid", k), k, "left_semi")
        return self._without_start(pairs.select("src", "dst"))


def doubled(edges: DataFrame) -> DataFrame:
    """The transitive closure (src, dst) of ``edges``.

    After round k all pairs up to 2**k steps apart are known, and the last round's are those more than half of that apart.
    A pair up to twice as far apart is one of the last round's followed by a known one.
    """
    known = Parts(edges.select("src", "dst").distinct())
    while known.n:
        a, b = known.last.withColumnRenamed("dst", "mid"), known.all().withColumnRenamed("src", "mid")
        longer = salted_join(a, b, ["mid"], rows=known.n).select("src", "dst")
        known.add(cut(longer.distinct().join(known.all(), ["src", "dst"], "left_anti")))
    return known.all()


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(src, dst, depth): what each start reaches and in how many steps, nearest first; the start itself if on a cycle."""
    first = salted_join(starts.select(F.col("eid").alias("src")).distinct(), edges, ["src"])
    seen, depth = Parts(first.select("src", "dst", F.lit(1).alias("depth")).distinct()), 1
    edge = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    while seen.n:
        depth += 1
        on = salted_join(seen.last.select("src", F.col("dst").alias("at")), edge, ["at"], rows=seen.n).select("src", F.col("to").alias("dst")).distinct()
        seen.add(cut(on.join(seen.all(), ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth))))
    return seen.all()
