"""Typed queries into DataFrame plans: one scan for each row variable, joins along references, semi- and anti-joins."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.numbering import ranked
from ..operators.shared import cut
from ..schema import Datum, constant
from ..terms import Aggregate, And, Applied, Call, Compare, Constraint, Exists, FieldTerm, Not, Or, Row, Shape, Term, Truth, Windowed, dnf, field_of, term_id

SYMBOLS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "prefix": lambda a, b: a.startswith(b)}


def eid(row: Row) -> str:
    return f"r{row._number}__eid"


def col_name(t: FieldTerm) -> str:
    return f"r{t.row._number}__{t.of.name}"


def whole(t: FieldTerm) -> str:
    """The unexploded set of a field of many values."""
    return f"r{t.row._number}__{t.of.name}__all"


def terms_of(c: Constraint) -> list[Term]:
    """The rows and fields that a constraint speaks of, inside not_ and exists too, without those of rows that an exists brings."""
    if isinstance(c, (And, Or)):
        return [t for p in c.parts for t in terms_of(p)]
    if isinstance(c, Not):
        return terms_of(c.part)
    if isinstance(c, Exists):
        return [t for t in terms_of(c.part) if row_of(t)._number != c.row._number]
    if isinstance(c, Call):
        return [x for x in (c.left, c.right) if isinstance(x, Row)]
    if isinstance(c, Truth):
        return []
    return [field_of(x) for x in (c.left, c.right) if isinstance(x, Term)]


def substituted(c: Constraint, change) -> Constraint:
    """``c`` with its terms changed."""
    if isinstance(c, (And, Or)):
        return type(c)(tuple(substituted(p, change) for p in c.parts))
    if isinstance(c, Not):
        return Not(substituted(c.part, change))
    if isinstance(c, Exists):
        return Exists(c.row, substituted(c.part, change))
    if isinstance(c, Call):
        return Call(c.rule, change(c.left), change(c.right))
    if isinstance(c, Truth):
        return c
    return Compare(c.op, change(c.left), change(c.right))


def row_of(t: Term) -> Row:
    return t if isinstance(t, Row) else t.row


def literal(value: Any, t: Term) -> Any:
    """A constant in the stored form of the term that it is compared with."""
    if isinstance(t, FieldTerm) and not t.of.ref:
        try:
            return constant(t.of.form.spark, t.of.form.encode(value))
        except (AttributeError, TypeError, ValueError):
            return F.lit(value)
    return F.lit(value)


class Plan:
    """Builds the plan of one alternative: the bindings of its row variables."""

    def __init__(self, db, relations: dict | None = None):
        self.db, self.relations = db, relations or {}
        self.outside: frozenset[str] = frozenset()  # columns of the plan around a subquery

    def _col(self, name: str) -> Column:
        return F.col(name).outer() if name in self.outside else F.col(name)

    # what each row must carry

    def bindings(self, parts: list[Constraint], outputs: list[Term]) -> DataFrame:
        """outputs: rows and fields that the caller needs. Rows that only not_ or exists speaks of get no scan here."""
        plain = [c for c in parts if isinstance(c, Compare)]
        calls = [c for c in parts if isinstance(c, Call)]
        subs = [c for c in parts if isinstance(c, (Not, Exists))]
        never = any(isinstance(c, Truth) and not c.holds for c in parts)
        rows: dict[int, Row] = {}
        hard: dict[tuple, FieldTerm] = {}  # one variable for each (row, field): present, and one element of a set
        alls: dict[tuple, FieldTerm] = {}  # sets taken whole, for membership
        soft: dict[tuple, FieldTerm] = {}  # for sub-plans: no presence is asked

        def need(t: Term) -> None:
            rows.setdefault(row_of(t)._number, row_of(t))
            if isinstance(t, FieldTerm):
                hard[t.id] = t

        for t in outputs:
            need(field_of(t))
        for c in plain:
            if self._member(c):
                rows.setdefault(c.left.row._number, c.left.row)
                alls[c.left.id] = c.left
            else:
                for t in terms_of(c):
                    need(t)
        for c in calls:
            for t in terms_of(c):
                need(t)
        for c in subs:
            for t in terms_of(c):
                if isinstance(t, FieldTerm):
                    soft[t.id] = t
        if not rows:
            raise ValueError("a query must bind at least one row")
        frames, used, tight = self._scans(rows, hard, alls, soft, plain)
        edges, rest = self._edges(plain, rows, used)
        df = self._join(frames, edges, calls, tight)
        df = df.filter(F.lit(False)) if never else df
        for c in rest:
            df = df.filter(self._condition(c))
        for c in subs:
            df = self._sub(df, c)
        return df

    @staticmethod
    def _member(c: Compare) -> bool:
        """set field === constant or set field === row is a pattern of its own; a constant tests membership."""
        return c.op == "=" and isinstance(c.left, FieldTerm) and c.left.of.many and not isinstance(c.right, Term)

    @staticmethod
    def _reference(c: Compare) -> tuple[FieldTerm, Row] | None:
        if c.op != "=":
            return None
        a, b = c.left, c.right
        if isinstance(a, FieldTerm) and a.of.ref and isinstance(b, Row):
            return a, b
        if isinstance(b, FieldTerm) and b.of.ref and isinstance(a, Row):
            return b, a
        return None

    def _scans(self, rows, hard, alls, soft, plain):
        refs = [(c, r) for c in plain if (r := self._reference(c))]
        ref_targets = {}
        for c, (f, target) in refs:
            if f.row._number in rows and target._number in rows and not f.of.many:
                ref_targets.setdefault(target._number, (c, f))
        frames, same, used = {}, [], set()
        tight = {c.left.row._number for c in plain if self._member(c)}  # rows that some filter cuts down
        for n, r in rows.items():
            fields = [t for t in {**soft, **hard}.values() if t.row._number == n]
            sets = [t for t in alls.values() if t.row._number == n]
            if n in ref_targets and not fields and not sets and ref_targets[n][1].row._number != n and n not in used:
                c, f = ref_targets[n]
                if all(x._number != n for y, (_, x) in refs if y is not c) and not any(self._reference(y) is None and any(row_of(t)._number == n for t in terms_of(y)) for y in plain):
                    same.append((f.row._number, r, f))
                    used.add(id(c))
                    continue
            df = self.db.frame(r._of)
            picked = [F.col("eid").alias(eid(r))]
            for t in fields:
                if t.of.many and t.id not in hard:
                    continue
                picked.append(F.col(t.of.name).alias(col_name(t)))
            for t in sets:
                picked.append(F.col(t.of.name).alias(whole(t)))
            df = df.select(*picked)
            for t in sets:
                for c in plain:
                    if self._member(c) and c.left.id == t.id:
                        df = df.filter(F.array_contains(whole(t), self._constant(c.right, t)))
            df = df.drop(*[whole(t) for t in sets])
            for t in fields:
                if t.id in hard and t.of.many:
                    df = df.withColumn(col_name(t), F.explode(col_name(t)))
                elif t.id in hard and t.of.optional:
                    df = df.filter(F.col(col_name(t)).isNotNull())
            for c in plain:
                if not self._member(c) and id(c) not in used and {row_of(t)._number for t in terms_of(c)} == {n} and self._reference(c) is None:
                    df = df.filter(self._condition(c))
                    used.add(id(c))
                    tight.add(n)
            frames[n] = df
        # a row of which only the identity is wanted is the reference to it
        for n, target, f in same:
            frames[n] = frames[n].withColumn(eid(target), F.col(col_name(f)))
        used |= {id(c) for c in plain if self._member(c)}
        return frames, used, tight

    def _constant(self, value: Any, t: FieldTerm):
        if isinstance(value, Datum):
            found = self.db.eid_of(value)
            return F.lit(found if found is not None else -1).cast("bigint")
        return literal(value, t)

    def _side(self, x: Any, other: Any):
        if isinstance(x, Row):
            return self._col(eid(x))
        if isinstance(x, FieldTerm):
            return self._col(col_name(x))
        if isinstance(x, Applied):
            return x.change(self._col(col_name(x.field)), *x.args)
        if isinstance(x, Datum):
            found = self.db.eid_of(x)
            return F.lit(found if found is not None else -1).cast("bigint")
        return literal(x, other)

    def _condition(self, c: Compare | Truth) -> Column:
        if isinstance(c, Truth):
            return F.lit(c.holds)
        return SYMBOLS[c.op](self._side(c.left, c.right), self._side(c.right, c.left))

    def _edges(self, plain, rows, used):
        edges, rest = [], []
        for c in plain:
            if id(c) in used:
                continue
            numbers = {row_of(t)._number for t in terms_of(c)}
            if c.op == "=" and len(numbers) == 2 and numbers <= set(rows):
                edges.append((numbers, c))
            else:
                rest.append(c)
        return edges, rest

    def _join(self, frames: dict[int, DataFrame], edges, calls, tight: set[int]) -> DataFrame:
        """Connected rows first; rows that nothing ties together are crossed, as the query asks.

        tight: rows that a filter cuts down. One of them comes first, so that what is called searches from there.
        """
        left = dict(frames)
        first = next((n for n in left if n in tight), next(iter(left)))
        df, have = left.pop(first), {first}
        edges, calls = list(edges), list(calls)
        while True:
            moved = False
            for n in list(left) if calls else []:
                mine = [c for numbers, c in edges if n in numbers and numbers - {n} <= have]
                if mine and n in tight:
                    df = df.join(left.pop(n), reduce(lambda a, b: a & b, [self._condition(c) for c in mine]))
                    have.add(n)
                    edges = [(s, c) for s, c in edges if c not in mine]
            for c in list(calls):
                sides = [(c.left, "src"), (c.right, "dst")]
                bound = [(s, k) for s, k in sides if not isinstance(s, Row) or eid(s) in df.columns]
                free = [(s, k) for s, k in sides if isinstance(s, Row) and eid(s) not in df.columns]
                if not any(isinstance(s, Row) for s, _ in bound):
                    continue
                ends = {s._number: df for s, _ in bound if isinstance(s, Row) and have & tight}
                ends |= {s._number: left[n] for s, _ in free for n in left if n in tight and eid(s) in left[n].columns}
                rel = self._relation(c, ends)
                on = reduce(lambda a, b: a & b, [self._side(s, None) == F.col(f"_{k}") for s, k in bound])
                pair = rel.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"))
                if free:
                    df = df.join(pair, on)
                    for s, k in free:
                        owner = next((n for n, x in left.items() if eid(s) in x.columns), None)
                        if eid(s) in df.columns:
                            df = df.filter(F.col(f"_{k}") == F.col(eid(s)))
                        elif owner is not None:
                            df = df.join(left.pop(owner), F.col(f"_{k}") == F.col(eid(s)))
                            have.add(owner)
                        else:
                            df = df.withColumn(eid(s), F.col(f"_{k}"))
                    df = df.drop("_src", "_dst")
                else:
                    df = df.join(pair, on, "left_semi")
                calls.remove(c)
                moved = True
            for n in list(left):
                mine = [c for numbers, c in edges if n in numbers and numbers - {n} <= have]
                if mine:
                    df = df.join(left.pop(n), reduce(lambda a, b: a & b, [self._condition(c) for c in mine]))
                    have.add(n)
                    edges = [(s, c) for s, c in edges if c not in mine]
                    moved = True
            if not moved:
                if not left:
                    break
                n = next(iter(left))
                df = df.crossJoin(left.pop(n))
                have.add(n)
        for _, c in edges:
            df = df.filter(self._condition(c))
        if calls:
            raise ValueError("a rule call must bind a row")
        return df

    def _relation(self, c: Call, ends: dict[int, DataFrame]) -> DataFrame:
        """The pairs of the rule. ends: bindings so far of rows that are cut down; the rule need only search from them."""
        known = self.relations.get(id(c), self.relations.get(c.rule.key))
        if known is not None:
            return known
        seeds = {}
        for side, name in ((c.left, "sources"), (c.right, "targets")):
            if isinstance(side, Datum):
                found = self.db.eid_of(side)
                seeds[name] = self.db.spark.createDataFrame([(found if found is not None else -1,)], "eid bigint")
            elif isinstance(side, Row) and side._number in ends:
                seeds[name] = cut(ends[side._number].select(F.col(eid(side)).alias("eid")).distinct())
        return c.rule.relation(self.db, **seeds)

    def _sub(self, df: DataFrame, c: Not | Exists) -> DataFrame:
        """Semi-join for exists, one anti-join for each alternative inside not_."""
        how = "left_semi" if isinstance(c, Exists) else "left_anti"
        alternatives = dnf(c.part)
        if isinstance(c, Exists) and len(alternatives) > 1:
            # a subquery for each alternative, which Catalyst makes a join that marks rows
            around, self.outside = self.outside, frozenset(df.columns)
            try:
                each = [self._correlated(df, parts, {c.row._number: c.row}) for parts in alternatives]
            finally:
                self.outside = around
            return df.filter(reduce(lambda a, b: a | b, [inner.filter(on).exists() for inner, on in each]))
        for parts in alternatives:
            inner, on = self._correlated(df, parts, {c.row._number: c.row} if isinstance(c, Exists) else {})
            if inner is None:
                hold = F.coalesce(on, F.lit(False))
                df = df.filter(~hold if how == "left_anti" else hold)
            else:
                df = df.join(inner, on, how)
        return df

    def _correlated(self, df: DataFrame, parts: list[Constraint], fresh: dict[int, Row]):
        """(plan of the rows that only the sub-plan speaks of, condition that ties it to ``df``); without such rows the plan is None."""
        have = set(df.columns)
        copies: dict[int, Row] = {}
        ties: list[Column] = []

        def local(t):
            """Outer rows stay; a set field that isn't bound outside is looked at through a copy of its row."""
            if isinstance(t, Applied):
                return Applied(t.name, t.change, local(t.field), *t.args)
            if isinstance(t, FieldTerm) and eid(t.row) in have and col_name(t) not in have:
                if t.row._number not in copies:
                    copies[t.row._number] = Row(t.row._of)
                return FieldTerm(copies[t.row._number], t.of)
            return t

        moved: list[Constraint] = []
        for p in parts:
            if isinstance(p, Compare):
                moved.append(Compare(p.op, local(p.left), local(p.right) if isinstance(p.right, Term) else p.right))
            else:
                moved.append(p)
        inner_parts, outer_parts, rows = [], [], dict(fresh)
        for p in moved:
            numbers = {row_of(t)._number: row_of(t) for t in terms_of(p)}
            mine = {n: r for n, r in numbers.items() if eid(r) not in have}
            rows.update(mine)
            if isinstance(p, (Call, Exists)) or mine and len(mine) == len(numbers):
                inner_parts.append(p)
            else:
                outer_parts.append(p)
        for n, r in copies.items():
            rows[r._number] = r
            ties.append(self._col(f"r{n}__eid") == F.col(eid(r)))
        # an outer row that a rule call or an inner exists speaks of is looked at through a copy as well
        again: dict[int, Row] = {}

        def copied(t):
            if not isinstance(t, Term) or eid(row_of(t)) not in have:
                return t
            r = again.setdefault(row_of(t)._number, Row(row_of(t)._of))
            copy = lambda f: FieldTerm(r, f.of)
            return r if isinstance(t, Row) else Applied(t.name, t.change, copy(t.field), *t.args) if isinstance(t, Applied) else copy(t)

        fixed = [substituted(p, copied) if isinstance(p, (Call, Exists)) else p for p in inner_parts]
        for n, r in again.items():
            rows[r._number] = r
            ties.append(self._col(f"r{n}__eid") == F.col(eid(r)))
        if not rows:
            return None, reduce(lambda a, b: a & b, [self._condition(p) for p in outer_parts], F.lit(True))
        needed: list[Term] = list(rows.values())
        for p in outer_parts:
            needed += [t for t in terms_of(p) if row_of(t)._number in rows]
        inner = self.bindings(fixed, needed)
        on = [*ties, *[self._condition(p) for p in outer_parts]]
        return inner, reduce(lambda a, b: a & b, on) if on else F.lit(True)


def output(t: Term) -> Column:
    if isinstance(t, Applied):
        return t.change(F.col(col_name(t.field)), *t.args)
    return F.col(eid(t)) if isinstance(t, Row) else F.col(col_name(t))


def aggregated(t: Aggregate) -> Column:
    c = output(t.of)
    if t.fn == "count":
        return F.count(F.lit(1))
    if t.fn == "count_distinct":
        return F.countDistinct(c)
    return F.avg(c.cast("double")) if t.fn == "avg" else {"sum": F.sum, "min": F.min, "max": F.max}[t.fn](c)


def _order(t: Windowed) -> list[Column]:
    return [output(o.term).desc_nulls_last() if o.descending else output(o.term).asc_nulls_first() for o in t.spec.orders]


def windowed(df: DataFrame, named: dict[str, Windowed]) -> DataFrame:
    """``df`` with a column for each window term. Terms without partition keys run over all rows, yet in many tasks."""
    keyed = {n: t for n, t in named.items() if t.spec.keys}
    # distinct values are counted by their ranks; a set of them would grow with the group
    ranks = {f"_d_{n}": F.dense_rank().over(Window.partitionBy(*map(output, t.spec.keys)).orderBy(output(t.of).desc_nulls_last())) for n, t in keyed.items() if t.fn == "count_distinct"}
    df = df.withColumns(ranks) if ranks else df
    out = {}
    for n, t in keyed.items():
        spec = Window.partitionBy(*map(output, t.spec.keys))
        ordered = spec.orderBy(*(_order(t) or [F.lit(0)]))
        if t.fn in ("row_number", "rank", "dense_rank"):
            out[n] = getattr(F, t.fn)().over(ordered).cast("bigint")
        elif t.fn in ("lag", "lead"):
            out[n] = getattr(F, t.fn)(output(t.of), t.offset).over(ordered)
        elif t.fn == "count_distinct":
            out[n] = F.coalesce(F.max(F.when(output(t.of).isNotNull(), F.col(f"_d_{n}"))).over(spec), F.lit(0)).cast("bigint")
        else:
            out[n] = aggregated(Aggregate(t.fn, t.of)).over(spec)
    df = df.withColumns(out) if out else df
    return _over_all(df, {n: t for n, t in named.items() if not t.spec.keys})


def _over_all(df: DataFrame, named: dict[str, Windowed]) -> DataFrame:
    orders: dict[tuple, list[str]] = {}
    whole = {}
    for n, t in named.items():
        if t.fn in ("row_number", "rank", "dense_rank", "lag", "lead"):
            orders.setdefault(tuple((term_id(o.term), o.descending) for o in t.spec.orders), []).append(n)
        else:
            whole[n] = aggregated(Aggregate(t.fn, t.of))
    for names in orders.values():
        numbers = [f"_{fn}" for fn in ("row_number", "rank", "dense_rank")]
        df = ranked(df, _order(named[names[0]]), *numbers)
        far = {n: (-1 if named[n].fn == "lag" else 1) * named[n].offset for n in names if named[n].fn in ("lag", "lead")}
        df = cut(df) if far else df
        rows = df
        for n, k in far.items():
            other = rows.select((F.col("_row_number") - k).alias("_row_number"), output(named[n].of).alias(n))
            df = df.join(other, "_row_number", "left")
        df = df.withColumns({n: F.col(f"_{named[n].fn}") for n in names if n not in far}).drop(*numbers)
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in whole.items()]))) if whole else df  # one row


def _base_terms(shape: Shape) -> list[Term]:
    out: list[Term] = []
    for t in shape.terms:
        if isinstance(t, (Row, FieldTerm, Applied)):
            out.append(t)
        elif isinstance(t, Aggregate):
            out.append(t.of)
        else:
            out += [*([t.of] if t.of is not None else []), *t.spec.keys, *[o.term for o in t.spec.orders]]
    return [field_of(t) for t in out]


def _one_scan(alternatives: list[list[Constraint]]) -> tuple[list[Constraint], list[list[Compare]]] | None:
    """Alternatives that differ only in plain filters, over the same always-present fields: (what they share, the filters)."""
    shared = [c for c in alternatives[0] if all(any(c is x for x in d) for d in alternatives[1:])]
    rest = [[c for c in d if not any(c is s for s in shared)] for d in alternatives]
    simple = lambda c: isinstance(c, Compare) and all(isinstance(t, FieldTerm) and not t.of.many and not t.of.optional and not t.of.ref for t in terms_of(c))
    if not all(simple(c) for d in rest for c in d):
        return None
    over = [{row_of(t)._number for c in d for t in terms_of(c)} for d in rest]
    return (shared, rest) if all(o == over[0] for o in over) else None


def compiled(db, shape: Shape, relations: dict | None = None) -> DataFrame:
    ids = [term_id(t) for t in shape.terms]
    for o in shape.orders:
        if term_id(o.term) not in ids:
            raise ValueError(f"order_by term {o.term!r} does not appear in find")
    alternatives = dnf(shape.constraint)
    outputs = _base_terms(shape)
    plan = Plan(db, relations)
    once = _one_scan(alternatives) if len(alternatives) > 1 else None
    if once:
        # one scan serves all alternatives; a row is given once for each that it satisfies
        shared, rest = once
        df = plan.bindings(shared, outputs + [t for d in rest for c in d for t in terms_of(c)])
        hits = F.array(*[F.when(reduce(lambda a, b: a & b, [plan._condition(c) for c in d], F.lit(True)), F.lit(i)) for i, d in enumerate(rest)])
        df = df.withColumn("_alternative", F.explode(F.filter(hits, lambda x: x.isNotNull())))
    else:
        wanted = list(dict.fromkeys(eid(t) if isinstance(t, Row) else col_name(t) for t in outputs))
        df = reduce(DataFrame.unionAll, [plan.bindings(d, outputs).select(*wanted) for d in alternatives])
    names, terms = shape.names, shape.terms
    if any(isinstance(t, Aggregate) for t in terms):
        keys = [output(t).alias(n) for n, t in zip(names, terms) if not isinstance(t, Aggregate)]
        sums = [aggregated(t).alias(n) for n, t in zip(names, terms) if isinstance(t, Aggregate)]
        if keys:
            df = df.groupBy(*keys).agg(*sums)
        else:
            df = df.agg(*sums, F.count(F.lit(1)).alias("_n")).filter("_n > 0")  # over nothing there is no row
        df = df.select(*names)
    else:
        over = {f"_w_{n}": t for n, t in zip(names, terms) if isinstance(t, Windowed)}
        df = windowed(df, over) if over else df
        df = df.select(*[(F.col(f"_w_{n}") if isinstance(t, Windowed) else output(t)).alias(n) for n, t in zip(names, terms)])
    if shape.is_distinct:
        df = df.dropDuplicates()
    if shape.orders:
        by = [names[ids.index(term_id(o.term))] for o in shape.orders]
        df = df.orderBy(*[F.col(n).desc_nulls_last() if o.descending else F.col(n).asc_nulls_first() for n, o in zip(by, shape.orders)])
    if shape.skipped:
        df = df.offset(shape.skipped)
    return df.limit(shape.limited) if shape.limited is not None else df
