"""References to records that don't exist: keyed pending state, maintained as references and parents come and go."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .datoms import POS, commit_times, facts, fact_state, many_attrs, micros
from .shared import cut
from .skew import LEAST, salted_join

REFS = "src string, rec string, target string, period string, ref_at decimal(30,0)"
PARENTS = f"space string, target string, alive boolean, born {POS}, born_tx bigint"


class OrphanState:
    """All present references by the key of their target, the index of parents, and which references wait.

    refs: src (the table), rec, target, period, ref_at (own time in microseconds; own transaction for the sources in
    ``by_tx``). parents: space (which sources may refer to it, see ``spaces``), target, alive, born and born_tx (time and
    transaction from which it was there). A parent that the index lacks was never there. ``step`` looks only at references
    that are new or whose parent has changed: new ones probe the index, arriving parents resolve the waiting, deletions
    reopen the resolved. A step's result is written down when the next step begins, so the last one costs no copy.
    """

    def __init__(self, spark: SparkSession, spaces: dict[str, str], by_tx: tuple[str, ...] = (), least: int = LEAST):
        self.spaces, self.by_tx, self.least = spaces, by_tx, least
        self.refs = spark.createDataFrame([], REFS + ", kind string")
        self.parents = spark.createDataFrame([], PARENTS)
        self.steps = self.told = 0  # steps so far, and those that brought parents

    def _space(self, src: Column) -> Column:
        return F.create_map(*[x for k, v in self.spaces.items() for x in (F.lit(k), F.lit(v))])[src]

    def _probe(self, refs: DataFrame) -> DataFrame:
        """kind: missing, deleted or late; null where the reference holds."""
        known = salted_join(refs.withColumn("space", self._space(F.col("src"))), self.parents, ["space", "target"], "left", self.least)
        born = F.when(F.col("src").isin(*self.by_tx), F.col("born_tx").cast(POS)).otherwise(F.col("born")) if self.by_tx else F.col("born")
        kind = F.when(F.col("alive").isNull(), "missing").when(~F.col("alive"), "deleted").when(born > F.col("ref_at"), "late")
        return known.select(*refs.columns, kind.alias("kind"))

    def step(self, new: DataFrame | None = None, gone: DataFrame | None = None, parents: DataFrame | None = None) -> "OrphanState":
        """new: references that appear. gone: (src, rec, target) that disappear. parents: their present form, whole rows; those with alive false are deleted."""
        if self.steps:
            self.refs, self.parents = cut(self.refs), (cut(self.parents) if self.told > 1 else self.parents)
        refs, first = self.refs, not self.steps
        self.steps += 1
        if gone is not None:
            refs = refs.join(gone.select("src", "rec", "target").distinct(), ["src", "rec", "target"], "left_anti")
        again = new.select(*[c for c in refs.columns if c != "kind"]).distinct() if new is not None else None
        if parents is not None:
            parents = cut(parents.select(*self.parents.columns))
            touched = parents.select("space", "target").distinct()
            spaced = refs.withColumn("space", self._space(F.col("src")))
            waiting = salted_join(spaced, touched, ["space", "target"], "left_semi", self.least).drop("space", "kind")
            refs = salted_join(spaced, touched, ["space", "target"], "left_anti", self.least).drop("space")
            again = waiting if again is None else again.unionByName(waiting)
            self.parents = self.parents.join(touched, ["space", "target"], "left_anti").unionByName(parents) if self.told else parents
            self.told += 1
        if again is not None:
            probed = self._probe(again) if self.told else again.withColumn("kind", F.lit("missing"))
            refs = probed if first else refs.unionByName(probed)
        self.refs = refs
        return self

    def pending(self) -> DataFrame:
        """(src, rec, target, kind, period): the distinct references that are orphans now."""
        return self.refs.filter(F.col("kind").isNotNull()).select("src", "rec", "target", "kind", "period").distinct()

    def counts(self) -> DataFrame:
        """A snapshot: orphans by source, kind and period."""
        return self.pending().groupBy("src", "kind", "period").agg(F.count(F.lit(1)).alias("orphans"))


def month(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def department_parents(department: DataFrame) -> DataFrame:
    """A code lives while it has a row without deleted_at; born is the first creation among those (null: before all)."""
    stays = F.col("deleted_at").isNull()
    code = F.upper(F.trim("code"))
    born = F.min(F.when(stays, F.coalesce(micros(F.col("created_at")), F.lit(-(1 << 62)))))
    rows = department.filter(code.isNotNull()).groupBy(code.alias("target")).agg(F.bool_or(stays).alias("alive"), born.cast(POS).alias("born"))
    return rows.select(F.lit("department").alias("space"), "target", "alive", "born", F.lit(None).cast("bigint").alias("born_tx"))


def entity_parents(feed: DataFrame, times: DataFrame, many: list[str]) -> DataFrame:
    """The entities that were ever asserted: alive while any fact of theirs is live, born with their first assert.

    From values to fields to entities, each step combined before its shuffle, so an entity or a field may hold any share
    of the facts.
    """
    add, pos = F.col("add"), F.col("pos")
    values = facts(feed).groupBy("e", "a", "v").agg(F.max(F.when(add, pos)).alias("la"), F.max(F.when(~add, pos)).alias("lr"), F.min(F.when(add, F.col("t"))).alias("t"))
    is_many = F.col("a").isin(many) if many else F.lit(False)
    stands = F.col("lr").isNull() | (F.col("lr") <= F.col("la"))
    # as in ``live``: many values each for itself, of single ones the last
    each = values.filter(F.col("la").isNotNull()).groupBy("e", "a").agg(F.max(F.when(~is_many, F.struct("la", "v", stands.alias("stands")))).alias("x"), F.bool_or(is_many & stands).alias("several"), F.min("t").alias("t"))
    one = F.coalesce(F.col("x.stands"), F.lit(False))
    known = each.groupBy("e").agg(F.bool_or(F.col("several") | one).alias("alive"), F.min("t").alias("t")).join(times, "t", "left")
    return known.select(F.lit("entity").alias("space"), F.col("e").cast("string").alias("target"), "alive", F.col("at").cast(POS).alias("born"), F.col("t").alias("born_tx"))


def stays(rows: DataFrame, many: list[str]) -> DataFrame:
    """(e, a, v, t): live values and the transaction of the assert that began the value's present stay.

    The stay began with the first assert after the last retract of the value and, for cardinality one, after the last
    assert of any other value. An assert of a value that holds begins nothing.
    """
    state = cut(fact_state(rows))
    is_many = F.col("a").isin(many) if many else F.lit(False)
    stands = F.col("lr").isNull() | (F.col("lr") <= F.col("la"))
    several = state.filter(is_many & F.col("la").isNotNull() & stands).select("e", "a", "v", F.col("lr").alias("after"))
    # of a single value the two last asserted; the limit works before the shuffle, so a field with very many values is no burden
    top = state.filter(~is_many & F.col("la").isNotNull()).withColumn("k", F.row_number().over(Window.partitionBy("e", "a").orderBy(F.desc("la"), F.desc("v")))).filter("k <= 2")
    last = top.groupBy("e", "a").agg(F.max(F.when(F.col("k") == 1, F.struct("v", "la", "lr"))).alias("x"), F.max(F.when(F.col("k") == 2, F.col("la"))).alias("other"))
    single = last.select("e", "a", "x.v", "x.la", "x.lr", "other").filter(stands).select("e", "a", "v", F.greatest("lr", "other").alias("after"))
    since = several.unionByName(single)
    told = rows.filter("add").select("e", "a", "v", "pos", "t").join(since, ["e", "a", "v"])
    told = told.filter(F.col("after").isNull() | (F.col("pos") >= F.col("after")))
    return told.groupBy("e", "a", "v").agg(F.min(F.struct("pos", "t")).alias("x")).select("e", "a", "v", "x.t")


def employee_refs(employee: DataFrame) -> DataFrame:
    code = F.nullif(F.upper(F.trim("dept")), F.lit(""))
    return employee.filter(F.col("email").isNotNull() & code.isNotNull()).select(F.lit("employee").alias("src"), F.col("email").alias("rec"), code.alias("target"), month(F.col("hired_at")).alias("period"), micros(F.col("hired_at")).cast(POS).alias("ref_at")).distinct()


def player_refs(player: DataFrame) -> DataFrame:
    return player.filter(F.col("email").isNotNull() & F.col("team").isNotNull()).select(F.lit("player").alias("src"), F.col("email").alias("rec"), F.col("team").cast("string").alias("target"), month(F.col("joined_at")).alias("period"), micros(F.col("joined_at")).cast(POS).alias("ref_at")).distinct()


SPACES = {"employee": "department", "player": "entity", "datom": "entity"}


def _datom_refs(feed: DataFrame, times: DataFrame, ref_attrs: list[str], many: list[str]) -> DataFrame:
    own = stays(facts(feed, ref_attrs), many).join(times, "t", "left")
    return own.select(F.lit("datom").alias("src"), F.concat(F.col("e").cast("string"), F.lit(":"), F.col("a")).alias("rec"), F.col("v").alias("target"), month(F.timestamp_micros("at")).alias("period"), F.col("t").cast(POS).alias("ref_at"))


def _ref_attrs(schema: DataFrame) -> list[str]:
    return sorted(r.attr for r in schema.filter((F.lower(F.trim("value_type")) == "ref") & F.col("attr").isNotNull()).select("attr").distinct().collect())


def orphans(feed: DataFrame, reports: DataFrame, schema: DataFrame, employee: DataFrame, department: DataFrame, player: DataFrame, least: int = LEAST) -> OrphanState:
    """The state after all references of Employee.dept, Player.team and ref-valued datoms and then all parents have come.

    References first: all of them wait as missing; then the parents come and resolve them or show that they are gone or
    were born too late. A reference whose own time is null can't be late and has period null. A ref that isn't a whole
    number points to nothing.
    """
    many = many_attrs(schema)
    out = OrphanState(feed.sparkSession, SPACES, ("datom",), least)
    times = cut(commit_times(feed, reports))
    out.step(new=employee_refs(employee).unionByName(player_refs(player)).unionByName(_datom_refs(feed, times, _ref_attrs(schema), many)))
    return out.step(parents=department_parents(department).unionByName(entity_parents(feed, times, many)))


def snapshots(feed: DataFrame, reports: DataFrame, schema: DataFrame, employee: DataFrame, department: DataFrame, player: DataFrame, points: list[int], least: int = LEAST) -> DataFrame:
    """(upto, src, kind, period, orphans): the counts after the transactions up to each of ``points``, which rise.

    One state goes from point to point: references that came, went or began a new stay, and parents that came, changed
    or were deleted in between, are all that a step is told. Employees, players and departments are there from the first.
    """
    many, attrs = many_attrs(schema), _ref_attrs(schema)
    state = OrphanState(feed.sparkSession, SPACES, ("datom",), least)
    times = cut(commit_times(feed, reports))
    refs = parents = None
    out = []
    for point in points:
        part = feed.filter(F.col("t") <= point)
        now = cut(employee_refs(employee).unionByName(player_refs(player)).unionByName(_datom_refs(part, times, attrs, many)))
        there = cut(department_parents(department).unionByName(entity_parents(part, times, many)).select(*state.parents.columns))
        state.step(new=_less(now, refs), gone=_less(refs, now) if refs is not None else None, parents=_less(there, parents))
        out.append(state.counts().select(F.lit(point).alias("upto"), "src", "kind", "period", "orphans"))
        refs, parents = now, there
    return reduce(DataFrame.unionAll, out)


def _less(a: DataFrame, b: DataFrame | None) -> DataFrame:
    """The rows of a that b hasn't."""
    if b is None:
        return a
    same = reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in a.columns])
    return a.join(b, same, "left_anti")
