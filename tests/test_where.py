from collections import Counter, defaultdict
from datetime import date
from decimal import Decimal
from types import SimpleNamespace
from typing import Annotated

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window, functions as F

from factbase import Computed, Datum, Db, Key, Lookup, UniqueViolation, day, entity, year
from factbase.functions import windows

from .schemas import Depot, Driver, Fleet, Meter, Permit, Post, Tram, Trip

FLEET = Fleet(11)
TRAMS, TRIPS, DEPOTS, DRIVERS = FLEET.trams, FLEET.trips, FLEET.depots, FLEET.drivers


@entity
class Bill:
    no: Key[int]
    total: Decimal
    share: float
    due: date | None


BILLS = [(i, Decimal(i * i) / 4, (i - 5) * 0.5, date(2025, 1 + i % 12, 1 + i) if i % 3 else None) for i in range(12)]


@pytest.fixture(scope="module")
def db(spark):
    return Db(spark).add(*FLEET.all(), *[Bill(*b) for b in BILLS]).folded()


def plates(q):
    return sorted(t.plate for t in q)


def test_ranges_prefixes_and_patterns(db):
    for predicate in (lambda t: t.built > 2000, lambda t: (t.built >= 1990) & (t.built < 2010), lambda t: (t.line < 3) | (t.line > 5), lambda t: t.line != 4):
        kept = [t for t in TRAMS if _plain(predicate, t)]
        assert plates(db.where(Tram, predicate)) == sorted(t.plate for t in kept) and kept
    assert plates(db.where(Tram, lambda t: t.plate.startswith("t1"))) == [f"t{i}" for i in range(10, 20)]
    assert plates(db.where(Tram, lambda t: t.plate.rlike("[37]$"))) == ["t03", "t07", "t13", "t17", "t23"]
    assert sorted(b.no for b in db.where(Bill, lambda b: b.total >= Decimal("6.25"))) == [b[0] for b in BILLS if b[1] >= Decimal("6.25")]
    assert sorted(b.no for b in db.where(Bill, lambda b: b.share >= 0.0)) == [b[0] for b in BILLS if b[2] >= 0]


def _plain(predicate, record):
    """The predicate on a record in plain Python."""

    class Value:
        def __init__(self, x):
            self.x = x

        __gt__ = lambda self, o: Value(self.x > o)
        __ge__ = lambda self, o: Value(self.x >= o)
        __lt__ = lambda self, o: Value(self.x < o)
        __ne__ = lambda self, o: Value(self.x != o)
        __and__ = lambda self, o: Value(self.x and o.x)
        __or__ = lambda self, o: Value(self.x or o.x)

    return predicate(SimpleNamespace(**{k: Value(v) for k, v in record.values.items()})).x


def test_references_sets_and_options(db):
    assert plates(db.where(Tram, lambda t: t.depot == DEPOTS[2])) == sorted(t.plate for t in TRAMS if t.depot == DEPOTS[2])
    assert plates(db.where(Tram, lambda t: t.depot.city == "Graz")) == sorted(t.plate for t in TRAMS if t.depot.city == "Graz")
    assert plates(db.where(Tram, lambda t: (t.depot.city == "Graz") | (t.line == 1))) == sorted(t.plate for t in TRAMS if t.depot.city == "Graz" or t.line == 1)
    assert plates(db.where(Tram, lambda t: t.twin.depot.lanes > 3)) == sorted(t.plate for t in TRAMS if t.twin and t.twin.depot.lanes > 3)
    assert plates(db.where(Tram, lambda t: t.colours.contains("g"))) == sorted(t.plate for t in TRAMS if "g" in t.colours)
    number = lambda p: sorted(d.number for d in db.where(Driver, p))
    assert number(lambda d: d.permits.contains(Permit("snow"))) == [d.number for d in DRIVERS if Permit("snow") in d.permits]
    assert number(lambda d: d.nick == None) == [d.number for d in DRIVERS if d.nick is None]  # noqa: E711
    assert number(lambda d: d.nick.contains("Lo")) == [d.number for d in DRIVERS if d.nick == "Lo"]
    assert number(lambda d: d.home == None) == [d.number for d in DRIVERS if d.home is None]  # noqa: E711
    assert sorted(d.number for d in db.match_by(Driver, "home", DEPOTS[0])) == [d.number for d in DRIVERS if d.home == DEPOTS[0]]
    assert sorted(t.plate for t in db.match_by(Tram, "colours", "r")) == sorted(t.plate for t in TRAMS if "r" in t.colours)


def test_collection_operations(db):
    q = db.where(Tram)
    assert q.count() == len(TRAMS) and q.exists() and not db.exists(Tram, lambda t: t.built > 3000) and db.count(Tram, lambda t: t.line == 2) == sum(t.line == 2 for t in TRAMS)
    assert {r["line"]: r["count"] for r in q.count_by("line").collect()} == Counter(t.line for t in TRAMS)
    newest = defaultdict(int)
    for t in TRAMS:
        newest[t.line] = max(newest[t.line], t.built)
    assert {r.line: r.top for r in q.group_by("line").agg(top=F.max("built")).collect()} == newest
    fold = q.group_by("line").fold(lambda g: pd.DataFrame({"line": g.line[:1], "n": [g.built.max()]}), "line bigint, n bigint")
    assert {r.line: r.n for r in fold.collect()} == newest
    by = sorted(TRAMS, key=lambda t: (t.built % 10, t.plate))
    assert [t.plate for t in q.order_by(lambda t: t.built % 10, "plate").offset(2).limit(3)] == [t.plate for t in by[2:5]]
    assert [t.plate for t in q.order_by_desc("plate").limit(2)] == ["t23", "t22"]
    assert plates(q.filter_not(lambda t: t.line > 3)) == sorted(t.plate for t in TRAMS if t.line <= 3)
    assert plates(q.where(opaque=lambda t: t.plate[1:] == str(t.built)[2:])) == sorted(t.plate for t in TRAMS if t.plate[1:] == str(t.built)[2:])
    assert sorted(r.n for r in q.map(n=lambda t: t.built * 2 - t.line).collect()) == sorted(t.built * 2 - t.line for t in TRAMS)
    assert sorted((r.y, r.d) for r in db.where(Bill, lambda b: b.due != None).map(y=lambda b: year(b.due), d=lambda b: day(b.due)).collect()) == sorted((b[3].year, b[3].day) for b in BILLS if b[3])  # noqa: E711
    twice = q.flat_map(lambda pdf: pd.concat([pdf[["plate"]], pdf[["plate"]]]), "plate string")
    assert twice.count() == 2 * len(TRAMS)


def test_a_second_query_for_each_entity(db):
    """A comprehension over two collections is one join."""
    rides = db.where(Tram, lambda t: t.line <= 4).flat_map(lambda t: db.where(Trip, lambda r: (r.plate == t.plate) & (r.riders > 20)).map(line=lambda r: t.line, stop=lambda r: r.stop))
    line = {t.plate: t.line for t in TRAMS}
    assert Counter(map(tuple, rides.collect())) == Counter((line[r.plate], r.stop) for r in TRIPS if r.riders > 20 and line.get(r.plate, 9) <= 4)
    plan = rides._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "LateralJoin" not in plan
    homes = db.where(Depot).flat_map(lambda d: db.where(Tram, lambda t: t.depot == d.eid).map(code=lambda t: d.code, plate=lambda t: t.plate))
    assert sorted(map(tuple, homes.collect())) == sorted((t.depot.code, t.plate) for t in TRAMS)


def test_columns_of_the_entity_cross_nothing(db):
    """Columns of a comprehension that use the outer entity leave one join on the key, whatever else is mapped."""
    line, built = {t.plate: t.line for t in TRAMS}, {t.plate: t.built for t in TRAMS}
    known = [r for r in TRIPS if r.plate in line]
    count = Counter(r.plate for r in known)
    trips = lambda t: db.where(Trip, lambda r: r.plate == t.plate)
    number = F.count(F.lit(1)).over(Window.partitionBy("plate"))
    cases = (
        (lambda t: trips(t).map(line=lambda r: t.line, stop=lambda r: r.stop), [(line[r.plate], r.stop) for r in known]),
        (lambda t: trips(t).map(x=lambda r: r.riders + t.built, y=lambda r: F.upper(t.plate.column), plate=lambda r: r.stop), [(r.riders + built[r.plate], r.plate.upper(), r.stop) for r in known]),
        (lambda t: trips(t).map(n=lambda r: number, line=lambda r: t.line), [(count[r.plate], line[r.plate]) for r in known]),
        (lambda t: db.where(Tram, lambda u: u.line == t.line).map(a=lambda u: t.plate, b=lambda u: u.plate), [(t.plate, u.plate) for t in TRAMS for u in TRAMS if t.line == u.line]),
        (lambda t: trips(t).order_by_desc("riders").limit(1).map(line=lambda r: t.line, most=lambda r: r.riders), [(line[p], max(r.riders for r in known if r.plate == p)) for p in count]),
    )
    for work, expected in cases:
        found = db.where(Tram).flat_map(work)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert Counter(map(tuple, found.collect())) == Counter(expected) and plan.count("Join Inner, ") == plan.count("Join ") == 1, plan
    mixed = db.where(Tram).flat_map(lambda t: trips(t).map(x=lambda r: F.sum("riders").over(Window.partitionBy("plate")) + t.line.column))
    made = lambda t: (lambda upper: trips(t).map(x=lambda r: upper, y=lambda r: t.line))(F.upper(t.plate.column))
    riders = Counter()
    for r in known:
        riders[r.plate] += r.riders
    assert Counter(r.x for r in mixed.collect()) == Counter(riders[r.plate] + line[r.plate] for r in known)
    assert Counter(map(tuple, db.where(Tram).flat_map(made).collect())) == Counter((r.plate.upper(), line[r.plate]) for r in known)


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id as eid", "concat('m', id) as name", "id as n").write.parquet(str(tmp_path / "m"))
    db = Db.from_frames(spark, {Meter: spark.read.parquet(str(tmp_path / "m"))}, 2000)
    for predicate, pushed, read in ((lambda m: m.n > 990, "GreaterThan(n,990)", "struct<eid:bigint,n:bigint>"), (lambda m: m.name.startswith("m99"), "StringStartsWith(name,m99)", "struct<eid:bigint,name:string>")):
        plan = db.where(Meter, predicate).frame.select("eid")._jdf.queryExecution().executedPlan().toString()
        assert pushed in plan and read in plan.split("ReadSchema")[1]


def test_reading_by_eid_key_and_lookup(spark, db):
    rows = {r.code: r.eid for r in db.frame(Depot).collect()}
    assert db.by_eid(Depot, rows["d3"]) == DEPOTS[3] and db.by_eid(Tram, rows["d3"]) is None
    assert db.find(Depot, "d1") == DEPOTS[1] and db.find(Depot, "d9") is None and db.find(Tram, TRAMS[4].built, "built").built == TRAMS[4].built
    got = db.load(Depot, rows["d2"])
    assert got.record == DEPOTS[2] and got.eid == rows["d2"] and got.city == DEPOTS[2].city and db.load(Tram, rows["d2"]) is None
    assert db.load(Depot, Lookup(Depot, "d0")).record == DEPOTS[0] and db.load(Depot, Lookup(Depot, "no")) is None
    assert [(s.eid, s.record) for s in db.every(Depot).stored()] == sorted(((rows[d.code], d) for d in DEPOTS), key=lambda x: x[0])
    some = spark.createDataFrame([(rows["d0"],), (rows["d0"],), (10**9,)], "eid bigint")
    assert [r.code for r in db.decoded(Depot, some).collect()] == ["d0"]


def test_what_cannot_be_decoded(spark):
    log = spark.createDataFrame([(1, "Meter/name", "a", 1, 0, None, "+"), (1, "Meter/n", "seven", 1, 1, None, "+"), (2, "Meter/name", "b", 2, 0, None, "+"), (2, "Meter/n", "2", 2, 1, None, "+")], "eid bigint, attr string, v string, tx bigint, seq bigint, time timestamp, op string")
    db = Db.from_log(spark, log, [Meter])
    with pytest.raises(PySparkException, match="LoadError: Meter #1"):
        db.load(Meter, 1)
    assert db.load(Meter, 2).n == 2 and db.load(Meter, 3) is None
    assert db.since(0).load(Meter, 1) is None and [s.eid for s in db.since(0).every(Meter).stored()] == [2]


def test_pull(db):
    rows = {r.plate: r.at for r in db.where(Tram).pull(lambda t: {"plate": t.plate, "at": t.depot(lambda d: d.city)}).collect()}
    assert rows == {t.plate: t.depot.city for t in TRAMS}
    back = {r.code: [(x.plate, x.where.city) for x in r.trams] for r in db.where(Depot).pull(lambda d: {"code": d.code, "trams": d.reverse(Tram, "depot", lambda t: {"plate": t.plate, "where": {"city": t.depot(lambda x: x.city)}})}).collect()}
    assert {c: sorted(x) for c, x in back.items()} == {d.code: sorted((t.plate, d.city) for t in TRAMS if t.depot == d) for d in DEPOTS}
    one = db.where(Depot, lambda d: d.code == "d1").pull(lambda d: {"trams": d.reverse(Tram, "depot", lambda t: t.plate)}).first()
    assert sorted(one.trams) == sorted(t.plate for t in TRAMS if t.depot == DEPOTS[1])
    permits = {r.n: set(r.p) for r in db.where(Driver).pull(lambda d: {"n": d.number, "p": d.permits.map(lambda p: p.name)}).collect()}
    assert permits == {d.number: {p.name for p in d.permits} for d in DRIVERS}
    holders = {r.name: sorted(x.n for x in r.who) for r in db.where(Permit).pull(lambda p: {"name": p.name, "who": p.reverse(Driver, "permits", lambda d: {"n": d.number, "more": {"nick": d.nick}})}).collect()}
    assert holders == {p: [d.number for d in DRIVERS if Permit(p) in d.permits] for p in ("snow", "night", "steep")}
    homes = {r.n: r.home for r in db.where(Driver).pull(lambda d: {"n": d.number, "home": d.home(lambda h: h.code)}).collect()}
    assert homes == {d.number: d.home.code if d.home else None for d in DRIVERS}
    eid = db.frame(Depot).filter("code = 'd2'").first().eid
    assert db.pull_by_eid(Depot, eid, lambda d: d.city).value == DEPOTS[2].city and db.pull_by_eid(Tram, eid, lambda t: t.plate) is None


def test_pull_of_whole_entities(spark, db):
    t = next(t for t in TRAMS if t.twin)
    whole = db.where(Tram, lambda x: x.plate == t.plate).pull(lambda x: x.value()).first()
    assert whole.depot.city == t.depot.city and whole.twin.depot.lanes == t.twin.depot.lanes and whole.built == t.built
    posts = [Post("p0", None)]
    for i in range(1, 5):
        posts.append(Post(f"p{i}", posts[-1]))
    chain = Db(spark).add(posts[-1])
    deep = chain.where(Post, lambda p: p.code == "p4").pull(lambda p: p.value()).first()
    assert deep.under.under.under.under.code == "p0" and deep.under.under.under.under.under is None
    flat = chain.where(Post, lambda p: p.code == "p4").pull(lambda p: p.value(0)).first()
    assert isinstance(flat.under, int)
    eids = {r.code: r.eid for r in chain.frame(Post).collect()}
    loop = chain.upsert_frame(Post, spark.createDataFrame([("p0", eids["p2"])], "code string, under bigint"))
    with pytest.raises(RecursionError):
        loop.where(Post).pull(lambda p: p.value())


def test_folds_of_windows(spark):
    df = spark.createDataFrame([(g, i, (i * 7) % 5) for g in "ab" for i in range(6)], "g string, i bigint, x bigint")
    spread = lambda x: int(x.max() - x.iloc[0])
    rows = [(g, i, (i * 7) % 5) for g in "ab" for i in range(6)]
    for running in (True, False):
        got = {(r.g, r.i): r.y for r in windows.folded(df, ["g"], [F.col("i")], "y", spread, ["x"], "bigint", running).collect()}
        assert got == {(g, i): max(x for h, j, x in rows if h == g and (j <= i or not running)) - 0 for g, i, _ in rows}


@entity
class Ferry:
    """Keyed by what two fields come to, whatever their order."""

    a: int
    b: int
    name: str
    route: Key[Annotated[str, Computed(lambda r: f"{min(r.a, r.b)}-{max(r.a, r.b)}", lambda r: F.concat_ws("-", F.least(r.a, r.b), F.greatest(r.a, r.b)))]]


def test_computed_keys(spark):
    db = Db(spark).add(Ferry(1, 2, "x"), Ferry(2, 3, "y"))
    assert db.find(Ferry, "1-2") == Ferry(1, 2, "x") and isinstance(db.find(Ferry, "1-2"), Datum)
    with pytest.raises(UniqueViolation):
        db.add(Ferry(2, 1, "z"))
    up = db.upsert(Ferry(2, 1, "z"))
    assert up.count(Ferry) == 2 and up.find(Ferry, "1-2").name == "z"
    bulk = up.upsert_frame(Ferry, spark.createDataFrame([(3, 2, "w"), (4, 1, "v")], "a bigint, b bigint, name string"))
    assert sorted((f.a, f.b, f.name) for f in bulk.where(Ferry)) == [(2, 1, "z"), (3, 2, "w"), (4, 1, "v")]
    moved = bulk.upsert_where(Ferry, lambda f: f.name == "v", {"a": lambda f: f.a + 1})
    assert sorted(r.route for r in moved.frame(Ferry).collect()) == ["1-2", "1-4", "1-5", "2-3"]
    with pytest.raises(AttributeError):
        Ferry(1, 2, "x", route="1-2")
    assert moved.retract(Ferry(3, 2, "w")).count(Ferry) == 3
