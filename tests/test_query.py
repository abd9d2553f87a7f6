from collections import Counter, defaultdict

import pytest

from factbase import Db, avg, count, count_distinct, day, dense_rank, empty, entity, exists, find, guard, Key, lag, max_, min_, month, not_, partition_by, plus_days, rank, row_number, sum_, year

from .schemas import Depot, Driver, Fleet, Permit, Post, Shelf, Tram, Trip

FLEET = Fleet(7)
TRAMS, TRIPS, DEPOTS, DRIVERS = FLEET.trams, FLEET.trips, FLEET.depots, FLEET.drivers


@pytest.fixture(scope="module")
def db(spark):
    return Db(spark).add(*FLEET.all()).folded()


def same(got, want):
    assert Counter(got) == Counter(want) and len(list(want)) > 0


def test_filters_and_bags(db):
    same(db.query(Tram, lambda t: find(t.plate).where(t.built > 2000)), [t.plate for t in TRAMS if t.built > 2000])
    either = lambda t: find(t.plate).where((t.built > 1990) | (t.line <= 3))
    same(db.query(Tram, either), [t.plate for t in TRAMS if t.built > 1990] + [t.plate for t in TRAMS if t.line <= 3])
    same(db.query(Tram, lambda t: either(t).distinct()), {t.plate for t in TRAMS if t.built > 1990 or t.line <= 3})
    same(db.query(Tram, lambda t: find(t.plate)), [t.plate for t in TRAMS])
    mixed = lambda t, d: find(t.plate).where((t.line == 1) | ((t.depot == d) & (d.city == "Ulm")))
    same(db.query(Tram, Depot, mixed), [t.plate for t in TRAMS if t.line == 1] + [t.plate for t in TRAMS if t.depot.city == "Ulm"])


def test_constants(db):
    same(db.query(Depot, lambda d: find(d.code).where(guard(2 > 1) & (d.lanes > 3))), [d.code for d in DEPOTS if d.lanes > 3])
    assert db.query(Depot, lambda d: find(d.code).where(guard(False))).run() == []
    assert db.query(Depot, lambda d: find(d.code).where(empty())).run() == []
    same(db.query(Depot, lambda d: find(d.code).where(empty() | (d.lanes > 3))), [d.code for d in DEPOTS if d.lanes > 3])
    assert [tuple(r) for r in db.pure(n=3, s="x").collect()] == [(3, "x")]


def test_joins(db):
    same(db.query(Tram, Depot, lambda t, d: find(t.plate, d.city).where((t.depot == d) & (d.lanes > 4))), [(t.plate, t.depot.city) for t in TRAMS if t.depot.lanes > 4])
    same(db.query(Tram, Trip, lambda t, r: find(t.plate, r.riders).where((t.plate == r.plate) & (r.riders > 40))), [(r.plate, r.riders) for r in TRIPS if r.riders > 40 and r.plate != "lost"])
    same(db.query(Depot, Depot, lambda a, b: find(a.code, b=b.code).where(a.lanes < b.lanes)), [(a.code, b.code) for a in DEPOTS for b in DEPOTS if a.lanes < b.lanes])
    same(db.query(Tram, Tram, lambda a, b: find(a.plate, b=b.plate).where((a.depot == b.depot) & (a.line == b.line) & (a != b))), [(a.plate, b.plate) for a in TRAMS for b in TRAMS if a.depot == b.depot and a.line == b.line and a is not b])
    same(db.query(Depot, Permit, lambda d, p: find(d.code, p.name)), [(d.code, p) for d in DEPOTS for p in ("snow", "night", "steep")])
    same(db.query(Driver, Permit, lambda d, p: find(d.number, p.name).where(d.permits == p)), [(d.number, p.name) for d in DRIVERS for p in d.permits])
    same(db.query(Tram, lambda t: find(t.plate).where(t.depot == DEPOTS[1])), [t.plate for t in TRAMS if t.depot == DEPOTS[1]])


def test_a_reference_alone_skips_the_target(db):
    q = db.query(Tram, Depot, lambda t, d: find(t.plate, at=d).where(t.depot == d))
    assert "Join" not in q.frame._jdf.queryExecution().optimizedPlan().toString() and len(q.run()) == len(TRAMS)


def test_aggregates(db):
    ages = defaultdict(list)
    for t in TRAMS:
        ages[t.depot.city].append(t.built)
    q = lambda t, d: find(d.city, n=count(t), low=min_(t.built), high=max_(t.built), mean=avg(t.built), kinds=count_distinct(t.line)).where(t.depot == d)
    lines = {c: len({t.line for t in TRAMS if t.depot.city == c}) for c in ages}
    same(db.query(Tram, Depot, q), [(c, len(x), min(x), max(x), sum(x) / len(x), lines[c]) for c, x in ages.items()])
    assert db.query(Trip, lambda r: find(total=sum_(r.riders), n=count(r))).run() == [(sum(r.riders for r in TRIPS), len(TRIPS))]
    assert db.query(Trip, lambda r: find(count(r)).where(r.riders > 1000)).run() == []

    def ranked(r):
        s = sum_(r.riders)
        return find(r.stop, s=s).order_by(s.desc(), r.stop).limit(4)

    totals = Counter()
    for r in TRIPS:
        totals[r.stop] += r.riders
    assert db.query(Trip, ranked).run() == sorted(totals.items(), key=lambda x: (-x[1], x[0]))[:4]
    for bad in (lambda r: find(count(3)), lambda r: find(3), lambda r: find(count(r), row_number().over(partition_by(r.stop)))):
        with pytest.raises((TypeError, ValueError)):
            db.query(Trip, bad)


def test_order_limit_offset(db):
    rows = db.query(Tram, Depot, lambda t, d: find(d.code, t.built, t.plate).where(t.depot == d).order_by(d.code, t.built.desc(), t.plate)).run()
    assert rows == sorted(((t.depot.code, t.built, t.plate) for t in TRAMS), key=lambda x: (x[0], -x[1], x[2]))
    assert db.query(Tram, lambda t: find(t.plate).order_by(t.plate.desc()).offset(3).limit(2)).run() == sorted((t.plate for t in TRAMS), reverse=True)[3:5]
    with pytest.raises(ValueError, match="does not appear in find"):
        db.query(Tram, lambda t: find(t.plate).order_by(t.built)).run()


def test_negation(db):
    ridden = {r.plate for r in TRIPS if r.riders > 50}
    same(db.query(Tram, lambda t: find(t.plate).where(not_(t.line == 2))), [t.plate for t in TRAMS if t.line != 2])
    same(db.query(Tram, Trip, lambda t, r: find(t.plate).where(not_((r.plate == t.plate) & (r.riders > 50)))), [t.plate for t in TRAMS if t.plate not in ridden])
    same(db.query(Tram, Depot, lambda t, d: find(d.code).where(not_(t.depot == d))), ["d4"])
    same(db.query(Tram, Trip, lambda t, r: find(t.plate).where(not_((t.line > 3) | ((r.plate == t.plate) & (r.riders > 50))))), [t.plate for t in TRAMS if t.line <= 3 and t.plate not in ridden])
    same(db.query(Driver, lambda d: find(d.number).where(not_(d.nick == "Kim"))), [d.number for d in DRIVERS if d.nick != "Kim"])
    for bad in (lambda t: find(t.plate).where(not_(not_(t.line == 2))), lambda t: find(t.plate).where((t.line == 1) | not_(t.line == 2))):
        with pytest.raises(ValueError, match="not"):
            db.query(Tram, bad).run()


def test_exists_is_a_semi_join(db):
    ridden = lambda t, p: any(r.plate == t.plate and p(r) for r in TRIPS)
    same(db.query(Tram, lambda t: find(t.plate).where(exists(Trip, lambda r: (r.plate == t.plate) & (r.riders < 30)))), [t.plate for t in TRAMS if ridden(t, lambda r: r.riders < 30)])
    either = lambda t: find(t.plate).where(exists(Trip, lambda r: (r.plate == t.plate) & ((r.riders < 10) | (r.stop == "s3"))))
    same(db.query(Tram, either), [t.plate for t in TRAMS if ridden(t, lambda r: r.riders < 10 or r.stop == "s3")])
    plan = db.query(Tram, either).frame._jdf.queryExecution().optimizedPlan().toString()
    assert "ExistenceJoin" in plan
    nested = lambda d: find(d.code).where(exists(Tram, lambda t: (t.depot == d) & exists(Trip, lambda r: (r.plate == t.plate) & (r.riders > 70))))
    same(db.query(Depot, nested), {t.depot.code for t in TRAMS if ridden(t, lambda r: r.riders > 70)})
    far = lambda d: find(d.code).where(exists(Tram, lambda t: (t.depot == d) & exists(Trip, lambda r: (r.plate == t.plate) & (r.stop != d.code) & (r.riders > 70))))
    same(db.query(Depot, far), {t.depot.code for t in TRAMS if ridden(t, lambda r: r.riders > 70)})
    same(db.query(Tram, lambda t: find(t.plate).where(not_(exists(Trip, lambda r: (r.plate == t.plate) & (r.riders < 30))))), [t.plate for t in TRAMS if not ridden(t, lambda r: r.riders < 30)])


def test_mistakes_fail_at_build(db):
    with pytest.raises(AttributeError):
        db.query(Tram, lambda t: find(t.color))
    with pytest.raises(TypeError):
        bool(Tram.row().line == 1)


def over(key, order):
    """Rows of each group in order, with their places."""
    groups = defaultdict(list)
    for t in TRAMS:
        groups[key(t)].append(t)
    return {k: sorted(g, key=order) for k, g in groups.items()}


def ranks(values):
    first = {}
    for i, v in enumerate(values, 1):
        first.setdefault(v, i)
    return [first[v] for v in values]


@pytest.mark.parametrize("alone", [False, True])
def test_windows(db, alone):
    """Over each depot, and over all rows, which no single task holds."""
    part = (lambda t: partition_by()) if alone else (lambda t: partition_by(t.depot))
    groups = over((lambda t: 0) if alone else (lambda t: t.depot.code), lambda t: (t.line, t.plate))
    spec = lambda t: part(t).order_by(t.line, t.plate)
    shape = lambda t: find(t.plate, n=row_number().over(spec(t)), r=rank().over(part(t).order_by(t.line)), d=dense_rank().over(part(t).order_by(t.line)), before=lag(t.built).over(spec(t)), two=lag(t.built, -2).over(spec(t)), total=sum_(t.built).over(part(t)), kinds=count_distinct(t.line).over(spec(t)), k=count(t).over(part(t)))
    want = []
    for g in groups.values():
        lines = [t.line for t in g]
        place = {v: i + 1 for i, v in enumerate(sorted(set(lines)))}
        want += [(t.plate, i + 1, r, place[t.line], g[i - 1].built if i else None, g[i + 2].built if i + 2 < len(g) else None, sum(x.built for x in g), len(place), len(g)) for i, (t, r) in enumerate(zip(g, ranks(lines)))]
    same(db.query(Tram, shape).run(), want)
    if alone:
        plan = db.query(Tram, lambda t: find(t.plate, n=row_number().over(spec(t)), s=sum_(t.built).over(part(t)))).frame._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan or "_part" in plan


def test_a_window_takes_the_rows_of_all_alternatives(db):
    shape = lambda t: find(t.plate, n=count(t).over(partition_by(t.line))).where((t.line <= 2) | (t.built > 2000))
    bag = [t for t in TRAMS if t.line <= 2] + [t for t in TRAMS if t.built > 2000]
    sizes = Counter(t.line for t in bag)
    same(db.query(Tram, shape), [(t.plate, sizes[t.line]) for t in bag])


def test_sets_share_one_element(db):
    same(db.query(Tram, lambda t: find(t.plate, t.colours)), [(t.plate, c) for t in TRAMS for c in t.colours])
    same(db.query(Tram, lambda t: find(t.plate, t.colours).where((t.colours > "b") & (t.colours < "r"))), [(t.plate, c) for t in TRAMS for c in t.colours if "b" < c < "r"])
    same(db.query(Tram, lambda t: find(t.plate, t.colours).where(t.colours == "g")), [(t.plate, c) for t in TRAMS if "g" in t.colours for c in t.colours])
    same(db.query(Tram, lambda t: find(t.plate).where(not_(t.colours == "g"))), [t.plate for t in TRAMS if "g" not in t.colours])
    same(db.query(Tram, lambda t: find(t.plate).where(not_(t.colours > "g"))), [t.plate for t in TRAMS if not any(c > "g" for c in t.colours)])


def test_an_optional_field_asks_for_presence(db):
    same(db.query(Driver, lambda d: find(d.number, d.nick)), [(d.number, d.nick) for d in DRIVERS if d.nick])
    same(db.query(Driver, Depot, lambda d, h: find(d.number, h.city).where(d.home == h)), [(d.number, d.home.city) for d in DRIVERS if d.home])


def test_dates(spark):
    from datetime import date, datetime, timedelta, timezone

    @entity
    class Due:
        id: Key[int]
        on: date
        at: datetime

    start = date(2023, 12, 30)
    rows = [(i, start + timedelta(i * 17), datetime(2023, 12, 31, 23, 30, tzinfo=timezone.utc) + timedelta(days=i)) for i in range(30)]
    db = Db(spark).add(*[Due(*r) for r in rows])
    same(db.query(Due, lambda d: find(d.id).where(d.on >= date(2024, 6, 1))), [i for i, on, _ in rows if on >= date(2024, 6, 1)])
    same(db.query(Due, lambda d: find(d.id, y=year(d.on), m=month(d.at)).where((day(d.on) > 15) & (plus_days(d.on, 30) < date(2024, 9, 1)))), [(i, on.year, at.month) for i, on, at in rows if on.day > 15 and on + timedelta(30) < date(2024, 9, 1)])
    per = Counter((on.year, on.month) for _, on, _ in rows)
    same(db.query(Due, lambda d: find(y=year(d.on), m=month(d.on), n=count(d))), [(*k, n) for k, n in per.items()])
    same(db.query(Due, Due, lambda a, b: find(a.id, b=b.id).where(plus_days(a.on, 17) == b.on)), [(i, i + 1) for i in range(29)])


def test_empty_database(spark):
    db = Db(spark, [Tram, Depot])
    assert db.query(Tram, lambda t: find(t.plate)).run() == [] and db.query(Tram, lambda t: find(n=count(t))).run() == []
    assert db.query(Tram, lambda t: find(t.plate, n=row_number().over(partition_by().order_by(t.plate)), s=sum_(t.line).over(partition_by()))).run() == []
    assert Db(spark, [Shelf, Post]).query(Post, Post, lambda a, b: find(a.code).where(a.under == b)).run() == []
