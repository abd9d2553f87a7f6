"""Rules against walks over the same graphs in plain Python."""

import random

import pytest

from factbase import Db, Rule, closure, count, exists, find, not_
from factbase import rules as rules_module

from .schemas import Post, Rail, Stop


def reached(edges, start):
    """What lies one or more steps from ``start``, with the least number of steps."""
    out, last, depth = {}, {start}, 0
    while last:
        depth += 1
        last = {b for a, b in edges if a in last} - set(out)
        out |= dict.fromkeys(last, depth)
    return out


def net(seed, n=14, loops=True):
    rnd = random.Random(seed)
    names = [f"s{i}" for i in range(n)]
    return {(a, b) for i, a in enumerate(names) for j, b in enumerate(names) if rnd.random() < 0.12 and (i != j and (loops or i < j))}


def stops(spark, edges, n=14):
    """A database of stops with their edges, loops included: the sets are filled in a second step."""
    db = Db(spark).add(*[Stop(f"s{i}", set()) for i in range(n)])
    eid = {r.name: r.eid for r in db.frame(Stop).collect()}
    rows = [(a, [eid[b] for x, b in edges if x == a]) for a in eid]
    return db.upsert_frame(Stop, spark.createDataFrame(rows, "name string, then array<bigint>"))


ON = Rule.reaches(Stop, "then")


@pytest.mark.parametrize("search", [1, 10**6], ids=["search", "double"])
def test_reaches(spark, monkeypatch, search):
    monkeypatch.setattr(rules_module, "SEARCH", search)
    edges = net(1)
    db = stops(spark, edges)
    pairs = {(a, b) for a in {x for x, _ in edges} for b in reached(edges, a) if a != b}
    ask = lambda *more: db.query(Stop, Stop, lambda a, b: find(a.name, b=b.name).where(ON(a, b) if not more else more[0](a, b) & ON(a, b))).run()
    assert sorted(ask()) == sorted(pairs)
    for name in ("s0", "s3", "s9"):
        assert sorted(ask(lambda a, b: a.name == name)) == sorted(p for p in pairs if p[0] == name)
        assert sorted(ask(lambda a, b: b.name == name)) == sorted(p for p in pairs if p[1] == name)
        assert sorted(ask(lambda a, b: (a.name <= "s3") & (b.name == name))) == sorted(p for p in pairs if p[0] <= "s3" and p[1] == name)
    near = db.query(Stop, Stop, lambda a, b: find(b.name).where((a.name == "s0") & ON(a, b) & not_(b.name == "s1")).order_by(b.name).limit(3)).run()
    assert near == sorted(b for a, b in pairs if a == "s0" and b != "s1")[:3]
    round_trip = db.query(Stop, Stop, lambda a, b: find(a.name).where((a.name == b.name) & Rule.reaches(Stop, "then", include_start=True)(a, b))).run()
    assert sorted(round_trip) == sorted(x for x in {a for a, _ in edges} if x in reached(edges, x))


def test_only_what_is_asked_for_is_searched(spark, monkeypatch):
    db = stops(spark, {(f"s{i}", f"s{i + 1}") for i in range(13)})
    monkeypatch.setattr(rules_module, "doubled", lambda edges: pytest.fail("all pairs were made"))
    got = db.query(Stop, Stop, lambda a, b: find(b.name).where((a.name == "s11") & ON(a, b))).run()
    assert sorted(got) == ["s12", "s13"]
    kids = Rule.recursive(Stop, Stop, lambda self: [lambda a, b: a.then == b, further(self)])
    assert sorted(db.query(Stop, Stop, lambda a, b: find(a.name).where((b.name == "s2") & back()(a, b)))) == ["s0", "s1"]
    assert sorted(db.query(Stop, Stop, lambda a, b: find(b.name).where((a.name == "s10") & kids(a, b)))) == ["s11", "s12", "s13"]


def further(self):
    def body(a, b):
        m = Stop.row()
        return self(a, m) & (m.then == b)

    return body


def back():
    def earlier(self):
        def body(a, b):
            m = Stop.row()
            return (a.then == m) & self(m, b)

        return body

    return Rule.recursive(Stop, Stop, lambda self: [lambda a, b: a.then == b, earlier(self)])


def test_a_record_is_an_end(spark):
    db = Db(spark).add(Stop("top", {Stop("left", set()), Stop("right", {Stop("low", set())})}))
    right = db.find(Stop, "right")
    assert db.query(Stop, lambda b: find(b.name).where(ON(right, b))).run() == ["low"]
    assert db.query(Stop, lambda a: find(a.name).where(ON(a, right))).run() == ["top"]


def test_reaches_wants_a_reference_to_its_own_class():
    with pytest.raises(TypeError):
        Rule.reaches(Stop, "name")
    with pytest.raises(AttributeError):
        Rule.reaches(Stop, "before")
    assert Rule.reaches(Post, "under").field.optional


@pytest.mark.parametrize("make", [lambda: Rule.recursive(Stop, Stop, lambda self: [lambda a, b: a.then == b, further(self)]), back, "twice"], ids=["onward", "backward", "both"])
@pytest.mark.parametrize("search", [1, 10**6], ids=["follow", "double"])
def test_recursion(spark, monkeypatch, make, search):
    """The same relation told from the left, from the right, and by two calls in one body."""
    monkeypatch.setattr(rules_module, "SEARCH", search)

    def twice(self):
        def body(a, b):
            m = Stop.row()
            return self(a, m) & self(m, b)

        return body

    rule = Rule.recursive(Stop, Stop, lambda self: [lambda a, b: a.then == b, twice(self)]) if make == "twice" else make()
    edges = net(2)
    db = stops(spark, edges)
    want = sorted((a, b) for a in {x for x, _ in edges} for b in reached(edges, a))
    assert sorted(db.query(Stop, Stop, lambda a, b: find(a.name, b=b.name).where(rule(a, b)))) == want
    assert sorted(db.query(Stop, Stop, lambda a, b: find(b.name).where((a.name == "s4") & rule(a, b)))) == [b for a, b in want if a == "s4"]
    assert sorted(db.query(Stop, Stop, lambda a, b: find(a.name).where((b.name == "s4") & rule(a, b)))) == [a for a, b in want if b == "s4"]
    per = {a: sum(x == a for x, _ in want) for a in {x for x, _ in want}}
    assert dict(db.query(Stop, Stop, lambda a, b: find(a.name, n=count(b)).where(rule(a, b))).run()) == per


def test_mutual_recursion(spark):
    """Even and odd numbers of steps."""
    odd, even = Rule(Stop, Stop), Rule(Stop, Stop)

    def then(rule):
        def body(a, b):
            m = Stop.row()
            return rule(a, m) & (m.then == b)

        return body

    odd.add(lambda a, b: a.then == b).add(then(even))
    even.add(then(odd))
    edges = net(3, loops=False)
    ways = {(a, b, 1) for a, b in edges}
    while (more := ways | {(a, d, 1 - k) for a, b, k in ways for c, d in edges if c == b}) != ways:
        ways = more
    db = stops(spark, edges)
    for rule, k in ((odd, 1), (even, 0)):
        assert sorted(db.query(Stop, Stop, lambda a, b: find(a.name, b=b.name).where(rule(a, b)))) == sorted((a, b) for a, b, x in ways if x == k)
        assert sorted(db.query(Stop, Stop, lambda a, b: find(b.name).where((a.name == "s0") & rule(a, b)))) == sorted(b for a, b, x in ways if x == k and a == "s0")


def test_rules_over_a_class_of_edges(spark):
    """Edges that are entities with a key of two references; a rule inside another and inside exists."""
    rnd = random.Random(5)
    posts = {x: Post(x, None) for x in "vwxyz"}
    edges = sorted({(rnd.choice("vwxyz"), rnd.choice("vwxyz")) for _ in range(8)})
    db = Db(spark).add(*posts.values(), *[Rail(posts[a], posts[b]) for a, b in edges])

    def rail(x, y):
        r = Rail.row()
        return (r.a == x) & (r.b == y)

    def onward(self):
        def body(x, y):
            m = Post.row()
            return self(x, m) & rail(m, y)

        return body

    by_rail = Rule.recursive(Post, Post, lambda self: [rail, onward(self)])
    there_and_back = Rule(Post, Post, lambda x, y: by_rail(x, y) & by_rail(y, x))
    got = set(db.query(Post, Post, lambda a, b: find(a.code, b=b.code).where(there_and_back(a, b))))
    assert got == {(a, b) for a in "vwxyz" for b in reached(edges, a) if a in reached(edges, b)}
    ends = db.query(Post, lambda p: find(p.code).where(not_(exists(Post, lambda q: by_rail(p, q))))).run()
    assert sorted(ends) == sorted(set("vwxyz") - {a for a, _ in edges})


def test_bodies_are_united(spark):
    posts = [Post("a", None), Post("b", None), Post("c", None)]
    db = Db(spark).add(*posts, Post("d", posts[0]))
    near = Rule(Post, Post, lambda x, y: x.code < y.code, lambda x, y: y.under == x)
    got = db.query(Post, Post, lambda x, y: find(x.code, y=y.code).where(near(x, y))).run()
    assert len(got) == len(set(got)) == 6
    free = Rule(Post, Post, lambda x, y: x.code == "a")  # the other end isn't bound, so it is any post
    assert len(db.query(Post, Post, lambda x, y: find(x.code, y=y.code).where(free(x, y))).run()) == 4
    with pytest.raises(ValueError):
        Rule(Post, Post, lambda x, y: not_(x.code == "a"))


def test_closure_counts_steps(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)]
    got = {tuple(r) for r in closure(spark.createDataFrame(edges, "src bigint, dst bigint"), spark.createDataFrame([(1,), (4,), (5,)], "eid bigint")).collect()}
    assert got == {(s, b, d) for s in (1, 4, 5) for b, d in reached(edges, s).items()}
