import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from factbase import Aborted, Add, Batch, Block, Db, Fn, Lookup, Retract, SetField, SinceView, UniqueViolation, UnknownIdentity, Upsert, UpsertWhere
from factbase import db as db_module
from factbase import tx as tx_module
from factbase.operators.shared import cut

from .schemas import Badge, Depot, Meter, Post, Remark, Shelf, Tram

ULM = Depot("d1", "Ulm", 4)


def tram(plate, depot=ULM, line=1):
    return Tram(plate, line, depot, 2001, {"r"}, None)


def log(db):
    return [(r.attr, r.v, r.op) for r in db.log().orderBy("tx", "seq").collect()]


def test_add_is_idempotent_and_identities_hold(spark):
    db = Db(spark).add(Badge("b7", "Iva"))
    again = db.add(Badge("b7", "Iva"))
    assert again.count(Badge) == 1 and len(log(again)) == 2 and again.basis == 2
    for bad in (Badge("b7", "Jo"), Badge("b8", "Iva")):
        with pytest.raises(UniqueViolation):
            db.add(bad)
    assert db.count(Badge) == 1
    assert Db(spark).add(Remark("late"), Remark("late"), Remark("full")).count(Remark) == 2


def test_upsert(spark):
    db = Db(spark).add(Badge("b7", "Iva"))
    up = db.upsert(Badge("b7", "Ivana"))
    assert [b.holder for b in up.where(Badge)] == ["Ivana"] and [b.holder for b in db.where(Badge)] == ["Iva"]
    assert [x[2] for x in log(up)] == ["+", "+", "-", "-", "+", "+"]
    assert len(log(up.upsert(Badge("b7", "Ivana")))) == 6
    diff = db.transact(Upsert([Badge("b7", "Ivana")], diff_only=True)).db_after
    assert log(diff)[2:] == [("Badge/holder", "Iva", "-"), ("Badge/holder", "Ivana", "+")]
    with pytest.raises(UniqueViolation):
        db.add(Badge("b8", "Oto")).upsert(Badge("b8", "Iva"))


def test_nested_references_are_added_only(spark):
    db = Db(spark).add(tram("t1"))
    assert db.count(Depot) == 1 and db.add(tram("t2")).count(Depot) == 1
    with pytest.raises(UniqueViolation):
        db.upsert(tram("t1", Depot("d1", "Graz", 4)))
    assert db.add(tram("t3", Lookup(Depot, "d1"))).find(Tram, "t3").depot == ULM
    with pytest.raises(UnknownIdentity):
        db.add(tram("t3", Lookup(Depot, "d0")))


def test_retract(spark):
    db = Db(spark).add(Badge("b1", "Iva"), Badge("b2", "Oto"))
    out = db.retract(Badge("b1", "Iva"), Badge("b3", "nobody"))
    assert [b.holder for b in out.where(Badge)] == ["Oto"] and db.count(Badge) == 2
    assert log(out)[-2:] == [("Badge/number", "b1", "-"), ("Badge/holder", "Iva", "-")]
    assert out.retract_where(Badge, lambda b: b.holder.startswith("O")).count(Badge) == 0
    with pytest.raises(LookupError):
        Db(spark).add(tram("t1")).retract(ULM).where(Tram).run()


def test_blocks(spark):
    db = Db(spark)
    more = lambda: UpsertWhere(Meter, lambda m: m.name == "km", {"n": lambda m: m.n * 3})
    assert db.transact(Batch((Add([Meter("km", 2)]), more()))).db_after.find(Meter, "km").n == 6
    one = db.add(Meter("km", 2))

    def twice(b):
        b.upsert_where(Meter, lambda m: m.name == "km", {"n": lambda m: m.n * 3})
        b.upsert_where(Meter, lambda m: m.name == "km", {"n": lambda m: m.n * 3})
        assert b.db.find(Meter, "km").n == 2  # the state at the start

    assert one.tx(twice).find(Meter, "km").n == 18
    fn = Fn(lambda d: Upsert([Meter("km", d.find(Meter, "km").n - 1)]))
    assert one.transact(Batch((more(), fn))).db_after.find(Meter, "km").n == 5
    with pytest.raises(UniqueViolation):
        db.tx(lambda b: b.add(Badge("b1", "same")).add(Badge("b2", "same")))
    assert db.count(Badge) == 0
    with pytest.raises(Aborted):
        one.tx(lambda b: b.abort("no"))
    assert db.transact(Block(lambda b: b.add(Remark("wet")))).db_after.count(Remark) == 1


def test_set_field_and_report(spark):
    rep = Db(spark).transact(Add([Badge("b1", "Iva"), Badge("b2", "Oto")]))
    assert rep.tx == 1 and len(rep.added_eids) == 2 and rep.datoms.count() == 4 and rep.db_before.count(Badge) == 0
    out = rep.db_after.transact(SetField(Badge, rep.added_eids[1], "holder", "Otto"))
    assert out.db_after.find(Badge, "b2").holder == "Otto" and out.datoms.count() == 2
    assert rep.db_after.transact(Retract([Badge("b1", "Iva")])).retracts == [Badge("b1", "Iva")]


def test_time_travel(spark):
    at = lambda h: datetime(2025, 5, 1, h, tzinfo=timezone.utc)
    db = Db(spark, [Meter]).transact(Add([Meter("km", 1)]), at(6)).db_after
    db = db.transact(Upsert([Meter("km", 2)]), at(18)).db_after
    n = lambda d: [m.n for m in d.where(Meter)]
    assert n(db.as_of(at(5))) == [] and n(db.as_of("2025-05-01T17:59:00Z")) == [1] and n(db.as_of("2025-05-01T20:00:00+02:00")) == [2]
    assert n(db.as_of(1)) == [1] and n(db.as_of(0)) == [] and n(db) == [2] and db.tx_time(1).hour == 6
    eid = db.frame(Meter).first().eid
    assert db.history(eid).count() == 6 and db.retract(Meter("km", 2)).history(eid).count() == 8
    assert db.history_of(Meter("km", 2)).count() == 6 and db.history_of(Meter("km", 1)).count() == 0
    later = db.since(1)
    assert n(later) == [2] and db.since(2).count(Meter) == 0
    with pytest.raises(SinceView):
        later.add(Meter("mi", 0))
    assert db.transact(Add([Meter("h", 0)]), at(1)).time == at(18)  # time doesn't fall


def test_partial_entities_are_passed_over(spark):
    db = Db(spark, [Badge]).add(Badge("b1", "Iva")).transact(Upsert([Badge("b1", "Eva")], diff_only=True)).db_after
    assert db.since(1).count(Badge) == 0 and db.since(1).datoms().count() == 1


def test_diff(spark):
    """Of any two values, and of one with its own past: against sets of facts."""
    rnd = random.Random(3)
    values = [Db(spark, [Meter, Shelf])]
    for _ in range(5):
        db = values[-1].upsert(Meter(rnd.choice("ab"), rnd.randrange(3)), Shelf("s", {rnd.choice("xyz") for _ in range(2)}))
        values.append(db.retract(Meter("a", 0)) if rnd.random() < 0.4 else db)
    other = values[2].add(Meter("z", 9))
    facts = lambda df: {(r.eid, r.attr, r.v) for r in df.collect()}
    pasts = [values[-1].as_of(t) for t in (1, 3)]
    for a, b in [(values[1], values[4]), (values[5], other), (other, values[3]), (pasts[0], values[-1]), (values[-1], pasts[1]), (values[3], values[3]), (pasts[0], pasts[1])]:
        d, mine, theirs = a.diff(b), facts(a.datoms()), facts(b.datoms())
        assert facts(d.added) == theirs - mine and facts(d.retracted) == mine - theirs
        assert {r.op for r in d.added.collect()} <= {"+"} and {r.op for r in d.retracted.collect()} <= {"-"} and d.is_empty == (mine == theirs)
    said = {(r.eid, r.attr, r.v): (r.tx, r.seq) for r in values[-1].datoms().collect()}
    assert all(said[r.eid, r.attr, r.v] == (r.tx, r.seq) for r in pasts[0].diff(values[-1]).added.collect())
    plan = pasts[0].diff(values[-1]).added._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Join" not in plan


def test_eids_go_on_past_those_only_referred_to(spark):
    db = Db(spark).add(Post("a", Post("b", None)))
    gone = db.log().filter("not (attr = 'Post/code' and v = 'a')")
    last = max(r.eid for r in db.frame(Post).collect())
    far = gone.unionAll(spark.createDataFrame([(1, "Post/under", "77", 9, 0, None, "+")], gone.schema))
    assert Db.from_log(spark, gone, [Post]).next_eid == last + 1 and Db.from_log(spark, far, [Post]).next_eid == 78
    assert Db.from_log(spark, far.limit(0), [Post]).next_eid == 1


def test_sets_in_the_log(spark):
    db = Db(spark).add(Shelf("a", {"x", "y"})).upsert(Shelf("a", {"y", "z"}))
    assert db.as_of(1).find(Shelf, "a").labels == {"x", "y"} and db.as_of(2).find(Shelf, "a").labels == {"y", "z"}


def test_frames_in_bulk(spark):
    db = Db(spark).add(Meter("a", 1))
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), ("c", 3)], "name string, n bigint")
    out = db.add_frame(Meter, rows)
    assert {m.name: m.n for m in out.where(Meter)} == {"a": 1, "b": 2, "c": 3} and out.log().count() == 6
    for bad in ([("a", 9)], [("z", 1), ("z", 2)]):
        with pytest.raises(UniqueViolation):
            db.add_frame(Meter, spark.createDataFrame(bad, "name string, n bigint"))
    up = out.upsert_frame(Meter, spark.createDataFrame([("a", 9), ("d", 4)], "name string, n bigint"))
    assert {m.name: m.n for m in up.where(Meter)} == {"a": 9, "b": 2, "c": 3, "d": 4}
    assert {m.name: m.n for m in up.as_of(2).where(Meter)} == {"a": 1, "b": 2, "c": 3}
    eids = [r.eid for r in up.frame(Meter).collect()]
    assert len(set(eids)) == 4 and up.next_eid > max(eids)
    assert db.add_frame(Meter, rows.limit(0)).count(Meter) == 1
    assert db.upsert_frame(Meter, up.frame(Meter)).count(Meter) == 4  # a frame has its own eids; they don't count


def test_large_changes_stay_in_frames(spark, monkeypatch):
    monkeypatch.setattr(tx_module, "FOLD", 3)
    monkeypatch.setattr(db_module, "FOLD", 3)
    db = Db(spark).add_frame(Meter, spark.range(20).selectExpr("concat('m', id) as name", "id as n"))
    up = db.upsert_where(Meter, lambda m: m.n >= 10, {"n": lambda m: m.n + 100})
    assert sorted(m.n for m in up.where(Meter)) == [*range(10), *range(110, 120)]
    assert up.as_of(1).count(Meter, lambda m: m.n >= 100) == 0
    down = up.retract_where(Meter, lambda m: m.n < 10)
    assert down.count(Meter) == 10 and down.log().filter("op = '-'").count() == 40
    small = down.add(Meter("x", 1)).add(Meter("y", 2)).add(Meter("z", 3), Meter("w", 4))
    assert small.count(Meter) == 14 and not small.log_rows and small.find(Meter, "w").n == 4


@pytest.mark.parametrize("n", [5, 51, 20_001])
def test_a_changed_key_is_another_entity_at_any_size(spark, n):
    """Each record is upserted under its new key: the next entity takes its values, the first stays, one is new."""
    rows = cut(spark.range(n).selectExpr("concat('m', id) as name", "id as n"))
    db = Db(spark).add_frame(Meter, rows)
    up = db.upsert_where(Meter, lambda m: m.n >= 0, {"name": lambda m: F.concat(F.lit("m"), (m.n + 1).column.cast("string"))})
    got = up.frame(Meter).select("eid", "name", "n")
    want = rows.selectExpr("concat('m', n + 1) as name", "n").unionAll(spark.createDataFrame([("m0", 0)], "name string, n bigint"))
    assert got.count() == n + 1 and got.select("name", "n").exceptAll(want).isEmpty()
    kept = got.join(db.frame(Meter).select("eid", F.col("name").alias("was")), "eid")
    assert kept.count() == n and kept.filter("name <> was").isEmpty()
    with pytest.raises(UniqueViolation):
        db.upsert_where(Meter, lambda m: m.n >= 0, {"name": "same"})


@pytest.mark.parametrize("lookups", [3, 50])
def test_uniques_move_at_once(spark, monkeypatch, lookups):
    """A ring of holders, one by one and as a frame: what holds after all changes counts."""
    monkeypatch.setattr(tx_module, "LOOKUPS", lookups)
    db = Db(spark).add_frame(Badge, spark.range(8).selectExpr("cast(id as string) as number", "concat('h', id) as holder"))
    turn = {"holder": lambda b: F.concat(F.lit("h"), (b.number.cast("int") + 1) % 8)}
    up = db.upsert_where(Badge, lambda b: b.number >= "0", turn)
    assert sorted((b.number, b.holder) for b in up.where(Badge)) == [(str(i), f"h{(i + 1) % 8}") for i in range(8)]
    with pytest.raises(UniqueViolation):
        db.upsert_where(Badge, lambda b: b.number < "6", turn)


def test_a_class_without_key_gets_the_changed_records_besides(spark):
    db = Db(spark).add(Remark("a"), Remark("b"))
    assert sorted(r.text for r in db.upsert_where(Remark, lambda r: r.text == "a", {"text": "c"}).where(Remark)) == ["a", "b", "c"]


def test_text(spark):
    db = Db(spark).add(Badge("b7", "Iva"))
    assert db.pretty() == 'Badge (1)\n  #1\n    holder = "Iva"\n    number = "b7"\n\n'
    lines = db.pretty_log().splitlines()
    assert lines[0].split() == ["tx", "time", "eid", "attr", "value", "op"] and lines[2].split()[2:] == ["#1", "Badge/number", '"b7"', "+"]
    assert "\x1b[32m" in db.pretty_log(color=True) and Db(spark).pretty() == "(empty db)\n" and Db(spark).pretty_log() == "(empty log)\n"


def test_many_records_over_a_base(spark):
    base = Db(spark).add_frame(Badge, spark.range(50).selectExpr("concat('b', id) as number", "concat('h', id) as holder"))
    out = base.upsert(*[Badge(f"b{i}", f"x{i}") for i in range(40, 60)]).retract(*[Badge(f"b{i}", f"h{i}") for i in range(5)])
    assert out.count(Badge) == 55 and out.find(Badge, "b45").holder == "x45" and out.find(Badge, "b1") is None
    with pytest.raises(UniqueViolation):
        base.add(Badge("q1", "h1"), Badge("q2", "fresh"))
