import threading
from dataclasses import dataclass
from datetime import date, datetime, timezone
from decimal import Decimal
from enum import Enum
from typing import Annotated

import pytest

from factbase import Codec, Conn, Db, Key, ParquetStorage, TsvStorage, UniqueViolation, count, entity, find, sum_
from factbase.streaming.log_stream import each_batch, log_stream

from .schemas import Badge, Depot, Meter, Remark, Tram


class Status(Enum):
    Active = 1
    Banned = 2


@dataclass(frozen=True)
class Address:
    street: str
    city: str


class Money:
    def __init__(self, cents):
        self.cents = cents

    def __eq__(self, other):
        return self.cents == other.cents

    def __hash__(self):
        return hash(self.cents)


@entity
class Account:
    id: Key[str]
    status: Status
    home: Address
    balance: Decimal
    tags: list[str]
    limits: dict[str, int]
    fee: Annotated[Money, Codec(int, lambda m: m.cents, Money)]
    previous: Address | None
    badges: set[Status]
    due: date
    seen: datetime
    raw: bytes
    score: float
    ok: bool


def account(**more):
    base = dict(id="1", status=Status.Active, home=Address("1 Main\tSt", "Paris\\\n"), balance=Decimal("12.50"), tags=["a", "b:c"], limits={"y": 2, "x": 1}, fee=Money(250), badges={Status.Banned, Status.Active}, due=date(2026, 1, 2), seen=datetime(2026, 1, 2, 3, 4, 5, 6000, timezone.utc), raw=b"\x00\xff", score=1.5e-9, ok=True)
    return Account(**{**base, **more})


def test_codecs(spark):
    db = Db(spark).add(account(), account(id="2", balance=Decimal("0.10"), status=Status.Banned, previous=Address("x", "y")))
    assert db.find(Account, "1") == account() and db.find(Account, "1").limits == {"x": 1, "y": 2}
    assert db.query(Account, lambda a: find(sum_(a.balance))).run()[0] == Decimal("12.60")
    assert db.query(Account, lambda a: find(a.status).order_by(a.status.desc())).run() == ["Banned", "Active"]
    assert db.where(Account, lambda a: a.status == Status.Active).count() == 1
    stored = {r.attr: r.v for r in db.log().filter("eid = 1").collect()}
    assert stored["Account/fee"] == "250" and stored["Account/status"] == "Active"
    back = Db.from_log(spark, db.log(), [Account])
    assert back.find(Account, "1") == account() and back.find(Account, "2").previous == Address("x", "y")
    assert back.diff(db).is_empty


@pytest.mark.parametrize("kind", ["parquet", "tsv"])
def test_storage(spark, tmp_path, kind):
    make = lambda: ParquetStorage(str(tmp_path)) if kind == "parquet" else TsvStorage(str(tmp_path), [Account, Meter])
    conn = Conn(spark, make(), [Account, Meter])
    conn.add(account())
    conn.add(Meter("a", 1))
    conn.upsert(Meter("a", 2))
    conn.close()
    again = Conn(spark, make(), [Account, Meter])
    assert again.db.find(Account, "1") == account() and again.db.find(Meter, "a").n == 2 and again.db.basis == 3
    assert again.db.as_of(2).find(Meter, "a").n == 1
    rep = again.add(account())
    assert rep.datoms.isEmpty() and rep.tx == 4
    assert again.add(Meter("b", 1)).added_eids[0] > 2
    again.retract(Meter("b", 1))
    assert Conn(spark, make(), [Account, Meter]).db.count(Meter) == 1


@pytest.mark.parametrize("kind", ["parquet", "tsv"])
def test_bulk_transactions_keep_their_order(spark, tmp_path, kind):
    """A transaction of several files of unequal size, which Spark reads largest first: retracts stay before asserts."""
    keep = ParquetStorage(str(tmp_path)) if kind == "parquet" else TsvStorage(str(tmp_path), [Meter])
    conn = Conn(spark, keep, [Meter])
    conn.add_frame(Meter, spark.range(30_000).selectExpr("concat(repeat('x', cast(id % 97 as int)), id) as name", "id as n"))
    conn.upsert_where(Meter, lambda m: m.n >= 6_000, {"n": lambda m: m.n + 1})
    back = Conn(spark, keep, [Meter]).db.frame(Meter)
    assert back.filter("name is null or n is null").isEmpty() and back.count() == 30_000
    assert back.agg({"n": "sum"}).first()[0] == sum(range(30_000)) + 24_000


def test_text_of_any_kind_comes_back(spark, tmp_path):
    keep, texts = TsvStorage(str(tmp_path), [Remark]), ["\x00", "a\x00\\b", "\\t", "\t", "\\\t\\n\n\r", "", "\\", "é\u2028"]
    Conn(spark, keep, [Remark]).add(*[Remark(t) for t in texts])
    assert sorted(r.text for r in Conn(spark, keep, [Remark]).db.where(Remark)) == sorted(texts)


@pytest.mark.parametrize("kind", ["parquet", "tsv"])
def test_of_two_writers_one_fails(spark, tmp_path, kind):
    make = lambda: Conn(spark, ParquetStorage(str(tmp_path)) if kind == "parquet" else TsvStorage(str(tmp_path), [Remark]), [Remark])
    a, b = make(), make()
    won, start = [], threading.Barrier(2)

    def write(conn, text):
        start.wait()
        try:
            conn.add(Remark(text))
            won.append(text)
        except RuntimeError:
            assert conn.db.count(Remark) == 0

    threads = [threading.Thread(target=write, args=x) for x in ((a, "a"), (b, "b"))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and [r.text for r in make().db.where(Remark)] == won


def test_compaction(spark, tmp_path):
    keep = ParquetStorage(str(tmp_path), every=4)
    conn = Conn(spark, keep, [Meter])
    for i in range(10):
        conn.upsert(Meter("a", i))
    again = Conn(spark, keep, [Meter])
    assert again.db.find(Meter, "a").n == 9 and again.db.log().count() == 2 + 9 * 4 and again.db.as_of(3).find(Meter, "a").n == 2
    assert sorted(map(tuple, again.db.log().collect()), key=repr) == sorted(map(tuple, conn.db.log().collect()), key=repr)
    assert len(again.db.log().inputFiles()) < 10
    keep.vacuum(spark)
    assert sorted(p.name for p in tmp_path.iterdir() if p.name[0] != "_") == ["tx=10", "tx=9", "upto=8"]
    assert Conn(spark, keep, [Meter]).db.find(Meter, "a").n == 9


def test_failed_append_aborts(spark):
    class Broken(ParquetStorage):
        def append(self, datoms, tx):
            raise OSError("disk")

        def load(self, spark):
            return None

    conn, heard = Conn(spark, Broken("")), []
    conn.listen(heard.append)
    with pytest.raises(OSError):
        conn.add(Remark("x"))
    assert conn.db.count(Remark) == 0 and conn.db.basis == 0 and not heard


def test_listen(spark):
    conn, heard = Conn(spark), []
    conn.add(Remark("before"))
    sub = conn.listen(lambda r: heard.append(r.tx))
    conn.listen(lambda r: 1 / 0)
    conn.listen(lambda r: conn.add(Remark("echo")) if r.tx == 2 else None)
    conn.add(Remark("a"))
    assert heard == [2, 3]
    sub.cancel()
    sub.cancel()
    conn.add(Remark("b"))
    assert heard == [2, 3] and not sub.is_active
    with pytest.raises(UniqueViolation):
        conn.tx(lambda b: b.add(Badge("a", "X"), Badge("b", "X")))
    assert conn.db.count(Badge) == 0


def test_watch(spark):
    conn, seen = Conn(spark), []
    ulm = Depot("d1", "Ulm", 4)
    conn.add(Tram("t1", 3, ulm, 2001, set(), None))
    runs = []

    def query(db):
        runs.append(1)
        return db.query(Tram, Depot, lambda t, d: find(t.plate, d.city).where(t.depot == d)).run()

    with conn.watch(query, seen.append):
        assert seen == [[("t1", "Ulm")]]
        conn.add(Remark("x"))
        conn.add(Remark("y"))
        assert len(runs) == 1
        conn.upsert(Tram("t1", 4, ulm, 2001, set(), None))
        assert len(runs) == 2 and len(seen) == 1
        conn.upsert(Depot("d1", "Graz", 4))
        assert seen[-1] == [("t1", "Graz")]
    conn.upsert(Depot("d1", "Lyss", 4))
    assert len(seen) == 2
    with pytest.raises(TypeError):
        conn.watch(lambda db: db.where(Tram), print)


def test_threads(spark):
    conn, heard = Conn(spark), []
    conn.add(Meter("hits", 0))
    conn.listen(lambda r: heard.append(r.tx))

    def work():
        for _ in range(3):
            conn.upsert_where(Meter, lambda m: m.name == "hits", {"n": lambda m: m.n + 1})

    threads = [threading.Thread(target=work) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert conn.db.find(Meter, "hits").n == 12 and heard == list(range(2, 14))


def test_a_watch_hears_of_what_it_writes_itself(spark):
    conn, seen = Conn(spark), []

    def grow(n):
        seen.append(n)
        if n < 3:
            conn.add(Remark(f"r{n}"))

    with conn.watch(lambda db: db.count(Remark), grow):
        assert seen == [0, 1, 2, 3]
    with pytest.raises(ZeroDivisionError):
        conn.watch(lambda db: 1 / 0, seen.append)
    conn.add(Remark("more"))
    assert seen == [0, 1, 2, 3]


def test_watches_of_two_threads_keep_their_reads_apart(spark):
    conn, here, heard = Conn(spark, entities=[Remark, Meter]), threading.Barrier(2, timeout=60), {"a": [], "b": []}

    def read(name, of):
        def query(db):
            n = db.count(of)
            if not heard[name]:
                here.wait()  # both are running now, and have read
            return n + db.count(of)

        return lambda: conn.watch(query, heard[name].append)

    threads = [threading.Thread(target=read("a", Remark)), threading.Thread(target=read("b", Meter))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    conn.add(Meter("x", 1))
    conn.add(Remark("y"))
    assert heard == {"a": [0, 2], "b": [0, 2]}


def test_followers_have_threads_and_catch_up(spark):
    conn, heard, done = Conn(spark, entities=[Remark]), [], threading.Event()
    conn.add(Remark("a"))
    conn.add(Remark("b"))
    names = []

    def f(report):
        names.append(threading.current_thread().name)
        heard.append((report.tx, [r.v for r in report.datoms.collect()], len(report.added_eids), report.db_before.count(Remark), report.db_after.count(Remark)))
        if report.tx == 2:
            conn.add(Remark("c"))
            raise ValueError("mine")
        if report.tx == 3:
            done.set()

    sub = conn.follow(f, after=0)
    assert done.wait(60)
    sub.cancel()
    sub.cancel()
    assert heard == [(1, ["a"], 1, 0, 1), (2, ["b"], 1, 1, 2), (3, ["c"], 1, 2, 3)] and threading.current_thread().name not in names
    seen, enough = [], threading.Event()
    with conn.watch_apart(lambda db: db.count(Remark), lambda n: (seen.append(n), n == 4 and enough.set())):
        conn.add(Remark("d"))
        assert enough.wait(60)
    assert seen[-1] == 4 and seen == sorted(set(seen))


def test_await_after(spark):
    conn = Conn(spark)
    t = threading.Timer(0.3, lambda: conn.add(Remark("x")))
    t.start()
    assert conn.await_after(0, 30).basis == 1
    with pytest.raises(TimeoutError):
        conn.await_after(5, 0.1)


def test_log_as_a_stream(spark, tmp_path):
    conn, got = Conn(spark, ParquetStorage(str(tmp_path / "log")), [Remark]), []
    conn.add(Remark("a"))
    conn.add(Remark("b"))

    def run():
        each_batch(log_stream(spark, str(tmp_path / "log")), str(tmp_path / "ck"), lambda b, _: got.extend(r.v for r in b.collect())).awaitTermination()

    run()
    assert sorted(got) == ["a", "b"]
    conn.add(Remark("c"))
    run()
    assert sorted(got) == ["a", "b", "c"]
    assert conn.db.query(Remark, lambda n: find(count(n))).run() == [3]
