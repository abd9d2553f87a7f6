"""A connection: one current database value, serialized writes, write-ahead storage, listeners and live queries."""

from __future__ import annotations

import sys
import threading
from collections import deque
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from .db import FOLD, Db, _reading
from .query import Query, TypedQuery
from .schema import Entity
from .sources.storage import MemoryStorage, Storage
from .tx import Add, AddFrame, Block, Retract, RetractWhere, TxReport, Upsert, UpsertWhere, commit


class Subscription:
    """Cancelling twice does no harm."""

    def __init__(self, stop: Callable[[], None]):
        self._stop, self._live = stop, True

    @property
    def is_active(self) -> bool:
        return self._live

    def cancel(self) -> None:
        if self._live:
            self._live = False
            self._stop()

    close = cancel

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.cancel()


class _Sink:
    def __init__(self, deliver: Callable[[TxReport], None], ready: bool = True):
        self.deliver, self.queue, self.ready = deliver, deque(), ready


def _live(query: Callable[[Db], Any], f: Callable[[Any], None]) -> Callable[..., None]:
    """Runs the query on a value, unless none of the classes written is one that it read before, and calls f if the result is another."""
    seen: dict[str, Any] = {}

    def run(db: Db, written: frozenset | None = None) -> None:
        if written is not None and not written & seen["reads"]:
            return
        reads: set[str] = set()
        token = _reading.set((*_reading.get(), reads))
        try:
            value = query(db)
        finally:
            _reading.reset(token)
        if isinstance(value, (Query, TypedQuery, DataFrame)):
            raise TypeError("watch needs a finished value; call run() or count() in the query")
        form = sorted(map(repr, value)) if isinstance(value, (list, set, frozenset)) else value
        seen["reads"] = reads
        if "form" not in seen or seen["form"] != form:
            seen["form"] = form
            f(value)

    return run


class Conn:
    """Writers take turns; readers never wait. Subscribers hear of commits in order, each once, on the thread that drains.

    A subscriber's errors stay with it, and what it writes is queued behind the commit it hears of.
    """

    def __init__(self, spark: SparkSession, storage: Storage | None = None, entities: Iterable[Entity] = (), db: Db | None = None):
        self.spark, self.storage = spark, storage or MemoryStorage()
        stored = self.storage.load(spark) if db is None else None
        self._current = db if db is not None else Db(spark, entities) if stored is None else Db.from_log(spark, stored, entities, keep=True)
        self._writing = threading.RLock()
        self._busy = threading.local()
        self._lock = threading.Lock()
        self._sinks: list[_Sink] = []
        self._draining = False
        self._newer = threading.Condition()

    @property
    def db(self) -> Db:
        return self._current

    def transact(self, tx, at=None) -> TxReport:
        """Commit: storage first, then the new value becomes current, then subscribers hear of it. If storage fails nothing has happened."""
        if getattr(self._busy, "now", False):
            raise RuntimeError("a transaction can't be started inside another")
        with self._writing:
            self._busy.now = True
            try:
                report = commit(self._current, tx, at)
                self.storage.append(report.datoms, report.tx)
                self._current = report.db_after
                with self._lock:
                    for s in self._sinks:
                        s.queue.append(report)
            finally:
                self._busy.now = False
        with self._newer:
            self._newer.notify_all()
        self._drain()
        return report

    def _drain(self) -> None:
        with self._lock:
            if self._draining:
                return
            self._draining = True
        while True:
            with self._lock:
                ready = next((s for s in self._sinks if s.queue and s.ready), None)
                if ready is None:
                    self._draining = False
                    return
                report = ready.queue.popleft()
            try:
                ready.deliver(report)
            except Exception:  # noqa: BLE001 - a subscriber's error is its own
                pass

    def _subscribe(self, sink: _Sink) -> Subscription:
        with self._lock:
            self._sinks.append(sink)

        def stop():
            with self._lock:
                if sink in self._sinks:
                    self._sinks.remove(sink)

        return Subscription(stop)

    def listen(self, f: Callable[[TxReport], None]) -> Subscription:
        return self._subscribe(_Sink(f))

    def watch(self, query: Callable[[Db], Any], f: Callable[[Any], None]) -> Subscription:
        """Run the query and call f with its result, now and whenever a class that it read was written and the result has changed.

        The query must give a finished value (a list, a number): a lazy one is an error. Lists compare without order.
        """
        run = _live(query, f)
        with self._writing:
            # what is committed from here on waits until the first result is out
            db, sink = self._current, _Sink(lambda report: run(report.db_after, report.classes), ready=False)
            out = self._subscribe(sink)
        try:
            run(db)
        except BaseException:
            out.cancel()
            raise
        sink.ready = True
        self._drain()
        return out

    def follow(self, f: Callable[[TxReport], None], after: int | None = None) -> Subscription:
        """f is called on a thread of its own with a report of each commit later than ``after`` (by default from now on), in order.

        The reports are read from the log, so commits before the call count as well and a slow f holds up nobody; they
        have no records in adds and retracts, as the log has none, and of a bulk transaction no added_eids, as those of frames
        haven't. Errors of f go to stderr.
        """

        def step(seen: int, db: Db) -> None:
            log, entities = db.log(), db.entities.values()
            for tx in range(seen + 1, db.basis + 1):
                facts = log.filter(F.col("tx") == tx)
                added = facts.groupBy("eid").agg(F.min("seq").alias("s"), F.max(F.col("op") == "+").alias("new")).filter("new").orderBy("s").limit(FOLD + 1)
                eids = [r.eid for r in added.collect()]
                eids = eids if len(eids) <= FOLD else []
                classes = frozenset(e.name for e in entities)
                try:
                    f(TxReport(tx, db.tx_time(tx), [], [], eids, facts, db.as_of(tx - 1), db.as_of(tx), classes))
                except Exception as e:  # noqa: BLE001 - a subscriber's error is its own
                    print(f"subscriber: {e!r}", file=sys.stderr)

        return self._thread(step, self._current.basis if after is None else after)

    def watch_apart(self, query: Callable[[Db], Any], f: Callable[[Any], None]) -> Subscription:
        """``watch`` on a thread of its own: if commits outpace f it goes on to the latest result. Errors go to stderr."""
        run = _live(query, f)
        return self._thread(lambda _, db: run(db), self._current.basis - 1)

    def _thread(self, step: Callable[[int, Db], None], seen: int) -> Subscription:
        over = threading.Event()

        def loop(seen: int) -> None:
            while not over.is_set():
                with self._newer:
                    self._newer.wait_for(lambda: over.is_set() or self._current.basis > seen)
                db = self._current
                if over.is_set():
                    return
                try:
                    step(seen, db)
                except Exception as e:  # noqa: BLE001 - a subscriber's error is its own
                    print(f"subscriber: {e!r}", file=sys.stderr)
                seen = db.basis

        def stop() -> None:
            with self._newer:
                over.set()
                self._newer.notify_all()

        threading.Thread(target=loop, args=(seen,), daemon=True).start()
        return Subscription(stop)

    def await_after(self, tx: int, timeout: float | None = None) -> Db:
        """The current value once it is later than ``tx``."""
        with self._newer:
            if not self._newer.wait_for(lambda: self._current.basis > tx, timeout):
                raise TimeoutError(f"nothing was committed after {tx}")
        return self._current

    def add(self, *data) -> TxReport:
        return self.transact(Add(data))

    def upsert(self, *data) -> TxReport:
        return self.transact(Upsert(data))

    def retract(self, *data) -> TxReport:
        return self.transact(Retract(data))

    def retract_where(self, of, predicate) -> TxReport:
        return self.transact(RetractWhere(of, predicate))

    def upsert_where(self, of, predicate, changes) -> TxReport:
        return self.transact(UpsertWhere(of, predicate, changes))

    def tx(self, build) -> TxReport:
        return self.transact(Block(build))

    def add_frame(self, of, frame, upsert: bool = False) -> TxReport:
        return self.transact(AddFrame(of, frame, upsert))

    def close(self) -> None:
        self.storage.close()

    def __repr__(self) -> str:
        return f"Conn(tx {self._current.basis})"
