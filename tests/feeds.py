"""Random dirty feeds, and what they add up to by the plainest means."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

FEED = "feed_no bigint, e bigint, a string, v string, v_kind string, t bigint, seq int, time timestamp_ntz, op string, received_at timestamp_ntz, bucket string, pos string, add int"
ZERO = datetime(2020, 1, 1)
MANY = ["C/many"]


def feed(seed: int, n: int = 120, entities: int = 4, monotone: bool = True, attrs=("C/one", "C/many")) -> list[tuple]:
    """Rows of the feed: shuffled, repeated, with nulls and odd spellings. The last columns clash with names that operators use."""
    rnd = random.Random(seed)
    times = [rnd.randrange(60) for _ in range(n + 1)]
    if monotone:
        times.sort()
    facts = []
    for t in range(1, n + 1):
        at = ZERO + timedelta(milliseconds=times[t], microseconds=0 if seed % 2 or monotone else rnd.randrange(1000))
        for seq in range(rnd.randrange(1, 3)):
            facts.append((rnd.randrange(entities), rnd.choice(attrs), rnd.choice(["x", "y", "z", ""]), t, seq, at, rnd.random() < 0.6))
    rows = []
    for e, a, v, t, seq, at, add in facts:
        for k in range(1 if rnd.random() < 0.7 else 3):
            op = rnd.choice(["+", "assert", " Assert "] if add else ["-", "RETRACT"])
            rows.append([e, a, v, None if rnd.random() < 0.3 else "x", t, seq, at if k == 0 else None, op, at + timedelta(milliseconds=rnd.randrange(50)), "b", "p", 1])
    rows += [[None, "C/one", "x", None, 1, 0, None, "+", ZERO, "b", "p", 1], [1, None, "x", None, 1, 0, None, "+", ZERO, "b", "p", 1], [1, "C/one", None, None, 1, 0, None, "+", ZERO, "b", "p", 1], [1, "C/one", "x", None, None, 0, ZERO, "+", None, "b", "p", 1], [1, "C/one", "x", None, 1, 0, None, None, ZERO, "b", "p", 1], [1, "C/one", "x", None, 1, 0, None, "keep", ZERO, "b", "p", 1]]
    rnd.shuffle(rows)
    return [(i, *r) for i, r in enumerate(rows)]


def facts_of(rows: list[tuple]) -> list[tuple]:
    """Distinct (t, seq, e, a, v, add), sorted."""
    out = set()
    for _, e, a, v, _, t, seq, _, op, *_ in rows:
        op = (op or "").strip().lower()
        if None not in (e, a, v, t) and op in ("+", "-", "assert", "retract"):
            out.add((t, seq, e, a, v, op in ("+", "assert")))
    return sorted(out)


def times_of(rows: list[tuple]) -> dict[int, datetime]:
    return {r[5]: r[7] for r in rows if r[5] is not None and r[7] is not None}


def folded(facts: list[tuple], many=MANY) -> dict[tuple, dict[str, int]]:
    """(e, a) to its values and the transaction that began the stay of each."""
    state: dict[tuple, dict[str, int]] = {}
    for t, _, e, a, v, add in facts:
        now = state.setdefault((e, a), {})
        if add:
            if a not in many:
                for other in [x for x in now if x != v]:
                    del now[other]
            now.setdefault(v, t)
        else:
            now.pop(v, None)
    return state


def live_of(facts, many=MANY) -> set[tuple]:
    return {(e, a, v) for (e, a), vs in folded(facts, many).items() for v in vs}
