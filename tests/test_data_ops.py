import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from factbase.operators import bitemporal, cow, datoms, hierarchy, history, incremental, orphans, skew, widen
from factbase.operators.numbering import numbered

from .feeds import FEED, MANY, ZERO, facts_of, feed, folded, live_of, times_of

REPORTS = "tx bigint, time timestamp_ntz, received_at timestamp_ntz"


def micros(x):
    return int((x - datetime(1970, 1, 1)) / timedelta(microseconds=1))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# skew


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_a_join(spark, how):
    rnd = random.Random(1)
    left = spark.createDataFrame([(rnd.choice([1, 1, 1, 2, 3, None]), i % 7, "s") for i in range(60)], "k bigint, x bigint, _salt0 string")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (9, "e")], "k bigint, y string")
    assert rows(skew.salted_join(left, right, ["k"], how, least=5)) == rows(left.join(right, ["k"], how))
    assert skew.salted_join(left.limit(0), right, ["k"], how, least=5).count() == 0


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("before", [False, True])
def test_running_over_a_hot_group(spark, descending, before):
    rnd = random.Random(2)
    data = [(1 if i % 3 else i, rnd.randrange(200), rnd.choice([None, *range(9)])) for i in range(300)]
    df = spark.createDataFrame(data, "k bigint, at bigint, x bigint")
    outs = {"hi": ("max", F.col("x")), "lo": ("min", F.col("x")), "n": ("sum", F.lit(1))}
    hot = rows(skew.running(df, ["k"], "at", outs, descending, before, least=20))
    assert skew.with_chunks(df, ["k"], "at", 20).filter("k = 1").select("_chunk").distinct().count() > 20
    assert hot == rows(skew.running(df, ["k"], "at", outs, descending, before, least=None))
    k, at, x, hi, lo, n = next(r for r in hot if r[0] == 1 and r[1] > 50)
    seen = [b for kk, a, b in data if kk == 1 and ((a > at if before else a >= at) if descending else (a < at if before else a <= at))]
    assert (hi, lo, n) == (max(v for v in seen if v is not None), min(v for v in seen if v is not None), len(seen))


def test_numbers_are_consecutive(spark):
    got = numbered(spark.range(50).selectExpr("id % 7 as k", "id"), ["k", "id"], "n", 10).orderBy("k", "id").collect()
    assert [r.n for r in got] == list(range(10, 60))
    assert numbered(spark.range(0), ["id"], "n").count() == 0


# 1


@pytest.mark.parametrize("seed", [1, 2])
def test_fact_table(spark, tmp_path, seed):
    data = feed(seed)
    df = spark.createDataFrame(data, FEED)
    want = live_of(facts_of(data))
    assert set(map(tuple, cow.rebuilt(df, f"{tmp_path}/a", 3).live(MANY).collect())) == want
    table = cow.FactTable(spark, f"{tmp_path}/b", buckets=5)
    late, early = df.filter("feed_no >= 60"), df.filter("feed_no < 60")
    table.apply(late).apply(early).apply(late)
    again = cow.FactTable(spark, f"{tmp_path}/b")
    assert again.version == 3 and set(map(tuple, again.live(MANY).collect())) == want
    before = dict(again.entry["at"])
    again.apply(spark.createDataFrame([(9999, 77, "C/one", "q", None, 5000, None, None, "+", None, "", "", 0)], FEED))
    assert sum(before[b] != p for b, p in again.entry["at"].items() if b in before) <= 1
    assert set(map(tuple, again.live(MANY).collect())) == want | {(77, "C/one", "q")}
    again.apply(df.limit(0))
    assert again.version == 4
    with pytest.raises(RuntimeError):
        table.apply(df)  # another writer has committed since
    again.vacuum()
    assert again.live(MANY).count() == len(want) + 1


def test_a_merge_shuffles_no_side_and_a_grown_table_gets_buckets(spark, tmp_path, monkeypatch):
    data = feed(5, n=200)
    df = spark.createDataFrame(data, FEED)
    table = cow.FactTable(spark, f"{tmp_path}/a", buckets=3).apply(df.filter("feed_no < 100"))
    plans, write = [], cow.FactTable._write
    monkeypatch.setattr(cow.FactTable, "_write", lambda self, rows, kind, n: (plans.append((kind, rows._jdf.queryExecution().executedPlan().toString())), write(self, rows, kind, n))[1])
    table.apply(df.filter("feed_no >= 100"))
    merge = dict(plans)["data"]
    assert "SortMergeJoin" in merge and "Exchange" not in merge
    monkeypatch.setattr(cow, "TARGET", 1 << 8)
    table.apply(df.filter("feed_no >= 250"))
    assert table.buckets > 3 and set(map(tuple, table.live(MANY).collect())) == live_of(facts_of(data))
    again = cow.FactTable(spark, f"{tmp_path}/a").apply(df.limit(0)).apply(df)
    assert set(map(tuple, again.live(MANY).collect())) == live_of(facts_of(data))
    for i in range(4):  # one-row deliveries leave folders of few buckets, until they are gathered
        again.apply(spark.createDataFrame([(9999, 100 + i, "C/one", "q", None, 5000, None, None, "+", None, "", "", 0)], FEED))
    assert len(set(again.entry["at"].values())) > 3
    monkeypatch.setattr(cow, "FOLDERS", 0)
    again.apply(df)
    assert len(set(again.entry["at"].values())) == 1 and set(map(tuple, again.live(MANY).collect())) == live_of(facts_of(data)) | {(100 + i, "C/one", "q") for i in range(4)}


def test_fact_table_without_facts(spark, tmp_path):
    assert cow.rebuilt(spark.createDataFrame([], FEED), f"{tmp_path}/x").live([]).count() == 0


# 2 and 7


def tracked(spark, data):
    df = spark.createDataFrame(data, FEED)
    return datoms.timed_facts(df, spark.createDataFrame([(1, ZERO, ZERO), (None, ZERO, None), (2, None, ZERO)], REPORTS), ["C/one"])


def value_at(data, e, a, instant):
    times = times_of(data)
    now = folded([f for f in facts_of(data) if f[2] == e and f[3] == a and times[f[0]] <= instant])
    return next(iter(now.get((e, a), {})), None)


@pytest.mark.parametrize("seed,monotone,least", [(1, True, 10**9), (2, True, 5), (3, False, 10**9), (4, False, 5)])
def test_points_in_rectangles(spark, seed, monotone, least):
    data = feed(seed, monotone=monotone, attrs=("C/one",), entities=3)
    points = [(k, name, ZERO + timedelta(milliseconds=m)) for k, (name, m) in enumerate((n, m) for n in ("p0", "p1", "both", "nobody", None) for m in range(-2, 64, 3))]
    owners = spark.createDataFrame([("p0", 0), ("p1", 1), ("both", 1), ("both", 2)], "who string, e bigint")
    df = spark.createDataFrame([(k, n, micros(at)) for k, n, at in points] + [(999, "p0", None)], "id bigint, who string, valid bigint")
    rects = bitemporal.rectangles(tracked(spark, data), least=least)
    got = {(r.id, r.e, r.v) for r in bitemporal.locate(df, rects, bitemporal.grid(rects), "who", owners, least).collect()}
    of = {"p0": [0], "p1": [1], "both": [1, 2]}
    want = {(k, e, v) for k, n, at in points for e in of.get(n, []) if (v := value_at(data, e, "C/one", at)) is not None}
    assert got == want and want


def test_rectangles_are_disjoint(spark):
    got = bitemporal.rectangles(tracked(spark, feed(5, attrs=("C/one",))), superseded=True).collect()
    top = 1 << 62
    for i, a in enumerate(got):
        for b in got[:i]:
            if a.e == b.e:
                apart = (a.valid_to or top) <= b.valid_from or (b.valid_to or top) <= a.valid_from or (a.known_to or top) <= b.known_from or (b.known_to or top) <= a.known_from
                assert apart, (a, b)


@pytest.mark.parametrize("seed,monotone,least", [(1, True, 10**9), (6, True, 5), (3, False, 10**9), (8, False, 5)])
def test_periods(spark, seed, monotone, least):
    data = feed(seed, n=400 if seed == 6 else 150, monotone=monotone, attrs=("C/one",), entities=2)
    got = {(r.e, r.v, r.start, r.stop) for r in history.periods(history.in_millis(tracked(spark, data)), least).collect()}
    want = set()
    base = micros(ZERO) // 1000
    for e in range(2):
        series = [value_at(data, e, "C/one", ZERO + timedelta(milliseconds=m)) for m in range(-1, 70)]
        start = 0
        for i in range(1, len(series) + 1):
            if i == len(series) or series[i] != series[start]:
                if series[start] is not None:
                    want.add((e, series[start], base - 1 + start, None if i == len(series) else base - 1 + i))
                start = i
    assert got == want


def test_words_of_64_snapshots_are_stitched(spark):
    data = [(i, 1, "C/one", "x" if i % 200 else "y", None, i, 0, ZERO + timedelta(seconds=i), "+", ZERO, "", "", 0) for i in range(1, 330)]
    for least in (10**9, 20):
        got = sorted((r.v, r.start, r.stop) for r in history.periods(history.in_millis(tracked(spark, data)), least).collect())
        at = lambda s: micros(ZERO + timedelta(seconds=s)) // 1000
        assert got == [("x", at(1), at(200)), ("x", at(201), None), ("y", at(200), at(201))]


def test_no_history(spark):
    assert history.periods(history.in_millis(tracked(spark, []))).count() == 0


# 3

LOG = "run_id bigint, consumer string, status string, after_tx bigint, upto_tx bigint, started_at timestamp_ntz, logged_at timestamp_ntz"


@pytest.mark.parametrize("least", [10**9, 8])
def test_catching_up(spark, tmp_path, least):
    rnd = random.Random(3)
    data = feed(7)
    reports = [(t, None, ZERO + timedelta(milliseconds=rnd.randrange(100))) for t in range(1, 121) if t % 9] + [(5, None, None), (None, None, ZERO)]
    log = []
    for run in range(40):
        low, who = rnd.randrange(120), rnd.choice(["a", "b"])
        begun = ZERO + timedelta(milliseconds=rnd.randrange(200))
        bounds = (low, low + rnd.choice([1, 5, 70, 500]))
        log.append((run, who, "running", *bounds, begun, begun))
        log.append((run, who, rnd.choice(["OK", "ok", " Ok", "failed"]), *bounds, begun, begun + timedelta(seconds=1)))
    log += [(50, "idle", None, 0, 500, ZERO + timedelta(days=1), ZERO), (51, None, "ok", 0, 500, ZERO, ZERO), (None, "x", "ok", 0, 500, ZERO, ZERO), (52, "a", "ok", None, 500, ZERO + timedelta(days=1), ZERO), (53, "a", "ok", 0, 500, None, ZERO)]
    frames = spark.createDataFrame(data, FEED), spark.createDataFrame(reports, REPORTS), spark.createDataFrame(log, LOG)
    readers = incremental.LogReaders(spark, f"{tmp_path}/r")
    with pytest.raises(incremental.RunFailed):
        readers.catch_up(*frames, fail=True, least=least)
    readers.catch_up(*frames, least=least)
    got = {tuple(r) for r in readers.output().collect()}
    first = {}
    for r in data:
        for f in facts_of([r]):
            if r[9] is not None:
                first[f] = min(first.get(f, r[9]), r[9])
    told = {}
    for tx, _, at in reports:
        if tx is not None and at is not None:
            told[tx] = min(told.get(tx, at), at)
    ended = [x for x in log[:80] if x[2].strip().lower() == "ok"]
    want = set()
    for f, at in first.items():
        if f[0] in told:
            since = max(at, told[f[0]])
            for who in ("a", "b", "idle", "x"):
                if not any(x[1] == who and x[3] < f[0] <= x[4] and x[5] >= since for x in ended):
                    want.add((who, f[0], f[2]))
    assert got == want and want
    if least == 8:
        # the next run has the new and the late, and all for a consumer that is new itself
        late = [(1000, 77, "C/one", "v", None, 3, 9, None, "+", ZERO + timedelta(days=1), "", "", 0), (1001, 78, "C/one", "v", None, 500, 0, None, "+", ZERO, "", "", 0)]
        readers.catch_up(frames[0].unionAll(spark.createDataFrame(late, FEED)), frames[1].unionAll(spark.createDataFrame([(500, None, ZERO + timedelta(days=1))], REPORTS)), frames[2], least=least)
        more = {tuple(r) for r in spark.read.parquet(readers.manifests()[-1]["path"]).collect()}
        assert more == {(who, t, e) for who in ("a", "b", "idle", "x") for t, e in ((3, 77), (500, 78))}
        readers.catch_up(*frames[:2], frames[2].unionAll(spark.createDataFrame([(99, "new", None, None, None, None, ZERO)], LOG)), least=least)
        assert {tuple(r) for r in spark.read.parquet(readers.manifests()[-1]["path"]).collect()} == {("new", f[0], f[2]) for f, at in first.items() if f[0] in told}


def test_nothing_to_catch_up_with(spark, tmp_path):
    none, reports = spark.createDataFrame([], LOG), spark.createDataFrame([], REPORTS)
    readers = incremental.LogReaders(spark, f"{tmp_path}/r")
    readers.catch_up(spark.createDataFrame(feed(1), FEED), reports, none)
    readers.catch_up(spark.createDataFrame([], FEED), reports, spark.createDataFrame([(1, "a", "ok", 0, 9, ZERO, ZERO)], LOG))
    assert readers.output().count() == 0 and readers.manifests()[-1]["upto"] is None


def test_reader_takes_each_record_once(spark, tmp_path):
    reader = incremental.Reader(spark, f"{tmp_path}/r")
    log = lambda *ts: spark.createDataFrame([(t, f"k{t}") for t in ts], "t bigint, k string")
    assert reader.run(log())["upto"] is None
    reader.run(log(1, 2, 3))
    with pytest.raises(RuntimeError):
        reader.run(log(1, 2, 3, 4, 5), fail=True)
    done = reader.run(log(1, 2, 3, 4, 5, 6))
    assert (done["after"], done["upto"]) == (3, 6)
    assert sorted(r.t for r in reader.output().collect()) == [1, 2, 3, 4, 5, 6]
    late = incremental.Reader(spark, f"{tmp_path}/late")
    late.run(log(1, 3, 5), keys=["k"])
    late.run(log(1, 2, 3, 5, 6), keys=["k"])
    late.run(log(1, 2, 3, 5, 6), keys=["k"])
    assert sorted(r.t for r in late.output().collect()) == [1, 2, 3, 5, 6]


@pytest.mark.parametrize("keys", [None, ["e", "a", "v", "t", "pos", "add"]])
def test_reader_on_a_dirty_feed(spark, tmp_path, keys):
    data = feed(11)  # shuffled, so rows of older transactions come late
    more = [] if keys is None else ["feed_no"]
    log = lambda n: datoms.facts(spark.createDataFrame(data[:n], FEED), None, *more)
    reader = incremental.Reader(spark, f"{tmp_path}/r")
    third = len(data) // 3
    reader.run(log(third), keys=keys)
    with pytest.raises(RuntimeError):
        reader.run(log(2 * third), keys=keys, fail=True)
    reader.run(log(2 * third), keys=keys)
    reader.run(log(len(data)), keys=keys)
    reader.run(log(len(data)), keys=keys)
    got = [(r.t, r.e, r.a, r.v, r.add, int(r.pos)) for r in reader.output().collect()]
    want = {(t, e, a, v, add, t * (1 << 31) + seq) for t, seq, e, a, v, add in facts_of(data)}
    assert len(got) == len(want) and set(got) == want
    if keys is not None:
        first = reader.manifests()[0]["taken"]
        assert spark.read.parquet(first).agg(F.max("feed_no")).first()[0] < third


def test_reader_with_null_keys_and_work(spark, tmp_path):
    log = lambda *rs: spark.createDataFrame(rs, "t bigint, k string, x bigint")
    reader = incremental.Reader(spark, f"{tmp_path}/n")
    work = lambda df: df.selectExpr("x + 1 as y")
    reader.run(log((5, None, 1), (5, "a", 2), (7, "a", 3), (None, "z", 9)), work, keys=["k"])
    reader.run(log((5, None, 1), (5, "a", 2), (7, "a", 3), (3, "late", 4), (None, "z", 9)), work, keys=["k"])
    assert sorted(r.y for r in reader.output().collect()) == [2, 3, 5] and reader.manifests()[1]["upto"] == 7
    rising = incremental.Reader(spark, f"{tmp_path}/up", rising=True)
    rising.run(log((1, "a", 1), (2, "b", 2)))
    rising.run(log((1, "a", 1), (2, "b", 2), (2, "c", 3), (4, None, 4), (4, None, 4)))
    rising.run(log((1, "a", 1), (2, "b", 2), (2, "c", 3), (4, None, 4), (4, None, 4)))
    assert sorted(r.x for r in rising.output().collect()) == [1, 2, 3, 4]


def test_readers_over_the_whole_feed(spark, tmp_path):
    data = feed(12)
    reports = [(t, None, ZERO + timedelta(milliseconds=t % 70)) for t in range(1, 121) if t % 9] + [(5, None, None), (None, None, ZERO)]
    log = spark.createDataFrame([(1, "a", "ok", 0, 9, ZERO, ZERO), (2, "b", "failed", 0, 9, ZERO, ZERO), (3, None, "ok", 0, 9, ZERO, ZERO)], LOG)
    frames = spark.createDataFrame(data, FEED), spark.createDataFrame(reports, REPORTS)
    got = [(r.consumer, r.t, r.e, r.a, r.v, r.add, int(r.pos)) for r in incremental.replayed(*frames, log, f"{tmp_path}/r").collect()]
    first = {f for r in data if r[9] is not None for f in facts_of([r])}
    want = {(who, t, e, a, v, add, t * (1 << 31) + seq) for who in "ab" for t, seq, e, a, v, add in first if t % 9}
    assert len(got) == len(want) and set(got) == want
    runs = incremental.Reader(spark, f"{tmp_path}/r/0", commit="since").manifests()
    assert len(runs) == 3 and [m["after"] for m in runs[1:]] == [m["upto"] for m in runs[:2]]
    assert all(spark.read.parquet(m["path"]).count() for m in runs)
    assert incremental.replayed(frames[0].limit(0), frames[1], log, f"{tmp_path}/none").count() == 0


# 4


@pytest.mark.parametrize(
    "kind,good,bad",
    [
        ("bigint", [" 12 ", "-9223372036854775808", "+0007"], ["9223372036854775808", "1.0", "", "0x1", "１", "1e3", "--1"]),
        ("int", ["2147483647", "-2147483648"], ["2147483648"]),
        ("double", ["1", "1.5E+3", "-0.5e2", " 7.089e0"], [".5", "5.", "NaN", "1e", "34e", "."]),
        ("decimal", ["12", "-1.5", "1.25"], ["1.255", "61-", "1e2", "1."]),
        ("boolean", ["TRUE", " false "], ["yes", "1", ""]),
        ("date", ["2024-02-29"], ["2023-02-29", "2024-2-9", "19/04/2009", "2024-13-01"]),
        ("instant", ["2024-02-29T23:59:59Z", "2024-01-01t00:00:00z"], ["2024-02-30T00:00:00Z", "2024-01-01T24:00:00Z", "2024-01-01T00:00:60Z", "noon", "2024-01-01 10:00"]),
        ("uuid", ["400FB526-7594-3e63-b47c-9acbff556a88"], ["400fb526", "g00fb526-7594-3e63-b47c-9acbff556a88"]),
        ("string", ["", "anything"], []),
    ],
)
def test_forms(kind, good, bad):
    assert all(widen.encoded(kind, x)[0] for x in good)
    assert not any(widen.encoded(kind, x)[0] for x in bad)


def test_wide_rows(spark):
    schema = spark.createDataFrame([("P/age", "P", "age", "bigint", "one", None), ("P/at", "P", "at", "instant", "one", None), ("P/tags", "P", "tags", "string", "many", None), ("Q/id", "Q", "id", "int", "one", None), (None, "P", "x", "int", "one", None), ("P/none", "P", None, "int", "one", None)], "attr string, cls string, field string, value_type string, cardinality string, target string")
    say = lambda n, e, a, v, t, op="+": (n, e, a, v, None, t, 0, None, op, None, "", "", 0)
    data = [say(1, 1, "P/age", "old", 1), say(2, 1, "P/age", " 41", 2), say(3, 1, "P/at", "2024-01-01T00:00:00Z", 1), say(4, 1, "P/tags", "b", 1), say(5, 1, "P/tags", "a", 2), say(6, 1, "P/tags", "b", 3, "-"), say(7, 1, "P/tags", "c", 3), say(8, 1, "Q/id", "7", 1), say(9, 2, "P/age", "x", 1), say(10, 3, "P/age", "1", 1), say(11, 3, "P/age", "1", 2, "-"), say(12, 1, "P/shoe", "9", 9), say(13, 1, "P/age", "old", 1)]
    wide = widen.widen(datoms.fact_state(datoms.facts(spark.createDataFrame(data, FEED))), schema, ["P", "Q"])
    got = {(r.e, r.cls): r for r in wide.collect()}
    assert set(got) == {(1, "P"), (1, "Q"), (2, "P")} and dict(wide.dtypes)["P_age"] == "bigint" and dict(wide.dtypes)["P_tags"] == "array<string>"
    one = got[1, "P"]
    assert one.P_age == 41 and one.P_tags == ["a", "c"] and one.P_at.replace(tzinfo=timezone.utc).year == 2024 and one.unusable == [] and one.Q_id is None
    assert got[2, "P"].P_age is None and got[2, "P"].unusable == ["P/age"] and got[1, "Q"].Q_id == 7
    empty = datoms.fact_state(datoms.facts(spark.createDataFrame([], FEED)))
    assert widen.widen(empty, schema, ["P"]).count() == 0 and widen.widen(empty, schema, ["None"]).count() == 0


def test_registers_merge_in_any_order():
    cells = [(0, 1, 0, False, "a", False), (0, 3, 0, False, "c", False), (0, 2, 0, False, "b", False), (1, 1, 0, False, "x", True), (1, 2, 0, True, "y", True)]
    for seed in range(5):
        random.Random(seed).shuffle(cells)
        a = widen.create(cells[0])
        for c in cells[1:2]:
            widen.merge_value(a, c)
        b = widen.create(cells[2])
        for c in cells[3:]:
            widen.merge_value(b, c)
        assert widen.merge_registers(a, b) == {0: (3, 0, False, "c"), 1: ["x"]}


# 5


def solved(parent):
    out = {}
    for x in parent:
        path, seen = [x], {x}
        while (p := parent[path[-1]]) is not None and p not in seen:
            path.append(p)
            seen.add(p)
        out[x] = (None, -1, None) if p is not None else (path[-1], len(path) - 1, path[::-1])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_forests(spark, seed):
    rnd = random.Random(seed)
    ids = [f"n{i}" for i in range(150)]
    parent = {x: None if rnd.random() < 0.05 else rnd.choice(ids[max(0, i - 4) : i + 2]) for i, x in enumerate(ids)}
    parent |= {f"c{i}": f"c{i - 1}" if i else None for i in range(70)}  # a chain
    parent |= {"l0": "l1", "l1": "l0", "l2": "l1", "s": "s", "under": "s", **{f"r{i}": f"r{(i + 1) % 40}" for i in range(40)}}
    df = spark.createDataFrame(list(parent.items()), "id string, up string")
    got = {r.id: (r.root, r.depth, r.path) for r in hierarchy.hierarchy(df, paths=True, least=40).collect()}
    assert got == solved(parent)
    plain = {r.id: (r.root, r.depth) for r in hierarchy.hierarchy(df).collect()}
    assert plain == {k: v[:2] for k, v in solved(parent).items()}
    below = {(r.id, r.descendant, r.distance) for r in hierarchy.descendants(hierarchy.hierarchy(df, paths=True)).collect()}
    assert below == {(p, x, d - i) for x, (_, d, path) in solved(parent).items() if path for i, p in enumerate(path[:-1])}


def test_links_from_both_tables(spark):
    node = spark.createDataFrame([(1, None, [2, 3, 3, None, 99]), (2, None, []), (2, 1, None), (3, None, None), (4, 77, None), (None, 1, [1]), (5, 5, None)], "id bigint, parent bigint, children array<bigint>")
    officer = spark.createDataFrame([("Ann", None), ("Bob", " ANN "), ("Cy", "bob"), ("Cy", " "), ("Di", "nobody"), (None, "Ann"), ("eve", "Flo"), ("Flo", "EVE"), ("ANN ", None)], "name string, boss string")
    got = {(r.src, r.id): (r.root, r.depth, r.path) for r in hierarchy.forest(node, officer, paths=True).collect()}
    assert got == {
        ("node", "1"): ("1", 0, ["1"]), ("node", "2"): ("1", 1, ["1", "2"]), ("node", "3"): ("1", 1, ["1", "3"]), ("node", "4"): ("4", 0, ["4"]), ("node", "5"): ("", -1, None),
        ("officer", "Ann"): ("ANN ", 0, ["ANN "]), ("officer", "ANN "): ("ANN ", 0, ["ANN "]), ("officer", "Bob"): ("ANN ", 1, ["ANN ", "Bob"]), ("officer", "Cy"): ("ANN ", 2, ["ANN ", "Bob", "Cy"]),
        ("officer", "Di"): ("Di", 0, ["Di"]), ("officer", "eve"): ("", -1, None), ("officer", "Flo"): ("", -1, None),
    }
    assert hierarchy.forest(node.limit(0), officer.limit(0)).count() == 0


def test_officers_have_descendants(spark):
    node = spark.createDataFrame([(1, None, [2]), (2, None, None), (3, 2, None)], "id bigint, parent bigint, children array<bigint>")
    officer = spark.createDataFrame([("Ann", None), ("Bob", " ANN "), ("Cy", "bob"), ("CY ", None), ("ANN ", None), (None, "Ann"), ("Di", "nobody")], "name string, boss string")
    got = rows(hierarchy.forest_descendants(node, officer, least=2))
    bosses = [("officer", a, x, d) for a in ("Ann", "ANN ") for x, d in (("Bob", 1), ("CY ", 2))]
    assert got == sorted([("node", "1", "2", 1), ("node", "1", "3", 2), ("node", "2", "3", 1), *bosses, ("officer", "Bob", "CY ", 1)], key=repr)
    assert hierarchy.forest_descendants(node.limit(0), officer.limit(0)).count() == 0


def test_descendants_on_and_below_loops(spark):
    parent = {"a": "b", "b": "c", "c": "a", "d": "a", "e": "d", "f": "e", "s": "s", "t": "s", "u": "t", "x": None, "y": "x"}
    parent |= {f"r{i}": f"r{(i + 1) % 21}" for i in range(21)} | {"q0": "r3", **{f"q{i}": f"q{i - 1}" for i in range(1, 12)}}
    want = set()
    for x in parent:
        seen, at = [x], parent[x]
        while at is not None and at not in seen:
            seen.append(at)
            at = parent[at]
        want |= {(top, x, i) for i, top in enumerate(seen) if i}
    df = spark.createDataFrame(list(parent.items()), "id string, up string")
    tree = hierarchy.hierarchy(df, paths=True)
    got = rows(hierarchy.descendants(tree).unionByName(hierarchy.loop_descendants(df, tree.filter("depth = -1"), least=3)))
    assert got == sorted(want, key=repr) and ("d", "f", 2) in want and ("t", "u", 1) in want
    node = spark.createDataFrame([(1, 2, [3]), (2, 1, None), (3, None, [4]), (4, None, None)], "id bigint, parent bigint, children array<bigint>")
    officer = spark.createDataFrame([("Eve", "flo"), ("Flo", "EVE"), ("Gus", "Flo"), ("Hal", "gus")], "name string, boss string")
    below = {(r.src, r.id, r.descendant, r.distance) for r in hierarchy.forest_descendants(node, officer).collect()}
    assert {("node", "3", "4", 1), ("node", "2", "4", 3), ("node", "1", "2", 1), ("officer", "Gus", "Hal", 1), ("officer", "Eve", "Hal", 3)} <= below and len(below) == 14


# 6


def test_orphan_state_step_by_step(spark):
    rnd = random.Random(4)
    ref = "src string, rec string, target string, period string, ref_at bigint"
    par = "space string, target string, alive boolean, born bigint, born_tx bigint"
    state = orphans.OrphanState(spark, {"s": "a", "t": "b"}, ("t",), least=10)
    refs, parents = {}, {}
    for _ in range(4):
        new = {(rnd.choice("st"), f"r{rnd.randrange(30)}", rnd.choice(["k1", "k1", "k2", "k3"])): ("2020-01", rnd.randrange(10)) for _ in range(25)}
        new = {k: v for k, v in new.items() if k not in refs}
        gone = set(rnd.sample(sorted(refs), len(refs) // 3))
        change = {(rnd.choice("ab"), f"k{rnd.randrange(1, 5)}"): (rnd.random() < 0.6, rnd.randrange(10), rnd.randrange(10)) for _ in range(3)}
        refs = {k: v for k, v in refs.items() if k not in gone} | new
        parents |= change
        state.step(spark.createDataFrame([(*k, *v) for k, v in new.items()], ref).selectExpr("src", "rec", "target", "period", "cast(ref_at as decimal(30,0)) as ref_at"), spark.createDataFrame([*map(tuple, gone)], "src string, rec string, target string"), spark.createDataFrame([(*k, *v) for k, v in change.items()], par).withColumn("born", F.col("born").cast("decimal(30,0)")))
        want = set()
        for (src, rec, target), (period, at) in refs.items():
            p = parents.get(({"s": "a", "t": "b"}[src], target))
            kind = "missing" if p is None else "deleted" if not p[0] else "late" if p[2 if src == "t" else 1] > at else None
            if kind:
                want.add((src, rec, target, kind, period))
        assert {tuple(r) for r in state.pending().collect()} == want
    assert sum(r.orphans for r in state.counts().collect()) == len(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_stays(spark, seed):
    data = feed(seed)
    got = {(r.e, r.a, r.v): r.t for r in orphans.stays(datoms.facts(spark.createDataFrame(data, FEED)), MANY).collect()}
    assert got == {(e, a, v): t for (e, a), vs in folded(facts_of(data)).items() for v, t in vs.items()}


def test_snapshots_are_what_a_fresh_start_gives(spark):
    """From point to point parents are deleted and come back, and references go and come."""
    say = lambda n, e, a, v, t, op="+": (n, e, a, v, None, t, 0, ZERO + timedelta(days=40 * t), op, None, "", "", 0)
    rows_ = [say(1, 1, "P/to", "2", 1), say(2, 2, "P/x", "a", 2), say(3, 2, "P/x", "a", 3, "-"), say(4, 3, "P/to", "2", 3), say(5, 1, "P/to", "2", 4, "-"), say(6, 2, "P/x", "b", 5), say(7, 1, "P/to", "9", 5), say(8, 3, "P/to", "1", 6), say(9, 1, "P/to", "9", 6, "-")]
    df = spark.createDataFrame(rows_, FEED)
    none = lambda s: spark.createDataFrame([], s)
    others = none(REPORTS), spark.createDataFrame([("P/to", "ref", "one")], "attr string, value_type string, cardinality string"), none("email string, dept string, hired_at timestamp_ntz"), none("code string, created_at timestamp_ntz, deleted_at timestamp_ntz"), spark.createDataFrame([("p", 2, ZERO)], "email string, team bigint, joined_at timestamp_ntz")
    got = {tuple(r) for r in orphans.snapshots(df, *others, [1, 2, 3, 4, 5, 6], least=2).collect()}
    want = {(k, *r) for k in range(1, 7) for r in orphans.orphans(df.filter(F.col("t") <= k), *others).counts().collect()}
    assert got == want and {(3, "datom", "deleted"), (1, "datom", "missing"), (2, "datom", "late")} <= {r[:3] for r in got}


def test_orphans_of_empty_tables(spark):
    none = lambda s: spark.createDataFrame([], s)
    out = orphans.orphans(none(FEED), none(REPORTS), none("attr string, value_type string, cardinality string"), none("email string, dept string, hired_at timestamp_ntz"), none("code string, created_at timestamp_ntz, deleted_at timestamp_ntz"), none("email string, team bigint, joined_at timestamp_ntz"))
    assert out.pending().count() == 0 and out.counts().count() == 0
