"""More queries for operators of the engine: reading, comprehensions, checks at build time, folds, keys, transactions, connections, storage."""

from __future__ import annotations

import re
import threading
from datetime import datetime, timezone
from decimal import Decimal
from typing import Annotated

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import Add, AddFrame, Batch, Codec, Computed, Conn, Db, Fn, Key, Lookup, ParquetStorage, Rule, SetField, TsvStorage, TxError, Upsert, UpsertWhere, count, count_distinct, day, day_at, dense_rank, empty, entity, exists, find, guard, lag, lead, max_, month, not_, partition_by, plus_days, rank, row_number, year
from ..functions import windows
from ..operators.numbering import numbered
from ..operators.shared import scratch, table
from ..sources.tpch import START, Cart, Customer, Nation, Order, Part, Region, Rep, Sale, Supplier, database
from .catalog import QUERIES, SQL, over, states, typed


def rows(db: Db, data: list[tuple], schema: str) -> DataFrame:
    return db.spark.createDataFrame(data, schema)


def refused(make) -> bool:
    """Whether a query or write is turned down when it is built."""
    try:
        made = make()
        getattr(made, "frame", None)
    except (TypeError, ValueError, AttributeError, RecursionError):
        return True
    return False


# reading

over("q_every", "select o_orderkey, row_number() over (order by o_orderkey) as n from orders")(lambda db: numbered(db.every(Order).frame.select("eid", "o_orderkey"), ["eid"], "n", 1).select("o_orderkey", "n"))
over("q_load", "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000)")(
    lambda db: db.decoded(Customer, db.frame(Order).filter("o_totalprice > 400000").select(F.col("customer").alias("eid"))).select("c_custkey", "c_name")
)


@over("q_by_eid", "select k, p_name from (values (cast(0 as bigint)), (7), (-1)) t(k) left join part on p_partkey = k union all select 5, cast(null as varchar)")
def _by_eid(db):
    """Parts by eid: two that are there, one that isn't, and a region, which is no part."""
    at = {k: db.by_eid(Part, START["Part"] + k) for k in (0, 7, -1)} | {5: db.by_eid(Part, START["Region"] + 1)}
    return rows(db, [(k, p.p_name if p else None) for k, p in at.items()], "k bigint, p_name string")


@over("q_find_by", "select cast(0 as bigint) as k, p_name as name from part where p_partkey = 12 union all select 1, r_name from region where r_name = 'ASIA' union all select 2, null union all select 3, r_name from region where r_regionkey = 3 union all select 4, null")
def _find_by(db):
    """By key, by a named field, by lookups; nothing where there is none."""
    load = lambda k: db.load(Region, Lookup(Region, k))
    found = [db.find(Part, 12), db.find(Region, "ASIA", "r_name"), db.find(Region, 77), load(3), load(33)]
    return rows(db, [(i, getattr(x, "p_name" if i == 0 else "r_name") if x else None) for i, x in enumerate(found)], "k bigint, name string")


@over("q_lookup_ref", "select s_name, n_name from supplier join nation on s_nationkey = n_nationkey union all select 'by key', n_name from nation where n_nationkey = 3 union all select 'by name', n_name from nation where n_name = 'NATION_7' union all select 'to the new one', 'NEW'")
def _lookup_ref(db):
    """References by key and by another field, also to what the same transaction has added."""
    by_name = Lookup(Nation, "NATION_7", "n_name")
    steps = [Add([Supplier(10**9, "by key", 3, Lookup(Nation, 3), 0.0), Supplier(10**9 + 1, "by name", 7, by_name, 0.0)])]
    new = Fn(lambda d: AddFrame(Nation, d.spark.createDataFrame([(99, "NEW", START["Region"], START["Nation"])], "n_nationkey bigint, n_name string, region bigint, next bigint")))
    out = db.transact(Batch((*steps, new, Add([Supplier(10**9 + 2, "to the new one", 99, Lookup(Nation, 99), 0.0)])))).db_after
    return out.query(Supplier, Nation, lambda s, n: find(s.s_name, n.n_name).where(s.nation == n)).frame


@over("q_match_by", "select 'set' as field, count(distinct l_orderkey) as n from lineitem where l_returnflag = 'A' union all select 'many refs', count(distinct l_orderkey) from lineitem where l_partkey = 12 union all select 'optional', count(*) from customer where c_acctbal = (select max(c_acctbal) from customer)")
def _match_by(db):
    top = db.frame(Customer).agg(F.max("credit")).first()[0]
    found = {"set": db.match_by(Cart, "flags", "A"), "many refs": db.match_by(Cart, "parts", db.find(Part, 12)), "optional": db.match_by(Customer, "credit", top)}
    return rows(db, [(k, q.count()) for k, q in found.items()], "field string, n bigint")


over("q_stored", "select r_regionkey as k, r_name as name from region")(lambda db: rows(db, [(s.eid - START["Region"], s.record.r_name if s.r_regionkey == s.record.r_regionkey else None) for s in db.every(Region).stored()], "k bigint, name string"))

# collections

over("q_contains", "select o_orderkey from (select l_orderkey as o_orderkey from lineitem group by 1 having bool_or(l_returnflag = 'A') and bool_or(l_returnflag = 'R'))")(lambda db: db.where(Cart, lambda c: c.flags.contains("A") & c.flags("R")).frame.select("o_orderkey"))
over("q_where_prefix", "select p_partkey from part where starts_with(p_name, 'blue') and p_size >= 20")(lambda db: db.where(Part, lambda p: p.p_name.startswith("blue") & (p.p_size >= 20)).frame.select("p_partkey"))
over("q_where_regex", "select p_partkey from part where regexp_matches(p_brand, '[37]$') or p_size = 1")(lambda db: db.where(Part, lambda p: p.p_brand.rlike("[37]$") | (p.p_size == 1)).frame.select("p_partkey"))
over("q_where_opaque", "select p_partkey from part where length(p_name) = p_size")(lambda db: db.where(Part, opaque=lambda p: len(p.p_name) == p.p_size).frame.select("p_partkey"))
over("q_filter_not", "select c_custkey from customer where not (c_acctbal >= 0 and c_acctbal > 100)")(lambda db: db.where(Customer).filter_not(lambda c: c.credit > 100).frame.select("c_custkey"))
over("q_map", "select o_orderkey, cast(o_totalprice * 2 + 1 as double) as x, cast(o_orderkey % 7 as bigint) as k from orders")(lambda db: db.where(Order).map(o_orderkey=lambda o: o.o_orderkey, x=lambda o: o.o_totalprice * 2.0 + 1.0, k=lambda o: o.o_orderkey % 7))
over("q_comprehension", "select c_name, o_orderkey from customer join orders on o_custkey = c_custkey where c_acctbal > 5000 and o_totalprice > 300000")(
    lambda db: db.where(Customer, lambda c: c.c_acctbal > 5000.0).flat_map(lambda c: db.where(Order, lambda o: (o.customer == c.eid) & (o.o_totalprice > 300000.0)).map(c_name=lambda o: c.c_name, o_orderkey=lambda o: o.o_orderkey))
)
over("q_flat_map", "select p_partkey, unnest(string_split(p_name, ' ')) as word from part")(lambda db: db.where(Part).flat_map(lambda pdf: pdf.assign(word=pdf.p_name.str.split(" ")).explode("word")[["p_partkey", "word"]], "p_partkey bigint, word string"))
over("q_fold", "select p_brand, median(p_size) as mid from part group by 1")(lambda db: db.where(Part).group_by("p_brand").fold(lambda g: pd.DataFrame({"p_brand": g.p_brand[:1], "mid": [float(g.p_size.median())]}), "p_brand string, mid double"))
over("q_query_order", "select p_partkey from part order by p_size % 10 desc, p_partkey desc limit 20 offset 7")(lambda db: db.where(Part).order_by_desc(lambda p: p.p_size % 10, "p_partkey").offset(7).limit(20).frame.select("p_partkey"))
over("q_one_exists", "select true as some, false as none, 'ASIA' as one, 5 as n")(
    lambda db: rows(db, [(db.exists(Part, lambda p: p.p_size > 1), db.exists(Part, lambda p: p.p_size > 10**6), db.where(Region, lambda r: r.r_name == "ASIA").one().r_name, db.count(Region))], "some boolean, none boolean, one string, n int")
)

# typed queries

over("q_pure", "select cast(1 as bigint) as n, 'x' as s")(lambda db: db.pure(n=1, s="x").select(F.col("n").cast("bigint").alias("n"), "s"))
typed("q_guard", "select p_partkey from part where p_size > 40", Part)(lambda p: find(p.p_partkey).where(guard(1 < 2) & (p.p_size > 40) | empty() | guard(False) & (p.p_size < 10)))
typed("q_many_ref_join", "select distinct l_orderkey as o_orderkey, p_partkey, p_name from lineitem join part on p_partkey = l_partkey where p_size = 50", Cart, Part)(lambda c, p: find(c.o_orderkey, p.p_partkey, p.p_name).where((c.parts == p) & (p.p_size == 50)))
DAY = "cast(o_orderdate as date)"
typed("q_dates", f"select o_orderkey, cast(year({DAY}) as int) as y, cast(month(o_orderdate) as int) as m, cast(day({DAY}) as int) as d, cast({DAY} + 30 as varchar) as later from orders where {DAY} + 30 < date '1999-01-15' and day({DAY}) > 10", Sale, post=lambda df: df.withColumn("later", F.col("later").cast("string")))(
    lambda s: find(s.o_orderkey, y=year(s.on), m=month(s.at), d=day(s.on), later=plus_days(s.on, 30)).where((plus_days(s.on, 30) < datetime(1999, 1, 15).date()) & (day(s.on) > 10))
)
typed("q_dates_grouped", f"select cast({DAY} as varchar) as day, cast(year({DAY}) as int) as y, count(*) as n from orders group by 1, 2", Sale, post=lambda df: df.withColumn("day", F.col("day").cast("string")))(lambda s: find(day=day_at(s.at), y=year(s.on), n=count(s)))
typed("q_date_join", f"select a.o_orderkey, b.o_orderkey as other from orders a join orders b on cast(a.o_orderdate as date) + 1 = cast(b.o_orderdate as date) where a.o_totalprice > 450000 and b.o_totalprice > 450000", Sale, Order, Sale, Order)(
    lambda a, x, b, y: find(a.o_orderkey, other=b.o_orderkey).where((plus_days(a.on, 1) == b.on) & (a.o_orderkey == x.o_orderkey) & (b.o_orderkey == y.o_orderkey) & (x.o_totalprice > 450000) & (y.o_totalprice > 450000))
)
BAG = "(select * from part where p_size <= 20 union all select * from part where p_size > 10)"
typed("q_window_or", f"select p_partkey, count(*) over (partition by p_brand) as n from {BAG}", Part)(lambda p: find(p.p_partkey, n=count(p).over(partition_by(p.p_brand))).where((p.p_size <= 20) | (p.p_size > 10)))
typed("q_count_distinct_over", "select p_partkey, n from part join (select p_brand, count(distinct p_size) as n from part group by 1) using (p_brand)", Part)(lambda p: find(p.p_partkey, n=count_distinct(p.p_size).over(partition_by(p.p_brand))))
ALL = "(order by o_totalprice desc, o_orderkey)"
typed(
    "q_window_all",
    f"select o_orderkey, row_number() over {ALL} as n, rank() over (order by o_orderpriority) as r, dense_rank() over (order by o_orderpriority) as d, lag(o_totalprice) over {ALL} as before, lead(o_orderkey, 3) over {ALL} as third, max(o_totalprice) over () as top, (select count(distinct o_custkey) from orders) as buyers from orders",
    Order,
)(lambda o: (lambda by: find(o.o_orderkey, n=row_number().over(by), r=rank().over(partition_by().order_by(o.o_orderpriority)), d=dense_rank().over(partition_by().order_by(o.o_orderpriority)), before=lag(o.o_totalprice).over(by), third=lead(o.o_orderkey, 3).over(by), top=max_(o.o_totalprice).over(by), buyers=count_distinct(o.customer).over(partition_by())))(partition_by().order_by(o.o_totalprice.desc(), o.o_orderkey)))
typed("q_exists_or", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and (o_totalprice > 490000 or (o_orderstatus = 'P' and o_orderpriority = '1-URGENT')))", Customer)(
    lambda c: find(c.c_custkey).where(exists(Order, lambda o: (o.customer == c) & ((o.o_totalprice > 490000) | ((o.o_orderstatus == "P") & (o.o_orderpriority == "1-URGENT")))))
)


@over("q_refusals", "select unnest(['not in not', 'not in or', 'not in a rule', 'order by what is not found', 'count of a constant', 'a constant found', 'aggregate and window', 'unknown field', 'truth of a term', 'comparing an aggregate']) as what, true as refused")
def _refusals(db):
    """What is turned down when a query is built."""
    p, o = Part.row(), Order.row()
    ask = lambda make: (lambda: db.query(Part, make).frame)
    cases = {
        "not in not": lambda: not_(not_(p.p_size == 1)),
        "not in or": ask(lambda p: find(p.p_name).where((p.p_size == 1) | not_(p.p_size == 2))),
        "not in a rule": lambda: Rule(Part, Part, lambda a, b: not_(a.p_size == b.p_size)),
        "order by what is not found": ask(lambda p: find(p.p_name).order_by(p.p_size)),
        "count of a constant": lambda: count(3),
        "a constant found": lambda: find(3),
        "aggregate and window": lambda: find(count(p), n=row_number().over(partition_by(p.p_brand))),
        "unknown field": lambda: find(p.p_colour),
        "truth of a term": lambda: bool(p.p_size == 1) or o,
        "comparing an aggregate": lambda: count(p) > 3,
    }
    return rows(db, [(k, refused(make)) for k, make in cases.items()], "what string, refused boolean")


# rules

STEPS = "with recursive t as (select c_custkey as b, cast(floor(c_custkey / 2) as bigint) as a, 1 as k from customer where c_custkey >= 2 union select t.b, cast(floor(t.a / 2) as bigint), k + 1 from t where t.a >= 2)"


def _parity() -> tuple[Rule, Rule]:
    """Customers an odd and an even number of steps above others; each rule calls the other."""
    odd, even = Rule(Rep, Rep), Rule(Rep, Rep)

    def then(rule):
        def body(a, b):
            m = Rep.row()
            return rule(a, m) & (b.boss == m)

        return body

    odd.add(lambda a, b: b.boss == a).add(then(even))
    even.add(then(odd))
    return odd, even


typed("q_rule_mutual", f"{STEPS} select a, count(*) as n from t where k % 2 = 0 group by a", Rep, Rep)(lambda a, b: find(a=a.c_custkey, n=count(b)).where(_parity()[1](a, b)))
typed("q_rule_mutual_bound", f"{STEPS} select a from t where k % 2 = 1 and b = 1000", Rep, Rep)(lambda a, b: find(a=a.c_custkey).where((b.c_custkey == 1000) & _parity()[0](a, b)))

# pull

over("q_pull_by_eid", "select p_name as value from part where p_partkey = 9")(lambda db: rows(db, [(db.pull_by_eid(Part, START["Part"] + 9, lambda p: p.p_name).value,)] + [("there",) for x in [db.pull_by_eid(Part, START["Region"], lambda p: p.p_name)] if x is not None], "value string"))
over("q_pull_many_refs", "select o_orderkey, list(p_name order by p_partkey) as names from (select distinct l_orderkey as o_orderkey, l_partkey from lineitem) join part on p_partkey = l_partkey group by 1")(
    lambda db: db.where(Cart).pull(lambda c: {"o_orderkey": c.o_orderkey, "names": c.parts.map(lambda p: p.p_name)})
)
over("q_pull_optional_ref", "select a.c_custkey, b.c_name as boss from customer a left join customer b on a.c_custkey >= 2 and b.c_custkey = a.c_custkey // 2")(lambda db: db.where(Rep).pull(lambda r: {"c_custkey": r.c_custkey, "boss": r.boss(lambda b: b.c_name)}))
over("q_pull_reverse_many", "select p_partkey, count(distinct l_orderkey) as n from part left join lineitem on l_partkey = p_partkey where p_size = 7 group by 1")(
    lambda db: db.where(Part, lambda p: p.p_size == 7).pull(lambda p: {"p_partkey": p.p_partkey, "carts": p.reverse(Cart, "parts", lambda c: c.o_orderkey)}).select("p_partkey", F.size("carts").cast("bigint").alias("n"))
)


@over("q_pull_value", "select c_custkey, case when c_custkey >= 2 then c_custkey // 2 end as b1, case when c_custkey >= 4 then c_custkey // 4 end as b2, case when c_custkey >= 32 then c_custkey // 32 end as b5 from customer")
def _pull_value(db):
    """Whole entities as deep as the data goes, here the first, second and fifth above each customer."""
    return db.where(Rep).pull(lambda r: r.value()).select("c_custkey", F.col("boss.c_custkey").alias("b1"), F.col("boss.boss.c_custkey").alias("b2"), F.col("boss.boss.boss.boss.boss.c_custkey").alias("b5"))


over("q_pull_loop", "select true as refused")(lambda db: rows(db, [(refused(lambda: db.where(Nation).pull(lambda n: n.value())),)], "refused boolean"))

# folds, keys, value types

over("q_running_fold", "select c_custkey, max(c_acctbal) over (partition by c_nationkey order by c_custkey rows unbounded preceding) - first(c_acctbal) over (partition by c_nationkey order by c_custkey rows unbounded preceding) as rise from customer")(
    lambda db: windows.folded(db.frame(Customer).select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey"], [F.col("c_custkey")], "rise", lambda x: float(x.max() - x.iloc[0]), ["c_acctbal"], "double").select("c_custkey", "rise")
)
over("q_whole_fold", "select p_partkey, median(p_size) over (partition by p_brand) as mid from part")(
    lambda db: windows.folded(db.frame(Part).select("p_partkey", "p_brand", "p_size"), ["p_brand"], [F.col("p_partkey")], "mid", lambda x: float(x.median()), ["p_size"], "double", running=False).select("p_partkey", "mid")
)


@entity
class Link:
    """Two numbers in any order."""

    a: int
    b: int
    said: str
    pair: Key[Annotated[str, Computed(lambda r: f"{min(r.a, r.b)}-{max(r.a, r.b)}", lambda r: F.concat_ws("-", F.least(r.a, r.b), F.greatest(r.a, r.b)))]]


@over("q_computed_key", "select c_custkey // 2 as a, c_custkey as b, case when c_custkey % 3 = 0 then 'again' else 'first' end as said, concat(c_custkey // 2, '-', c_custkey) as pair from customer where c_custkey >= 2")
def _computed_key(db):
    """Links of customers to superiors; a third is told again with the ends exchanged and takes the place of what was said first."""
    link = db.frame(Rep).filter("c_custkey >= 2").select(F.col("c_custkey").alias("b"), F.floor(F.col("c_custkey") / 2).alias("a"), F.lit("first").alias("said"))
    again = link.filter("b % 3 = 0").select(F.col("a").alias("b"), F.col("b").alias("a"), F.lit("again").alias("said"))
    out = Db(db.spark, [Link]).add_frame(Link, link).upsert_frame(Link, again).frame(Link)
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "said", "pair")


@entity
class Tag:
    """A brand: its price as a user type that is kept in cents, sizes and counts as a map."""

    brand: Key[str]
    top: Annotated[Decimal, Codec(int, lambda d: int(d * 100), lambda n: Decimal(n) / 100)]
    sizes: dict[str, int]


def _tags(db) -> Db:
    part = db.frame(Part)
    sizes = part.groupBy("p_brand", F.col("p_size").cast("string").alias("k")).agg(F.count(F.lit(1)).alias("v")).groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("sizes"))
    top = part.groupBy("p_brand").agg(F.max(F.round(F.col("p_retailprice") * 100).cast("bigint")).alias("top"))
    return Db(db.spark, [Tag]).add_frame(Tag, top.join(sizes, "p_brand").withColumnRenamed("p_brand", "brand"))


over("q_codec", "select brand, cents, cast(cents / 100.0 as varchar) as price from (select p_brand as brand, cast(round(max(p_retailprice) * 100) as bigint) as cents from part group by 1)")(
    lambda db: (lambda d: rows(d, [(t.brand, int(t.top * 100), str(float(t.top))) for t in d.where(Tag)], "brand string, cents bigint, price string"))(_tags(db))
)
over("q_map_values", "select p_brand as brand, cast(p_size as varchar) as k, count(*) as v from part group by 1, 2")(
    lambda db: (lambda d: rows(d, [(t.brand, k, v) for t in d.where(Tag) for k, v in t.sizes.items()], "brand string, k string, v bigint"))(_tags(db))
)
over("q_map_equal", "select p_brand as brand from part group by 1 having p_brand = 'Brand#4'")(lambda db: (lambda d: d.where(Tag, lambda t: t.sizes == d.find(Tag, "Brand#4").sizes).frame.select("brand"))(_tags(db)))

# transactions and time


@over("q_upsert_where_key", "with c as (select p_partkey + 1 as k, p_name as name from part where p_size > 25) select coalesce(k, p_partkey) as p_partkey, coalesce(name, p_name) as p_name from part full join c on p_partkey = k")
def _upsert_where_key(db):
    """Changed keys: each record is written under its new one."""
    return db.upsert_where(Part, lambda p: p.p_size > 25, {"p_partkey": lambda p: p.p_partkey + 1}).frame(Part).select("p_partkey", "p_name")


@over("q_diff_only", "select case when p_size > 45 then 'bulk' else 'none' end as kind, case when p_size > 45 then '+' else '-' end as op, count(*) as n from part where p_size > 45 group by all union all select 'full', '+', 2 union all select 'full', '-', 2 union all select 'diff', '+', 1 union all select 'diff', '-', 1")
def _diff_only(db):
    """What is written for a changed name: all fields, or that one."""
    small = Db(db.spark).add(Region(1, "A"))
    wrote = lambda kind, report: report.datoms.groupBy("op").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "op", "n")
    bulk = Db(db.spark, [Region]).transact(AddFrame(Region, db.frame(Part).filter("p_size > 45").select(F.col("p_partkey").alias("r_regionkey"), F.lit("x").alias("r_name")))).datoms.filter("attr = 'Region/r_name'")
    named = bulk.groupBy("op").agg(F.count(F.lit(1)).alias("n")).select(F.lit("bulk").alias("kind"), "op", "n")
    return named.unionAll(wrote("full", small.transact(Upsert([Region(1, "B")])))).unionAll(wrote("diff", small.transact(Upsert([Region(1, "B")], diff_only=True))))


@over("q_commit_at", "select cast(1 as bigint) as tx, timestamp '2024-03-01 09:00:00' as time union all select 2, timestamp '2024-03-01 09:00:00' union all select 3, timestamp '2024-03-02 00:00:00'")
def _commit_at(db):
    """A time given can't fall behind the last."""
    out = Db(db.spark, [Region])
    for k, at in enumerate([datetime(2024, 3, 1, 9, tzinfo=timezone.utc), datetime(2024, 3, 1, 8, tzinfo=timezone.utc), "2024-03-02"]):
        out = out.transact(Add([Region(k, f"r{k}")]), at).db_after
    return out.log().groupBy("tx").agg(F.max("time").cast("timestamp_ntz").alias("time"))


@over("q_errors", "select unnest(['UniqueViolation', 'UniqueViolation', 'UnknownIdentity', 'UnknownEntity', 'Aborted', 'SinceView']) as error, 5 as kept")
def _errors(db):
    """A transaction that fails leaves nothing behind."""
    base, said = Db(db.spark).add_frame(Region, table_of(db, Region)), []
    other = Region(0, "OTHER")
    for what in (lambda: base.add(other), lambda: base.tx(lambda b: b.add(Region(50, "x"), Region(50, "y"))), lambda: base.add(Nation(1, "n", Lookup(Region, 99), Lookup(Nation, 1))), lambda: base.transact(SetField(Region, 10**6, "r_name", "z")), lambda: base.tx(lambda b: b.add(Region(60, "n")).abort()), lambda: base.since(0).add(Region(70, "n"))):
        try:
            what()
        except TxError as e:
            said.append(type(e).__name__)
    return rows(db, [(e, base.count(Region)) for e in said], "error string, kept int")


def table_of(db, of) -> DataFrame:
    return db.frame(of).drop("eid")


@over("q_history_of", "select cast(1 as bigint) as tx, 'ASIA' as name, '+' as op union all select 2, 'ASIA', '-' union all select 2, 'AZJA', '+' union all select 3, 'AZJA', '-'")
def _history_of(db):
    """All names of a region, found by what it is now, and by eid after it is gone."""
    one = Db(db.spark).add_frame(Region, table_of(db, Region)).upsert(Region(2, "AZJA"))
    eid = one.eid_of(Region(2, "AZJA"))
    now, later = one.history_of(Region(2, "AZJA")), one.retract(Region(2, "AZJA")).history(eid).filter("tx = 3")
    return now.unionAll(later).filter("attr = 'Region/r_name'").select("tx", F.col("v").alias("name"), "op")


over("q_as_of_basis", "select max(event_id) as basis from events", states)(lambda db: rows(db, [(db.as_of(10**12).basis,)], "basis bigint"))
over("q_counters", "select cast(78 as bigint) as next_eid, cast(9 as bigint) as basis")(lambda db: (lambda d: rows(d, [(d.next_eid, d.basis)], "next_eid bigint, basis bigint"))(Db.from_log(db.spark, rows(db, [(1, "Rep/c_custkey", "1", 1, 0, None, "+"), (1, "Rep/boss", "77", 9, 0, None, "+")], "eid bigint, attr string, v string, tx bigint, seq bigint, time timestamp, op string"), [Rep])))

# text

BASE = START["Region"]
over("q_pretty", f"select line from (select 0 as k, 'Region (' || count(*) || ')' as line from region union all select unnest([3 * r_regionkey + 1, 3 * r_regionkey + 2, 3 * r_regionkey + 3]), unnest(['  #' || ({BASE} + r_regionkey), '    r_name      = \"' || r_name || '\"', '    r_regionkey = ' || r_regionkey]) from region)")(
    lambda db: rows(db, [(x,) for x in _regions(db).pretty().splitlines() if x], "line string")
)
over("q_pretty_log", f"select line from (select 'Region/' || unnest(['r_regionkey', 'r_name']) || ' ' || unnest([cast(r_regionkey as varchar), '\"' || r_name || '\"']) || ' +' as line from region)")(
    lambda db: rows(db, [(" ".join(re.split(r"\s{2,}", x.rstrip())[-3:]),) for x in _regions(db).pretty_log().splitlines()[2:]], "line string")
)


def _regions(db) -> Db:
    return Db.from_frames(db.spark, {Region: db.frame(Region)}, 2 * BASE)


# connections


@over("q_listen", "select cast(2 as bigint) as tx, count(*) * 2 as facts from nation union all select 3, 2 union all select 4, 2")
def _listen(db):
    """Commits after the subscription, each once and in order, also one that a subscriber makes itself; another's errors are its own."""
    conn, heard = Conn(db.spark, entities=[Region]), []
    conn.add(Region(100, "BEFORE"))
    conn.listen(lambda r: heard.append((r.tx, r.datoms.count())))
    conn.listen(lambda r: 1 / 0)
    conn.listen(lambda r: conn.add(Region(101, "ECHO")) if r.tx == 2 else None)
    conn.add_frame(Region, db.frame(Nation).select(F.col("n_nationkey").alias("r_regionkey"), F.col("n_name").alias("r_name")))
    conn.retract(Region(101, "ECHO"))
    return rows(db, heard, "tx bigint, facts bigint")


@over("q_follow", "select cast(1 as bigint) as tx, 2 * count(*) as facts, count(*) as added, count(*) as live from region union all select 2, 2, 1, count(*) + 1 from region")
def _follow(db):
    """A subscriber with a thread of its own catches up from the log."""
    conn, heard, done = Conn(db.spark, entities=[Region]), [], threading.Event()
    conn.add_frame(Region, table_of(db, Region))
    conn.add(Region(100, "MU"))

    def f(report):
        heard.append((report.tx, report.datoms.count(), len(report.added_eids), report.db_after.count(Region)))
        if report.tx == 2:
            done.set()

    with conn.follow(f, after=0):
        done.wait(120)
    return rows(db, heard, "tx bigint, facts bigint, added bigint, live bigint")


over("q_watch_lazy", "select true as refused")(lambda db: rows(db, [(refused(lambda: Conn(db.spark).watch(lambda d: d.where(Region), print)),)], "refused boolean"))


@over("q_await", "select cast(1 as bigint) as basis, 1 as regions, true as late")
def _await(db):
    conn, late = Conn(db.spark), False
    timer = threading.Timer(0.2, lambda: conn.add(Region(1, "A")))
    timer.start()
    got = conn.await_after(0, 60)
    try:
        conn.await_after(got.basis, 0.05)
    except TimeoutError:
        late = True
    return rows(db, [(got.basis, got.count(Region), late)], "basis bigint, regions int, late boolean")


# storage


def q_tsv_bulk(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in text lines, most of them changed in one transaction of many facts, read back by another connection."""
    keep, db = TsvStorage(scratch(spark, "lines"), [Order]), database(spark, folder)
    conn = Conn(spark, keep, [Order])
    conn.transact(AddFrame(Order, db.frame(Order)))
    conn.transact(UpsertWhere(Order, lambda o: o.o_totalprice > 60000, {"o_orderpriority": lambda o: F.lower(o.o_orderpriority.column), "o_totalprice": lambda o: o.o_totalprice + 1}))
    return Conn(spark, keep, [Order]).db.frame(Order).select("o_orderkey", F.round(F.col("o_totalprice"), 2).alias("o_totalprice"), "o_orderpriority", "o_orderstatus")


def q_compaction(spark: SparkSession, folder: str) -> DataFrame:
    """A log compacted every two transactions: live values, and what held after the second."""
    keep = ParquetStorage(scratch(spark, "log"), every=2)
    conn = Conn(spark, keep, [Part])
    conn.transact(AddFrame(Part, table(spark, folder, "part")))
    for size in (30, 20, 10):
        conn.transact(UpsertWhere(Part, lambda p, s=size: p.p_size > s, {"p_size": lambda p: p.p_size + 100}))
    keep.vacuum(spark)
    db = Conn(spark, keep, [Part]).db
    now, then = (d.frame(Part).select("p_partkey", F.col("p_size").cast("int").alias(n)) for d, n in ((db, "now"), (db.as_of(2), "second")))
    return now.join(then, "p_partkey")


QUERIES["q_tsv_bulk"], SQL["q_tsv_bulk"] = q_tsv_bulk, "select o_orderkey, round(case when o_totalprice > 60000 then o_totalprice + 1 else o_totalprice end, 2) as o_totalprice, case when o_totalprice > 60000 then lower(o_orderpriority) else o_orderpriority end as o_orderpriority, o_orderstatus from orders"
QUERIES["q_compaction"], SQL["q_compaction"] = q_compaction, "select p_partkey, case when p_size > 30 then p_size + 300 when p_size > 20 then p_size + 200 when p_size > 10 then p_size + 100 else p_size end as now, case when p_size > 30 then p_size + 100 else p_size end as second from part"
