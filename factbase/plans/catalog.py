"""A query for each operator of the engine over the star-schema tables, with the SQL that says the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import AddFrame, Block, Conn, ParquetStorage, Rule, TsvStorage, UpsertWhere, avg, closure, count, count_distinct, dense_rank, exists, find, lag, lead, max_, min_, not_, partition_by, rank, row_number, sum_
from ..functions import windows
from ..operators.shared import scratch, table
from ..sources.tpch import Cart, Customer, LineItem, Nation, Order, Part, Region, Supplier, User, UserState, database, states
from ..streaming.log_stream import log_stream

QUERIES: dict = {}
SQL: dict[str, str] = {}


def typed(name: str, sql: str, *of, post=None):
    """A typed query over the classes ``of``: the body gives its shape."""

    def wrap(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = database(spark, folder).query(*of, build).frame
            return post(df) if post else df

        run.__name__ = name
        QUERIES[name] = run
        SQL[name] = sql
        return build

    return wrap


def over(name: str, sql: str | None, make=database):
    """A query that is a function of the database."""

    def wrap(work):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return work(make(spark, folder))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return work

    return wrap


money = lambda *names: (lambda df: df.withColumns({n: F.col(n).cast("double") for n in names}))

# filters and unions

typed("q_scan_filter", "select c_name, c_acctbal from customer where c_acctbal > 5000", Customer)(lambda c: find(c.c_name, c.c_acctbal).where(c.c_acctbal > 5000))
typed("q_between", "select p_name, p_size from part where p_size > 10 and p_size <= 20", Part)(lambda p: find(p.p_name, p.p_size).where((p.p_size > 10) & (p.p_size <= 20)))
typed("q_prefix", "select c_name from customer where starts_with(c_name, 'Customer#00000001')", Customer)(lambda c: find(c.c_name).where(c.c_name.startswith("Customer#00000001")))
typed("q_or_bag", "select c_name from customer where c_acctbal > 1000 union all select c_name from customer where c_acctbal > 5000", Customer)(lambda c: find(c.c_name).where((c.c_acctbal > 1000) | (c.c_acctbal > 5000)))
typed("q_or_distinct", "select distinct c_mktsegment from customer where c_acctbal > 1000 or c_acctbal < 0", Customer)(lambda c: find(c.c_mktsegment).where((c.c_acctbal > 1000) | (c.c_acctbal < 0)).distinct())
typed("q_or_shapes", "select c_name from customer where c_acctbal > 9000 union all select c_name from customer join nation on c_nationkey = n_nationkey where n_nationkey = 3", Customer, Nation)(lambda c, n: find(c.c_name).where((c.c_acctbal > 9000) | ((c.nation == n) & (n.n_nationkey == 3))))

# joins

typed("q_ref_join", "select c_name, n_name from customer join nation on c_nationkey = n_nationkey where c_acctbal > 5000", Customer, Nation)(lambda c, n: find(c.c_name, n.n_name).where((c.nation == n) & (c.c_acctbal > 5000)))
typed("q_value_join", "select c_name, s_name from customer join supplier on c_nationkey = s_nationkey where c_acctbal > 9000", Customer, Supplier)(lambda c, s: find(c.c_name, s.s_name).where((c.c_nationkey == s.s_nationkey) & (c.c_acctbal > 9000)))
typed("q_theta_join", "select n_name, r_name from nation join region on n_nationkey < r_regionkey", Nation, Region)(lambda n, r: find(n.n_name, r.r_name).where(n.n_nationkey < r.r_regionkey))
typed("q_cross_join", "select n_name, r_name from nation cross join region", Nation, Region)(lambda n, r: find(n.n_name, r.r_name))
typed(
    "q_multiway5",
    "select n_name, sum(cast(l_extendedprice as decimal(18,2)))::double as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' group by n_name",
    LineItem, Order, Customer, Nation, Region, post=money("revenue"),
)(lambda l, o, c, n, r: find(n.n_name, revenue=sum_(l.price)).where((l.order == o) & (o.customer == c) & (c.nation == n) & (n.region == r) & (r.r_name == "ASIA")))
typed("q_self_join", "select a.n_name, b.n_name as other from nation a join nation b on a.n_regionkey = b.n_regionkey where a.n_nationkey <> b.n_nationkey", Nation, Nation)(lambda a, b: find(a.n_name, other=b.n_name).where((a.region == b.region) & (a != b)))
over("q_ref_walk", "select c_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'EUROPE'")(lambda db: db.where(Customer, lambda c: c.nation.region.r_name == "EUROPE").frame.select("c_name"))
over("q_ref_eq", "select c_name from customer where c_nationkey = 7")(lambda db: db.where(Customer, lambda c: c.nation == db.frame(Nation).filter("n_nationkey = 7").first().eid).frame.select("c_name"))

# negation and existence

typed("q_not_const", "select n_name from nation where n_name <> 'FRANCE'", Nation)(lambda n: find(n.n_name).where(not_(n.n_name == "FRANCE")))
typed("q_not_cross", "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)", Order, LineItem)(lambda o, l: find(o.o_orderkey).where(not_(l.order == o)))
typed("q_not_or", "select c_name from customer where not (c_acctbal > 3000) and not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')", Customer, Order)(lambda c, o: find(c.c_name).where(not_((c.c_acctbal > 3000) | ((o.customer == c) & (o.o_orderstatus == "P")))))
typed("q_not_and", "select c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)", Customer, Order)(lambda c, o: find(c.c_name).where(not_((o.customer == c) & (o.o_totalprice > 200000))))
typed("q_exists_semi", "select c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')", Customer)(lambda c: find(c.c_name).where(exists(Order, lambda o: (o.customer == c) & (o.o_orderstatus == "P"))))
typed("q_exists_nested", "select n_name from nation where exists (select 1 from customer where c_nationkey = n_nationkey and exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000))", Nation)(lambda n: find(n.n_name).where(exists(Customer, lambda c: (c.nation == n) & exists(Order, lambda o: (o.customer == c) & (o.o_totalprice > 450000)))))

# options and sets

typed("q_optional_presence", "select c_name, c_acctbal as credit from customer where c_acctbal >= 0", Customer)(lambda c: find(c.c_name, c.credit))
over("q_optional_none", "select c_name from customer where not (c_acctbal >= 0)")(lambda db: db.where(Customer, lambda c: c.credit == None).frame.select("c_name"))  # noqa: E711
TYPES = "(select distinct user_id, event_type from events where user_id is not null)"
typed("q_set_member", f"select user_id from {TYPES} where event_type = 'click'", User)(lambda u: find(u.user_id).where(u.types == "click"))
typed("q_set_fanout", f"select user_id, event_type as types from {TYPES} where event_type is not null", User)(lambda u: find(u.user_id, u.types))
typed("q_set_same_element", f"select user_id, event_type as types from {TYPES} where event_type > 'a' and event_type < 'm'", User)(lambda u: find(u.user_id, u.types).where((u.types > "a") & (u.types < "m")))
typed("q_set_not", "select l_orderkey as o_orderkey from lineitem group by 1 having not bool_or(l_returnflag > 'N')", Cart)(lambda c: find(c.o_orderkey).where(not_(c.flags > "N")))

# aggregates

typed("q_count", "select c_mktsegment, count(*) as n from customer group by 1", Customer)(lambda c: find(c.c_mktsegment, n=count(c)))
typed("q_count_distinct", "select o_orderstatus, count(distinct o_custkey) as n from orders group by 1", Order)(lambda o: find(o.o_orderstatus, n=count_distinct(o.customer)))
typed("q_sum", "select l_returnflag, l_linestatus, sum(cast(l_extendedprice as decimal(18,2)))::double as total from lineitem group by 1, 2", LineItem, post=money("total"))(lambda l: find(l.l_returnflag, l.l_linestatus, total=sum_(l.price)))
typed("q_avg", "select l_returnflag, avg(l_quantity) as mean from lineitem group by 1", LineItem)(lambda l: find(l.l_returnflag, mean=avg(l.l_quantity)))
typed("q_minmax", "select p_brand, min(p_size) as low, max(p_size) as high from part group by 1", Part)(lambda p: find(p.p_brand, low=min_(p.p_size), high=max_(p.p_size)))
typed("q_agg_order", "select p_brand, count(*) as n from part group by 1 order by n desc, p_brand limit 5", Part)(lambda p: (lambda n: find(p.p_brand, n=n).order_by(n.desc(), p.p_brand).limit(5))(count(p)))
typed("q_global_agg", "select count(*) as n, max(o_totalprice) as top from orders having count(*) > 0", Order)(lambda o: find(n=count(o), top=max_(o.o_totalprice)))
typed("q_global_agg_empty", "select count(*) as n from orders where o_totalprice < 0 having count(*) > 0", Order)(lambda o: find(n=count(o)).where(o.o_totalprice < 0))
over("q_groupby_agg", "select p_type, max(p_retailprice) as top, count(*) as n from part group by 1")(lambda db: db.where(Part).group_by("p_type").agg(top=F.max("p_retailprice"), n=F.count(F.lit(1))))
over("q_count_by", "select o_orderpriority, count(*) as count from orders group by 1")(lambda db: db.where(Order).count_by("o_orderpriority"))

# windows

BY = "(partition by c_nationkey order by c_acctbal desc nulls last, c_custkey)"
part = lambda c: partition_by(c.c_nationkey).order_by(c.c_acctbal.desc(), c.c_custkey)
typed("q_row_number", f"select c_custkey, row_number() over {BY} as n from customer", Customer)(lambda c: find(c.c_custkey, n=row_number().over(part(c))))
typed("q_rank", "select p_partkey, rank() over (partition by p_brand order by p_size) as n from part", Part)(lambda p: find(p.p_partkey, n=rank().over(partition_by(p.p_brand).order_by(p.p_size))))
typed("q_dense_rank", "select p_partkey, dense_rank() over (partition by p_brand order by p_size) as n from part", Part)(lambda p: find(p.p_partkey, n=dense_rank().over(partition_by(p.p_brand).order_by(p.p_size))))
typed("q_lag", f"select c_custkey, lag(c_acctbal) over {BY} as before from customer", Customer)(lambda c: find(c.c_custkey, before=lag(c.c_acctbal).over(part(c))))
typed("q_lead", f"select c_custkey, lead(c_acctbal, 2) over {BY} as after from customer", Customer)(lambda c: find(c.c_custkey, after=lead(c.c_acctbal, 2).over(part(c))))
typed("q_agg_over", "select p_partkey, sum(p_size) over (partition by p_brand)::bigint as total, max(p_size) over (partition by p_brand) as top from part", Part)(lambda p: find(p.p_partkey, total=sum_(p.p_size).over(partition_by(p.p_brand)), top=max_(p.p_size).over(partition_by(p.p_brand).order_by(p.p_size))))
over("q_running", "select p_partkey, sum(p_size) over (partition by p_brand order by p_partkey rows unbounded preceding)::bigint as total from part")(lambda db: windows.running(db.frame(Part).select("p_partkey", "p_brand", "p_size"), ["p_brand"], [F.col("p_partkey")], total=F.sum("p_size")).select("p_partkey", "total"))
over("q_whole", "select p_partkey, count(*) over (partition by p_brand) as n from part")(lambda db: windows.whole(db.frame(Part).select("p_partkey", "p_brand"), ["p_brand"], n=F.count(F.lit(1))).select("p_partkey", "n"))
typed("q_topn_per_group", f"select c_custkey from (select c_custkey, row_number() over {BY} as n from customer) where n <= 3", Customer, post=lambda df: df.filter("n <= 3").select("c_custkey"))(lambda c: find(c.c_custkey, n=row_number().over(part(c))))
typed("q_order_limit", "select c_name, c_acctbal from customer order by c_acctbal desc, c_name limit 10", Customer)(lambda c: find(c.c_name, c.c_acctbal).order_by(c.c_acctbal.desc(), c.c_name).limit(10))
typed("q_offset", "select c_name from customer order by c_name limit 5 offset 20", Customer)(lambda c: find(c.c_name).order_by(c.c_name).offset(20).limit(5))

# rules: customer k reports to k / 2, nation k points to the next of 25

TREE = "with recursive t as (select c_custkey as b, cast(floor(c_custkey / 2) as bigint) as a from customer where c_custkey >= 2 union select t.b, cast(floor(t.a / 2) as bigint) from t where t.a >= 2)"
RING = "with recursive t as (select n_nationkey as a, (n_nationkey + 1) % 25 as b from nation union select t.a, (t.b + 1) % 25 from t)"


def _above() -> Rule:
    def further(self):
        def body(a, b):
            m = Customer.row()
            return self(a, m) & (b.boss == m)

        return body

    return Rule.recursive(Customer, Customer, lambda self: [lambda a, b: b.boss == a, further(self)])


typed("q_rule_or", "select distinct a.n_name, b.n_name as other from nation a join nation b on a.n_regionkey = b.n_regionkey or b.n_nationkey = (a.n_nationkey + 1) % 25", Nation, Nation)(lambda a, b: find(a.n_name, other=b.n_name).where(Rule(Nation, Nation, lambda x, y: x.region == y.region, lambda x, y: x.next == y)(a, b)))
typed("q_rule_recursive_tree", f"{TREE} select a, count(*) as n from t group by a", Customer, Customer)(lambda a, b: find(a=a.c_custkey, n=count(b)).where(_above()(a, b)))
typed("q_rule_recursive_cycle", f"{RING} select a, b from t", Nation, Nation)(lambda a, b: find(a=a.n_nationkey, b=b.n_nationkey).where(_around()(a, b)))


def _around() -> Rule:
    def further(self):
        def body(a, b):
            m = Nation.row()
            return self(a, m) & (m.next == b)

        return body

    return Rule.recursive(Nation, Nation, lambda self: [lambda a, b: a.next == b, further(self)])


UP = Rule.reaches(Customer, "boss")
typed("q_reaches_forward", f"{TREE} select a from t where b = 1000", Customer, Customer)(lambda b, a: find(a=a.c_custkey).where((b.c_custkey == 1000) & UP(b, a)))
typed("q_reaches_reverse", f"{TREE} select b from t where a = 5", Customer, Customer)(lambda b, a: find(b=b.c_custkey).where((a.c_custkey == 5) & UP(b, a)))
typed("q_reaches_both", f"{TREE} select a, b from t where a <= 3 and b > 1000", Customer, Customer)(lambda b, a: find(a=a.c_custkey, b=b.c_custkey).where((a.c_custkey <= 3) & (b.c_custkey > 1000) & UP(b, a)))
typed("q_rule_recursive_bound", f"{TREE} select b from t where a = 5", Customer, Customer)(lambda a, b: find(b=b.c_custkey).where((a.c_custkey == 5) & _above()(a, b)))
typed("q_reaches_pairs", f"{TREE} select a, b from t", Customer, Customer)(lambda b, a: find(a=a.c_custkey, b=b.c_custkey).where(UP(b, a)))


@over("q_closure", "with recursive t as (select n_nationkey as a, (n_nationkey + 1) % 25 as b, 1 as depth from nation union all select a, (b + 1) % 25, depth + 1 from t where depth < 25) select a, b, depth from t")
def _closure(db):
    """How many steps it is from each nation to each, itself included, around the ring."""
    edges = db.frame(Nation).select(F.col("eid").alias("src"), F.col("next").alias("dst"))
    name = lambda eid, n: db.frame(Nation).select(F.col("eid").alias(eid), F.col("n_nationkey").alias(n))
    return closure(edges, db.frame(Nation).select("eid")).join(name("src", "a"), "src").join(name("dst", "b"), "dst").select("a", "b", "depth")


# pull

over("q_pull_ref", "select c_name, n_name as nation, r_name as region from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")(
    lambda db: db.where(Customer).pull(lambda c: {"c_name": c.c_name, "at": c.nation(lambda n: {"nation": n.n_name, "region": n.region(lambda r: r.r_name)})}).select("c_name", "at.nation", "at.region")
)
over("q_pull_reverse_counts", "select c_name, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by c_custkey, c_name")(
    lambda db: db.where(Customer).pull(lambda c: {"c_name": c.c_name, "orders": c.reverse(Order, "customer", lambda o: o.o_orderkey)}).select("c_name", F.size("orders").cast("bigint").alias("n"))
)
over("q_pull_reverse_list", "select r_name, list(n_name order by n_nationkey) as nations from region join nation on n_regionkey = r_regionkey group by r_name")(
    lambda db: db.where(Region).pull(lambda r: {"r_name": r.r_name, "nations": r.reverse(Nation, "region", lambda n: n.n_name)})
)

# time travel over the events as a log

E = "(select * from events where user_id is not null and event_type is not null and value is not null)"
LATEST = f"select user_id, arg_max(event_type, event_id) as last_type, arg_max(value, event_id) as last_value from {E}"
HALF = "(select max(event_id) // 2 from events)"
state = lambda db: db.frame(UserState).select("user_id", "last_type", "last_value")
half = lambda db: db.basis // 2
over("q_as_of_tx", f"{LATEST} where event_id <= {HALF} group by user_id", states)(lambda db: state(db.as_of(half(db))))
over("q_as_of_time", f"{LATEST} where ts <= timestamp '2024-01-05 00:00:00' group by user_id", states)(lambda db: state(db.as_of("2024-01-05T00:00:00Z")))
over("q_since", f"{LATEST} where event_id > {HALF} group by user_id", states)(lambda db: state(db.since(half(db))))
# a value is compared as text, or as the number it stands for
said = lambda df, *more: df.select("eid", "attr", F.when(F.col("attr") != "UserState/last_value", F.col("v")).alias("v"), F.when(F.col("attr") == "UserState/last_value", F.col("v").cast("double")).alias("x"), *more)
SAID = "(select user_id as eid, 'UserState/user_id' as attr, cast(user_id as varchar) as v, cast(null as double) as x, * from {0} union all select user_id, 'UserState/last_type', last_type, null, * from {0} union all select user_id, 'UserState/last_value', null, last_value, * from {0})"
TOLD = f"with f as (select event_id as tx, user_id, event_type as last_type, value as last_value, '+' as op from {E}), b as (select event_id as tx, user_id, lag(event_type) over w as last_type, lag(value) over w as last_value, '-' as op from {E} window w as (partition by user_id order by event_id)), t as (from f union all by name from b where last_type is not null)"
over("q_history", f"{TOLD} select eid, attr, v, x, tx, op from {SAID.format('t')} where eid = (select min(user_id) from events)", states)(lambda db: said(db.history(db.frame(UserState).agg(F.min("eid")).first()[0]), "tx", "op"))
over("q_log", f"{TOLD} select eid, attr, v, x, tx, op from {SAID.format('t')}", states)(lambda db: said(db.log(), "tx", "op"))
over("q_log_counts", f"select '+' as op, 3 * count(*) as n from {E} union all select '-', 3 * (count(*) - count(distinct user_id)) from {E}", states)(lambda db: db.log().groupBy("op").agg(F.count(F.lit(1)).alias("n")))
over("q_live_datoms", f"with s as ({LATEST} group by user_id) select eid, attr, v, x from {SAID.format('s')}", states)(lambda db: said(db.datoms()))
DIFF = f"with a as ({LATEST} where event_id <= {HALF} group by user_id), b as ({LATEST} group by user_id), fa as (select eid, attr, v, x from {SAID.format('a')}), fb as (select eid, attr, v, x from {SAID.format('b')})"
over("q_diff_added", f"{DIFF} from fb except from fa", states)(lambda db: said(db.as_of(half(db)).diff(db).added))
over("q_diff_retracted", f"{DIFF} from fa except from fb", states)(lambda db: said(db.as_of(half(db)).diff(db).retracted))

# writes

over("q_upsert_where", "select c_custkey, case when c_mktsegment = 'BUILDING' then c_name || '!' else c_name end as c_name from customer")(
    lambda db: db.upsert_where(Customer, lambda c: c.c_mktsegment == "BUILDING", {"c_name": lambda c: F.concat(c.c_name.column, F.lit("!"))}).frame(Customer).select("c_custkey", "c_name")
)
over("q_retract_where", "select o_orderkey from orders where not (o_totalprice > 100000)")(lambda db: db.retract_where(Order, lambda o: o.o_totalprice > 100000).frame(Order).select("o_orderkey"))


@over("q_tx_block", "select r_name, r_regionkey from region where r_regionkey <> 0 union all select 'ATLANTIS', 98 union all select 'ATLANTIS', 99")
def _block(db):
    """Three steps of one transaction; the last sees what the first has added, and writes it anew under another key."""

    def build(b):
        b.add(Region(98, "ATLANTIS"))
        b.retract_where(Region, lambda r: r.r_regionkey == 0)
        b.upsert_where(Region, lambda r: r.r_name == "ATLANTIS", {"r_regionkey": 99})

    return db.transact(Block(build)).db_after.frame(Region).select("r_name", F.col("r_regionkey").cast("int").alias("r_regionkey"))


@over("q_branch", "select 'kept' as side, count(*) as n from nation union all select 'branch', count(*) - 1 from nation")
def _branch(db):
    """A branch is written to, the original isn't."""
    other = db.retract_where(Nation, lambda n: n.n_nationkey == 3)
    side = lambda name, d: d.frame(Nation).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n")
    return side("kept", db).unionAll(side("branch", other))


@over("q_bulk_upsert", "select r_regionkey, lower(r_name) as r_name from region union all select 50, 'new'")
def _bulk(db):
    new = db.frame(Region).select("r_regionkey", F.lower("r_name").alias("r_name")).unionAll(db.spark.createDataFrame([(50, "new")], "r_regionkey int, r_name string"))
    return db.upsert_frame(Region, new).frame(Region).select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")


def _stored(storage):
    def work(spark: SparkSession, folder: str) -> DataFrame:
        """Parts are committed to storage in bulk, raised in a second transaction, and read back by a new connection."""
        keep = storage(scratch(spark, "log"))
        conn = Conn(spark, keep, [Part])
        conn.transact(AddFrame(Part, table(spark, folder, "part")))
        conn.transact(UpsertWhere(Part, lambda p: p.p_size > 40, {"p_size": lambda p: p.p_size + 100}))
        return Conn(spark, keep, [Part]).db.frame(Part).select("p_partkey", "p_name", F.col("p_size").cast("int").alias("p_size"))

    return work


STORED = "select p_partkey, p_name, case when p_size > 40 then p_size + 100 else p_size end as p_size from part"
QUERIES["q_storage_roundtrip"], SQL["q_storage_roundtrip"] = _stored(ParquetStorage), STORED
QUERIES["q_tsv_roundtrip"], SQL["q_tsv_roundtrip"] = _stored(lambda path: TsvStorage(path, [Part])), STORED


def q_stream_log(spark: SparkSession, folder: str) -> DataFrame:
    """The stored log of two transactions, taken by a stream that ends when it has caught up."""
    path, out = scratch(spark, "log"), scratch(spark, "stream")
    conn = Conn(spark, ParquetStorage(path), [Supplier])
    conn.transact(AddFrame(Region, table(spark, folder, "region")))
    conn.transact(AddFrame(Nation, database(spark, folder).frame(Nation)))
    log_stream(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-mark").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("attr").agg(F.count(F.lit(1)).alias("n"))


def q_stream_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Tables that grow, committed one by one, as the stream of the log has them: facts and values of each attribute."""
    path, out = scratch(spark, "log"), scratch(spark, "stream")
    conn, db = Conn(spark, ParquetStorage(path), [Supplier, Part, Order]), database(spark, folder)
    for of in (Supplier, Part, Order):
        conn.transact(AddFrame(of, db.frame(of)))
    log_stream(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-mark").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("attr").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("vals"))


def q_watch_count(spark: SparkSession, folder: str) -> DataFrame:
    """What a live count of regions is told over three commits, of which one leaves it as it was."""
    conn, seen = Conn(spark, entities=[Region]), []
    conn.transact(AddFrame(Region, table(spark, folder, "region")))
    with conn.watch(lambda db: db.count(Region), seen.append):
        conn.add(Region(100, "ATLANTIS"))
        conn.upsert(Region(100, "MU"))
        conn.retract(Region(100, "MU"))
    return spark.createDataFrame([(i, n) for i, n in enumerate(seen)], "step bigint, regions bigint")


QUERIES["q_stream_log"] = q_stream_log
SQL["q_stream_log"] = "select a as attr, n from (values ('Region/r_regionkey'), ('Region/r_name')) t(a), (select count(*) as n from region) union all select a, n from (values ('Nation/n_nationkey'), ('Nation/n_name'), ('Nation/region'), ('Nation/next')) t(a), (select count(*) as n from nation)"
GROWING = {"Supplier": ("supplier", {n: n for n in ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")} | {"nation": "s_nationkey"}), "Part": ("part", {n: n for n in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")}), "Order": ("orders", {n: n for n in ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")} | {"customer": "o_custkey"})}
QUERIES["q_stream_tables"] = q_stream_tables
SQL["q_stream_tables"] = " union all ".join(f"select '{of}/{f}' as attr, count({c}) as n, count(distinct {c}) as vals from {t}" for of, (t, fields) in GROWING.items() for f, c in fields.items())
QUERIES["q_watch_count"] = q_watch_count
SQL["q_watch_count"] = "select cast(0 as bigint) as step, count(*) as regions from region union all select 1, count(*) + 1 from region union all select 2, count(*) from region"
