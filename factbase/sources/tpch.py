"""The star-schema tables as entities, and the events as the log of a class of user states."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..db import LOG, Db
from ..operators.shared import table
from ..schema import Key, entity
from .ingest import keyed, placed, to_ref

STEP = 1 << 52  # eids of one class


@entity
class Region:
    r_regionkey: Key[int]
    r_name: str


@entity
class Nation:
    n_nationkey: Key[int]
    n_name: str
    region: Region
    next: "Nation"


@entity
class Customer:
    c_custkey: Key[int]
    c_name: str
    c_nationkey: int
    nation: Nation
    c_acctbal: float
    c_mktsegment: str
    boss: "Customer | None"
    credit: float | None


@entity
class Supplier:
    s_suppkey: Key[int]
    s_name: str
    s_nationkey: int
    nation: Nation
    s_acctbal: float


@entity
class Part:
    p_partkey: Key[int]
    p_name: str
    p_brand: str
    p_type: str
    p_size: int
    p_retailprice: float


@entity
class Order:
    o_orderkey: Key[int]
    customer: Customer
    o_orderstatus: str
    o_totalprice: float
    o_orderpriority: str


@entity
class LineItem:
    order: Order
    part: Part
    supplier: Supplier
    l_linenumber: int
    l_quantity: float
    price: Decimal
    l_returnflag: str
    l_linestatus: str


@entity
class User:
    user_id: Key[int]
    types: set[str]


@entity
class UserState:
    user_id: Key[int]
    last_type: str
    last_value: float


@entity
class Sale:
    """An order by when it was made."""

    o_orderkey: Key[int]
    at: datetime
    on: date


@entity
class Cart:
    """An order by what is in it."""

    o_orderkey: Key[int]
    parts: set[Part]
    flags: set[str]


@entity
class Rep:
    """A customer and the one it reports to."""

    c_custkey: Key[int]
    c_name: str
    boss: "Rep | None"


CLASSES = (Region, Nation, Customer, Supplier, Part, Order, LineItem, User, Sale, Cart, Rep)
START = {e.name: (i + 1) * STEP for i, e in enumerate(CLASSES)}


def database(spark: SparkSession, folder: str) -> Db:
    """All classes; only the frames that a query reads are ever scanned, and of those only the columns."""
    read = lambda n: table(spark, folder, n)
    ref = lambda df, c, of: to_ref(df, c, START[of.name])

    def nation():
        return keyed(ref(read("nation").withColumnRenamed("n_regionkey", "region"), "region", Region).withColumn("next", F.lit(START["Nation"]) + (F.col("n_nationkey") + 1) % 25), "n_nationkey", START["Nation"])

    def customer():
        df = read("customer").withColumn("nation", F.lit(START["Nation"]) + F.col("c_nationkey").cast("bigint"))
        # every customer but the first reports to the one with half the number
        df = df.withColumn("boss", F.when(F.col("c_custkey") >= 2, F.lit(START["Customer"]) + F.floor(F.col("c_custkey") / 2))).withColumn("credit", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
        return keyed(df, "c_custkey", START["Customer"])

    def supplier():
        return keyed(read("supplier").withColumn("nation", F.lit(START["Nation"]) + F.col("s_nationkey").cast("bigint")), "s_suppkey", START["Supplier"])

    def order():
        return keyed(ref(read("orders").withColumnRenamed("o_custkey", "customer"), "customer", Customer), "o_orderkey", START["Order"])

    def line():
        df = placed(read("lineitem"), START["LineItem"]).select("eid", F.col("l_orderkey").alias("order"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), "l_linenumber", "l_quantity", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), "l_returnflag", "l_linestatus")
        return ref(ref(ref(df, "order", Order), "part", Part), "supplier", Supplier)

    def sale():
        return keyed(read("orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"), F.to_date("o_orderdate").alias("on")), "o_orderkey", START["Sale"])

    def cart():
        rows = ref(read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("part"), "l_returnflag"), "part", Part)
        return keyed(rows.groupBy("o_orderkey").agg(F.sort_array(F.collect_set("part")).alias("parts"), F.sort_array(F.collect_set("l_returnflag")).alias("flags")), "o_orderkey", START["Cart"])

    def rep():
        boss = F.when(F.col("c_custkey") >= 2, F.lit(START["Rep"]) + F.floor(F.col("c_custkey") / 2))
        return keyed(read("customer").select("c_custkey", "c_name", boss.alias("boss")), "c_custkey", START["Rep"])

    def user():
        return keyed(read("events").filter("user_id is not null").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("types")), "user_id", START["User"])

    frames = {Region: lambda: keyed(read("region"), "r_regionkey", START["Region"]), Nation: nation, Customer: customer, Supplier: supplier, Part: lambda: keyed(read("part"), "p_partkey", START["Part"]), Order: order, LineItem: line, User: user, Sale: sale, Cart: cart, Rep: rep}
    return Db.from_frames(spark, frames, (len(CLASSES) + 2) * STEP)


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """Each event as one transaction that upserts the state of its user: what held is retracted, what holds asserted."""
    events = table(spark, folder, "events").filter("user_id is not null and event_type is not null and value is not null")
    before = Window.partitionBy("user_id").orderBy("event_id")
    rows = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("time"), "event_type", "value", F.lag("event_type").over(before).alias("type0"), F.lag("value").over(before).alias("value0"))
    fact = lambda name, v, op, seq: F.struct(F.lit(f"UserState/{name}").alias("attr"), v.cast("string").alias("v"), F.lit(op).alias("op"), F.lit(seq).cast("bigint").alias("seq"))
    old = [fact("user_id", F.when(F.col("type0").isNotNull(), F.col("user_id")), "-", 0), fact("last_type", F.col("type0"), "-", 1), fact("last_value", F.col("value0"), "-", 2)]
    new = [fact("user_id", F.col("user_id"), "+", 3), fact("last_type", F.col("event_type"), "+", 4), fact("last_value", F.col("value"), "+", 5)]
    said = rows.select(F.col("user_id").alias("eid"), F.col("event_id").alias("tx"), "time", F.explode(F.filter(F.array(*old, *new), lambda x: x["v"].isNotNull())).alias("x"))
    return said.select("eid", "x.attr", "x.v", "tx", "x.seq", "time", "x.op").select(*LOG.names)


def states(spark: SparkSession, folder: str) -> Db:
    return Db.from_log(spark, event_log(spark, folder), [UserState])
