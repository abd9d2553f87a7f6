"""Queries on the general data-processing operators, with the SQL that says the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import bitemporal, cow, datoms, hierarchy, history, incremental, orphans, widen
from ..operators.shared import cut, scratch, table

TRACKED = ["Employee/dept", "Employee/salary", "Employee/nickname"]
WIDE = ["Account", "Item", "Person", "Task"]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    feed = table(spark, folder, "datom")
    many = datoms.many_attrs(table(spark, folder, "attr_schema"))
    return cow.rebuilt(feed, scratch(spark, "facts")).live(many)


def _tracked(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    return datoms.timed_facts(table(spark, folder, "datom"), table(spark, folder, "txreport"), [*TRACKED, *more])


def _buyers(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Orders as points, and the entities that an email was ever given to."""
    plain = lambda c: F.lower(F.trim(c))
    orders = table(spark, folder, "purchase").filter("order_no is not null and placed_at is not null and buyer is not null")
    points = orders.select("order_no", plain("buyer").alias("email"), datoms.micros(F.col("placed_at")).alias("valid")).distinct()
    given = datoms.facts(table(spark, folder, "datom"), ["Employee/email"]).filter("add")
    return points, given.select(plain("v").alias("email"), "e").distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    points, owners = _buyers(spark, folder)
    rects = cut(bitemporal.rectangles(_tracked(spark, folder)))
    return bitemporal.locate(points, rects, cut(bitemporal.grid(rects)), "email", owners).select("order_no", "a", "v").distinct()


def p2_known(spark: SparkSession, folder: str) -> DataFrame:
    """As p2_found, but by what the first half of the log's transactions say: the points lie in valid and recorded time."""
    points, owners = _buyers(spark, folder)
    rows = _tracked(spark, folder)
    middle = table(spark, folder, "datom").agg(F.max("t")).first()[0] // 2
    rects = cut(bitemporal.rectangles(rows, superseded=True))
    hits = bitemporal.locate(points.withColumn("known", F.lit(middle)), rects, cut(bitemporal.grid(rects)), "email", owners)
    return hits.select("order_no", "a", "v").distinct()


def p2_rectangles(spark: SparkSession, folder: str) -> DataFrame:
    """All current-version rectangles, those that the log held before it learned better too."""
    return bitemporal.rectangles(_tracked(spark, folder), superseded=True)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The committed output of one run by high watermarks that the run log has set."""
    readers = incremental.LogReaders(spark, scratch(spark, "readers"))
    readers.catch_up(*[table(spark, folder, n) for n in ("datom", "txreport", "run_log")])
    return readers.output().select("consumer", F.col("t").alias("tx"), "e")


def p3_reader(spark: SparkSession, folder: str) -> DataFrame:
    """What runs by watermark over the whole feed give each consumer: every available datom once."""
    rows = incremental.replayed(*[table(spark, folder, n) for n in ("datom", "txreport", "run_log")], scratch(spark, "reader"))
    seq = (F.col("pos") - F.col("t").cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(10,0)")).cast("bigint")
    return rows.select("consumer", F.col("t").alias("tx"), seq.alias("seq"), "e", "a", "v", F.col("add").alias("added"))


def p4_wide(spark: SparkSession, folder: str) -> DataFrame:
    state = datoms.fact_state(datoms.facts(table(spark, folder, "datom")))
    return widen.widen(state, table(spark, folder, "attr_schema"), WIDE)


def p4_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Every typed value of p4_wide, told as text, or as a double where it is a fraction; arrays with | between their parts."""
    wide, cells = p4_wide(spark, folder), []
    for name, kind in wide.dtypes[3:]:
        c, number = F.col(name), kind == "double" or kind.startswith("decimal")
        text = F.array_join(F.transform(c, lambda x: x.cast("string")), "|") if kind.startswith("array") else F.unix_micros(c).cast("string") if kind == "timestamp" else c.cast("string")
        cells.append(F.struct(F.lit(name).alias("field"), (F.lit(None).cast("string") if number else text).alias("v"), (c.cast("double") if number else F.lit(None).cast("double")).alias("x")))
    return wide.select("e", "cls", F.explode(F.filter(F.array(*cells), lambda y: y["v"].isNotNull() | y["x"].isNotNull())).alias("y")).select("e", "cls", "y.*")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_wide(spark, folder).select("e", F.explode("unusable").alias("a"))


def _forest(spark: SparkSession, folder: str, paths: bool = False) -> DataFrame:
    return hierarchy.forest(table(spark, folder, "node"), table(spark, folder, "officer"), paths)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _forest(spark, folder).select("src", "id", "root", "depth")


def p5_paths(spark: SparkSession, folder: str) -> DataFrame:
    return _forest(spark, folder, paths=True).select("src", "id", "depth", "path")


def p5_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """All descendants of every node and officer, on and below loops too."""
    return hierarchy.forest_descendants(table(spark, folder, "node"), table(spark, folder, "officer"))


def _orphans(spark: SparkSession, folder: str) -> orphans.OrphanState:
    return orphans.orphans(*[table(spark, folder, n) for n in ("datom", "txreport", "attr_schema", "employee", "department", "player")])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).pending()


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).counts()


def p6_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """The counts after a third, two thirds and all of the log."""
    top = table(spark, folder, "datom").agg(F.max("t")).first()[0]
    return orphans.snapshots(*[table(spark, folder, n) for n in ("datom", "txreport", "attr_schema", "employee", "department", "player")], [top // 3, top * 2 // 3, top])


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = history.periods(history.in_millis(_tracked(spark, folder)))
    return rows.select("e", "a", "v", F.col("start").alias("from_ms"), F.coalesce("stop", F.lit(-1)).alias("to_ms"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_known, p2_rectangles, p3_found, p3_reader, p4_found, p4_wide, p4_cells, p5_found, p5_paths, p5_descendants, p6_found, p6_counts, p6_snapshots, p7_found)}

FACTS = """d as (select distinct e, a, v, t, coalesce(seq, -1) as s, lower(trim(op)) in ('+', 'assert') as ad from datom
  where e is not null and a is not null and v is not null and t is not null and lower(trim(op)) in ('+', 'assert', '-', 'retract')),
m as (select distinct attr from attr_schema where lower(trim(cardinality)) = 'many' and attr is not null),
ra as (select e, a, v, max((t, s)) filter (ad) as la, max((t, s)) filter (not ad) as lr, min(t) filter (ad) as fa from d group by e, a, v),
lv as (select e, a, v, la from ra where a in (from m) and la is not null and (lr is null or lr <= la)
  union all select e, a, v, la from (select *, row_number() over (partition by e, a order by la desc, v desc) as k from ra where a not in (from m) and la is not null) where k = 1 and (lr is null or lr <= la)),
ct as (select t, max(time) as time from (select t, time from datom union all select tx, time from txreport) where t is not null and time is not null group by t)"""

# the state of (e, a) after each instant: the last assert so far, unless its value was retracted after it and by then
STATES = FACTS + """,
x as (select d.*, ct.time, epoch_us(ct.time) as us from d join ct using (t) where a in ('Employee/dept', 'Employee/salary', 'Employee/nickname')),
i as (select distinct e, a, {at} as inst from x),
la as (select i.e, i.a, i.inst, arg_max(x.v, (x.t, x.s, x.v)) as v, max((x.t, x.s)) as p from i join x on x.e = i.e and x.a = i.a and {xat} <= i.inst where x.ad group by i.e, i.a, i.inst),
st as (select i.e, i.a, i.inst, case when exists (select 1 from x r where r.e = la.e and r.a = la.a and r.v = la.v and not r.ad and (r.t, r.s) > la.p and {rat} <= la.inst) then null else la.v end as v
  from i left join la using (e, a, inst))"""


def _states(at: str) -> str:
    return STATES.format(at=at.format("x."), xat=at.format("x."), rat=at.format("r."))


def _typed(kind: str, pattern: str, also: str = "true") -> str:
    return f"when value_type = '{kind}' then regexp_full_match(s, '{pattern}') and {also}"


USABLE = f"""coalesce(case
      {_typed("bigint", "[+-]?[0-9]+", "try_cast(s as bigint) is not null")} {_typed("int", "[+-]?[0-9]+", "try_cast(s as int) is not null")}
      {_typed("double", "[+-]?[0-9]+([.][0-9]+)?(e[+-]?[0-9]+)?")} {_typed("decimal", "[+-]?[0-9]+([.][0-9]{1,2})?")} {_typed("boolean", "true|false")}
      {_typed("date", "[0-9]{4}-[0-9]{2}-[0-9]{2}", "try_cast(s as date) is not null")}
      {_typed("instant", "[0-9]{4}-[0-9]{2}-[0-9]{2}t[0-9]{2}:[0-9]{2}:[0-9]{2}z", "try_strptime(upper(s), '%Y-%m-%dT%H:%M:%SZ') is not null")}
      {_typed("uuid", "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")} else true end, false)"""

LOOPFREE = """nl as (select distinct c, p from (select cast(id as varchar) as c, cast(parent as varchar) as p from node
  union all select cast(unnest(children) as varchar), cast(id as varchar) from node) where c is not null and p is not null),
oi as (select lower(trim(name)) as id, min(name) as shown from officer where name is not null group by 1),
ol as (select lower(trim(name)) as c, min(lower(trim(boss))) as p from officer where lower(trim(boss)) in (select id from oi) group by 1),
ni as (select distinct cast(id as varchar) as id from node where id is not null),
n2 as (select c, min(p) as p from nl where c in (from ni) and p in (from ni) group by c),
nr as (select id, id as root, cast(0 as bigint) as depth from ni where id not in (select c from n2)
  union all select n2.c, nr.root, nr.depth + 1 from nr join n2 on n2.p = nr.id),
orr as (select id, id as root, cast(0 as bigint) as depth from oi where id not in (select c from ol)
  union all select ol.c, orr.root, orr.depth + 1 from orr join ol on ol.p = orr.id)"""

ORPHANS = f"""with {FACTS},
dep as (select upper(trim(code)) as k, bool_or(deleted_at is null) as alive, min(case when deleted_at is null then coalesce(created_at, timestamp '1800-01-01') end) as born from department where code is not null group by 1),
ent as (select cast(ra.e as varchar) as k, min(fa) as t, bool_or(lv.e is not null) as alive from ra left join lv using (e, a, v) where fa is not null group by ra.e),
en as (select ent.k, ent.t, ent.alive, ct.time from ent left join ct using (t)),
rl as (select lv.* from lv where a in (select attr from attr_schema where lower(trim(value_type)) = 'ref')),
o2 as (select rl.e, rl.a, rl.v, greatest(max(case when q.v <> rl.v and m.attr is null then q.la end), max(case when q.v = rl.v then q.lr end)) as brk from rl left join m on m.attr = rl.a join ra q on q.e = rl.e and q.a = rl.a group by 1, 2, 3),
own as (select o2.e, o2.a, o2.v, min(d.t) as t from o2 join d on d.e = o2.e and d.a = o2.a and d.v = o2.v and d.ad and (o2.brk is null or (d.t, d.s) >= o2.brk) group by 1, 2, 3),
er as (select distinct email, upper(trim(dept)) as k, hired_at from employee where email is not null and trim(dept) <> ''),
pr as (select distinct email, cast(team as varchar) as k, joined_at from player where email is not null and team is not null),
o as (
  select 'employee' as src, email as rec, er.k as target, case when dep.k is null then 'missing' when not alive then 'deleted' when born > hired_at then 'late' end as kind, strftime(hired_at, '%Y-%m') as period from er left join dep on dep.k = er.k
  union select 'player', email, pr.k, case when en.k is null then 'missing' when not alive then 'deleted' when en.time > joined_at then 'late' end, strftime(joined_at, '%Y-%m') from pr left join en on en.k = pr.k
  union select 'datom', cast(own.e as varchar) || ':' || own.a, own.v, case when en.k is null then 'missing' when not alive then 'deleted' when en.t > own.t then 'late' end, strftime(ct.time, '%Y-%m') from own left join en on en.k = own.v left join ct on ct.t = own.t)"""

SQL = {
    "p1_found": f"with {FACTS} select e, a, v from lv",
    "p2_found": f"""with {_states("epoch_us({}time)")},
      nx as (select *, lead(inst) over (partition by e, a order by inst) as nxt from st),
      ow as (select distinct e, lower(trim(v)) as email from d where a = 'Employee/email' and ad),
      po as (select distinct order_no, lower(trim(buyer)) as email, epoch_us(placed_at) as p from purchase where order_no is not null and placed_at is not null and buyer is not null)
      select distinct order_no, a, v from po join ow using (email) join nx using (e) where v is not null and inst <= p and (nxt is null or p < nxt)""",
    "p2_known": f"""with {_states("epoch_us({}time)").replace("join ct using (t) where a in", "join ct using (t) where t <= (select max(t) // 2 from datom) and a in")},
      nx as (select *, lead(inst) over (partition by e, a order by inst) as nxt from st),
      ow as (select distinct e, lower(trim(v)) as email from d where a = 'Employee/email' and ad),
      po as (select distinct order_no, lower(trim(buyer)) as email, epoch_us(placed_at) as p from purchase where order_no is not null and placed_at is not null and buyer is not null)
      select distinct order_no, a, v from po join ow using (email) join nx using (e) where v is not null and inst <= p and (nxt is null or p < nxt)""",
    "p2_rectangles": f"""with {_states("epoch_us({}time)")},
      nx as (select *, lead(inst) over (partition by e, a order by inst) as nxt from st),
      k as (select nx.*, (select arg_max(x.t, (x.t, x.s)) from x where x.e = nx.e and x.a = nx.a and x.ad and x.us <= nx.inst) as kf from nx where v is not null),
      nw as (select e, a, us as nxt, min(t) as kt from x group by 1, 2, 3)
      select e, a, v, inst as valid_from, nxt as valid_to, kf as known_from, cast(null as bigint) as known_to from k
      union all select k.e, k.a, k.v, k.nxt, cast(null as bigint), k.kf, kt from k join nw using (e, a, nxt) left join k k2 on k2.e = k.e and k2.a = k.a and k2.inst = k.nxt where k2.kf is distinct from k.kf""",
    "p3_found": f"""with {FACTS},
      av0 as (select e, a, v, t, coalesce(seq, -1) as s, lower(trim(op)) in ('+', 'assert') as ad, min(received_at) as r from datom
        where e is not null and a is not null and v is not null and t is not null and lower(trim(op)) in ('+', 'assert', '-', 'retract') group by all),
      rp as (select tx, min(received_at) as r from txreport where tx is not null and received_at is not null group by tx),
      av as (select e, t, max(greatest(av0.r, rp.r)) as since from av0 join rp on rp.tx = av0.t where av0.r is not null group by e, t),
      ru as (select * from (select *, row_number() over (partition by run_id order by logged_at desc nulls last, lower(trim(status)) = 'ok') as k from run_log where run_id is not null and consumer is not null) where k = 1 and lower(trim(status)) = 'ok'),
      co as (select distinct consumer from run_log where consumer is not null)
      select consumer, t as tx, e from co cross join av where not exists (select 1 from ru where ru.consumer = co.consumer and ru.after_tx < av.t and av.t <= ru.upto_tx and ru.started_at >= av.since)""",
    "p3_reader": f"""with {FACTS},
      rc as (select distinct d.* from d join datom using (e, a, v, t) where received_at is not null and d.s = coalesce(seq, -1) and lower(trim(op)) in ('+', 'assert', '-', 'retract') and d.ad = (lower(trim(op)) in ('+', 'assert'))),
      co as (select distinct consumer from run_log where consumer is not null)
      select consumer, t as tx, s as seq, e, a, v, ad as added from co cross join rc where t in (select tx from txreport where tx is not null and received_at is not null)""",
    "p4_found": f"""with {FACTS},
      y as (select distinct e, a, lower(trim(value_type)) as value_type, lower(trim(v)) as s from lv join attr_schema on attr = a and cls in ('Person', 'Item', 'Account', 'Task'))
      select distinct e, a from y where not {USABLE}""",
    "p4_cells": f"""with {FACTS},
      y as (select e, cls, field, v, lower(trim(value_type)) as value_type, lower(trim(cardinality)) as card, lower(trim(v)) as s from lv join attr_schema on attr = a and cls in ('Person', 'Item', 'Account', 'Task'))
      select e, cls, cls || '_' || field as field, string_agg(case value_type when 'string' then v when 'bigint' then cast(try_cast(s as bigint) as varchar) when 'int' then cast(try_cast(s as int) as varchar)
        when 'date' then cast(try_cast(s as date) as varchar) when 'instant' then cast(epoch_us(try_strptime(upper(s), '%Y-%m-%dT%H:%M:%SZ')) as varchar) when 'double' then null when 'decimal' then null else s end, '|' order by v) as v,
        max(case when value_type in ('double', 'decimal') then try_cast(s as double) end) as x
      from y where {USABLE} group by e, cls, field""",
    "p5_found": f"""with recursive {LOOPFREE}
      select 'node' as src, ni.id, coalesce(root, '') as root, coalesce(depth, -1) as depth from ni left join nr using (id)
      union all select 'officer', name, coalesce(r.shown, ''), coalesce(depth, -1) from (select distinct name from officer where name is not null) left join orr on orr.id = lower(trim(name)) left join oi r on r.id = orr.root""",
    "p5_paths": f"""with recursive {LOOPFREE},
      np as (select id, cast(0 as bigint) as depth, [id] as path from ni where id not in (select c from n2) union all select n2.c, np.depth + 1, list_append(np.path, n2.c) from np join n2 on n2.p = np.id),
      op as (select id, cast(0 as bigint) as depth, [shown] as path from oi where id not in (select c from ol) union all select ol.c, op.depth + 1, list_append(op.path, oi.shown) from op join ol on ol.p = op.id join oi on oi.id = ol.c)
      select 'node' as src, ni.id, coalesce(depth, -1) as depth, path from ni left join np using (id)
      union all select 'officer', name, coalesce(depth, -1), path from (select distinct name from officer where name is not null) left join op on op.id = lower(trim(name))""",
    "p5_descendants": f"""with recursive {LOOPFREE},
      up as (select 'node' as src, c, p from n2 union all select 'officer', c, p from ol),
      wk as (select src, c, p, [c, p] as w from up where c <> p union all select wk.src, wk.c, up.p, list_append(wk.w, up.p) from wk join up on up.src = wk.src and up.c = wk.p where not list_contains(wk.w, up.p))
      select src, p as id, c as descendant, cast(len(w) - 1 as bigint) as distance from wk where src = 'node'
      union all select src, name, oi.shown, cast(len(w) - 1 as bigint) from wk join (select distinct name from officer where name is not null) on lower(trim(name)) = p join oi on oi.id = c where src = 'officer'""",
    "p6_found": f"{ORPHANS} select src, rec, target, kind, period from o where kind is not null",
    "p6_counts": f"{ORPHANS} select src, kind, period, count(*) as orphans from o where kind is not null group by 1, 2, 3",
    "p6_snapshots": " union all ".join(f"select * from ({ORPHANS.replace('from datom' + chr(10) + '  where e', f'from datom{chr(10)}  where t <= (select {k} from datom) and e')} select (select {k} from datom) as upto, src, kind, period, count(*) as orphans from o where kind is not null group by all)" for k in ("max(t) // 3", "max(t) * 2 // 3", "max(t)")),
    "p7_found": f"""with {_states("cast(ceil(epoch_us({}time) / 1000.0) as bigint)")},
      nx as (select *, lead(inst) over w as nxt, lag(v) over w as pv from st window w as (partition by e, a order by inst)),
      g as (select *, sum(case when v is not distinct from pv then 0 else 1 end) over (partition by e, a order by inst) as isl from nx)
      select e, a, any_value(v) as v, min(inst) as from_ms, coalesce(case when bool_or(nxt is null) then -1 end, max(nxt)) as to_ms from g where v is not null group by e, a, isl""",
}
