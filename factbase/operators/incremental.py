"""Processing only new or changed records, each exactly once, also after failed runs and for late records."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .cow import Files
from .datoms import facts, micros
from .shared import cut
from .skew import LEAST, running, salted_join

FAN = 6  # bits: a node of the tree over commit numbers has 64 children


def availability(feed: DataFrame, reports: DataFrame) -> DataFrame:
    """(t, e, since): the instant (microseconds) from which every datom of e in t that will be available is.

    A datom is available from the later of its first received_at and the first of its transaction's report; one that
    lacks either isn't. Repeated and late rows count by their first receipt. A pair (t, e) is given with the latest of
    its datoms, since a run that could take that one could take them all.
    """
    latest = _received(feed).groupBy("t", "e").agg(F.max("r").alias("r"))
    return latest.join(_told(reports), "t").select("t", "e", micros(F.greatest("r", "told")).alias("since"))


def available(feed: DataFrame, reports: DataFrame) -> DataFrame:
    """Each datom (t, e, a, v, pos, add) that will be available, with ``since`` as in ``availability``."""
    return _received(feed).join(_told(reports), "t").select("t", "e", "a", "v", "pos", "add", micros(F.greatest("r", "told")).alias("since"))


def _received(feed: DataFrame) -> DataFrame:
    first = facts(feed, None, "received_at").groupBy("t", "e", "a", "v", "pos", "add").agg(F.min("received_at").alias("r"))
    return first.filter(F.col("r").isNotNull())


def _told(reports: DataFrame) -> DataFrame:
    known = reports.filter(F.col("tx").isNotNull() & F.col("received_at").isNotNull())
    return known.groupBy(F.col("tx").alias("t")).agg(F.min("received_at").alias("told"))


def ended_ok(log: DataFrame) -> DataFrame:
    """(consumer, low, high, started): the runs that ended ok; they took low <= t < high.

    Of a run's rows the one with the latest logged_at counts (null first; among equals one that isn't ok, so nothing is
    skipped). Rows without run_id or consumer are no run; a run without bounds or start took nothing.
    """
    ok = F.coalesce(F.lower(F.trim("status")) == "ok", F.lit(False))
    last = log.filter(F.col("run_id").isNotNull() & F.col("consumer").isNotNull()).groupBy("run_id").agg(F.max(F.struct("logged_at", (~ok).alias("bad"), "consumer", "after_tx", "upto_tx", "started_at")).alias("x")).select("x.*")
    runs = last.filter(~F.col("bad") & F.col("started_at").isNotNull() & (F.col("after_tx") < F.col("upto_tx")))
    return runs.select("consumer", (F.col("after_tx") + 1).alias("low"), (F.col("upto_tx") + 1).alias("high"), micros(F.col("started_at")).alias("started"))


def _covers(low: Column, high: Column, level: int, top: bool) -> Column:
    """The nodes of ``level`` wholly in [low, high) whose parent isn't: at most 126, unless at the top."""
    lo = F.ceil(low / F.lit(1 << FAN * level)) if level else low
    hi = F.floor(high / F.lit(1 << FAN * level)) if level else high
    span = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    if top:
        return span(lo, hi)
    size = 1 << FAN * (level + 1)
    inner, outer = F.ceil(low / F.lit(size)) * (1 << FAN), F.floor(high / F.lit(size)) * (1 << FAN)
    return F.when(inner < outer, F.concat(span(lo, inner), span(outer, hi))).otherwise(span(lo, hi))


def covered(commits: DataFrame, spans: DataFrame) -> DataFrame:
    """(t, took, least): for each commit number the spans that hold it, as (started, consumer) with the latest start of
    each consumer, and the least of the starts.

    spans: (consumer, low, high, started), low <= t < high. A span is cut into nodes of a tree over commit numbers, and
    what a node has is handed down to those of its children that exist, level by level: work in proportion to the commits
    and spans, however long the spans are and however many of them overlap, and no join from number to interval. Commit
    numbers are whole and not negative.
    """
    highest = commits.agg(F.max("t")).first()[0] or 0
    levels = max(1, -(-int(highest).bit_length() // FAN))
    nodes = {0: commits}
    for i in range(1, levels):
        nodes[i] = nodes[i - 1].select(F.floor(F.col("t") / (1 << FAN)).alias("t")).distinct()
    down = None
    for i in reversed(range(levels)):
        own = spans.select("consumer", "started", F.explode(_covers(F.greatest(F.col("low"), F.lit(0)), F.least(F.col("high"), F.lit(highest + 1)), i, i == levels - 1)).alias("t"))
        if down is not None:
            kids = nodes[i].withColumn("up", F.floor(F.col("t") / (1 << FAN)))
            own = own.unionByName(kids.join(down.withColumnRenamed("t", "up"), "up").select("consumer", "started", "t"))
        down = own.groupBy("consumer", "t").agg(F.max("started").alias("started"))
    return down.groupBy("t").agg(F.collect_list(F.struct("started", "consumer")).alias("took"), F.min("started").alias("least"))


NEVER = -(1 << 63)


def untaken(runs: DataFrame, consumers: DataFrame, least: int = LEAST) -> DataFrame:
    """(consumer, low, high, started): the spans that no run of a consumer covers, holes and all above its highest run; started is ``NEVER``."""
    reach = running(runs.groupBy("consumer", "low").agg(F.max("high").alias("high")), ["consumer"], "low", {"reach": ("max", F.col("high"))}, before=True, least=least)
    holes = reach.select("consumer", F.coalesce("reach", F.lit(0)).alias("from"), F.col("low").alias("to")).filter(F.col("from") < F.col("to"))
    above = consumers.join(runs.groupBy("consumer").agg(F.max("high").alias("from")), "consumer", "left").select("consumer", F.coalesce("from", F.lit(0)).alias("from"), F.lit((1 << 63) - 1).alias("to"))
    return holes.unionByName(above).select("consumer", F.col("from").alias("low"), F.col("to").alias("high"), F.lit(NEVER).alias("started"))


def pending(ready: DataFrame, runs: DataFrame, consumers: DataFrame, least: int = LEAST) -> DataFrame:
    """(consumer, t, e) of ``ready`` that no run of the consumer has taken.

    ready: as of ``availability``, written down. runs: as of ``ended_ok``. A run has taken a datom if it covers t and
    started when the datom was available or later. consumers: (consumer), distinct; those without runs count as well.
    A datom that every consumer took is passed over at one comparison; consumers never come to the driver.
    """
    runs = cut(runs)
    spans = runs.unionByName(untaken(runs, consumers, least))
    held = salted_join(ready, covered(ready.select("t").distinct(), spans), ["t"], least=least).filter(F.col("least") < F.col("since"))
    return held.select(F.explode(F.filter("took", lambda x: x["started"] < F.col("since"))).alias("x"), "t", "e").select("x.consumer", "t", "e")


def named(log: DataFrame) -> DataFrame:
    return log.filter(F.col("consumer").isNotNull()).select("consumer").distinct()


class RunFailed(RuntimeError):
    """A run that was told to fail."""


class Reader:
    """Runs of one consumer over a log: each gives the records that are there and that no committed run has given, once.

    The upper bound is fixed when the run starts. What a run takes is written down once; that, its output and the
    watermark are committed by one rename of one manifest file, which names both folders: a run that dies before has
    done nothing, and the next begins where the last success ended. Rows without a commit aren't committed and wait.

    A record is known by ``keys``, by its whole row unless some are given; null is a value like others. Of several rows
    of a record the one of the least commit counts. Records that come late, under a commit below the watermark, are
    taken by the next run, so a run looks at the whole log and at all keys taken. Where the commit of a new record is
    never below those before it and a record's commit never changes, say ``rising``: then runs begin at the watermark.
    """

    def __init__(self, spark: SparkSession, root: str, commit: str = "t", rising: bool = False):
        self.spark, self.root, self.commit, self.rising, self.files = spark, root, commit, rising, Files(spark, root)

    def manifests(self) -> list[dict]:
        done = [n for n in self.files.names(f"{self.root}/_runs") if n.endswith(".json")]
        return [json.loads(self.files.read(f"{self.root}/_runs/{n}")) for n in done]

    def output(self) -> DataFrame | None:
        """All that committed runs gave."""
        paths = [m["path"] for m in self.manifests() if m["path"]]
        return self.spark.read.parquet(*paths) if paths else None

    def run(self, log: DataFrame, work=None, keys: list[str] | None = None, fail: bool = False) -> dict:
        done = self.manifests()
        mark = done[-1]["upto"] if done else None
        upper = log.agg(F.max(self.commit)).first()[0]  # fixed now; what comes later is the next run's
        c = F.col(self.commit)
        batch = log.filter(c <= F.lit(upper)) if upper is not None else log.limit(0)
        given = self.spark.read.parquet(*[m.get("taken", m["path"]) for m in done]) if done else None
        if self.rising and mark is not None:
            # another record may have come at the very mark
            batch, given = batch.filter(c >= F.lit(mark)), given.filter(c >= F.lit(mark))
        keys = keys or log.columns
        rest = sorted(set(log.columns) - set(keys), key=lambda n: (n != self.commit, n))
        row = F.struct(*rest) if rest else F.lit(None)
        marked = batch.select(*keys, F.lit(False).alias("_given"), row.alias("_row"))
        if given is not None:
            marked = marked.unionByName(given.select(*keys, F.lit(True).alias("_given")), allowMissingColumns=True)
        # null keys are a group like others
        fresh = marked.groupBy(*keys).agg(F.max("_given").alias("_given"), F.min("_row").alias("_row")).filter("not _given")
        name = f"{len(done) + 1:08d}-{uuid.uuid4().hex}"
        taken = path = f"{self.root}/taken/{name}"
        fresh.select(*keys, *[F.col("_row")[n].alias(n) for n in rest]).select(*log.columns).write.parquet(taken)
        if work is not None:
            path = f"{self.root}/out/{name}"
            work(self.spark.read.parquet(taken)).write.parquet(path)
        if fail:
            raise RunFailed("the run failed before its commit")
        entry = {"after": mark, "upto": upper if mark is None or (upper is not None and upper > mark) else mark, "path": path, "taken": taken}
        self.files.put(f"{self.root}/_runs/{len(done) + 1:08d}.json", json.dumps(entry))
        return entry


class LogReaders(Reader):
    """Runs on behalf of all consumers that a run log names, on top of what the log says that they took themselves.

    Each consumer has a high watermark in two numbers: the commit up to which it has been served and the instant up to
    which what was available counted. Before the first run they come from the log: a consumer's runs that ended ok. A
    run fixes its upper bounds at the start, gives each consumer what lies above its watermark and what came in late
    below it, and commits output, bounds and the consumers served by one rename of a manifest. A run that dies has done
    nothing; a consumer that the log names only later begins at nothing.
    """

    def served(self) -> DataFrame | None:
        """(consumer, low, high, started): what committed runs have given, in the form of runs."""
        done = self.manifests()
        marks = [self.spark.read.parquet(m["marks"]).select("consumer", F.lit(0).cast("bigint").alias("low"), F.lit(m["upto"] + 1).cast("bigint").alias("high"), F.lit(m["seen"]).cast("bigint").alias("started")) for m in done if m["upto"] is not None]
        return reduce(DataFrame.unionAll, marks).groupBy("consumer").agg(F.max("low").alias("low"), F.max("high").alias("high"), F.max("started").alias("started")) if marks else None

    def catch_up(self, feed: DataFrame, reports: DataFrame, log: DataFrame, fail: bool = False, least: int = LEAST) -> dict:
        """One run over (consumer, t, e), see ``pending``."""
        done, served = self.manifests(), self.served()
        ready = cut(availability(feed, reports))
        upto, seen = ready.agg(F.max("t"), F.max("since")).first()  # fixed now
        consumers = cut(named(log))
        if served is not None and consumers.join(served, "consumer", "left_anti").isEmpty():
            low, instant = served.agg(F.min("high"), F.min("started")).first()
            ready = ready.filter((F.col("t") >= low) | (F.col("since") > instant))
        runs = ended_ok(log) if served is None else ended_ok(log).unionByName(served)
        name = f"{len(done) + 1:08d}-{uuid.uuid4().hex}"
        entry = {"upto": upto, "seen": seen, "path": f"{self.root}/out/{name}", "marks": f"{self.root}/marks/{name}"}
        pending(ready, runs, consumers, least).write.parquet(entry["path"])
        consumers.write.parquet(entry["marks"])
        if fail:
            raise RunFailed("the run failed before its commit")
        self.files.put(f"{self.root}/_runs/{len(done) + 1:08d}.json", json.dumps(entry))
        return entry


def replayed(feed: DataFrame, reports: DataFrame, log: DataFrame, root: str, steps: int = 3) -> DataFrame:
    """(consumer, t, e, a, v, pos, add): what Reader runs over the whole feed give each consumer that the log names.

    The runs are made at ``steps`` instants, the last when everything is available. Each sees what is available by then,
    in the order in which it became so: that never falls, while transactions are received late. The second run fails
    before its commit once and is made again.
    """
    spark = feed.sparkSession
    ready = cut(available(feed, reports))
    names = sorted(r.consumer for r in log.filter(F.col("consumer").isNotNull()).select("consumer").distinct().collect())  # registered readers, not data
    low, high = ready.agg(F.min("since"), F.max("since")).first()
    out = ready.select(F.lit(None).cast("string").alias("consumer"), "*").limit(0)
    for k, name in enumerate(names if low is not None else []):
        reader = Reader(spark, f"{root}/{k}", commit="since", rising=True)
        for i in range(1, steps + 1):
            seen = ready.filter(F.col("since") <= low + (high - low) * i // steps)
            if i == 2:
                try:
                    reader.run(seen, fail=True)
                except RunFailed:
                    pass
            reader.run(seen)
        out = out.unionByName(reader.output().select(F.lit(name).alias("consumer"), "*"))
    return out.drop("since")
