"""A bucketed copy-on-write table of facts, to which deliveries of a change feed are applied.

Rows are (e, a, v, la, lr), see ``fact_state``; a row's bucket is a hash of its key (e, a, v). ``apply`` routes a
delivery to buckets, sort-merges it with the present files of the buckets it touches and no others, writes replacement
files and commits by renaming a new manifest into place. A reader holds to the manifest it began with. A run that dies
leaves files no manifest names. Since rows merge by maximum, a delivery that is repeated, late or out of order changes
nothing it shouldn't, and applying it again after a failure is safe.
"""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .datoms import POS, facts, fact_state, live

KEY = ["e", "a", "v"]
SCHEMA = f"e bigint, a string, v string, la {POS}, lr {POS}"


class Files:
    """Small files in any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, path: str) -> str:
        s = self.fs.open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8")
        finally:
            s.close()

    def put(self, path: str, text: str) -> None:
        """Write beside, then rename: the file is there whole or not at all, and never replaces another."""
        beside = self.path(f"{path}.{uuid.uuid4().hex}.part")
        out = self.fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(self.path(path)) or not self.fs.rename(beside, self.path(path)):
            self.fs.delete(beside, False)
            raise RuntimeError(f"another writer committed {path} first")

    def drop(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


TARGET = 256 << 20  # bytes of files that a bucket should have; at twice that much the table gets more of them
MOST = 100_000  # buckets, Spark's own limit
FOLDERS = 8  # folders that the touched buckets of one merge may lie in before the whole table is written anew


class FactTable:
    """root: a folder all executors reach. buckets: how many; by default as many as shuffles have partitions, more for a large first delivery.

    Folders are written by Spark's own bucketing, so the merge of a delivery with the buckets it touches is a sort-merge
    join in which neither side is shuffled. A table that has grown gets more buckets with the next delivery.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark, self.root, self.files = spark, root, Files(spark, root)
        self.version, self.entry = 0, {"buckets": buckets, "at": {}}
        done = [n for n in self.files.names(f"{root}/_manifest") if n.endswith(".json")]
        if done:
            self.version = int(done[-1].split(".")[0])
            self.entry = json.loads(self.files.read(f"{root}/_manifest/{done[-1]}"))

    @property
    def buckets(self) -> int:
        return self.entry["buckets"]

    def _write(self, rows: DataFrame, kind: str, buckets: int) -> str:
        """Write rows into a new bucketed folder, sorted by key."""
        name = f"{self.version + 1:08d}-{uuid.uuid4().hex}"  # no other writer has this folder
        path, view = f"{self.root}/{kind}/{name}", f"factbase_{name.replace('-', '_')}"
        rows.write.format("parquet").bucketBy(buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(view)
        self.spark.sql(f"drop table {view}")  # the name only; the files stay
        return path

    def _folder(self, path: str, buckets: int) -> DataFrame:
        """A folder as a bucketed scan."""
        view = f"factbase_{uuid.uuid4().hex}"
        self.spark.sql(f"create table {view} ({SCHEMA}) using parquet clustered by ({', '.join(KEY)}) sorted by ({', '.join(KEY)}) into {buckets} buckets location '{path}'")
        df = self.spark.table(view)
        df.schema  # noqa: B018 - resolved before the name goes
        self.spark.sql(f"drop table {view}")
        return df

    def _held(self, path: str) -> list[str]:
        """The buckets that a folder has files of, told by their names."""
        found = {m.group(1) for n in self.files.names(path) if (m := re.search(r"_(\d+)\.c\d+\.", n))}
        return sorted(str(int(b)) for b in found)

    def _of(self, path: str, buckets: set[str]) -> DataFrame:
        """The rows of a folder that are in the buckets."""
        df = self._folder(path, self.buckets)
        if buckets >= set(self._held(path)):
            return df
        return df.filter(F.pmod(F.hash(*KEY), F.lit(self.buckets)).isin(sorted(map(int, buckets))))

    def _folders(self, buckets: set[str] | None = None) -> dict[str, set[str]]:
        """The folders of the present files, each with the buckets, of those given, that it holds."""
        out: dict[str, set[str]] = {}
        for b, path in self.entry["at"].items():
            if buckets is None or b in buckets:
                out.setdefault(path, set()).add(b)
        return out

    def _read(self) -> list[DataFrame]:
        return [self._of(path, mine) for path, mine in self._folders().items()]

    def _bytes(self, paths) -> int:
        return sum(self.files.fs.getContentSummary(self.files.path(p)).getLength() for p in paths)

    def apply(self, delivery: DataFrame) -> "FactTable":
        """Merge one delivery of the feed. An empty delivery commits nothing."""
        if self.buckets is None:
            size = int(str(delivery._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            size = size if size < 1 << 60 else 0  # not known
            self.entry["buckets"] = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), min(MOST, -(-size // TARGET)))
        buckets = self.buckets
        changes = fact_state(facts(delivery))
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != buckets:
            changes = changes.repartition(buckets, *KEY)
        routed = self._write(changes, "delta", buckets)
        touched = set(self._held(routed))
        if not touched:
            return self
        base = self._folders(touched)
        path = routed
        if len(base) > FOLDERS or self._bytes(set(self.entry["at"].values())) > 2 * TARGET * buckets:
            # the whole table, into folders anew and as many buckets as it needs
            total = self._bytes({*self.entry["at"].values(), routed})
            fresh = max(buckets, min(MOST, -(-total // TARGET)))
            every = reduce(DataFrame.unionAll, [*self._read(), self._folder(routed, buckets)])
            merged = every.repartition(fresh, *KEY).groupBy(*KEY).agg(F.max("la").alias("la"), F.max("lr").alias("lr"))
            buckets, path = fresh, self._write(merged, "data", fresh)
            at = {}
        else:
            at = dict(self.entry["at"])
            if base:
                # a bucket lies in one folder, so its part of the delivery meets that folder's rows and no others
                merged = [self._of(routed, touched - set().union(*base.values()))]
                for folder, mine in base.items():
                    old = self._of(folder, mine).withColumnsRenamed({"la": "_la", "lr": "_lr"}).hint("merge")
                    both = self._of(routed, mine).join(old, KEY, "full")
                    merged.append(both.select(*KEY, F.greatest("la", "_la").alias("la"), F.greatest("lr", "_lr").alias("lr")))
                merged = merged if touched - set().union(*base.values()) else merged[1:]
                path = self._write(reduce(DataFrame.unionAll, merged), "data", buckets)
        version, entry = self.version + 1, {"buckets": buckets, "at": {**at, **{b: path for b in self._held(path)}}}
        self.files.put(f"{self.root}/_manifest/{version:08d}.json", json.dumps(entry))
        if path != routed:
            self.files.drop(routed)
        self.version, self.entry = version, entry
        return self

    def state(self) -> DataFrame:
        parts = self._read()
        return reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], SCHEMA)

    def live(self, many: list[str]) -> DataFrame:
        """(e, a, v) that hold now."""
        return live(self.state(), many).select("e", "a", "v")

    def vacuum(self) -> None:
        """Drop the folders that the present manifest doesn't name. Only when no reader holds an older one."""
        keep = set(self.entry["at"].values())
        for kind in ("data", "delta"):
            for n in self.files.names(f"{self.root}/{kind}"):
                if f"{self.root}/{kind}/{n}" not in keep:
                    self.files.drop(f"{self.root}/{kind}/{n}")


def rebuilt(feed: DataFrame, root: str, deliveries: int = 2) -> FactTable:
    """A new table at ``root`` with the whole feed applied, in ``deliveries`` parts by feed_no (null feed_no with the first)."""
    spark = feed.sparkSession
    low, high = feed.agg(F.min("feed_no"), F.max("feed_no")).first()
    out = FactTable(spark, root)
    if low is None:
        return out.apply(feed)
    step = (high - low) // deliveries + 1
    part = F.coalesce(F.floor((F.col("feed_no") - low) / step), F.lit(0))
    for i in range(deliveries):
        out.apply(feed.filter(part == i))
    return out
