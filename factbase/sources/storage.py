"""Where a connection keeps its log."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..db import LOG
from ..operators.cow import Files
from ..schema import Entity


class Storage(Protocol):
    def load(self, spark: SparkSession) -> DataFrame | None: ...

    def append(self, datoms: DataFrame, tx: int) -> None: ...

    def close(self) -> None: ...


class MemoryStorage:
    """Keeps nothing."""

    def load(self, spark):
        return None

    def append(self, datoms, tx):
        pass

    def close(self):
        pass


class ParquetStorage:
    """One folder of Parquet files for each transaction, ``tx=N``. A commit is the folder's rename into place.

    Reading filters on tx touch only the folders wanted; what a writer that died left under _writing is never read. Every
    ``every`` transactions the log so far is written once more into a few files, ``upto=N``, so a reader plans one such
    folder and the transactions after it, however long the log is. The single folders stay for streams that haven't
    come so far; ``vacuum`` drops them.
    """

    def __init__(self, path: str, every: int = 256):
        self.path, self.every = path, every

    def _parts(self, spark: SparkSession) -> tuple[int, list[int]]:
        """The transaction up to which the log is compacted, and those after it."""
        names = Files(spark, self.path).names(self.path)
        done = max((int(n[5:]) for n in names if n.startswith("upto=")), default=-1)
        return done, sorted(tx for n in names if n.startswith("tx=") and (tx := int(n[3:])) > done)

    def load(self, spark: SparkSession) -> DataFrame | None:
        done, later = self._parts(spark)
        parts = [spark.read.schema(LOG).parquet(f"{self.path}/upto={done}")] if done >= 0 else []
        if later:
            parts.append(spark.read.schema(LOG).option("basePath", self.path).parquet(*[f"{self.path}/tx={tx}" for tx in later]).select(*LOG.names))
        return reduce(DataFrame.unionAll, parts) if parts else None

    def append(self, datoms: DataFrame, tx: int) -> None:
        spark = datoms.sparkSession
        _commit(Files(spark, self.path), self.path, f"tx={tx}", lambda to: datoms.select(*[n for n in LOG.names if n != "tx"]).write.parquet(to))
        if len(self._parts(spark)[1]) >= self.every:
            self.compact(spark)

    def compact(self, spark: SparkSession) -> None:
        """Write the log so far into one folder, in order of tx, so that filters on it skip row groups."""
        _, later = self._parts(spark)
        if later:
            log = self.load(spark)
            _commit(Files(spark, self.path), self.path, f"upto={later[-1]}", lambda to: log.repartitionByRange("tx").sortWithinPartitions("tx", "seq").write.parquet(to))

    def vacuum(self, spark: SparkSession) -> None:
        """Drop what the latest compacted folder holds. Only when no stream or reader is behind it."""
        files, (done, _) = Files(spark, self.path), self._parts(spark)
        for n in files.names(self.path):
            if n.startswith("tx=") and int(n[3:]) <= done or n.startswith("upto=") and int(n[5:]) < done:
                files.drop(f"{self.path}/{n}")

    def close(self) -> None:
        pass


def _commit(files: Files, root: str, name: str, write: Callable[[str], None]) -> None:
    """Write beside, in a folder that no other writer has, then rename; of two writers of one name the second fails."""
    own = f"{name}-{uuid.uuid4().hex}"
    beside, to = f"{root}/_writing/{own}", f"{root}/{name}"
    write(beside)
    done = not files.fs.exists(files.path(to)) and files.fs.rename(files.path(beside), files.path(to))
    # a folder that came into being meanwhile takes ours in, in some file systems
    if not done or files.fs.exists(files.path(f"{to}/{own}")):
        files.drop(f"{to}/{own}")
        files.drop(beside)
        raise RuntimeError(f"{name} is already stored")


def _escaped(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _plain(c: Column) -> Column:
    """Text without escapes: what stands between doubled backslashes has only those of the blanks."""
    part = F.split(c, r"\\\\", -1)
    for a, b in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
        part = _replaced(part, a, b)
    return F.when(F.contains(c, F.lit("\\")), F.array_join(part, "\\")).otherwise(c)


def _replaced(parts: Column, a: str, b: str) -> Column:
    return F.transform(parts, lambda x: F.replace(x, F.lit(a), F.lit(b)))


# The letters that tell a stored value's kind.
TAGS = {T.LongType: "l", T.IntegerType: "i", T.DoubleType: "d", T.BooleanType: "b", T.DecimalType: "D", T.DateType: "i", T.TimestampType: "l"}


def _tag(t: T.DataType) -> str:
    return "v" if isinstance(t, (T.ArrayType, T.StructType)) else TAGS.get(type(t), "s")


def _parts(x) -> str:
    """A value with parts: each as its kind, its length, a colon and its text; records as name, value, name, value."""
    items = [y for pair in x.items() for y in pair] if isinstance(x, dict) else x
    out = []
    for y in items:
        kind, text = ("v", _parts(y)) if isinstance(y, (list, dict)) else ("b", "true" if y else "false") if isinstance(y, bool) else ("l", str(y)) if isinstance(y, int) else ("d", repr(y)) if isinstance(y, float) else ("s", y or "")
        out.append(f"{kind}{len(text)}:{text}")
    return "".join(out)


def _whole(s: str) -> list:
    out, i = [], 0
    while i < len(s):
        colon = s.index(":", i)
        end = colon + 1 + int(s[i + 1 : colon])
        text = s[colon + 1 : end]
        out.append({"v": _whole, "b": lambda x: x == "true", "l": int, "i": int, "d": float}.get(s[i], str)(text))
        i = end
    return out


def _formed(t: T.DataType, x):
    """A parsed value back in the form that the log has for its type."""
    if isinstance(t, T.ArrayType):
        return [_formed(t.elementType, y) for y in x]
    if isinstance(t, T.StructType):
        given = dict(zip(x[::2], x[1::2]))
        return {f.name: _formed(f.dataType, given[f.name]) for f in t.fields if f.name in given}
    return x


class TsvStorage:
    """Lines of eid, attribute, kind, value, transaction, epoch milliseconds and sign, tabs between them.

    For logs that are exchanged with other tools; a transaction is a folder of text files. The entities tell the kinds.
    """

    def __init__(self, path: str, entities: list[Entity]):
        self.path, self.entities = path, entities
        self.types = {f.attr: (T.LongType() if f.ref else f.form.spark) for e in entities for f in e.fields.values()}

    def _map(self, values: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("attr")]

    def lines(self, datoms: DataFrame) -> DataFrame:
        tag = F.coalesce(self._map({a: _tag(t) for a, t in self.types.items()}), F.lit("s"))
        days = self._map({a: type(t).__name__ for a, t in self.types.items()})

        @F.pandas_udf("string")
        def parts(v: pd.Series) -> pd.Series:
            return v.map(lambda x: _parts(json.loads(x)))

        value = F.when(tag == "v", _escaped(parts(F.when(tag == "v", F.col("v")).otherwise("[]")))).when(days == "DateType", F.unix_date(F.col("v").try_cast("date")).cast("string")).when(days == "TimestampType", F.floor(F.col("v").try_cast("bigint") / 1000).cast("string")).otherwise(_escaped(F.col("v")))
        millis = F.coalesce(F.unix_millis("time"), F.lit(0))
        return datoms.orderBy("tx", "seq").select(F.concat_ws("\t", F.col("eid").cast("string"), _escaped(F.col("attr")), tag, value, F.col("tx").cast("string"), millis.cast("string"), "op").alias("value"))

    def append(self, datoms: DataFrame, tx: int) -> None:
        _commit(Files(datoms.sparkSession, self.path), self.path, f"{tx:012d}", self.lines(datoms).write.text)

    def load(self, spark: SparkSession) -> DataFrame | None:
        names = [n for n in Files(spark, self.path).names(self.path) if n[:1].isdigit()]
        return self.parsed(spark.read.text([f"{self.path}/{n}" for n in names])) if names else None

    def parsed(self, lines: DataFrame) -> DataFrame:
        """The log from its lines; a line without seven parts or with another sign is an error.

        Lines have no seq: they count in the order in which they were written, by number of the part file, start of the
        split and place in it. Spark numbers the rows of a task from 0, whatever splits it was given, so numbers rise in a
        split; a line has more bytes than a task can have lines before it, so they don't reach those of the next split.
        """
        p = F.split("value", "\t")
        part = lambda i: F.element_at(p, i + 1)
        types = {a: t.json() for a, t in self.types.items() if _tag(t) == "v"}

        @F.pandas_udf("string")
        def whole(attr: pd.Series, v: pd.Series) -> pd.Series:
            forms = {a: T._parse_datatype_json_string(t) for a, t in types.items()}
            return pd.Series([json.dumps(_formed(forms[a], _whole(x)) if a in forms else _whole(x), separators=(",", ":"), ensure_ascii=False) for a, x in zip(attr, v)])

        file = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("bigint")
        inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        at = F.coalesce(file, F.lit(0)) * (1 << 40) + F.col("_metadata.file_block_start") + inside
        good = (F.size(p) == 7) & part(6).isin("+", "-")
        rows = lines.select(F.when(good, p).otherwise(F.raise_error(F.concat(F.lit("malformed line: "), F.col("value")))).alias("p"), at.alias("at"))
        rows = rows.select(*[F.element_at("p", i + 1).alias(n) for i, n in enumerate(["eid", "attr", "tag", "raw", "tx", "millis", "op"])], "at").withColumn("attr", _plain(F.col("attr")))
        kind = self._map({a: type(t).__name__ for a, t in self.types.items()})
        text = _plain(F.col("raw"))
        v = F.when(F.col("tag") == "v", whole("attr", F.when(F.col("tag") == "v", text).otherwise(""))).when(kind == "DateType", F.date_from_unix_date(F.col("raw").try_cast("int")).cast("string")).when(kind == "TimestampType", (F.col("raw").try_cast("bigint") * 1000).cast("string")).otherwise(text)
        return rows.select(F.col("eid").cast("bigint").alias("eid"), "attr", v.alias("v"), F.col("tx").cast("bigint").alias("tx"), F.col("at").alias("seq"), F.timestamp_millis(F.col("millis").cast("bigint")).alias("time"), "op")

    def close(self) -> None:
        pass
