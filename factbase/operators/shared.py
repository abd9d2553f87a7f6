"""The shared folder: lineage cuts and tables that outlive an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where that is unset and driver and executors are one process, a temporary folder; on a cluster that is an error, as
    every machine has its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if root is None and jsc.getCheckpointDir().isDefined():
        root = jsc.getCheckpointDir().get()
    if root is None:
        if not jsc.isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='factbase-')}"
        atexit.register(shutil.rmtree, root[7:], ignore_errors=True)
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; what is there is dropped when the driver ends."""
    path = f"{shared_root(spark).rstrip('/')}/factbase/{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_drop, spark)
    _scratch.append(path)
    return path


_scratch: list[str] = []


def _drop(spark: SparkSession) -> None:
    try:
        hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _scratch:
            hadoop(path).getFileSystem(conf).delete(hadoop(path), True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder: no lineage, and no copy that dies with an executor."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
