"""Intermediate tables in the folder that the cluster shares.

A stage whose result is read more than once is written as Parquet and read
again.  The written files cut the lineage, so a lost executor costs only the
tasks it ran, and nothing lives on a single machine's disk.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
_OPEN = threading.local()  # lists of what was written by calls that are still running
_WHERE: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()  # tables that were written, by the DataFrames that read them


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Where that is unset, a session
    on one machine, as in tests, takes a temporary folder that is made once; on a
    cluster no folder of one machine would do, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _FALLBACK:
        _FALLBACK["dir"] = tempfile.mkdtemp(prefix="echoframe-")
    return _FALLBACK["dir"]


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once under the shared folder and return it as read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    for written in getattr(_OPEN, "calls", []):
        written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WHERE[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` returned and that nothing will read again;
    other DataFrames are left alone."""
    for df in tables:
        path = _WHERE.pop(df, None)
        if path is not None:
            for calls in getattr(_OPEN, "calls", []):
                if path in calls:
                    calls.remove(path)
            remove(df.sparkSession, path)


def settled(spark: SparkSession, made: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that ``made`` returns, written; what was written on the way to it is
    removed.  Tables that were there before stay."""
    if not hasattr(_OPEN, "calls"):
        _OPEN.calls = []
    _OPEN.calls.append([])
    try:
        out = made()
    finally:
        written = _OPEN.calls.pop()
    out = materialize(out, name)
    for path in written:
        for calls in _OPEN.calls:
            if path in calls:
                calls.remove(path)
        remove(spark, path)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Remove a table that was written here."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the stored tables under ``sf_dir``.  A table of fewer parts than there
    are cores, such as a single small file, is dealt out over all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
