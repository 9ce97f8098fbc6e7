"""Intermediate tables in the shared folder: written and read back, so that lost executors cost no recomputation."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The driver's garbage is collected when its heap has taken more than this share of what it may, and not more often than
#: every so many seconds.
HEAP_SHARE, EVERY_S = 0.5, 10
#: How tables are written to a local file system: without checksum files (Parquet has its own) and _SUCCESS. Where Hadoop
#: has no native library, it starts a process for each file and folder to set its permissions, and a process being started
#: still shares all memory of the JVM that starts it.
LOCAL = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def _delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system, wherever it is; nothing happens if it is gone."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001 - the session may be over, and its folder with it
        pass


def folder(spark: SparkSession) -> str:
    """A folder of this session's own, removed at its end: in spark.checkpoint.dir, where set; else a temporary one in
    single-process local mode, or one in the shared warehouse."""
    sc = spark.sparkContext
    if getattr(sc, "_cloneloom_scratch", None):
        return sc._cloneloom_scratch
    shared = sc.getConf().get("spark.checkpoint.dir")
    if shared:
        base = shared.rstrip("/")
    elif sc.master.startswith("local") and "cluster" not in sc.master:
        base = "file://" + tempfile.gettempdir()
    else:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    sc._cloneloom_scratch = f"{base}/cloneloom-{uuid.uuid4().hex}"
    atexit.register(_at_exit, spark, sc._cloneloom_scratch)
    return sc._cloneloom_scratch


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Within it, what a job shuffled is deleted when the job ends, rather than when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _local(spark: SparkSession, path: str) -> str | None:
    """The path without its scheme, if it is in a local file system."""
    sc = spark.sparkContext
    uri = sc._jvm.org.apache.hadoop.fs.Path(path).toUri()
    scheme = uri.getScheme() or sc._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(sc._jsc.hadoopConfiguration()).getScheme()
    return uri.getPath() if scheme == "file" else None


def relieve(spark: SparkSession) -> None:
    """Let the driver's JVM drop garbage, with the shuffles and broadcasts that nothing refers to, and shrink its heap, which
    would otherwise grow to its limit over many short jobs of which little remains."""
    sc = spark.sparkContext
    now = time.monotonic()
    if now - getattr(sc, "_cloneloom_relieved", -EVERY_S) < EVERY_S:
        return
    heap = sc._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > HEAP_SHARE * heap.maxMemory():
        gc.collect()  # Python's references keep Java's objects
        sc._jvm.java.lang.System.gc()
        sc._cloneloom_relieved = time.monotonic()


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df written as Parquet to the session's folder and read back, which ends its lineage."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    schema = df.schema
    write = df.write.option("compression", compression)
    local = _local(df.sparkSession, path)
    if local:
        Path(local, "_temporary/0/_temporary").mkdir(parents=True)  # the committer's folders, made without processes
        write = write.options(**LOCAL).mode("append")
    write.parquet(path)
    relieve(df.sparkSession)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that cut wrote, and of which all that was derived has been written in turn."""
    for t in tables:
        path = getattr(t, "_scratch_path", None)
        if path:
            _delete(t.sparkSession, path)
