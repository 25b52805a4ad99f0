"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it
back, so a lost executor costs a re-read and never a re-computation of earlier
rounds.  Only in local mode, where that setting is absent, a folder of this process
is used; on a cluster executors would not see it, so the setting is asked for there.
A run's folder is deleted when the driver's file system closes.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

_own_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or in local mode this process's own folder."""
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="ledgergraph-")
        atexit.register(shutil.rmtree, _own_root, ignore_errors=True)
    return f"file://{os.path.abspath(_own_root)}"


#: Rows and bytes of an Arrow batch on its way to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits where they exceed ours: whole texts are
    large rows, and a worker holds several arrays of a batch's size at a time."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(name).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


#: Bytes of a shuffle, as written, that adaptive execution gives one task.
PARTITION_BYTES = 16 << 20


def small_partitions(spark: SparkSession) -> None:
    """Lower what adaptive execution aims to give a task where it exceeds ours: rows sorted
    and grouped in memory take many times their written size."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if now > PARTITION_BYTES:
        spark.conf.set(name, str(PARTITION_BYTES))


def together(spark: SparkSession, *calls: Callable[[], T]) -> list[T]:
    """What the calls give, made side by side: jobs of one fill the cores that small ones
    of another leave."""
    with ThreadPoolExecutor(len(calls)) as pool:
        return [x.result() for x in [pool.submit(inheritable_thread_target(spark)(c)) for c in calls]]


#: Of ledgers and logs that are written whole: ids and texts take about two thirds of the bytes of the default.
CODEC = "zstd"


class Workspace:
    """A folder of its own for one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        small_partitions(spark)
        self.spark = spark
        self.path = f"{shared_root(spark)}/ledgergraph/{name}-{uuid.uuid4().hex}"
        path, files = self._files(self.path)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def folder(self, name: str) -> str:
        """The path of a folder, made if it is not there, that a stream can watch."""
        path, files = self._files(f"{self.path}/{name}")
        files.mkdirs(path)
        return path.toString()

    def cut(self, df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
        """Write ``df``, by the session's codec if none is given, and return the written table."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path, compression=codec)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
        """Write ``df`` in so many buckets of ``by`` and return the written table: joins and
        groupings by ``by`` read it where it lies.  Rows that already lie by ``by`` in as
        many partitions are written where they are; others want a repartition first.

        Buckets need a table's name; it is dropped at once, as the plan that is returned
        knows the files.  A key's rows share a task, so keys of too many belong elsewhere.
        """
        table = f"ledgergraph_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, by).sortBy(by).format("parquet").option("path", f"{self.path}/{name}").saveAsTable(table)
        found = self.spark.table(table)
        self.spark.sql(f"drop table {table}")
        return found

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        path, files = self._files(f"{self.path}/{name}")
        files.delete(path, True)

    def _files(self, name: str):
        """A path, and the file system that holds it."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(context._jsc.hadoopConfiguration())
