"""Network columns of accounts that a batch job refreshes while a stream reads them.

A refresh writes a new version and then moves a pointer file to it, so a reader that
resolves the pointer (every micro-batch does) sees one whole version.  Versions are
never changed; a batch that runs again after a failure reads what is current then.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ("device_sharing_count", "n_institutions", "pagerank", "kcore_number")


class NetworkCache:
    """``key`` and double columns, at a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, key: T.DataType, columns: tuple[str, ...] = COLUMNS):
        self.spark, self.path, self.columns = spark, path, columns
        self.schema = T.StructType([T.StructField("account_id", key)] + [T.StructField(c, T.DoubleType()) for c in columns])
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self._conf)

    def current(self) -> str | None:
        """The version that the pointer names."""
        path, files = self._at("CURRENT")
        return self.spark.read.text(path.toString()).first()[0] if files.exists(path) else None

    def read(self) -> DataFrame:
        """The current version; no rows before the first."""
        version = self.current()
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{version}")

    def refresh(self, active: DataFrame, sources: Mapping[str, DataFrame | None]) -> str:
        """Publish a version of the accounts of ``active`` (``account_id``), no others.

        A column whose source (``account_id`` and the column) is there is written anew,
        0 for accounts that it lacks; a column without a source keeps its old values.
        """
        old = self.read()
        found = active.select("account_id").where("account_id is not null").distinct().join(old, "account_id", "left")
        for c in self.columns:
            source = sources.get(c)
            if source is not None:
                found = found.drop(c).join(source.select("account_id", F.col(c).cast("double").alias(c)), "account_id", "left")
        version = f"v-{uuid.uuid4().hex}"
        found.select("account_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in self.columns]).write.parquet(f"{self.path}/{version}")
        self._point(version)
        return version

    def _point(self, version: str) -> None:
        draft, files = self._at(f".CURRENT-{version}")
        out = files.create(draft)
        out.write(bytearray(version.encode()))
        out.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        context.rename(draft, self._at("CURRENT")[0], options)
