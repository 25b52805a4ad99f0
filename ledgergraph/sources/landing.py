"""Loading a folder of raw landing CSV files that can stop and go on.

A file stream is the resume point: a file's rows are stored by the batch that read it,
and a batch whose write failed is written again under its own number.  Lines that do not
fit the types go to a reject table as they stand.  When all files are in, a signature
(version, columns, rows, rejects) is committed last, by a rename; a reader that does not
find it, or finds another one, has no complete load.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workspace import Workspace
from ..plans.fixtures import fixture, fixture_sql

#: The seven raw columns, in their order in the files, under canonical names.
RAW = "from_account bigint, to_account bigint, amount double, currency string, payment_format string, is_laundering int, tx_date date"
VERSION = 1
#: Lines of a file that the test ledger is written as.
FILE_LINES = 500_000
_SIGNATURE = "SIGNATURE.json"


class Landing:
    """A load of CSV files below ``source`` into tables below ``target``."""

    def __init__(self, spark: SparkSession, source: str, target: str, schema: str = RAW):
        self.spark, self.source, self.target, self.schema = spark, source, target, schema
        self.columns = [c.split()[0] for c in schema.split(", ")]

    def run(self, files: int = 1, before: Callable[[int], None] | None = None) -> dict:
        """Load what has not been loaded, ``files`` a batch, and sign; the signature.

        ``before`` is called with a batch's number before it is stored.
        """
        bad = "_line"
        raw = (
            self.spark.readStream.schema(f"{self.schema}, {bad} string").option("header", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", bad).option("maxFilesPerTrigger", files).csv(self.source)
        )

        def store(batch: DataFrame, number: int) -> None:
            if before:
                before(number)
            # both tables need all columns read once, as the line is known only then
            held = batch.persist()
            try:
                held.where(F.col(bad).isNull()).drop(bad).write.mode("overwrite").parquet(f"{self.target}/rows/batch={number}")
                held.where(F.col(bad).isNotNull()).select(bad).write.mode("overwrite").parquet(f"{self.target}/rejects/batch={number}")
            finally:
                held.unpersist()

        query = (
            raw.writeStream.option("checkpointLocation", f"{self.target}/checkpoint").trigger(availableNow=True).foreachBatch(store).start()
        )
        query.awaitTermination()
        return self._sign()

    def _stored(self) -> dict:
        rows = self.spark.read.schema(f"{self.schema}, batch int").parquet(f"{self.target}/rows").count()
        return {"version": VERSION, "columns": self.columns, "rows": rows, "rejects": self.rejects().count()}

    def _at(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.target}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _sign(self) -> dict:
        found = self._stored()
        draft, fs = self._at(f".draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(found, sort_keys=True).encode()))
        out.close()
        final, _ = self._at(_SIGNATURE)
        fs.delete(final, False)
        if not fs.rename(draft, final):
            raise RuntimeError(f"the signature of {self.target} could not be committed")
        return found

    def signature(self) -> dict | None:
        path, fs = self._at(_SIGNATURE)
        return json.loads(self.spark.read.text(path.toString(), wholetext=True).first()[0]) if fs.exists(path) else None

    def rejects(self) -> DataFrame:
        """The lines that do not fit, and their batch."""
        return self.spark.read.schema("_line string, batch int").parquet(f"{self.target}/rejects").withColumnRenamed("_line", "line")

    def rows(self) -> DataFrame:
        """The loaded rows; raises if the load is not complete or not of these columns."""
        found = self.signature()
        if found is None or (found["version"], found["columns"]) != (VERSION, self.columns):
            raise RuntimeError(f"{self.target} holds no complete load of {', '.join(self.columns)}")
        return self.spark.read.schema(f"{self.schema}, batch int").parquet(f"{self.target}/rows").drop("batch")


def src_landing_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw ledger as CSV files with some broken lines, loaded with a stop after the
    first batch: the good rows counted by their columns, and a row that counts the broken
    lines, of accounts -1."""
    work = Workspace(spark, "landing")
    raw = fixture(spark, sf_dir, "raw_landing")
    amount = F.when(F.expr("cast(`Account.1` as bigint) % 50 = 0"), F.lit("n/a")).otherwise(F.col("Amount Paid").cast("string"))
    lines = raw.withColumn("Amount Paid", amount).withColumn("Timestamp", F.date_format("Timestamp", "yyyy-MM-dd"))
    # three batches, of as many files as keep a file's lines within FILE_LINES: a file is read by few tasks
    lines = work.cut(lines, "lines")
    files = max(1, -(-lines.count() // (3 * FILE_LINES)))
    lines.repartition(3 * files).write.option("header", True).csv(f"{work.path}/csv")
    load = Landing(spark, f"{work.path}/csv", f"{work.path}/table")

    def stop(number: int) -> None:
        if number == 1:
            raise InterruptedError("stopped between two batches")

    try:
        load.run(files, before=stop)
    except Exception as error:  # the stream wraps what its sink raises
        if "stopped between two batches" not in str(error):
            raise
    load.run(files)
    good = load.rows().groupBy("from_account", "to_account", "currency", "payment_format", "is_laundering").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double"), 2).alias("amount")
    )
    broken = load.rejects().agg(F.count(F.lit(1)).alias("n"))
    nothing = [F.lit("" if t == "string" else -1).cast(t).alias(c) for c, t in good.drop("n").dtypes]
    return good.unionByName(broken.select(*nothing, "n"))


QUERIES = {"src_landing_resume": src_landing_resume}
COVERS = {"src_landing_resume": "S5 S29"}
SQL = {
    "src_landing_resume": f"""WITH {fixture_sql("{raw_landing}")}
SELECT "Account" AS from_account, "Account.1" AS to_account, "Payment Currency" AS currency, "Payment Format" AS payment_format, "Is Laundering" AS is_laundering,
  count(*) AS n, CAST(sum(CAST("Amount Paid" AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM raw_landing WHERE "Account.1" % 50 <> 0 GROUP BY ALL
UNION ALL SELECT -1, -1, '', '', -1, count(*), -1 FROM raw_landing WHERE "Account.1" % 50 = 0""",
}
