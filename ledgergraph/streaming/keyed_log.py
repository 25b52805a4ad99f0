"""Transfers as keyed JSON events: a log's writer, its reader, and a sink that commits.

A log has a ``key`` (the sender, so an account's transfers stay in one partition and in
order) and a ``value`` (the transfer as JSON).  Structured Streaming commits a batch's
offsets to the checkpoint only after its sink has returned, so a batch that failed is
offered again; the sink replaces a batch by its number, which makes that harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workspace import CODEC, Workspace
from ..plans.fixtures import fixture, fixture_sql
from .account_state import DEDUP_S, offered, rocksdb

LOG_SCHEMA = "key string, value string"
EVENT = (
    "tx_id string, from_account string, to_account string, amount double, currency string, channel string, payment_format string, "
    "tx_timestamp string, device_id string, institution_id string, is_laundering int, typology string"
)
#: A batch is due at this many events or after this many seconds, and takes
#: at most so many times as many; the rest waits for the next one.
FLUSH_EVENTS, FLUSH_S, MOST_FLUSHES = 100, 5, 20


def to_events(tx: DataFrame) -> DataFrame:
    """``key, value, ts`` of transfers; nulls are written, absent senders have an empty key."""
    fields = [f.split()[0] for f in EVENT.split(", ")]
    typed = {"amount": "double", "is_laundering": "int"}
    columns = [F.col(c).cast(typed.get(c, "string")).alias(c) for c in fields]
    return tx.select(
        F.coalesce(F.col("from_account").cast("string"), F.lit("")).alias("key"),
        F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"),
        F.col("tx_timestamp").cast("timestamp").alias("ts"),
    )


def _read(log: DataFrame) -> DataFrame:
    event = F.from_json(F.col("value").cast("string"), EVENT)
    read = log.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), event.alias("e"))
    return read.withColumn("ts", F.try_to_timestamp("e.tx_timestamp").cast("timestamp"))


def parsed(log: DataFrame) -> DataFrame:
    """The events' fields and ``ts``; events without an id or a time are left out."""
    return _read(log).where("e.tx_id is not null and ts is not null").select("e.*", "ts")


def unreadable(log: DataFrame) -> DataFrame:
    """``key, value`` of the events that :func:`parsed` leaves out."""
    return _read(log).where("e.tx_id is null or ts is null").select("key", "value")


def claimed(events: DataFrame, ttl_s: int = DEDUP_S) -> DataFrame:
    """The first event of each ``tx_id`` within the time-to-live; what comes later than
    that after the newest event is a repeat of an expired claim and is dropped."""
    return events.withWatermark("ts", f"{ttl_s} seconds").dropDuplicatesWithinWatermark(["tx_id"])


def read_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The log of a topic from its start, in batches by size and time."""
    return (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("startingOffsets", "earliest").option("minOffsetsPerTrigger", FLUSH_EVENTS).option("maxTriggerDelay", f"{FLUSH_S}s")
        .option("maxOffsetsPerTrigger", FLUSH_EVENTS * MOST_FLUSHES).load()
    )


def write_kafka(events: DataFrame, servers: str, topic: str) -> None:
    """Append ``key, value`` to a topic, acknowledged by all replicas."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.retries": "3"}
    events.select("key", "value").write.format("kafka").options(**options).save()


def read_log(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """The log in a folder of Parquet files, at most ``files`` a batch, oldest first."""
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files).parquet(path)


def commit_to(events: DataFrame, path: str, once: bool = True) -> DataFrame:
    """Write every batch below ``path`` and return the table; with ``once`` what is
    available is processed, else a batch starts every few seconds until stopped."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}", compression=CODEC)

    writer = events.writeStream.outputMode("append").option("checkpointLocation", f"{path}-checkpoint").foreachBatch(sink)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{FLUSH_S} seconds")
    with rocksdb(events.sparkSession):
        writer.start().awaitTermination()
    return events.sparkSession.read.schema(events.schema).parquet(path)


def stream_json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "json-events")
    # the test ledger uses some ids twice; its earliest transfer of an id is offered
    first = F.min_by(F.struct("*"), F.struct("tx_timestamp", "amount")).alias("t")
    tx = fixture(spark, sf_dir, "tx").groupBy("tx_id").agg(first).select("t.*")
    # the transfers are written and not their texts, which are several times as long
    log = to_events(work.cut(tx, "transfers", CODEC))
    broken = log.select("key", F.expr("substring(value, 1, 20)").alias("value"), "ts")
    read = parsed(spark.readStream.schema(LOG_SCHEMA).parquet(work.folder("log")))
    events = claimed(read.drop("payment_format", "institution_id"))  # what is not asked for does not move
    for _ in offered(work, log.unionByName(log).unionByName(broken), "log", slices=3):
        found = commit_to(events, f"{work.path}/out")
    return found.drop("ts", "batch")


QUERIES = {"stream_json_events": stream_json_events}
COVERS = {"stream_json_events": "S17 S18 S23 T1 T12"}
SQL = {
    "stream_json_events": f"""WITH {fixture_sql("{tx}")}
SELECT tx_id, CAST(from_account AS VARCHAR) AS from_account, CAST(to_account AS VARCHAR) AS to_account, CAST(amount AS DOUBLE) AS amount,
  currency, channel, CAST(tx_timestamp AS VARCHAR) AS tx_timestamp, device_id, is_laundering, typology FROM tx
QUALIFY row_number() OVER (PARTITION BY tx_id ORDER BY tx_timestamp, amount) = 1""",
}
