"""Stateful streams over a transfer or event log.

Streams are read from staged Parquet files, offered time slice by time slice, and run
until what is available is processed, so a slice is a micro-batch of as many files as
its rows need; the checkpoint and the exactly-once file sink take the place of offset
commits.  Event time drives windows, so a replayed history
gives the results of its first run.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.expressions import NIGHT_HOURS
from ..functions.workspace import CODEC, Workspace

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
#: Seconds of the velocity, rapid in-out and retention windows, and of the dedup time-to-live.
VELOCITY_S, RAPID_S, RETENTION_S, DEDUP_S = 3600, 600, 7200, 86_400


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start herein keep their state in RocksDB: sets of ids outgrow a heap."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def stage_slices(rows: DataFrame, path: str, slices: int = 4) -> None:
    """Write ``rows`` as a file per slice of their ``ts``, in its order: a task writes a
    whole slice, so this is for small logs, and :func:`offered` for others."""
    edges = rows.agg(F.min("ts").cast("double"), F.max("ts").cast("double")).first()
    width = (edges[1] - edges[0]) / slices
    for i in range(slices):
        low, high = edges[0] + i * width, edges[0] + (i + 1) * width
        at = F.col("ts").cast("double")
        part = rows.where((at >= low) & (at < high) if i < slices - 1 else at >= low)  # rounding may leave the last end short
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)


def offered(work: Workspace, rows: DataFrame, name: str, slices: int = 4) -> Iterator[int]:
    """Write ``rows`` below ``name`` slice by slice of their ``ts``, in its order, each by as
    many tasks as it has; a stream that is run after each of them has a slice a batch."""
    path = f"{work.path}/{name}"
    at = F.col("ts").cast("double")
    low, high = rows.agg(F.min(at), F.max(at)).first()
    width = (high - low) / slices
    for i in range(slices):
        begin, end = low + i * width, low + (i + 1) * width
        part = rows.where((at >= begin) & (at < end) if i < slices - 1 else at >= begin)  # rounding may leave the last end short
        part.write.mode("append").parquet(path, compression=CODEC)
        yield i


def _events(events: DataFrame, copies: int = 1) -> DataFrame:
    rows = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("_copy")


def stage(events: DataFrame, path: str, slices: int = 4, copies: int = 1) -> None:
    """Write ``events`` as files in event-time order, each row ``copies`` times; small logs only."""
    stage_slices(_events(events, copies), path, slices)


def read_staged(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def run_to_parquet(stream: DataFrame, work: Workspace, name: str, mode: str = "append", offers: Iterable[int] = (0,)) -> DataFrame:
    """Process what is available, after each of ``offers``, and return the sink as a table."""
    for _ in offers:
        _run_available(stream, work, name, mode)
    return work.spark.read.parquet(f"{work.path}/{name}")


def _run_available(stream: DataFrame, work: Workspace, name: str, mode: str) -> None:
    path = f"{work.path}/{name}"
    writer = stream.writeStream.option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).outputMode("append").start()
    else:  # the table after each batch replaces (complete) or joins (update) the last one

        def sink(df: DataFrame, batch: int) -> None:
            target = path if mode == "complete" else f"{path}/batch={batch}"
            df.write.mode("overwrite").parquet(target)

        query = writer.outputMode(mode).foreachBatch(sink).start()
    query.awaitTermination()


def deduplicated(stream: DataFrame, ttl_s: int = DEDUP_S) -> DataFrame:
    """One row per event id within the time-to-live."""
    return stream.withWatermark("ts", f"{ttl_s} seconds").dropDuplicatesWithinWatermark(["event_id"])


def hourly(stream: DataFrame) -> DataFrame:
    """Tumbling hourly counts by type."""
    return (
        stream.withWatermark("ts", f"{RETENTION_S} seconds")
        .groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.unix_seconds("w.start").alias("start"), "event_type", "n")
    )


def sessions(stream: DataFrame, gap: str = "1 hour") -> DataFrame:
    """Session windows per account."""
    return (
        stream.withWatermark("ts", f"{RETENTION_S} seconds")
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.unix_seconds("w.start").alias("start"), F.unix_seconds("w.end").alias("end"), "user_id", "n")
    )


STATE = "total bigint, amount double, night bigint, largest double, last_ts double, max_gap double, recent string, kinds string"
OUTPUT = (
    "user_id bigint, total bigint, amount double, night bigint, largest double, max_gap double, velocity bigint, channels bigint"
)


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Running counters, longest gap, hourly velocity and channels of one account.

    Rows of a batch are taken in order of event time and id; only the retention
    window's times are kept.
    """
    total, amount, night, largest, last, gap, recent, kinds = (
        state.get if state.exists else (0, 0.0, 0, 0.0, -1.0, 0.0, "", "")
    )
    times = [float(x) for x in recent.split(",") if x]
    names = set(kinds.split(",")) - {""}
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    for ts, value, kind in zip(rows["ts"], rows["value"], rows["event_type"], strict=True):
        at = ts.timestamp()
        total, amount, largest = total + 1, amount + value, max(largest, value)
        night += ts.hour in NIGHT_HOURS
        if last >= 0:
            gap = max(gap, at - last)
        last = max(last, at)
        times.append(at)
        names.add(kind)
    times = [t for t in times if t > last - RETENTION_S]
    state.update((int(total), float(amount), int(night), float(largest), last, gap, ",".join(map(repr, times)), ",".join(sorted(names))))
    velocity = sum(t > last - VELOCITY_S for t in times)
    yield pd.DataFrame(
        [(key[0], total, amount, night, largest, gap, velocity, len(names))], columns=[c.split()[0] for c in OUTPUT.split(", ")]
    )


def account_features(stream: DataFrame) -> DataFrame:
    """The features of every account after each batch that touches it (update mode)."""
    return stream.groupBy("user_id").applyInPandasWithState(_update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def latest(updates: DataFrame) -> DataFrame:
    """The last update of each account: totals only grow."""
    return updates.groupBy("user_id").agg(F.max_by(F.struct("*"), "total").alias("s")).select("s.*")


def _staged(spark: SparkSession, sf_dir: str, name: str, copies: int = 1) -> tuple[Workspace, DataFrame]:
    work = Workspace(spark, name)
    stage(spark.read.parquet(f"{sf_dir}/events.parquet"), f"{work.path}/in", copies=copies)
    return work, read_staged(spark, f"{work.path}/in")


def offered_events(spark: SparkSession, sf_dir: str, name: str, copies: int = 1, slices: int = 4) -> tuple[Workspace, DataFrame, Iterator[int]]:
    """The events as a stream, and the offers that fill it."""
    work = Workspace(spark, name)
    offers = offered(work, _events(spark.read.parquet(f"{sf_dir}/events.parquet"), copies), "in", slices)
    return work, spark.readStream.schema(EVENT_SCHEMA).parquet(work.folder("in")), offers


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, stream, offers = offered_events(spark, sf_dir, "stream-dedup", copies=2)
    return run_to_parquet(deduplicated(stream).select("event_id", "user_id", "event_type", "value"), work, "out", offers=offers)


def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, stream, offers = offered_events(spark, sf_dir, "stream-hourly")
    return run_to_parquet(hourly(stream), work, "out", "complete", offers)


def stream_account_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, stream, offers = offered_events(spark, sf_dir, "stream-state")
    found = latest(run_to_parquet(account_features(stream), work, "out", "update", offers).drop("batch"))
    return found.withColumn("amount", F.round("amount", 4)).withColumn("max_gap", F.round("max_gap", 3))


QUERIES = {
    "stream_dedup": stream_dedup,
    "stream_hourly": stream_hourly,
    "stream_account_features": stream_account_features,
}
COVERS = {
    "stream_dedup": "T1 M9", "stream_hourly": "T14", "stream_account_features": "T5 T13 M11 E16",
}
SQL = {
    "stream_dedup": "SELECT DISTINCT event_id, user_id, event_type, value FROM events",
    "stream_hourly": "SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_account_features": """
WITH g AS (SELECT user_id, event_type, value, ts, epoch(ts) AS ep, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap,
    max(epoch(ts)) OVER (PARTITION BY user_id) AS last FROM events)
SELECT user_id, count(*) AS total, cast(round(cast(sum(cast(value AS DECIMAL(18,6))) AS DECIMAL(38,6)), 4) AS DOUBLE) AS amount,
  count(*) FILTER (WHERE hour(ts) IN (22, 23, 0, 1, 2, 3)) AS night, max(value) AS largest, round(max(gap), 3) AS max_gap,
  count(*) FILTER (WHERE ep > last - 3600) AS velocity, count(DISTINCT event_type) AS channels
FROM g GROUP BY user_id""",
}
