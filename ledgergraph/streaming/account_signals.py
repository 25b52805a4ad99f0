"""Signals of accounts over a stream of transfers.

Lifetime sets (senders, recipients, devices) are kept as deduplicated pairs, so a
hub's set is spread over the state store and never lies in one row.  Of the transfers
only those are kept that an account's one-hour and ten-minute windows hold, a row each,
in a table that every batch derives from the last one's by joins and groupings alone.
Network features come from a table that a periodic batch job replaces; every
micro-batch reads it anew, and an account that it lacks has zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workspace import Workspace
from ..operators.features import feat_device_sharing, feat_institutions
from ..plans.dialect import DUCK
from ..plans.fixtures import fixture, fixture_sql
from .account_state import RAPID_S, RETENTION_S, VELOCITY_S, offered, rocksdb, run_to_parquet


def endpoints(transfers: DataFrame) -> DataFrame:
    """A row per transfer and end: ``account_id, direction, peer, device_id, ts``; the
    device is its sender's."""
    out = F.struct(F.col("from_account").alias("account_id"), F.lit("OUT").alias("direction"), F.col("to_account").alias("peer"), "device_id")
    into = F.struct(F.col("to_account").alias("account_id"), F.lit("IN").alias("direction"), F.col("from_account").alias("peer"), F.lit(None).cast("string").alias("device_id"))
    return transfers.select("ts", F.explode(F.array(out, into)).alias("e")).select("ts", "e.*")


def seen_items(ends: DataFrame) -> DataFrame:
    """The first row of every account's sender, recipient and device: ``account_id, kind, item``."""
    peer = F.struct(F.when(F.col("direction") == "IN", "sender").otherwise("recipient").alias("kind"), F.col("peer").cast("string").alias("item"))
    device = F.struct(F.lit("device").alias("kind"), F.col("device_id").alias("item"))
    items = ends.select("account_id", F.explode(F.array(peer, device)).alias("i")).select("account_id", "i.*")
    return items.where("item is not null").dropDuplicates(["account_id", "kind", "item"])


def signals(ends: DataFrame) -> DataFrame:
    """What the store of :func:`run_with_network` needs of the ends: ``account_id, into, at``."""
    return ends.select("account_id", (F.col("direction") == "IN").alias("into"), F.col("ts").cast("double").alias("at"))


def _merged(held: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The state after a batch: a row per transfer end that a window of its account still
    holds, with the account's ``last`` time, its count ``n`` and whether the batch touched it.
    A busy account's windows are rows, spread like any others."""
    new = batch.select("account_id", "into", "at", F.lit(0).cast("long").alias("n"), F.lit(True).alias("touched"))
    every = new if held is None else held.select("account_id", "into", "at", "n", F.lit(False).alias("touched")).unionByName(new)
    account = every.groupBy("account_id").agg(
        F.max("at").alias("last"), (F.max("n") + F.count_if("touched")).alias("n"), F.max("touched").alias("touched")
    )
    width = F.when(F.col("into"), RAPID_S).otherwise(VELOCITY_S)
    return every.select("account_id", "into", "at").join(account, "account_id").where(F.col("at") >= F.col("last") - width)


def _signals_of(state: DataFrame) -> DataFrame:
    """``account_id, last_ts, n, velocity_1h, rapid_inout`` of every account that the batch
    touched, as of its last transfer: transfers sent within the hour (ends included), and
    whether money left within ten minutes of its arrival.  ``n`` counts since the state
    last expired."""
    gap = F.max(F.when(~F.col("into"), F.col("at"))) - F.max(F.when(F.col("into"), F.col("at")))
    return state.where("touched").groupBy("account_id").agg(
        F.max("last").alias("last_ts"), F.max("n").alias("n"), F.count_if(~F.col("into")).alias("velocity_1h"),
        F.coalesce(gap.between(0, RAPID_S), F.lit(False)).alias("rapid_inout"),
    )


def run_with_network(updates: DataFrame, work: Workspace, name: str, cache: str) -> DataFrame:
    """Process what is available of :func:`signals`; every batch joins the network features
    that the table at ``cache`` (``account_id, device_sharing_count, n_institutions``) has by then.

    The state is a table that each batch writes anew under its own number from the one
    before, so a batch that runs again finds what it found at first.  Accounts silent for the
    retention time before the watermark are not carried on, and rows before it come too late.
    """
    path = f"{work.path}/{name}"

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = None
        if number:
            held = spark.read.parquet(f"{path}-state/batch={number - 1}")
            newest = held.agg(F.max("last")).first()[0]
            if newest is not None:
                batch = batch.where(F.col("at") >= newest - RETENTION_S)
                held = held.where(F.col("last") >= newest - 2 * RETENTION_S)
        _merged(held, batch).write.mode("overwrite").parquet(f"{path}-state/batch={number}")
        found = _signals_of(spark.read.parquet(f"{path}-state/batch={number}"))
        joined = found.join(spark.read.parquet(cache), "account_id", "left").fillna(0, ["device_sharing_count", "n_institutions"])
        joined.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number > 1:
            work.drop(f"{name}-state/batch={number - 2}")  # a batch may run again, the one before it not

    query = updates.writeStream.option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return work.spark.read.parquet(path)


def network_cache(spark: SparkSession, tx: DataFrame) -> DataFrame:
    """What the periodic job writes: shared devices and institutions per account."""
    shared, places = (op.apply(spark, {"tx": tx}) for op in (feat_device_sharing, feat_institutions))
    return shared.join(places, "account_id", "full_outer").fillna(0)


def replay(spark: SparkSession, latest: DataFrame, transfers: DataFrame) -> DataFrame:
    """Read-only scoring of offered transfers (``tx_id, from_account``): the sender's
    signals as stored; nothing is updated.  An unknown sender has none."""
    return transfers.select("tx_id", F.col("from_account").alias("account_id")).join(latest, "account_id", "left")


def stream_account_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "account-signals")
    tx = work.cut(fixture(spark, sf_dir, "tx"), "tx")
    network = f"{work.path}/network"
    network_cache(spark, tx).write.parquet(network)
    rows = tx.select("tx_id", "from_account", "to_account", "device_id", F.col("tx_timestamp").cast("timestamp").alias("ts"))
    ends = endpoints(spark.readStream.schema(rows.schema).parquet(work.folder("in")))
    kept, seen = signals(ends), seen_items(ends)
    for _ in offered(work, rows, "in"):
        updates = run_with_network(kept, work, "signals", network)
        with rocksdb(spark):
            found = run_to_parquet(seen, work, "items")
    latest = updates.groupBy("account_id").agg(F.max_by(F.struct("*"), "batch").alias("s")).select("s.*")
    items = found.groupBy("account_id").pivot("kind", ["sender", "recipient", "device"]).count()
    return latest.join(items, "account_id").select(
        "account_id", "last_ts", "velocity_1h", "rapid_inout", "device_sharing_count", "n_institutions",
        F.coalesce("sender", F.lit(0)).alias("unique_senders"), F.coalesce("recipient", F.lit(0)).alias("unique_recipients"),
        F.coalesce("device", F.lit(0)).alias("device_count"),
    )


QUERIES = {"stream_account_signals": stream_account_signals}
COVERS = {"stream_account_signals": "T3 T4 T7"}


def _sql() -> str:
    shared, places = (op.build(DUCK).replace("{tx}", "tx") for op in (feat_device_sharing, feat_institutions))
    return f"""WITH {fixture_sql("{tx}")},
  ends AS (SELECT from_account AS account_id, 'OUT' AS side, to_account AS peer, device_id, epoch(tx_timestamp) AS ep FROM tx
    UNION ALL SELECT to_account, 'IN', from_account, NULL, epoch(tx_timestamp) FROM tx),
  late AS (SELECT *, max(ep) OVER (PARTITION BY account_id) AS last FROM ends),
  seen AS (SELECT account_id, max(last) AS last_ts, count(*) FILTER (WHERE side = 'OUT' AND ep >= last - {VELOCITY_S}) AS velocity_1h,
    count(*) FILTER (WHERE side = 'IN' AND ep >= last - {RAPID_S}) AS recent, max(ep) FILTER (WHERE side = 'OUT') AS last_out,
    max(ep) FILTER (WHERE side = 'IN') AS last_in, count(DISTINCT peer) FILTER (WHERE side = 'IN') AS unique_senders,
    count(DISTINCT peer) FILTER (WHERE side = 'OUT') AS unique_recipients, count(DISTINCT device_id) AS device_count FROM late GROUP BY account_id)
SELECT s.account_id, last_ts, velocity_1h, coalesce(recent > 0 AND last_out - last_in BETWEEN 0 AND {RAPID_S}, false) AS rapid_inout,
  coalesce(device_sharing_count, 0) AS device_sharing_count, coalesce(n_institutions, 0) AS n_institutions,
  unique_senders, unique_recipients, device_count
FROM seen s LEFT JOIN ({shared}) d ON s.account_id = d.account_id LEFT JOIN ({places}) p ON s.account_id = p.account_id"""


SQL = {"stream_account_signals": _sql()}
