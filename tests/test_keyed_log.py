"""Keyed JSON events: round trip, repeats, unreadable events, and expiry of memories."""

from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from ledgergraph.functions.workspace import Workspace
from ledgergraph.streaming import keyed_log, node_memory
from ledgergraph.streaming.account_state import stage_slices

TX = (
    "tx_id string, from_account string, to_account string, amount decimal(18,2), currency string, channel string, payment_format string, "
    "tx_timestamp timestamp_ntz, device_id string, institution_id string, is_laundering int, typology string"
)


def transfers(spark, *rows):
    return spark.createDataFrame([(i, a, b, None, "IDR", "atm", None, at, None, "B", 0, None) for i, a, b, at in rows], TX)


def test_events_keep_nulls_and_keys(spark):
    tx = transfers(spark, ("T1", "A", "B", datetime(2025, 1, 1, 9)), ("T2", None, "B", datetime(2025, 1, 1, 10)))
    log = keyed_log.to_events(tx)
    assert {r.key for r in log.collect()} == {"A", ""}
    back = keyed_log.parsed(log).select("tx_id", "from_account", "to_account")
    assert {tuple(r) for r in back.collect()} == {("T1", "A", "B"), ("T2", None, "B")}


def test_what_does_not_read_is_told_apart(spark):
    rows = [("A", '{"tx_id":"T1","tx_timestamp":"2025-01-01 09:00:00","more":1}'), ("A", '{"tx_id":"T2"'), ("A", None), ("A", "[]"),
            ("A", '{"tx_id":"T3","tx_timestamp":"soon"}'), (None, '{"tx_timestamp":"2025-01-01 09:00:00"}')]
    log = spark.createDataFrame(rows, keyed_log.LOG_SCHEMA)
    assert [r.tx_id for r in keyed_log.parsed(log).collect()] == ["T1"]
    assert keyed_log.unreadable(log).count() == 5
    kafka = log.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    assert keyed_log.parsed(kafka).count() == 1


def test_an_offered_again_log_changes_nothing(spark):
    work = Workspace(spark, "t-log")
    log = keyed_log.to_events(transfers(spark, ("T1", "A", "B", datetime(2025, 1, 1, 9)), ("T2", "A", "C", datetime(2025, 1, 1, 10)))).drop("ts")
    counts = []
    for _ in range(3):  # the same events once more, then the stream goes on from its checkpoint
        log.coalesce(1).write.mode("append").parquet(f"{work.path}/log")
        counts.append(keyed_log.commit_to(keyed_log.claimed(keyed_log.parsed(keyed_log.read_log(spark, f"{work.path}/log"))), f"{work.path}/out").count())
    assert counts == [2, 2, 2]


def test_an_idle_memory_starts_anew():
    def rows(*days):
        return pd.DataFrame({"event_id": range(len(days)), "user_id": 1, "ts": [pd.Timestamp("2025-01-01") + pd.Timedelta(days=d) for d in days],
                             "value": 5.0, "event_type": "click"})

    first, kept, anew = (node_memory._replay(rows(*d), node_memory.np.zeros(node_memory.DIM), -1.0)[0] for d in ((0,), (0, 30), (0, 31)))
    assert anew[1][2] == first[0][2] != kept[1][2]


def test_slices_lose_no_row(spark):
    for k in (1, 2, 3, 7, 11):
        work = Workspace(spark, "t-slices")
        rows = spark.range(50).select(F.timestamp_micros(F.col("id") * 86_399_999_983 + 1_700_000_000_123_457).alias("ts"))
        stage_slices(rows, f"{work.path}/in", k)
        assert spark.read.parquet(f"{work.path}/in").count() == 50
