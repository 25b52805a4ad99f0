"""The store over tables: no Python an account, state carried over batches, versions that stay."""

import inspect
from datetime import datetime, timedelta

from pyspark.sql import types as T

from ledgergraph.functions.workspace import Workspace
from ledgergraph.streaming import account_store
from ledgergraph.streaming.network_cache import NetworkCache

SCHEMA = "tx_id string, from_account bigint, to_account bigint, amount decimal(18,2), channel string, device_id string, ts timestamp"
START = datetime(2025, 3, 1, 9)


def test_no_python_call_an_account():
    source = "".join(map(inspect.getsource, (account_store.StoreRun, account_store.batch_sums, account_store.batch_items)))
    assert "states(" not in source.replace(":func:`states`", "") and "InPandas" not in source and "Processor" not in source


def test_state_is_carried_and_versions_stay(spark):
    from decimal import Decimal

    work = Workspace(spark, "t-tables")
    run = account_store.StoreRun(work, T._parse_datatype_string(SCHEMA), NetworkCache(spark, f"{work.path}/net", T.LongType()))
    tx = lambda i, a, b, m, c="atm": (f"t{i}", a, b, Decimal(10 * i), c, "d", START + timedelta(minutes=m))
    offers = [[tx(1, 1, 2, 0), tx(2, 1, 2, 50)], [tx(3, 1, 3, 70, "qris"), tx(4, 9, 8, 71)], [tx(5, 2, 1, 75), tx(6, 1, 2, 40)]]
    for rows in offers:
        run.offer(spark.createDataFrame(rows, SCHEMA))
    first, second, third = ({r.account_id: r for r in run.stored(i).collect()} for i in run.batches)
    assert (first[1].out_n, first[1].recipients, first[1].max_gap) == (2, 1, 50 * 60_000_000) and 9 not in first
    assert (second[1].recipients, second[1].by_channel) == (2, {"atm": 2, "qris": 1}) and second[2] == first[2]  # untouched, kept
    # peers had before count once more in no batch; a late transfer takes no part in the last time
    assert (third[1].out_n, third[1].in_n, third[1].recipients, third[1].senders, third[1].devices) == (4, 1, 2, 1, 1)
    assert third[1].last_ts - third[1].last_out == 5 * 60_000_000 and len(third[1].newest) == 4 and third[1].newest == sorted(third[1].newest)
    seconds = {i: run.stored_seconds(i).where("account_id = 1").agg({"n": "sum"}).first()[0] for i in run.batches}
    assert seconds == {run.batches[0]: 2, run.batches[1]: 2, run.batches[2]: 3}  # an hour, both ends included
    touched = spark.read.parquet(f"{run.output}/batch={run.batches[1]}")
    assert {r.account_id for r in touched.collect()} == {1, 3, 9, 8}
