"""Signals over batches: windows that reach into the batch before, and no Python per account."""

import inspect
from datetime import datetime, timedelta

from ledgergraph.functions.workspace import Workspace
from ledgergraph.streaming import account_signals

SCHEMA = "tx_id string, from_account bigint, to_account bigint, device_id string, ts timestamp"
START = datetime(2025, 3, 1, 9)


def test_windows_are_carried_and_expire(spark):
    work = Workspace(spark, "t-carried")
    spark.createDataFrame([], "account_id bigint, device_sharing_count bigint, n_institutions bigint").write.parquet(f"{work.path}/net")
    ends = account_signals.endpoints(spark.readStream.schema(SCHEMA).parquet(work.folder("in")))
    kept, found = account_signals.signals(ends), []
    for minutes in ((0, 50), (55, 59), (400,), (401,)):
        rows = [(f"t{m}", 5 if m == 400 else 1, 2, "d", START + timedelta(minutes=m)) for m in minutes]
        if 59 in minutes:
            rows.append(("in", 3, 1, "d", START + timedelta(minutes=58)))
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{work.path}/in")
        updates = account_signals.run_with_network(kept, work, "out", f"{work.path}/net")
        found.append({r.account_id: r for r in updates.where(f"batch = {len(found)}").collect()})
    assert 1 not in found[2]  # another account moves the time on
    assert [(b[1].velocity_1h, b[1].rapid_inout, b[1].n) for b in (*found[:2], found[3])] == [(2, False, 2), (4, True, 5), (1, False, 1)]


def test_no_python_by_account():
    source = inspect.getsource(account_signals)
    assert "InPandas" not in source and "transformWith" not in source
