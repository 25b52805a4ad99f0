"""The online account store: batches in any cut, hubs, stored state, and its network cache."""

import math
import random
from datetime import datetime, timedelta

from pyspark.sql import types as T

from ledgergraph.functions.workspace import Workspace
from ledgergraph.operators.features import FEATURE_COLUMNS
from ledgergraph.streaming.account_store import INLINE_ITEMS, StoreRun
from ledgergraph.streaming.network_cache import COLUMNS, NetworkCache

SCHEMA = "tx_id string, from_account string, to_account string, amount decimal(18,2), channel string, device_id string, ts timestamp"
START = datetime(2025, 3, 15, 9, 0)


def transfers(n=400, seed=1):
    """A hub that sends to far more accounts than its value holds, null fields, equal times."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        sender = "hub" if i % 2 else f"a{rng.randrange(5)}"
        at = START + timedelta(seconds=30 * (i // 2) + rng.randrange(20))
        rows.append((f"t{i}", sender, f"r{rng.randrange(3 * INLINE_ITEMS)}", round(rng.uniform(1, 99999), 2), rng.choice(["atm", "qris", None]), rng.choice(["d1", "d2", "", None]), at))
    rows += [("n1", None, "r0", 5.0, "atm", None, START), ("n2", "a0", "a0", 10000.0, "atm", None, START), ("n3", "a1", "a2", 9999.0, "atm", None, None)]
    from decimal import Decimal

    return [(*r[:3], Decimal(str(r[3])), *r[4:]) for r in rows]


def plain(rows, account):
    out = sorted((r for r in rows if r[1] == account and r[6]), key=lambda r: r[6])
    into = [r for r in rows if r[2] == account and r[6]]
    every = sorted(r[6] for r in [*out, *into])
    last = every[-1]
    sent = [r[6].timestamp() for r in out][-20:]
    gaps = [b - a for a, b in zip(sent, sent[1:])]
    mean = sum(gaps) / len(gaps) if gaps else 0
    counts = {}
    for r in [*out, *into]:
        counts[r[4] or "unknown"] = counts.get(r[4] or "unknown", 0) + 1
    hour = sum(r[6] >= last - timedelta(seconds=3600) for r in out)
    return {
        "in_degree": len(into), "out_degree": len(out), "unique_recipients": len({r[2] for r in out}), "unique_senders": len({r[1] for r in into if r[1]}),
        "out_amount_sum": float(sum(r[3] for r in out)), "max_single_tx": float(max(r[3] for r in [*out, *into])), "velocity_1h": hour,
        "burst_ratio": hour / len(every), "inter_tx_std": math.sqrt(sum((g - mean) ** 2 for g in gaps) / len(gaps)) if gaps else 0.0,
        "dormancy_days": max([(b - a).total_seconds() for a, b in zip(every, every[1:])], default=0) / 86400,
        "channel_entropy": -sum(n / len(every) * math.log2(n / len(every) + 1e-12) for n in counts.values()),
        "device_count": len({r[5] for r in [*out, *into] if r[5]}),
    }


def test_store_over_batches_equals_the_whole_history(spark):
    rows = transfers()
    frame = spark.createDataFrame(rows, SCHEMA)
    work = Workspace(spark, "store-test")
    cache = NetworkCache(spark, f"{work.path}/network", T.StringType())
    run = StoreRun(work, frame.schema, cache)
    cut = START + timedelta(seconds=3000)
    early, late = [r for r in rows if not r[6] or r[6] < cut], [r for r in rows if r[6] and r[6] >= cut]
    run.offer(spark.createDataFrame(early, SCHEMA))
    cache.refresh(spark.createDataFrame([("hub",)], "account_id string"), {"pagerank": spark.createDataFrame([("hub", 0.5)], "account_id string, pagerank double")})
    run.offer(spark.createDataFrame(late, SCHEMA))
    found = {r.account_id: r for r in run.latest().collect()}
    assert set(FEATURE_COLUMNS) < set(run.latest().columns)
    assert None not in found and set(found) == {x for r in rows if r[6] for x in r[1:3] if x}
    for account in ("hub", "a0", "a3", "r0", "r7"):
        for name, value in plain(rows, account).items():
            assert math.isclose(found[account][name], value, rel_tol=1e-9, abs_tol=1e-9), (account, name)
    assert found["hub"].unique_recipients > INLINE_ITEMS
    # the second version is seen by the second batch alone
    assert found["hub"].pagerank == 0.5
    first = spark.read.parquet(f"{run.output}/batch={run.batches[0]}").where("account_id = 'hub'").first()
    assert first.pagerank == 0.0 and first.out_degree == sum(r[1] == "hub" for r in early)
    # stored state as of the first batch, though the second has been processed
    stored = {r.account_id: r for r in run.stored(run.batches[0]).collect()}
    assert stored["hub"].out_n == first.out_degree and stored["hub"].recipients == len({r[2] for r in early if r[1] == "hub"})
    offered = spark.createDataFrame([("x", "hub", cut), ("y", "nobody", cut)], "tx_id string, from_account string, ts timestamp")
    asked = {r.tx_id: r for r in run.replay(offered, run.batches[0]).collect()}
    assert asked["x"].velocity_1h == sum(r[1] == "hub" and r[6] >= cut - timedelta(seconds=3600) for r in early if r[6])
    assert asked["x"].known and not asked["y"].known and asked["y"].total_tx == 0


def test_cache_versions(spark):
    work = Workspace(spark, "cache-test")
    cache = NetworkCache(spark, f"{work.path}/cache", T.LongType())
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "account_id bigint")
    values = lambda c, **kv: spark.createDataFrame([(int(k[1:]), v) for k, v in kv.items()], f"account_id bigint, {c} double")
    assert cache.current() is None and cache.read().count() == 0
    first = cache.refresh(ids(1, 2, 3), {"pagerank": values("pagerank", a1=0.1, a2=0.2), "kcore_number": values("kcore_number", a3=4.0)})
    held = cache.read()
    second = cache.refresh(ids(2, 3, 3, 4), {"pagerank": values("pagerank", a3=0.7), "kcore_number": None})
    assert cache.current() == second != first
    # pruned, overwritten with 0, kept
    rows = {r.account_id: (r.pagerank, r.kcore_number, r.n_institutions) for r in cache.read().collect()}
    assert rows == {2: (0.0, 0.0, 0.0), 3: (0.7, 4.0, 0.0), 4: (0.0, 0.0, 0.0)}
    # a reader of the old version still has it
    assert {r.account_id for r in held.collect()} == {1, 2, 3} and held.columns == ["account_id", *COLUMNS]
