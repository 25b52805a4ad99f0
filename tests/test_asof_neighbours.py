"""As-of neighbours against a plain scan: ties, hubs over many buckets, empty histories."""

import random
from datetime import datetime, timedelta

import pytest

from ledgergraph.plans.catalog import OPERATORS


def plain(rows, k):
    out = []
    for tx_id, a, b, at in rows:
        for side, node in (("SRC", a), ("DST", b)):
            past = []
            for other, x, y, t in rows:
                if t < at:
                    past += [(t, other, y)] if x == node else []
                    past += [(t, other, x)] if y == node else []
            past = sorted(past, reverse=True)[:k]
            out.append((tx_id, side, node, ",".join(str(p[2]) for p in past), ",".join(p[1] for p in past), ",".join(str(int((at - p[0]).total_seconds())) for p in past), "1" * len(past) + "0" * (k - len(past))))
    return sorted(out)


@pytest.mark.parametrize(("k", "bucket"), [(1, 60), (3, 10), (5, 3600)])
def test_asof_neighbours_are_the_latest_before(spark, k, bucket):
    rng, start, rows = random.Random(k), datetime(2025, 3, 1), []
    for i in range(160):
        a = 0 if i % 3 else rng.randrange(6)  # a hub
        rows.append((f"t{i:03d}", a, rng.randrange(9), start + timedelta(seconds=rng.choice([rng.randrange(40), rng.randrange(4000)]))))
    tx = spark.createDataFrame(rows, "tx_id string, from_account bigint, to_account bigint, tx_timestamp timestamp_ntz")
    found = OPERATORS["graph_asof_neighbours"].apply(spark, {"tx": tx}, k=k, bucket_s=bucket).collect()
    assert sorted((r.tx_id, r.side, r.node, r.peers, r.edges, r.ages, r["mask"]) for r in found) == plain(rows, k)


def test_asof_plan_has_no_self_join_of_transfers(spark):
    tx = spark.createDataFrame([], "tx_id string, from_account string, to_account string, tx_timestamp timestamp_ntz")
    found = OPERATORS["graph_asof_neighbours"].apply(spark, {"tx": tx})
    assert found.count() == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 2 and "Cartesian" not in plan
