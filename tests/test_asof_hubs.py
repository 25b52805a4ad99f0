"""As-of neighbours of hubs, which go apart, and of the other accounts."""

import random
from datetime import datetime, timedelta

import pytest

from ledgergraph.plans.catalog import OPERATORS
from ledgergraph.plans.dialect import SPARK

from .test_asof_neighbours import plain


@pytest.mark.parametrize("hub_rows", [0, 30, 1000])
def test_asof_neighbours_of_hubs_and_others(spark, hub_rows):
    """Accounts on both sides of the bound: repeated rows, transfers to oneself, no account."""
    rng, start, rows = random.Random(9), datetime(2025, 3, 1), []
    for i in range(120):
        rows.append((f"t{i // 2:03d}", rng.choice([0, 0, 0, 1, 2, 3, 4]), rng.randrange(7), start + timedelta(seconds=rng.randrange(60))))
    rows += [rows[5], rows[6], ("self", 2, 2, start + timedelta(seconds=20))]
    tx = spark.createDataFrame([*rows, ("none", None, None, start), ("timeless", 0, 1, None)], "tx_id string, from_account bigint, to_account bigint, tx_timestamp timestamp_ntz")
    found = OPERATORS["graph_asof_neighbours"].apply(spark, {"tx": tx}, k=3, bucket_s=10, hub_rows=hub_rows).collect()
    assert sorted((r.tx_id, r.side, r.node, r.peers, r.edges, r.ages, r["mask"]) for r in found) == plain(rows, 3)


def test_asof_histories_of_ordinary_accounts_do_not_move(spark):
    """Beside the ids of hubs, a single exchange: the ends by their account."""
    from ledgergraph.operators.graph import graph_asof_neighbours

    tx = spark.range(100).selectExpr("'t' || id as tx_id", "id % 7 as from_account", "id % 5 as to_account", "timestamp_seconds(id)::timestamp_ntz as tx_timestamp")
    text = graph_asof_neighbours.build(SPARK)
    only = text[: text.index("placed as (")].rstrip().rstrip(",") + text[text.index("\nselect e.tx_id") : text.rindex("\nunion all\nselect e.tx_id")]
    plan = spark.sql(only, tx=tx)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window ") == 2 and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
