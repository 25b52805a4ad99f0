"""SQL twins where the test tables are too small to tell: slow core numbers, many clusters."""

import datetime

import pandas as pd
import pytest

from ledgergraph.operators import iterative

from .oracle import connect, same


def ledger(folder, pairs, illicit=False):
    """Tables of which the ledger view makes a transfer per pair."""
    numbers = range(1, len(pairs) + 1)
    orders = pd.DataFrame({"o_orderkey": numbers, "o_custkey": [a for a, _ in pairs], "o_orderpriority": "1-URGENT", "o_orderstatus": "F"})
    lines = pd.DataFrame({
        "l_orderkey": numbers, "l_linenumber": 1, "l_partkey": [b for _, b in pairs], "l_suppkey": 1, "l_extendedprice": 10.0,
        "l_returnflag": "R", "l_linestatus": "F", "l_discount": 0.1 if illicit else 0.0, "l_shipdate": datetime.date(2025, 1, 1),
    })
    orders.to_parquet(f"{folder}/orders.parquet")
    lines.to_parquet(f"{folder}/lineitem.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["feat_kcore", "graph_active_writeback"])
def test_sql_core_numbers_settle(tmp_path, name):
    """The ends of a chain take its middle down one account a round."""
    found = connect(ledger(tmp_path, [(i, i + 1) for i in range(1, 200)])).execute(iterative.SQL[name]).df()
    assert len(found) == 200 and set(found["kcore_number"]) == {1}


def test_sql_numbers_more_clusters_than_four_digits(spark, tmp_path):
    folder = ledger(tmp_path, [(i, 100_000 + i) for i in range(1, 10_051)], illicit=True)
    wanted = connect(folder).execute(iterative.SQL["graph_clusters"]).df()
    assert wanted["cluster_id"].is_unique and wanted["cluster_id"].str.len().max() == 6
    same(iterative.graph_clusters(spark, folder).toPandas(), wanted)
