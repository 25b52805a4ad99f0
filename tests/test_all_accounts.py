"""Whole-table operators answer for every account and transfer."""

import pytest

from ledgergraph.operators import features, graph, scoring  # noqa: F401
from ledgergraph.plans.catalog import OPERATORS
from ledgergraph.plans.fixtures import fixture

SF = "/root/testdata/sf0.001"


def test_a_negative_for_every_transfer(spark):
    want = {r.tx_id for r in fixture(spark, SF, "tx").select("tx_id").collect()}
    assert {r.tx_id for r in OPERATORS["ml_negative_samples"].query(spark, SF).select("tx_id").collect()} == want


@pytest.mark.parametrize("name, column", [("graph_ego_rank", "seed"), ("graph_temporal_neighbours", "node")])
def test_a_row_for_every_account(spark, name, column):
    tx = fixture(spark, SF, "tx")
    if column == "node":
        cut = tx.selectExpr("avg(unix_timestamp(cast(tx_timestamp as timestamp))) as m").first()["m"]
        tx = tx.where(f"unix_timestamp(cast(tx_timestamp as timestamp)) <= floor({cut!r})")
    else:
        tx = tx.where("from_account <> to_account")
    want = {x for r in tx.select("from_account", "to_account").collect() for x in r}
    assert {r[0] for r in OPERATORS[name].query(spark, SF).select(column).distinct().collect()} == want


def test_incoming_of_takes_its_ids_from_the_table(spark):
    tables = {"tx": fixture(spark, SF, "tx"), "customer": spark.createDataFrame([(1,), (7,), (8,)], "c_custkey bigint")}
    found = {r.account_id for r in OPERATORS["feat_incoming_of"].apply(spark, tables).collect()}
    assert found == {r[0] for r in tables["tx"].where("to_account in (1, 7, 8)").select("to_account").distinct().collect()}
    assert 1 in found or 8 in found
