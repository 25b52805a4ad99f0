"""The ledger that a plan of many uses gets written has the columns that the plan names."""

import pytest

from ledgergraph.plans import fixtures, registry
from ledgergraph.plans.catalog import OPERATORS
from ledgergraph.plans.dialect import SPARK

registry.queries()  # loads the plans
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["rule_cycle_motif", "alerts_generate", "graph_asof_neighbours"])
def test_only_named_columns_are_written(spark, name):
    found = fixtures.fixture_tables(spark, SF, OPERATORS[name]._fixture_text(SPARK))["tx"]
    assert {"from_account", "to_account", "tx_timestamp"} <= set(found.columns)
    assert not {"currency", "payment_format", "institution_id"} & set(found.columns)
    assert ("tx_id" in found.columns) == (name != "rule_cycle_motif")


def test_a_plan_that_takes_all_gets_all(spark):
    tx = fixtures.fixture(spark, SF, "tx")
    assert fixtures.named_columns(tx, "select * from {tx}").columns == tx.columns
    assert fixtures.named_columns(tx, "select count(*) as n from {tx}").columns == tx.columns[:1]
    assert "typology" in fixtures.named_columns(tx, "select alert_id from {alerts}").columns  # named by a view
