"""Every registered query of the library against its SQL."""

import pytest

from ledgergraph.plans import registry
from ledgergraph.plans.catalog import OPERATORS

from .oracle import connect, same

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: Empty on the smallest tables, and checked at larger ones by the driver.
MAY_BE_EMPTY = {"flag_rapid_cashout", "flag_frequency", "rule_qris_ring", "rule_judol_ring", "rule_cycle_motif", "graph_clusters", "graph_cluster_detail", "graph_cluster_drawing"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    same(got, connect(SF).execute(SQL[name]).df())
    assert len(got) or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() or name in MAY_BE_EMPTY


def test_every_plan_says_what_it_covers():
    assert all(op.covers and op.doc for op in OPERATORS.values())


def test_parameters_override_defaults(spark):
    from ledgergraph.plans.fixtures import fixture_tables

    tables = fixture_tables(spark, SF, "{tx}")
    few = OPERATORS["rule_fan_out"].apply(spark, tables, min_recipients=30).count()
    many = OPERATORS["rule_fan_out"].apply(spark, tables, min_recipients=1, min_tx=1).count()
    assert few < many
