"""Plans that read the ledger once, and the bound on what a task is given."""

import pytest

from ledgergraph.functions.workspace import PARTITION_BYTES
from ledgergraph.operators import features, flags, graph, scoring  # noqa: F401  (they register the plans)
from ledgergraph.plans.catalog import OPERATORS

SF = "/root/testdata/sf0.001"


def scans(frame):
    plan = frame._jdf.queryExecution().optimizedPlan()
    return sum("l_orderkey" in n.output().mkString(",") for n in _nodes(plan) if n.children().isEmpty())


@pytest.mark.parametrize("name", ["score_signals", "alerts_stream", "flag_channel_hop", "feat_channel_entropy"])
def test_the_ledger_is_read_once(spark, name):
    assert scans(OPERATORS[name].query(spark, SF)) == 1


@pytest.mark.parametrize("name", ["graph_vertices", "graph_viz_sample", "graph_two_hops", "feat_channel_entropy"])
def test_a_task_is_given_a_bounded_share(spark, name):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "64m")
    OPERATORS[name].query(spark, SF)
    assert int(spark.conf.get(key)) == PARTITION_BYTES
    spark.conf.set(key, "1m")  # a lower one stays
    OPERATORS[name].query(spark, SF)
    assert spark.conf.get(key) == "1m"
    spark.conf.unset(key)


def test_the_ledger_is_narrow_before_its_join(spark):
    """No column of the line that the ledger's own follow from is moved by the join."""
    plan = OPERATORS["graph_viz_sample"].query(spark, SF)._jdf.queryExecution().optimizedPlan()
    joins = [n.output().mkString(",") for n in _nodes(plan) if n.nodeName() == "Join" and "l_orderkey" in n.output().mkString(",")]
    assert joins and not any(c in j for j in joins for c in ("l_returnflag", "l_linestatus", "l_discount"))


def _nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def test_signals_count_no_nulls_and_ties(spark):
    rows = [
        ("t1", 1, 2, "d1", "2024-01-01 10:00:00", None), ("t2", 1, 3, None, "2024-01-01 10:30:00", "judol"), ("t3", 1, None, "d1", "2024-01-01 10:30:00", None),
        ("t4", 2, 1, "d2", "2024-01-01 10:25:00", "qris"), ("t5", None, 1, "d9", "2024-01-01 10:26:00", None), ("t6", 4, 1, "d3", None, None),
    ]
    tx = spark.createDataFrame(rows, "tx_id string, from_account long, to_account long, device_id string, at string, typology string")
    tx = tx.selectExpr("*", "cast(at as timestamp_ntz) as tx_timestamp")
    none = spark.createDataFrame([], "account_id long, risk_score double")
    found = {r.account_id: r for r in OPERATORS["score_signals"].apply(spark, {"tx": tx, "predictions": none}).collect()}
    assert set(found) == {1, 2}  # 4 has no time
    one, two = found[1], found[2]
    assert (one.tx_id, one.fan_out, one.fan_in, one.devices, one.velocity, one.rapid, one.typology) == ("t3", 2, 2, 1, 3, True, "judol")
    assert (two.tx_id, two.fan_out, two.fan_in, two.devices, two.velocity, two.rapid, two.typology) == ("t4", 1, 1, 1, 1, False, "")


def test_hops_of_accounts_of_two_channels_only(spark):
    rows = [("a", 1, 9, "atm", 0), ("b", 1, 9, "qris", 10), ("c", 2, 8, "atm", 0), ("d", 2, 8, "qris", 5), ("e", 2, 8, "teller", 8), ("f", None, 7, "atm", 0)]
    tx = spark.createDataFrame(rows, "tx_id string, from_account long, to_account long, channel string, m int")
    tx = tx.selectExpr("*", "timestampadd(MINUTE, m, timestamp_ntz'2024-01-01 00:00:00') as tx_timestamp", "cast(1 as decimal(18,2)) as amount")
    found = {r.account_id: (r.fastest, r.hops) for r in OPERATORS["flag_channel_hop"].apply(spark, {"tx": tx}).collect()}
    assert found == {1: (600, 1), 9: (600, 1)}
