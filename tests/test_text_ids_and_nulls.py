"""Accounts named by texts, stored rows without ids, rules by their defaults, added rules."""

import re

import pytest
from pyspark.sql import functions as F

from ledgergraph.operators import rules
from ledgergraph.plans import registry
from ledgergraph.plans.catalog import OPERATORS
from ledgergraph.plans.dialect import SPARK
from ledgergraph.plans.fixtures import fixture_tables

from .oracle import connect, rows

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()
IDS = {"from_account", "to_account", "account_id", "c_custkey"}
PARAMS = {"ml_edge_encoding": {"text_ids": True}, "ml_negative_samples": {"text_ids": True}, "graph_two_hops": {"seed": "A000000000042"}, "graph_ego_network": {"seed": "A000000000042"}}
NAMES = [
    "alerts_generate", "rule_union_suspects", "rule_cycle_motif", "rule_late_layers", "ml_edge_encoding", "ml_negative_samples", "graph_two_hops", "graph_ego_network",
    "src_accounts_upsert", "graph_ego_rank", "feat_account_table", "ml_standardise", "osint_alerts", "src_demo_collectors", "graph_device_cousage",
]


def named(table):
    return table.select(*[F.concat(F.lit("A"), F.lpad(F.col(c).cast("string"), 12, "0")).alias(c) if c in IDS else F.col(c) for c in table.columns])


def numbers(frame):
    """Names back to numbers, so that rows compare; ids made from names aside."""
    found = frame.drop(columns=[c for c in frame.columns if c == "alert_id"])
    return found.map(lambda x: int(m[1]) if isinstance(x, str) and (m := re.fullmatch(r"A0*(\d+)", x)) else x)


@pytest.mark.parametrize("name", NAMES)
def test_text_ids_give_the_rows_of_numbers(spark, name):
    op = OPERATORS[name]
    tables = {n: named(t) for n, t in fixture_tables(spark, SF, op._fixture_text(SPARK)).items()}
    got = op.apply(spark, tables, **{**op.fixture, **PARAMS.get(name, {})}).toPandas()
    assert rows(numbers(got)) == rows(numbers(connect(SF).execute(SQL[name]).df()))


def test_no_plan_needs_a_null_aware_broadcast(spark):
    for name, op in OPERATORS.items():
        assert not re.search(r"\bnot\s+in\s*\(\s*select\b", op._fixture_text(SPARK), re.I), name
    for name in ("src_insert_ignore", "feat_account_sample", "osint_alerts", "graph_two_hops"):
        plan = OPERATORS[name].query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "isNullAware" not in plan and "LeftAnti, BuildRight, true" not in plan, name


def test_stored_rows_without_ids_hide_nothing(spark):
    tx = spark.createDataFrame([("t1", 1.0), ("t2", 2.0), ("t2", 3.0)], "tx_id string, amount double")
    stored = spark.createDataFrame([(None,), ("t1",)], "tx_id string")
    found = OPERATORS["src_insert_ignore"].apply(spark, {"tx": tx, "alerts": stored}).collect()
    assert [(r.tx_id, r.amount, r.offered) for r in found] == [("t2", 2.0, 2)]


def test_known_accounts_are_not_offered_again(spark):
    tx = spark.sql("select 't' as tx_id, 1L as from_account, 2L as to_account, 'b' as institution_id, timestamp_ntz'2025-01-01 00:00:00' as tx_timestamp")
    known = spark.sql("select 1L as account_id")
    assert [r.account_id for r in OPERATORS["src_accounts_upsert"].apply(spark, {"tx": tx, "known_accounts": known}).collect()] == [2]


def test_alerts_take_the_rules_defaults_and_all_layers():
    text = OPERATORS["alerts_generate"].build(SPARK)
    for name in rules._SUSPECT_RULES:
        assert OPERATORS[name].build(SPARK) in text, name
    assert "amount < 500000 " in text and "senders >= 30" in text and "CYCLE_MOTIF" in text
    assert set(rules.LAYERS) == set(re.findall(r"'([A-Z_]+)' as typology", text))
    own = OPERATORS["alerts_generate"].build(SPARK, rules={"rule_judol_ring": {"min_senders": 9}})
    assert "senders >= 9" in own and "senders >= 30" not in own


LEDGER = [(f"t{i}", a, b, 100.0) for i, (a, b) in enumerate([("x", "y"), ("y", "z"), ("z", "x"), ("x", "q"), ("q", "x")])]


def test_a_registered_rule_is_reported_with_the_others(spark):
    tx = spark.createDataFrame(LEDGER, "tx_id string, from_account string, to_account string, amount double").selectExpr(
        "*", "'atm' as channel", "timestamp_ntz'2025-01-01 10:00:00' as tx_timestamp", "0 as is_laundering"
    )

    def big(ledger, params):
        hits = ledger.where(F.col("amount") >= params.get("least", 50)).select(F.col("from_account").alias("account_id")).distinct()
        return hits.select("account_id", F.lit("big").alias("rule_triggered"), F.lit(0.6).alias("confidence"))

    rules.register_rule("BIG_ONE", "CUSTOM", big)
    try:
        with pytest.raises(ValueError):
            rules.register_rule("BIG_ONE", "CUSTOM", big)
        found = rules.detect(spark, tx).collect()
        assert {r.account_id for r in found if r.typology == "BIG_ONE" and r.layer == "CUSTOM"} == {"x", "y", "z", "q"}
        # x and q send to each other; of these suspects x lies on the cycle x, y, z
        assert {r.account_id for r in found if r.typology == "CYCLE"} == {"x", "q"}
        assert {r.account_id for r in found if r.typology == "CYCLE_MOTIF"} == {"x"}
        assert [r.rule_order for r in found if r.typology == "BIG_ONE"] == [10] * 4
        assert not [r for r in rules.detect(spark, tx, {"BIG_ONE": {"least": 500}}).collect() if r.typology == "BIG_ONE"]
    finally:
        rules.unregister_rule("BIG_ONE")
