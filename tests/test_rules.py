"""Hand-computed cases on the edges of predicates."""

from datetime import datetime

import pytest

from ledgergraph.operators import features, flags, iterative, rules, scoring  # noqa: F401
from ledgergraph.plans.catalog import OPERATORS

COLUMNS = "tx_id string, from_account bigint, to_account bigint, amount decimal(18,2), currency string, channel string, payment_format string, tx_timestamp timestamp_ntz, device_id string, institution_id string, is_laundering int, typology string"


def ledger(spark, *rows):
    from decimal import Decimal

    full = [
        (f"T{i}", a, b, Decimal(str(amount)), "IDR", channel, "x", ts, f"D{a}", "BANK_1", bad, None)
        for i, (a, b, amount, ts, channel, bad) in enumerate(rows)
    ]
    return {"tx": spark.createDataFrame(full, COLUMNS)}


def at(hour, minute=0, second=0, day=1):
    return datetime(2025, 3, day, hour, minute, second)


def test_night_window_of_features_is_22_to_3(spark):
    tx = ledger(spark, *[(1, 2, 10, at(h), "atm", 0) for h in (21, 22, 23, 0, 3, 4)])
    row = OPERATORS["feat_incoming"].apply(spark, tx).first()
    assert row.in_night == 4


def test_night_window_of_flags_is_0_to_4(spark):
    tx = ledger(spark, *[(1, 2, 10, at(h), "atm", 0) for h in (23, 0, 4, 5)])
    found = {r.account_id: r.hits for r in OPERATORS["flag_timing"].apply(spark, tx).collect()}
    assert found == {1: 2, 2: 2}


@pytest.mark.parametrize("amount,hit", [(424_999, False), (425_000, True), (499_999, True), (499_999.5, False)])
def test_structuring_rule_bands_are_closed(spark, amount, hit):
    tx = ledger(spark, *[(1, 2, amount, at(10, i), "atm", 0) for i in range(3)])
    assert (OPERATORS["rule_structuring"].apply(spark, tx).count() == 1) == hit


@pytest.mark.parametrize("amount,share", [(9_500, 1.0), (9_999.99, 1.0), (10_000, 0.0)])
def test_structuring_score_bands_are_half_open(spark, amount, share):
    tx = ledger(spark, (1, 2, amount, at(10), "atm", 0))
    assert OPERATORS["feat_outgoing"].apply(spark, tx).first().structuring_score == share


def test_burst_window_is_closed_and_single_transfers_have_none(spark):
    tx = ledger(spark, (1, 2, 5, at(10), "atm", 0), (1, 3, 5, at(11), "atm", 0), (1, 4, 5, at(13), "atm", 0))
    found = {r.account_id: r for r in OPERATORS["feat_temporal"].apply(spark, tx).collect()}
    assert found[1].burst_ratio == pytest.approx(2 / 3) and found[1].dormancy_days == 7200 / 86400
    assert found[2].burst_ratio == found[2].inter_tx_std == found[2].dormancy_days == 0


def test_frequency_hour_is_open_at_its_end(spark):
    tx = ledger(spark, (1, 2, 5, at(10), "atm", 0), (1, 2, 5, at(10, 59, 59), "atm", 0), (1, 2, 5, at(11), "atm", 0))
    found = OPERATORS["flag_frequency"].apply(spark, tx, min_hits=2).collect()
    assert {r.peak for r in found} == {2}


def test_rapid_cashout_of_the_flag_fixture(spark):
    rows = [(2, 9, a, at(2, 30 + m), c, 0) for a, m, c in ((4_990_000, 0, "qris"), (4_980_000, 5, "t"), (4_970_000, 10, "atm"), (4_960_000, 15, "m"))]
    rows += [(1, 2, 5_000_000, at(2, 50), "t", 0), (2, 3, 4_900_000, at(2, 53), "qris", 0)]
    rows += [(2, 8, 100_000, at(2, 55), "qris", 0), (2, 8, 100_000, at(3, 0), "qris", 0), (2, 8, 100_000, at(3, 5), "t", 0), (2, 8, 100_000, at(3, 10), "atm", 0)]
    tx = ledger(spark, *rows)
    cash = {r.account_id: r for r in OPERATORS["flag_rapid_cashout"].apply(spark, tx).collect()}
    assert (cash[2].events, cash[2].fastest) == (3, 180)
    hits = {(r.account_id, r.lim): r.hits for r in OPERATORS["flag_structuring"].apply(spark, tx).collect()}
    assert hits[(2, 5_000_000)] == 5
    assert {r.account_id: r.peak for r in OPERATORS["flag_frequency"].apply(spark, tx).collect()}[2] == 10
    assert 2 in {r.account_id for r in OPERATORS["flag_channel_switch"].apply(spark, tx).collect()}


def test_self_transfer_counts_on_both_sides(spark):
    row = OPERATORS["feat_account_table"].apply(spark, ledger(spark, (1, 1, 5, at(10), "atm", 1))).first()
    assert (row.in_degree, row.out_degree, row.total_tx, row.is_laundering_label) == (1, 1, 2, 1)


def test_device_pool_of_21_is_left_out(spark):
    from ledgergraph.operators.features import feat_device_sharing

    tx = ledger(spark, *[(i, 100, 5, at(1), "atm", 0) for i in range(21)])["tx"]
    shared = tx.selectExpr(*[c if c != "device_id" else "'D' as device_id" for c in tx.columns])
    # the cut-off keeps all rows, since they share one time
    assert feat_device_sharing.apply(spark, {"tx": shared}).count() == 0
    assert {r.device_sharing_count for r in feat_device_sharing.apply(spark, {"tx": shared.where("from_account < 20")}).collect()} == {19}


def test_components_and_risk_of_the_graph_fixture(spark):
    rows = [(1, 2, 4_900_000, at(1), "x", 1), (2, 3, 4_800_000, at(2), "x", 1), (3, 4, 4_700_000, at(3), "x", 1), (4, 5, 4_600_000, at(4), "x", 0), (1, 5, 3_000_000, at(5), "x", 1), (10, 11, 200_000, at(6), "x", 0)]
    found = iterative.clusters(spark, ledger(spark, *rows)["tx"]).collect()
    assert [(r.cluster_id, r["size"], r.illicit_edges, r.risk_level) for r in found] == [("C0001", 5, 4, "MEDIUM")]


def test_pagerank_sums_to_one_and_kcore_counts_self_loops(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (7, 7)], "src bigint, dst bigint")
    ranks = {r.account_id: r.pagerank for r in iterative.pagerank(spark, pairs, rounds=20).collect()}
    assert sum(ranks.values()) == pytest.approx(1, abs=1e-9)
    core = {r.account_id: r.kcore_number for r in iterative.kcore(spark, pairs).collect()}
    assert core == {1: 2, 2: 2, 3: 2, 4: 1, 7: 1}


@pytest.mark.parametrize("score,levels", [(0.5, ("MEDIUM", "LOW", "LOW", "MEDIUM")), (0.8, ("HIGH", "MEDIUM", "MEDIUM", "MEDIUM")), (0.85, ("HIGH", "HIGH", "HIGH", "HIGH"))])
def test_level_scales_differ_on_their_edges(spark, score, levels):
    from ledgergraph.functions import expressions as e

    x = f"{score}e0"
    row = spark.sql(f"select {e.severity(x)} a, {e.level_binned(x)} b, {e.level_ensemble(x)} c, {e.level_stream(x)} d").first()
    assert tuple(row) == levels
