"""Registered flags read an account's 500 newest transfers."""

from ledgergraph.operators import flags  # noqa: F401
from ledgergraph.plans.catalog import OPERATORS

from .test_rules import at, ledger


def registered(spark, name, rows):
    found = OPERATORS[name].apply(spark, ledger(spark, *rows), **OPERATORS[name].fixture).collect()
    return {r.account_id: r for r in found}


def test_channel_hop_sees_more_than_two_transfers(spark):
    # account 1 hops after ten minutes, then stays on one channel; account 3's third channel is its oldest
    rows = [(1, 2, 5, at(10), "atm", 0), (1, 2, 5, at(10, 10), "qris", 0), (1, 2, 5, at(15), "qris", 0), (1, 2, 5, at(20), "qris", 0)]
    rows += [(3, 4, 5, at(9), "teller", 0), (3, 5, 5, at(10), "atm", 0), (3, 6, 5, at(10, 5), "qris", 0)]
    rows += [(7, 8, 5, at(10), "atm", 0), (7, 8, 5, at(10, 30), "qris", 0)]  # not within half an hour
    found = registered(spark, "flag_channel_hop", rows)
    assert set(found) == {1, 2} and found[1].fastest == 600 and found[1].hops == 1


def test_incident_amounts_hold_500_transfers(spark):
    found = registered(spark, "flag_incident_amounts", [(1, 2, 1, at(i // 60, i % 60), "atm", 0) for i in range(520)])
    assert found[1].n == 500 and found[1].amount_involved == 500
