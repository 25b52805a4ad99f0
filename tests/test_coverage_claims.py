"""Inventory ids are claimed only by queries that build them."""

from ledgergraph.plans import registry


def test_claims_of_the_stream_state():
    claimed = registry.coverage()
    assert claimed["T6"] == claimed["T11"] == ["stream_account_store"] and claimed["T10"] == ["stream_state_replay"]
    assert "stream_account_signals" in claimed["T3"]
    assert claimed["S27"] == ["gen_typologies"]
    assert "stream_account_features" not in claimed["T7"] and "gen_motifs" not in claimed["S27"]
