"""Device co-usage over all accounts, against plain Python."""

from collections import defaultdict

from ledgergraph.operators import graph  # noqa: F401
from ledgergraph.plans.catalog import OPERATORS
from ledgergraph.plans.fixtures import fixture

SF = "/root/testdata/sf0.001"


def test_device_cousage_counts_the_union_for_all_accounts(spark):
    on = {1: "ab", 2: "abc", 3: "bc", 4: "c", 5: "d", 6: "ab", 7: "abcd", 50: "e", 51: "e"}
    rows = [(a, dev) for a, devices in on.items() for dev in devices * 2] + [(8, None)]
    tx = spark.createDataFrame(rows, "from_account bigint, device_id string")
    found = {r.account_id: r.sharing for r in OPERATORS["graph_device_cousage"].apply(spark, {"tx": tx}).collect()}
    others = {a: sum(1 for b in on if b != a and set(on[a]) & set(on[b])) for a in on}
    assert found == {a: n for a, n in others.items() if n}


def test_device_cousage_answers_for_every_sending_account(spark):
    own = {(r.from_account, r.device_id) for r in fixture(spark, SF, "tx").select("from_account", "device_id").collect()}
    on = defaultdict(set)
    for a, dev in own:
        on[dev].add(a)
    near = defaultdict(set)
    for a, dev in own:
        near[a] |= on[dev] - {a}
    found = {r.account_id: r.sharing for r in OPERATORS["graph_device_cousage"].query(spark, SF).collect()}
    assert found == {a: len(x) for a, x in near.items() if x}
