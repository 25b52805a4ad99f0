"""Two-hop sampled means against a plain version, with a hub."""

import hashlib
import math
import random

from ledgergraph.plans.catalog import OPERATORS


def test_sampled_hops_against_a_plain_version(spark):
    rng = random.Random(4)
    pairs = [("hub", f"a{i}") for i in range(300)] + [(f"a{rng.randrange(300)}", f"a{rng.randrange(300)}") for _ in range(250)] + [("a1", "a1"), ("x", "y")]
    values = {x: rng.randrange(1000) / 8 for x in {v for p in pairs for v in p} if x not in ("a7", "y")}
    tx = spark.createDataFrame(pairs + pairs[:20], "from_account string, to_account string")
    features = spark.createDataFrame(list(values.items()), "account_id string, v double")
    found = {r.account_id: r for r in OPERATORS["graph_sampled_hops"].apply(spark, {"tx": tx, "features": features}, columns=("v",), first=4, second=3).collect()}
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def sample(a, k, salt):
        return sorted(near[a], key=lambda b: (hashlib.md5(f"{salt}{a}|{b}".encode()).hexdigest(), b))[:k]

    def mean(xs):
        known = [values[x] for x in xs if x in values]
        return sum(known) / len(known) if known else None

    assert set(found) == set(near) and len(near["hub"]) == 300
    for a in near:
        one = sample(a, 4, "1:")
        two = [c for b in one for c in sample(b, 3, "2:") if c != a]
        r = found[a]
        assert (r.n_one, r.n_two) == (len(one), len(two))
        for got, wanted in ((r.one_v, mean(one)), (r.two_v, mean(two))):
            assert (got is None and wanted is None) or math.isclose(got, wanted, abs_tol=1e-6)
