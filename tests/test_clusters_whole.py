"""Clusters of all illicit transfers, against plain union-find."""

from collections import Counter, defaultdict

from ledgergraph.operators import iterative
from ledgergraph.plans.fixtures import fixture

SF = "/root/testdata/sf0.001"


def test_clusters_hold_all_illicit_transfers(spark):
    edges = [(r.from_account, r.to_account) for r in fixture(spark, SF, "tx").where("is_laundering = 1").collect()]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    members = defaultdict(list)
    for x in sorted(parent):
        members[find(x)].append(x)
    illicit = Counter(find(a) for a, _ in edges)
    level = lambda n: "HIGH" if n >= 20 else "MEDIUM" if n >= 5 else "LOW"
    wanted = [
        (root, len(m), illicit[root], level(len(m)), ",".join(map(str, m[:5])))
        for root, m in sorted(members.items(), key=lambda x: (-len(x[1]), x[0])) if len(m) >= 2
    ]
    found = iterative.graph_clusters(spark, SF).orderBy("cluster_id").collect()
    assert wanted and [tuple(r)[1:] for r in found] == wanted
    assert sum(r.illicit_edges for r in found) + sum(illicit[r] for r, m in members.items() if len(m) < 2) == len(edges)
