"""PageRank and core numbers over edges that stay where they lie."""

import random

import pytest

from ledgergraph.functions.workspace import Workspace
from ledgergraph.operators.iterative import Adjacency, kcore, pagerank


def _ledger(kind=int):
    rng = random.Random(5)
    pairs = {(rng.randrange(60), rng.randrange(60)) for _ in range(260)}
    pairs |= {(0, i) for i in range(100)} | {(i, 0) for i in range(40)} | {(7, 7), (100, 101), (101, 102)}
    return sorted((kind(a), kind(b)) for a, b in pairs)


def _pagerank(pairs, damping=0.85, rounds=30, seeds=None):
    nodes = sorted({x for p in pairs for x in p})
    out = {x: [b for a, b in pairs if a == x] for x in nodes}
    start = {x: 1.0 if seeds is None or x in seeds else 0.0 for x in nodes}
    total = sum(start.values()) or 1
    start = {x: v / total for x, v in start.items()}
    rank = dict(start)
    for _ in range(rounds):
        loose = sum(rank[x] for x in nodes if not out[x])
        now = {x: (1 - damping + damping * loose) * start[x] for x in nodes}
        for x in nodes:
            for y in out[x]:
                now[y] += damping * rank[x] / len(out[x])
        rank = now
    return rank


def _kcore(pairs):
    """By peeling; a self-loop is a neighbour of itself and goes with its account."""
    near = {x: set() for p in pairs for x in p}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    core, k = {}, 0
    while near:
        x = min(near, key=lambda n: len(near[n]))
        k = max(k, len(near[x]))
        core[x] = k
        for y in near.pop(x):
            if y in near:
                near[y].discard(x)
    return core


@pytest.mark.parametrize("hub_edges", [5, 60])
def test_hubs_apart_change_nothing(spark, hub_edges):
    pairs = _ledger()
    df = spark.createDataFrame(pairs, "src bigint, dst bigint")
    got = {r.account_id: r.kcore_number for r in kcore(spark, df, hub_edges=hub_edges).collect()}
    assert got == _kcore(pairs)
    for seeds in (None, [3, 4]):
        marked = None if seeds is None else spark.createDataFrame([(x,) for x in seeds], "account_id bigint")
        found = {r.account_id: r.pagerank for r in pagerank(spark, df, rounds=3, seeds=marked, hub_edges=hub_edges).collect()}
        assert found == pytest.approx(_pagerank(pairs, rounds=3, seeds=seeds), abs=1e-12)


def test_text_ids_and_empty_graph(spark):
    pairs = _ledger(lambda x: f"A{x}")
    got = {r.account_id: r.kcore_number for r in kcore(spark, spark.createDataFrame(pairs, "src string, dst string"), hub_edges=20).collect()}
    assert got == _kcore(pairs)
    none = spark.createDataFrame([], "src string, dst string")
    assert kcore(spark, none).count() == 0 and pagerank(spark, none, rounds=2).count() == 0


def test_no_exchange_of_edges(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as at sizes where nothing is small
    try:
        edges = spark.range(3000).selectExpr("id % 50 as src", "id % 61 as dst").distinct()
        graph = Adjacency(Workspace(spark, "plan"), edges)
        state = graph.degree.selectExpr("src", "1.0D / degree as share")
        plan = graph.along(state)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Bucketed: true" in plan
    assert plan.count("Exchange hashpartitioning") == 1  # of the state
    moved = plan[plan.index("Exchange hashpartitioning") :]
    assert "dst" not in moved
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("ledgergraph_")]
