"""Core numbers by what fell: long falls, hubs, and rounds as wide as the graph is."""

import random

import pytest

from ledgergraph.functions.workspace import Workspace, together
from ledgergraph.operators.iterative import Adjacency, kcore

from .test_graph_rounds import _kcore


@pytest.mark.parametrize("hub_edges", [6, 1024])
def test_long_falls_and_cliques(spark, hub_edges):
    rng = random.Random(3)
    pairs = {(i, i + 1) for i in range(45)}  # ends fall one after the other
    pairs |= {(a, b) for a in range(100, 112) for b in range(a) if b >= 100} | {(45, 100), (100, 45)}
    pairs |= {(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(300)} | {(0, i) for i in range(200, 230)}
    df = spark.createDataFrame(sorted(pairs), "src bigint, dst bigint")
    got = {r.account_id: r.kcore_number for r in kcore(spark, df, hub_edges=hub_edges).collect()}
    assert got == _kcore(pairs)


def test_buckets_follow_the_graph_and_not_the_session(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, "64")
    try:
        edges = spark.range(2000).selectExpr("id % 40 as src", "id % 61 as dst")
        graph = Adjacency(Workspace(spark, "width"), edges.union(edges))
        assert graph.parts == spark.sparkContext.defaultParallelism < 64
        assert graph.degree.agg({"degree": "sum"}).first()[0] == edges.distinct().count()  # repeated edges count once
        state, _ = graph.placed(graph.moved(graph.degree, "src"), "state", graph.degree.degree)
        moved = graph.along(state)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in moved  # a placed state meets its edges where it lies
    finally:
        spark.conf.set(name, before)


def test_side_by_side(spark):
    assert together(spark, lambda: spark.range(3).count(), lambda: spark.range(5).count()) == [3, 5]
