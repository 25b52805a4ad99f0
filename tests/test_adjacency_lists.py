"""An account's edges are one row of the layout, so that rounds sort accounts and not edges."""

from ledgergraph.functions.workspace import Workspace
from ledgergraph.operators.iterative import Adjacency


def test_a_row_an_account(spark):
    pairs = [(i % 7, i) for i in range(100)] + [(99, i) for i in range(50)]
    graph = Adjacency(Workspace(spark, "lists"), spark.createDataFrame(pairs, "src long, dst long"), hub_edges=40)
    assert graph.some and graph.rest.count() == 7  # the hub lies apart
    found = graph.along(graph.degree.select("src", "degree")).select("src", "dst").collect()
    assert sorted(map(tuple, found)) == sorted(pairs)
