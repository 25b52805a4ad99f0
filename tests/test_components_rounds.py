"""A round of components is one write; what ends the rounds is observed in it."""

from pyspark.sql.classic.dataframe import DataFrame

from ledgergraph.functions.workspace import Workspace
from ledgergraph.operators.components import connected_components


def test_rounds_read_nothing_back(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    empty = edges.where("a < 0")

    def refused(*_):
        raise AssertionError("a round was read back")

    with monkeypatch.context() as m:
        for action in ("first", "head", "collect"):
            m.setattr(DataFrame, action, refused)
        found, none = (connected_components(e, Workspace(spark, "rounds"), "c") for e in (edges, empty))
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100)}
    assert none.count() == 0
