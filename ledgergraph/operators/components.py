"""Connected components by alternating large-star and small-star.

Kiveris, Lattanzi, Mirrokni, Rastogi, Vassilvitskii: "Connected Components in
MapReduce and Beyond" (SoCC 2014).  Every round is two aggregations with
map-side combining and one join; edges never meet in one task by component, and
nothing but an edge count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.workspace import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie every neighbour greater than a node to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("low")).select(
        F.col("src").alias("node"), F.least("src", "low").alias("low")
    )
    return (
        both.join(least, both.src == least.node)
        .where(F.col("dst") > F.col("src"))
        .select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst")
    least = down.groupBy("src").agg(F.min("dst").alias("low")).withColumnRenamed("src", "node")
    inner = (
        down.join(least, down.src == least.node)
        .where(F.col("dst") > F.col("low"))
        .select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    )
    return inner.unionByName(least.select(F.col("node").alias("src"), F.col("low").alias("dst"))).distinct()


def _written(work: Workspace, edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The written edges, and their number and checksum, observed while they are written."""
    seen = Observation()
    check = F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("check")
    found = work.cut(edges.observe(seen, F.count(F.lit(1)).alias("n"), check), name)
    return found, (seen.get["n"] or 0, seen.get["check"])


def connected_components(edges: DataFrame, work: Workspace, name: str, max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` for every node that is not its component's smallest.

    ``edges`` has two columns of one type, in any direction, repeats and self-loops
    allowed; edges with a null end are left out.  Nodes without a row are alone or
    the smallest of their component.  Empty edges give an empty result.  Raises
    ``RuntimeError`` if ``max_rounds`` (logarithmic in practice) do not suffice.
    """
    a, b = edges.columns
    edges = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where(
        "src is not null and dst is not null and src <> dst"
    )
    edges, before = _written(work, edges.distinct(), f"{name}-0")
    for i in range(1, max_rounds + 1):
        if not before[0]:
            break
        edges, after = _written(work, _small_star(_large_star(edges)), f"{name}-{i}")
        work.drop(f"{name}-{i - 1}")
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))
