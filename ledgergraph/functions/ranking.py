"""Ranks and running sums whose windows hold a bounded share of the rows.

The rank of a moment is found from counts per day and then within its day; dense
indices and running sums are counted per bucket first.  The only windows without a
partition run over days or buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.dialect import Spark
from .workspace import Workspace


def moments(rows: str, column: str, ranks: dict[str, str]) -> str:
    """CTEs ``at_<name>`` (``v``, ``ties``): the value at a rank from 0 of the rows'
    times, and how many rows of that very time come before the rank.  A rank is an
    expression of ``total``, the number of rows; null if it is out of range."""
    parts = [
        f"day_ as (select cast({column} as date) as day, count(*) as n from {rows} where {column} is not null group by cast({column} as date))",
        "run_ as (select day, n, cast(sum(n) over (order by day) as bigint) as upto, cast(sum(n) over () as bigint) as total from day_)",
    ]
    for name, rank in ranks.items():
        parts += [
            f"pick_{name} as (select day, {rank} - (upto - n) as place from run_ where {rank} >= upto - n and {rank} < upto)",
            f"sec_{name} as (select {column} as v, count(*) as n from {rows} r join pick_{name} on cast({column} as date) = day group by {column})",
            f"cum_{name} as (select v, n, cast(sum(n) over (order by v) as bigint) as upto from sec_{name})",
            f"at_{name} as (select max(v) as v, max(place - (upto - n)) as ties from cum_{name} cross join pick_{name} "
            "where place >= upto - n and place < upto)",
        ]
    return ",\n  ".join(parts)


def indexed(d: Spark, source: str, text_ids: bool = False, bucket: int = 65_536, prefix: int = 12) -> str:
    """CTE ``ids`` (``id, idx``): the ids of a query in order, numbered from 0.

    Ids are numbered within buckets that follow their order: ranges of ``bucket``
    numbers, or of texts those of equal first ``prefix`` characters.
    """
    of = f"substr(id, 1, {prefix})" if text_ids else d.idiv("id", str(bucket))
    return f"""some_ids as ({source}),
  id_runs as (select {of} as b, count(*) as n from some_ids group by {of}),
  id_bases as (select b, coalesce(cast(sum(n) over (order by b rows between unbounded preceding and 1 preceding) as bigint), 0) as base from id_runs),
  ids as (select id, base + row_number() over (partition by b order by id) - 1 as idx from some_ids join id_bases on {of} = b)"""


def cumulated(source: str, steps: int = 4096) -> str:
    """CTE ``cum`` (``k, s, tp, n, ctp, cn, np``) of a query of ``k, y, s`` (scores 0 to 1):
    positives and rows at a score, down to it, and all positives of ``k``."""
    before = "over (partition by k order by b desc rows between unbounded preceding and 1 preceding) as bigint), 0)"
    inside = "over (partition by k, b order by s desc rows unbounded preceding) as bigint)"
    return f"""cum_g as (select k, s, cast(floor(s * {steps}) as bigint) as b, cast(sum(y) as bigint) as tp, count(*) as n
    from ({source}) q group by k, s),
  cum_b as (select k, b, cast(sum(tp) as bigint) as tp, cast(sum(n) as bigint) as n from cum_g group by k, b),
  cum_o as (select k as k0, b as b0, coalesce(cast(sum(tp) {before} as tp0, coalesce(cast(sum(n) {before} as n0,
    cast(sum(tp) over (partition by k) as bigint) as np from cum_b),
  cum as (select k, s, tp, n, np, tp0 + cast(sum(tp) {inside} as ctp, n0 + cast(sum(n) {inside} as cn
    from cum_g join cum_o on k = k0 and b = b0)"""


def ranked(work: Workspace, rows: DataFrame, by: list[Column], name: str) -> DataFrame:
    """``rows`` with ``place`` from 1 in the order ``by``: range-sorted, numbered within
    partitions and moved on by the sizes of those before, one number each."""
    sorted_ = rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id())
    numbered = work.cut(sorted_.withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy(*by))), name)
    sizes = numbered.groupBy("_part").agg(F.max("_i").alias("n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_base"))  # a row per partition
    return numbered.join(F.broadcast(bases), "_part").withColumn("place", F.col("_base") + F.col("_i")).drop("_part", "_i", "_base")
