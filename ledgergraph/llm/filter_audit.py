"""What filters do to each other: every order of application, audited by source.

The orders of ``n`` filters form a trie of prefixes.  It is walked depth first: each
prefix is applied to the persisted survivors of the one before it, and all prefixes of
the same filters, in whatever order, share one state, as the survivors are the same.
A state is visited once; there one aggregate over its survivors counts, for each filter
still to come, the rows that this edge of the trie removes.  So ``2**n - 1`` states
answer ``n!`` orders, at most ``n`` of them persisted at a time, and every figure of
the report is a count of an edge or a sum of such counts:

* a filter's redundant removals are its failures among all rows (its edge from the
  empty state) less what the edge in question removes;
* its unique failures are the removals on its edge from the state of all others;
* its Shapley sum weighs the removals of each of its edges by the orders through it.

Texts are judged once, in one pass, before the walk; the states hold slim rows.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from ..functions.workspace import Workspace, small_batches

#: The filters of :func:`judge`, by letter: short, repetitive, shouting, with marks, copies.
FILTERS = "ABCDE"
_CAPITALS = bytes(range(0x41, 0x5B))
_MARKS = b"#$%&*|"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = W.utf8(batch.column(2))
        fails: list[list[bool]] = [[] for _ in "ABCD"]
        prints = []
        for a, b in itertools.pairwise(offsets.tolist()):
            raw = data[a:b].tobytes()
            found = raw.split()  # of bytes: parts at ASCII white space
            n = len(found)
            points = b - a - int(np.count_nonzero((data[a:b] & 0xC0) == 0x80))
            fails[0].append(n < 50)
            fails[1].append(100 * len(set(found)) < 65 * n)
            fails[2].append(100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > 5 * points)
            fails[3].append(len(raw.translate(None, _MARKS)) < len(raw))
            prints.append(hashlib.blake2b(raw, digest_size=16).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(prints, pa.binary()), *(pa.array(x, pa.bool_()) for x in fails)],
            ["doc_id", "part", "fp", *"ABCD"],
        )


def judge(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """``part``, the failures ``A`` to ``E``, ``good`` and ``toxic`` of every row.

    A: under 50 words; B: under 65 % of the words distinct; C: over 5 % of the code
    points capitals A-Z; D: any of ``#$%&*|``; E: the text of a smaller id.  Words are
    runs without ASCII white space, null texts are empty, and a null part is ``""``.
    Rows without an id are no copies, nor is what only they hold; labels of repeated
    ids are taken together.  Texts are compared by a 128-bit digest.
    """
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text")
    ).mapInArrow(_judge, f"doc_id {kind}, part string, fp binary, A boolean, B boolean, C boolean, D boolean")
    slim = Workspace(spark, "filter-audit").cut(slim, "judged")
    copies = slim.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    told = (
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").alias("labelled"))
        .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    )
    return (
        slim.join(copies, "fp", "left")
        .join(told, slim.doc_id == F.col("labelled"), "left")
        .select(
            "part",
            *"ABCD",
            F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("E"),
            F.coalesce("good", F.lit(False)).alias("good"),
            F.coalesce("toxic", F.lit(False)).alias("toxic"),
        )
    )


class _Walk:
    """The trie's states, depth first, each once."""

    def __init__(self, work: Workspace, filters: str):
        self.work, self.filters = work, filters
        self.paths: list[str] = []
        self.seen: set[frozenset[str]] = set()
        self.schema = None

    def visit(self, prefix: str, survivors: DataFrame) -> None:
        state = frozenset(prefix)
        if state in self.seen or len(state) == len(self.filters):
            return
        self.seen.add(state)
        rest = [f for f in self.filters if f not in state]
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self._count(_name(state), survivors, rest)
            for f in rest:
                self.visit(prefix + f, survivors.where(~F.col(f)))
        finally:
            survivors.unpersist()

    def _count(self, state: str, survivors: DataFrame, rest: list[str]) -> None:
        """Write the state's rows by part, and what each filter to come removes."""
        sums = [
            F.struct(
                F.lit(f).alias("filter"),
                F.count_if(F.col(f)).alias("removed"),
                F.count_if(F.col(f) & F.col("good")).alias("good_lost"),
                F.count_if(F.col(f) & F.col("toxic")).alias("toxic_lost"),
            )
            for f in rest
        ]
        counts = survivors.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("edges"))
        counts = counts.select(F.lit(state).alias("state"), "part", "n", "edges")
        self.schema = self.work.cut(counts, f"state-{state}").schema
        self.paths.append(f"{self.work.path}/state-{state}")

    def edges(self) -> DataFrame:
        """``state, part, n, filter, removed, good_lost, toxic_lost``."""
        read = self.work.spark.read.schema(self.schema).parquet(*self.paths)
        return read.select("state", "part", "n", F.explode("edges").alias("e")).select("state", "part", "n", "e.*")


def _name(state: frozenset[str] | str) -> str:
    return "".join(sorted(state)) or "0"


def audit(spark: SparkSession, judged: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley``: a row per part, order of ``filters`` and step.

    ``judged`` has ``part``, a boolean column per filter (a letter each), ``good`` and
    ``toxic``.  Parts are those of its rows, so an empty table gives no rows; a part
    whose rows are all gone has rows of zeros.
    """
    work = Workspace(spark, "filter-audit")
    walk = _Walk(work, filters)
    walk.visit("", work.cut(judged, "base"))
    edges, n = walk.edges(), len(filters)
    depth = F.when(F.col("state") == "0", 0).otherwise(F.length("state"))
    through = F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)])
    of_filter = edges.groupBy("part", "filter").agg(
        F.sum(F.when(depth == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(depth == n - 1, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * through[depth]).alias("shapley"),
    )
    every = [
        (state, f)
        for k in range(n)
        for state in itertools.combinations(sorted(filters), k)
        for f in filters
        if f not in state
    ]
    every_edge = F.array(*[F.struct(F.lit(_name(s)).alias("state"), F.lit(f).alias("filter")) for s, f in every])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    figures = (
        edges.where("state = '0'").select("part").distinct()
        .select("part", F.explode(every_edge).alias("e")).select("part", "e.*")
        .join(edges, ["part", "state", "filter"], "left")
        .join(of_filter, ["part", "filter"], "left")
        .select("part", "state", "filter", *map(zero, ("n", "removed", "good_lost", "toxic_lost", "fails", "unique_fails", "shapley")))
    )
    # n! * n rows, whatever the tables
    steps = spark.createDataFrame(
        [
            ("".join(order), i + 1, _name(order[:i]), order[i])
            for order in itertools.permutations(sorted(filters))
            for i in range(n)
        ],
        "filter_order string, step int, state string, filter string",
    )
    return figures.join(F.broadcast(steps), ["state", "filter"]).select(
        "part",
        "filter_order",
        "step",
        (F.col("n") - F.col("removed")).alias("kept"),
        "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails",
        "good_lost",
        "toxic_lost",
        "shapley",
    )


def filter_audit(spark: SparkSession, docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """:func:`audit` of the five filters of :func:`judge` over whole texts."""
    return audit(spark, judge(spark, docs, labels, **columns))


#: DuckDB's rows for :func:`filter_audit`, from counts by part and set of failures.
SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
firsts AS (SELECT text, min(doc_id) AS least FROM texts GROUP BY text),
told AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CAST(len(words) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INT)
    + 4 * CAST(100 * (length(t.text) - length(regexp_replace(t.text, '[A-Z]', '', 'g'))) > 5 * length(t.text) AS INT)
    + 8 * CAST(regexp_matches(t.text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(t.doc_id > f.least, false) AS INT) AS mask
  FROM texts t JOIN firsts f ON t.text = f.text LEFT JOIN told l ON t.doc_id = l.doc_id),
cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM judged GROUP BY ALL),
letters(letter, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
grown AS (
  SELECT '' AS o, 0 AS m UNION ALL
  SELECT o || letter, m | b FROM grown, letters WHERE m & b = 0),
orders AS (SELECT o FROM grown WHERE length(o) = 5),
steps AS (
  SELECT o AS filter_order, CAST(s AS INT) AS step, (SELECT b FROM letters WHERE letter = substr(o, CAST(s AS INT), 1)) AS b,
    (SELECT coalesce(sum(b), 0) FROM letters WHERE strpos(substr(o, 1, CAST(s AS INT) - 1), letter) > 0)::INT AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS s)),
counted AS (
  SELECT part, filter_order, step, b,
    coalesce(sum(n) FILTER (mask & (before | b) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & b <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & before <> 0 AND mask & b <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = b), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & b <> 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & b <> 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, b))::BIGINT AS shapley
FROM counted
"""
