"""A Merkle manifest of a dataset: a tree per group, a tree over the groups, proofs.

Each row is a leaf, the SHA-256 of its fields.  Leaves of a group lie in the order of
their ids; every eight consecutive nodes of a level (the last run: fewer) become their
hash, up to the group's subroot; the subroots, in the order of the groups, become the
root in the same way.

1. Leaves are hashed in the JVM, written, and range-sorted by group and id into an
   RDD.  Texts never move.
2. Each partition counts its first and its last group, the only ones that it can share
   with others: two counts a partition reach the driver and give every partition the
   place of its leaves within their groups.
3. Each partition builds all subtrees whose leaves it holds.  Nodes without their
   whole run, at most seven at either end of a level, go on by coordinate (group,
   level, index), and a shuffle a level finishes what lies above them.
4. The way down gives each such node the runs between it and the root.  These go to
   its partition by number, where the leaves are still sorted; a leaf's proof is its
   local runs and those.

A group may be a third of all rows or far more: its partitions work apart, and what
they exchange grows with the number of partitions.  Lost partitions are made again
from the written leaves, in the same order, as leaf hashes break ties.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import groupby

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.workspace import Workspace

FAN = 8
#: Leaves of a partition, about at most; a task holds these with their subtrees.
PARTITION_LEAVES = 1 << 16
#: Leaves up to which one partition will do.
FEW_LEAVES = 1 << 13

#: A run of nodes on the way to the root, and which of them is on the way.
Step = tuple[list[str], int]

_PATH = "array<struct<run:array<string>,pos:int>>"


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def fold(leaf: str, path: Iterable[Step]) -> str:
    """The root that a leaf and the other nodes of its runs give."""
    for run, pos in path:
        leaf = digest([*run[:pos], leaf, *run[pos + 1 :]])
    return leaf


def siblings(path: Iterable[Step]) -> Iterator[str]:
    """A proof's hashes: the other nodes of each run, from the leaf to the root."""
    for run, pos in path:
        yield from run[:pos]
        yield from run[pos + 1 :]


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def climb(leaves: list[str], start: int, total: int) -> list[tuple[int, list[str], int, int]]:
    """Levels ``(start, nodes, first, last)`` over consecutive leaves of a group of
    ``total``; ``first`` to ``last`` are the parents whose whole runs are among the
    nodes.  The last level is the subroot or has no such parent."""
    out, nodes = [], leaves
    while True:
        end = start + len(nodes)
        first, last = -(-start // FAN), -(-end // FAN) if end == total else end // FAN
        if total == 1 or first >= last:
            out.append((start, nodes, 0, 0))
            return out
        out.append((start, nodes, first, last))
        nodes = [digest(nodes[j * FAN - start : (j + 1) * FAN - start]) for j in range(first, last)]
        start, total = first, -(-total // FAN)


def ragged(levels: list[tuple[int, list[str], int, int]]) -> Iterator[tuple[int, int, str]]:
    """``level, index, hash`` of the nodes whose parent lies elsewhere, or of the subroot."""
    for level, (start, nodes, first, last) in enumerate(levels):
        for i, node in enumerate(nodes, start):
            if not first <= i // FAN < last:
                yield level, i, node


def _ends(index: int, rows: Iterator) -> Iterator[tuple[int, list[tuple[str, int]]]]:
    """A partition's first and last group and their numbers of rows."""
    found: list[tuple[str, int]] = []
    for group, own in groupby(rows, key=lambda r: r[0]):
        found[1:] = [(group, sum(1 for _ in own))]
    yield index, found


def _places(ends: list[tuple[int, list[tuple[str, int]]]]) -> list[dict[str, tuple[int, int]]]:
    """For each partition, where its first and last group begin in it, and their totals."""
    totals: dict[str, int] = {}
    out: list[dict[str, tuple[int, int]]] = []
    starts = []
    for _, found in sorted(ends):
        starts.append({g: (totals.get(g, 0), n) for g, n in found})
        for g, n in found:
            totals[g] = totals.get(g, 0) + n
    for own in starts:
        out.append({g: (start, totals[g]) for g, (start, _) in own.items()})
    return out


class _Forest:
    """Trees over a sorted RDD of rows ``(group, leaf, ...)``."""

    def __init__(self, spark: SparkSession, work: Workspace, rows: RDD, name: str):
        self.spark, self.work, self.rows, self.name = spark, work, rows, name
        self.n_parts = rows.getNumPartitions()
        # two counts a partition
        places = _places(rows.mapPartitionsWithIndex(_ends).collect())
        self.places = spark.sparkContext.broadcast(places)
        self._grow()

    def _segments(self) -> Callable[[int, Iterator], Iterator[tuple[str, int, list, list]]]:
        """A partition's rows by group: its name, total, rows and local levels."""
        places = self.places

        def run(index: int, rows: Iterator) -> Iterator[tuple[str, int, list, list]]:
            for group, own in groupby(rows, key=lambda r: r[0]):
                held = list(own)
                start, total = places.value[index].get(group, (0, len(held)))
                yield group, total, held, climb([r[1] for r in held], start, total)

        return run

    def _grow(self) -> None:
        """Local subtrees, then a level at a time what lies above them."""
        segments = self._segments()

        def local(index: int, rows: Iterator) -> Iterator[tuple]:
            for group, total, _, levels in segments(index, rows):
                for level, i, node in ragged(levels):
                    yield index, group, height(total), level, i, node

        emitted = self.spark.createDataFrame(
            self.rows.mapPartitionsWithIndex(local), "pid int, grp string, top int, level int, idx long, node string", verifySchema=False
        )
        self.emitted = self.work.cut(emitted, f"{self.name}-ragged")
        # levels to finish, of the groups that span partitions
        self.top = self.emitted.where("level < top").agg(F.max("top")).first()[0] or 0
        self.runs: list[DataFrame] = []
        made = self.emitted.drop("pid").where("false")
        for level in range(self.top):
            pool = self.emitted.drop("pid").where(F.col("level") == level).unionByName(made).where("level < top")
            # at most FAN nodes a run
            runs = pool.groupBy("grp", "top", F.expr(f"idx div {FAN}").alias("idx")).agg(
                F.array_sort(F.collect_list(F.struct("idx", "node"))).alias("own")
            )
            self.runs.append(self.work.cut(runs.select("grp", "top", "idx", F.col("own.node").alias("run"), F.col("own.idx").alias("at")), f"{self.name}-runs-{level}"))
            made = self.runs[-1].select("grp", "top", F.lit(level + 1).alias("level"), "idx", F.sha2(F.array_join("run", ""), 256).alias("node"))

    def subroots(self) -> DataFrame:
        """``grp, node`` of every group."""
        found = [self.emitted.where("level = top").select("grp", "node")]
        for level, runs in enumerate(self.runs):
            tops = runs.where(F.col("top") == level + 1)
            found.append(tops.select("grp", F.sha2(F.array_join("run", ""), 256).alias("node")))
        return reduce(DataFrame.unionByName, found)

    def prove(self, above: DataFrame, emit: Callable[[tuple, list[Step], str, str], tuple], schema: T.StructType | str) -> DataFrame:
        """Rows ``emit(row, path, subroot, root)``, with ``above`` (``grp, subroot, root,
        path``: the runs from a group's subroot on)."""
        found, known = [self.emitted.where("level = top").select("pid", "grp", "level", "idx").join(above, "grp")], None
        for level in range(self.top, -1, -1) if self.top else ():
            paths = above.select("grp", F.lit(0).cast("long").alias("idx"), "subroot", "root", "path").where("false")
            if level:
                tops = self.runs[level - 1].where(F.col("top") == level).select("grp", "idx")
                paths = tops.join(above, "grp").select(*paths.columns)
            if known is not None:
                below = self.runs[level].join(known.withColumnRenamed("path", "rest"), ["grp", "idx"])
                below = below.select("grp", "subroot", "root", "rest", "run", F.posexplode("at").alias("pos", "i"))
                step = F.array(F.struct("run", "pos"))
                paths = paths.unionByName(below.select("grp", F.col("i").alias("idx"), "subroot", "root", F.concat(step, F.col("rest")).alias("path")))
            known = self.work.cut(paths, f"{self.name}-paths-{level}")
            own = self.emitted.where((F.col("level") == level) & (F.col("level") < F.col("top")))
            found.append(own.select("pid", "grp", "level", "idx").join(known, ["grp", "idx"]))
        upper = reduce(DataFrame.unionByName, found).select("pid", "grp", "level", "idx", "subroot", "root", "path")
        keyed = upper.rdd.map(lambda r: (r[0], ((r[1], r[2], r[3]), (r[4], r[5], [(list(s[0]), s[1]) for s in r[6]]))))
        keyed = keyed.partitionBy(self.n_parts, lambda pid: pid)
        rows = self.rows
        if keyed.getNumPartitions() > self.n_parts:  # the rest has no rows
            rows = rows.union(self.spark.sparkContext.parallelize([], keyed.getNumPartitions() - self.n_parts))
        segments = self._segments()
        packed = rows.mapPartitionsWithIndex(lambda index, own: [(index, list(map(tuple, own)))])
        known_above = keyed.mapPartitions(lambda own: [dict(pair for _, pair in own)])

        def proofs(pair: tuple) -> Iterator[tuple]:
            (index, held), upper_of = pair
            for group, _, own, levels in segments(index, iter(held)):
                leaf_start = levels[0][0]
                for i, row in enumerate(own, leaf_start):
                    path: list[Step] = []
                    level = 0
                    start, nodes, first, last = levels[0]
                    while first <= i // FAN < last:
                        j = i // FAN
                        a = j * FAN - start
                        path.append((nodes[a : a + FAN], i - j * FAN))
                        i, level = j, level + 1
                        start, nodes, first, last = levels[level]
                    subroot, root, rest = upper_of[group, level, i]
                    yield emit(row, path + rest, subroot, root)

        return self.spark.createDataFrame(packed.zip(known_above).flatMap(proofs), schema, verifySchema=False)


def _sorted(spark: SparkSession, rows: DataFrame, keys: list[str], n: int) -> RDD:
    """``n`` rows in the order of ``keys``, nulls first."""
    parts = 1
    if n > FEW_LEAVES:
        parts = max(math.ceil(n / PARTITION_LEAVES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).rdd


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 of fields, each its UTF-8 length and value, or a dash if null."""
    return F.sha2(F.concat(*map(_field, fields)).cast("binary"), 256)


def lower_case(text: Column) -> Column:
    """A-Z lower-cased; all else, other letters included, stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _group(c: Column) -> Column:
    """A group's name such that null comes first."""
    return F.coalesce(F.concat(F.lit(":"), c.cast("string")), F.lit(""))


def _trees(
    spark: SparkSession, docs: DataFrame, fields: list[str], id_col: str, group_col: str, other: Column | None
) -> tuple[_Forest, DataFrame, T.DataType, DataFrame]:
    """The groups' trees, ``grp, subroot, root, path`` of every group, and the leaves."""
    work = Workspace(spark, "merkle")
    leaf = leaf_hash(*[F.col(c) for c in fields])
    found = docs.select(
        _group(F.col(group_col)).alias("grp"), leaf.alias("leaf"), F.col(id_col).alias("id"), (F.lit(None).cast("string") if other is None else other).alias("other")
    )
    leaves = work.cut(found, "leaves")
    forest = _Forest(spark, work, _sorted(spark, leaves, ["grp", "id", "leaf"], leaves.count()), "groups")
    subroots = work.cut(forest.subroots().select(F.lit("").alias("grp"), F.col("node").alias("leaf"), F.col("grp").alias("name")), "subroots")
    roots = _Forest(spark, work, _sorted(spark, subroots, ["name"], subroots.count()), "root")
    root = roots.subroots().select("grp", F.col("node").alias("subroot"), F.col("node").alias("root"), F.array().cast(_PATH).alias("path"))
    above = roots.prove(root, lambda row, path, _, top: (row[2], row[1], top, path), f"grp string, subroot string, root string, path {_PATH}")
    return forest, work.cut(above, "above"), docs.schema[id_col].dataType, leaves


def manifest(spark: SparkSession, docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "lang") -> DataFrame:
    """``group_col, n, subroot, root`` of every group (null a group of its own)."""
    _, above, _, leaves = _trees(spark, docs, fields, id_col, group_col, None)
    name = F.when(F.col("grp") != "", F.substring("grp", 2, 2**31 - 1)).alias(group_col)
    return leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).join(above, "grp").select(name, "n", "subroot", "root")


def prove(
    spark: SparkSession,
    docs: DataFrame,
    fields: list[str],
    id_col: str = "doc_id",
    group_col: str = "lang",
    presented: Column | None = None,
    with_paths: bool = True,
) -> DataFrame:
    """``id_col, leaf, subroot, root, proof_sha256, folded_root, verified`` and, if asked
    for, ``path`` (the runs from leaf to root, with the leaf's place in each) of every row.

    ``presented`` is the leaf hash that a holder of the row presents (null: the row's
    own); ``folded_root`` is what it gives with the proof, ``verified`` whether that is
    the root.  Ids ascend, nulls first; rows that share an id lie in the order of their
    leaf hashes, and equal rows have a leaf each.  A null group is one group, before
    the others.  A leaf alone is its subroot, a subroot alone the root, and their proofs
    have no hashes.  Columns other than ``fields``, id and group are not read.  An empty
    table gives no rows.
    """
    forest, above, kind, _ = _trees(spark, docs, fields, id_col, group_col, presented)

    def emit(row: tuple, path: list[Step], subroot: str, root: str) -> tuple:
        _, leaf, key, other = row
        folded = fold(other or leaf, path)
        out = (key, leaf, subroot, root, digest(siblings(path)), folded, folded == root)
        return (*out, path) if with_paths else out

    schema = T.StructType([T.StructField(id_col, kind)])
    for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"):
        schema = schema.add(c, "string")
    schema = schema.add("verified", "boolean")
    if with_paths:
        step = T.StructType([T.StructField("run", T.ArrayType(T.StringType())), T.StructField("pos", T.IntegerType())])
        schema = schema.add("path", T.ArrayType(step))
    return forest.prove(above, emit, schema)


DOCUMENT_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def tampering_audit(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """:func:`prove` of documents of which some are presented with a lower-cased text:
    those of whose decimal id 3 divides the CRC-32 (a missing id: none)."""
    fields = [lower_case(F.col(c)) if c == "text" else F.col(c) for c in DOCUMENT_FIELDS]
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return prove(spark, docs, DOCUMENT_FIELDS, presented=F.when(chosen, leaf_hash(*fields)), with_paths=False)


def _sql_leaf(text: str) -> str:
    parts = [
        f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
        for c in (*DOCUMENT_FIELDS[:-1], text)
    ]
    return f"sha256({' || '.join(parts)})"


#: DuckDB's rows for :func:`tampering_audit`; ``crc`` is CRC-32 by its bits.
SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS r, doc_id, lang, {_sql_leaf("text")} AS leaf,
    CASE WHEN crc % 3 = 0 THEN {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other
  FROM (SELECT *, xor(list_reduce(
      list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384::BIGINT))),
    4294967295::BIGINT) AS crc FROM documents)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
low AS (
  SELECT coalesce(':' || lang, '') AS g, 0 AS level, i, n, leaf AS h FROM placed
  UNION ALL
  SELECT g, level + 1, i // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY g, level, i // {FAN}, n),
subroots AS (
  SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 1000 AS level, i, n, h FROM subroots
  UNION ALL
  SELECT level + 1, i // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, i // {FAN}, n),
nodes AS (
  SELECT g, level, i, h FROM low WHERE n > 1
  UNION ALL SELECT NULL, level, i, h FROM high WHERE n > 1),
around AS (
  SELECT a.g, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before,
    coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM nodes a JOIN nodes b ON a.g IS NOT DISTINCT FROM b.g AND a.level = b.level AND a.i // {FAN} = b.i // {FAN} GROUP BY ALL),
steps AS (
  SELECT p.r, a.level, a.before, a.after FROM placed p JOIN around a
    ON a.g = coalesce(':' || p.lang, '') AND a.i = p.i // CAST(pow({FAN}, a.level) AS BIGINT)
  UNION ALL
  SELECT p.r, a.level, a.before, a.after FROM placed p JOIN subroots s ON s.g = coalesce(':' || p.lang, '')
    JOIN around a ON a.g IS NULL AND a.i = s.i // CAST(pow({FAN}, a.level - 1000) AS BIGINT)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY level) AS k FROM steps),
folded AS (
  SELECT r, 0::BIGINT AS k, coalesce(other, leaf) AS h FROM leaves
  UNION ALL
  SELECT f.r, n.k, sha256(n.before || f.h || n.after) FROM folded f JOIN numbered n ON f.r = n.r AND n.k = f.k + 1)
SELECT p.doc_id, p.leaf, s.h AS subroot, t.h AS root,
  sha256(coalesce((SELECT string_agg(before || after, '' ORDER BY level) FROM steps x WHERE x.r = p.r), '')) AS proof_sha256,
  f.h AS folded_root, f.h = t.h AS verified
FROM placed p JOIN subroots s ON s.g = coalesce(':' || p.lang, '') JOIN (SELECT h FROM high WHERE n = 1) t ON true
JOIN (SELECT r, arg_max(h, k) AS h FROM folded GROUP BY r) f ON f.r = p.r
"""
