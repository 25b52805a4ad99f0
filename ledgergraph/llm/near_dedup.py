"""MinHash near-duplicates with exact confirmation.

1. One pass over the texts gives each document its set of word shingles (64-bit
   hashes), ``rows * bands`` minima under strongly universal multiply-shift hash
   functions, a key per band of ``rows`` minima, and the lowest byte of each minimum.
2. Documents with equal sets form a class (fingerprint, smallest id), so copies
   never meet as pairs; only the class representative goes on.
3. Representatives that share a band key are tied to the smallest one there.
   Large-star/small-star components of these ties are *clumps*: every pair that
   shares any key lies in one clump.
4. A clump larger than a block may be a chain of pages that only share a template.
   It is split again: its documents meet by band key, pairs whose minima agree too
   seldom for a link are dropped, and components of the rest take its place, so a
   chain costs as much as its buckets and not the square of its length.
5. Inside a clump signatures are compared first: a pair whose share of equal minima
   falls over six standard deviations below the threshold is dropped (a true link
   does so with probability under 1e-8).  The others are confirmed on full shingle
   sets unless links found so far join them already, so a spanning set of links is
   left.  A clump larger than a block is dealt to block pairs, so no task holds more
   than two blocks.
6. Components of the confirmed links, again by alternating stars, give the result.

A pair at the threshold similarity ``s`` is missed by all bands with probability
``(1 - s**rows)**bands``: 2.6e-7 for the default 6 x 32 at 0.85.  Shingles are
compared by a 64-bit hash: two documents of ``n`` different shingles together are
judged wrongly only if two of these collide, with probability under ``n**2 / 2**65``
(1e-11 at 20 000 shingles).
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from ..operators.components import connected_components
from ..functions.workspace import Workspace

#: Representatives and shingles that one side of a block pair holds on average.
BLOCK_DOCS = 1024
BLOCK_SHINGLES = 1 << 20


@lru_cache(maxsize=4)
def hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of ``n`` functions ``x -> (a*x + b) mod 2**64 >> 32``
    on 32-bit ``x`` (Dietzfelbinger's strongly universal family)."""
    rng = np.random.default_rng(97)
    return rng.integers(0, 2**64, n, dtype=np.uint64), rng.integers(0, 2**64, n, dtype=np.uint64)


def minima(sets: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` minima of each non-empty set; ``starts`` are the sets' first items."""
    a, b = hash_family(n)
    x = sets >> np.uint64(32)
    y = np.empty_like(x)
    out = np.empty((len(starts), n), np.uint64)
    for j in range(n):
        np.multiply(x, a[j], out=y)
        y += b[j]
        out[:, j] = np.minimum.reduceat(y, starts)
    return out >> np.uint64(32)


def band_keys(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    key = np.zeros((len(signature), bands), np.uint64) + W.mix(np.arange(bands, dtype=np.uint64))
    parts = signature.reshape(len(signature), bands, rows)
    for r in range(rows):
        key = W.mix(key * W._R + parts[:, :, r])
    return key


def _sketch(shingle: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.pieces(batch.column(1), W.BLANK_SEPARATED):
                sets, bounds = W.shingle_sets(piece, shingle)
                size = np.diff(bounds)
                full = size > 0
                keys, low = np.empty(0, np.uint64), [None] * len(piece)
                if full.any():
                    signature = minima(sets, bounds[:-1][full], rows * bands)
                    keys = band_keys(signature, rows, bands)
                    for i, own in zip(np.flatnonzero(full).tolist(), signature.astype(np.uint8), strict=True):
                        low[i] = own.tobytes()
                raw = sets.tobytes()
                prints = [
                    hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None
                    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
                ]
                lists = np.zeros(len(size) + 1, np.int32)
                np.cumsum(full * bands, out=lists[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(piece.first, len(piece)),
                        pa.array(size.astype(np.int64)),
                        pa.array(prints, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(keys.ravel().view(np.int64))),
                        pa.array(low, pa.binary()),
                        batch.column(2).slice(piece.first, len(piece)),
                    ],
                    ["doc_id", "n_shingles", "fp", "keys", "low", "mark"],
                )

    return run


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal leading ``n_keys`` columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    key: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [*np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(c[a].item() for c in columns)
            if now != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def least_agreement(percent: int, width: int) -> float:
    """The share of ``width`` equal minima below which no pair can be a link."""
    s = percent / 100
    return s - 6 * math.sqrt(s * (1 - s) / width)


def _agreeing(least: float):
    """Spanning ties of the rows of a bucket's block pair whose minima's bytes agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in grouped(batches, 3):
            block = table.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            block, table = block[order], table.take(pa.array(order))
            rows = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(len(order), -1)
            second, across = block != block[0], block[0] != block[-1]
            label, found = np.arange(len(order)), []
            for i in range(len(order) - 1):
                if across and second[i]:
                    break
                near = np.flatnonzero((label != label[i]) & (second if across else np.arange(len(order)) > i))
                near = near[(rows[near] == rows[i]).mean(axis=1) >= least]
                for j in near.tolist():
                    if label[j] != label[i]:
                        found.append((i, j))
                        label[label == label[j]] = label[i]
            if found:
                ends = [table.column("rep").take(pa.array([p[k] for p in found])).combine_chunks() for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(ends, ["rep", "low"])

    return run


def _dealt(members: DataFrame, group: str, size: DataFrame) -> DataFrame:
    """``members`` dealt to the block pairs ``i <= j`` of their group; ``size`` gives
    each group's number of blocks ``m``."""
    return (
        members.join(size, group)
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("m")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("m") - 1).cast("int"))))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
    )


def _blocks(n: Column) -> Column:
    return F.ceil(n / F.lit(BLOCK_DOCS))


def _split(work: Workspace, clumps: DataFrame, reps: DataFrame, least: float, kind: str) -> DataFrame:
    """``node, component`` like ``clumps``, the large ones split to what bands and minima tie."""
    large = (
        clumps.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= BLOCK_DOCS).select("component")
    )
    inside = clumps.join(large, "component", "left_semi")
    inside = inside.select("node").unionByName(large.select(F.col("component").alias("node")))
    keyed = reps.join(inside, reps.rep == inside.node, "left_semi").dropDuplicates(["rep"])
    keyed = work.cut(keyed.select("rep", "low", F.explode("keys").alias("key")), "large")
    sizes = keyed.groupBy("key").agg(_blocks(F.count(F.lit(1))).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ties = (
        _dealt(keyed, "key", sizes.drop("n"))
        .select("key", "i", "j", "rep", "block", "low")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
        .mapInArrow(_agreeing(least), f"rep {kind}, low {kind}")
    )
    return clumps.join(large, "component", "left_anti").unionByName(connected_components(ties, work, "split").select("component", "node"))


def confirmed(
    sets: list[np.ndarray], signatures: np.ndarray, block: np.ndarray, percent: int
) -> list[tuple[int, int]]:
    """A spanning set of the links ``100 * intersection >= percent * union`` between
    the sets: of all pairs if ``block`` is constant, else of pairs across the two
    blocks."""
    n, width = signatures.shape
    least = least_agreement(percent, width)
    size = [len(x) for x in sets]
    starts = np.cumsum([0, *size])
    vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
    own = [ids[a:b] for a, b in itertools.pairwise(starts.tolist())]
    marked = np.zeros(len(vocabulary), bool)
    label, links = np.arange(n), []
    across = block[0] != block[-1]
    second = block != block[0]
    for i in range(n):
        if across and second[i]:
            break
        open_ = (label != label[i]) & (second if across else np.arange(n) > i)
        near = np.flatnonzero(open_)
        near = near[(signatures[near] == signatures[i]).mean(axis=1) >= least]
        if not len(near):
            continue
        marked[own[i]] = True
        for j in near.tolist():
            if label[j] != label[i]:
                common = int(np.count_nonzero(marked[own[j]]))
                if 100 * common >= percent * (size[i] + size[j] - common):
                    links.append((i, j))
                    label[label == label[j]] = label[i]
        marked[own[i]] = False
    return links


def _confirm(shingle: int, percent: int, n_minima: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in grouped(batches, 3):
            sets: list[np.ndarray] = []
            signatures = []
            for piece in W.pieces(table.column("text").combine_chunks(), W.BLANK_SEPARATED):
                found, bounds = W.shingle_sets(piece, shingle)
                full = np.flatnonzero(np.diff(bounds))  # all, unless ids repeat with other texts
                own = np.zeros((len(piece), n_minima), np.uint32)
                own[full] = minima(found, bounds[:-1][full], n_minima)
                sets += np.split(found, bounds[1:-1])
                signatures.append(own)
            nodes, block = table.column("rep"), table.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            order = order[[len(sets[i]) > 0 for i in order]]
            if len(order) < 2:
                continue
            links = confirmed([sets[i] for i in order], np.concatenate(signatures)[order], block[order], percent)
            ends = [nodes.take(pa.array(order[[p[k] for p in links]].astype(np.int64))) for k in (0, 1)] if links else []
            if links:
                yield pa.RecordBatch.from_arrays([e.combine_chunks() for e in ends], ["a", "b"])

    return run


def _found(
    spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, rows: int, bands: int
) -> DataFrame:
    """``doc_id, n_shingles, fp`` (null for an empty set) ``, mark`` (MD5 of the text)
    ``, component`` of every row.

    A class of equal sets is a node by the smallest id of its rows.  Ids of rows with
    several texts would name several classes, so there, if there are any, the text's
    mark is a part of the node.
    """
    work = Workspace(spark, "near-dedup")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    sketches = work.cut(
        source.withColumn("mark", F.md5(F.col("text").cast("binary"))).mapInArrow(
            _sketch(shingle, rows, bands),
            f"doc_id {kind}, n_shingles bigint, fp binary, keys array<bigint>, low binary, mark string",
        ),
        "sketches",
    )
    several = sketches.where("doc_id is not null and fp is not null").groupBy("doc_id")
    several = work.cut(several.agg(F.min("mark").alias("a"), F.max("mark").alias("b")).where("a < b").select("doc_id"), "several")
    plain = several.isEmpty()
    if plain:
        noded, id_of, clump_of = sketches.withColumn("node", F.col("doc_id")), lambda c: F.col(c), lambda c: F.col(c)
        right_text = F.col("rep") == F.col("doc_id")
    else:
        own = F.struct(F.col("doc_id").alias("id"), F.when(F.col("many"), F.col("mark")).alias("mark"))
        noded = sketches.join(several.withColumn("many", F.lit(True)), "doc_id", "left")
        noded = work.cut(noded.withColumn("node", F.when(F.col("doc_id").isNotNull(), own)).drop("many"), "noded")
        # two clumps of one hash are compared together, which finds no link more or less
        id_of, clump_of = lambda c: F.col(c)["id"], lambda c: F.xxhash64(c)
        right_text = (F.col("rep.id") == F.col("doc_id")) & (
            F.col("rep.mark").isNull() | (F.col("rep.mark") == F.md5(F.col("text").cast("binary")))
        )
    kind = noded.schema["node"].dataType.simpleString()
    classes = noded.where("fp is not null").groupBy("fp").agg(F.min("node").alias("rep"))
    reps = (
        noded.alias("s")
        .join(classes.alias("c"), (F.col("s.fp") == F.col("c.fp")) & (F.col("s.node") == F.col("c.rep")))
        .select("rep", "n_shingles", "keys", "low")
    )
    keyed = reps.select("rep", F.explode("keys").alias("key"))
    shared = (
        keyed.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").drop("high")
    )
    ties = keyed.join(shared, "key").where("rep <> low").select("rep", "low")
    clumps = connected_components(ties, work, "clumps")
    clumps = work.cut(_split(work, clumps, reps, least_agreement(percent, rows * bands), kind), "fine")
    members = work.cut(
        clumps.select(F.col("node").alias("rep"), clump_of("component").alias("clump"))
        .unionByName(clumps.select(F.col("component").alias("rep"), clump_of("component").alias("clump")).distinct())
        .join(reps.groupBy("rep").agg(F.max("n_shingles").alias("n")), "rep"),
        "members",
    )
    blocks = members.groupBy("clump").agg(
        F.greatest(_blocks(F.count(F.lit(1))), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).alias("m")
    )
    links = (
        # the dealt ids grow with the corpus, so they are shuffled at every size
        _dealt(members, "clump", blocks)
        .select("clump", "i", "j", "rep", "block")
        .hint("shuffle_hash")
        .join(source, right_text)
        .select("clump", "i", "j", "rep", "block", "text")
        .repartition("clump", "i", "j")
        .sortWithinPartitions("clump", "i", "j")
        .mapInArrow(_confirm(shingle, percent, rows * bands), f"a {kind}, b {kind}")
    )
    components = connected_components(links, work, "links")
    found = work.cut(
        classes.join(components, F.col("rep") == F.col("node"), "left")
        .select("fp", F.coalesce("component", "rep").alias("component"))
        .select("fp", id_of("component").alias("component")),
        "classes",
    )
    return sketches.select("doc_id", "n_shingles", "fp", "mark").join(found, "fp", "left")


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    rows: int = 6,
    bands: int = 32,
) -> DataFrame:
    """Near-duplicate components of whole texts.

    Words are the maximal runs without ASCII white space, lower-cased A-Z; a set is
    the distinct ``shingle``-word runs, or the whole sequence if shorter.  Two
    documents are linked if ``100 * |A & B| >= percent * |A | B|``.

    Returns ``id_col, n_shingles, component_id, kept``, a row per input row.
    ``component_id`` is the smallest id reachable through links, ``kept`` whether it
    is the row's own.  Null, empty and blank texts have an empty set, link with
    nothing and are kept.  Every row is judged by its own text: rows that share an id
    have one component if their sets are equal or linked, and may else differ in
    component and in ``kept``.  A row without an id has the component of the rows with
    its set, and is kept only if none of these has an id.  Other columns are not read;
    an empty table gives no rows.
    """
    found = _found(spark, docs, id_col, text_col, shingle, percent, rows, bands)
    return found.select(
        F.col("doc_id").alias(id_col),
        "n_shingles",
        F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        F.when(F.col("fp").isNull(), F.lit(True))
        .otherwise(F.col("doc_id").eqNullSafe(F.col("component")))
        .alias("kept"),
    )


def keep_one(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    rows: int = 6,
    bands: int = 32,
) -> DataFrame:
    """``docs`` without the rows that :func:`near_duplicates` does not keep.

    Rows that share an id go one by one, each by its text.  Of rows without an id go
    those whose set a row with an id has; of the others with equal sets one stays, that
    of the smallest text hash (rows of that very text are told apart by a hash of all
    columns).  All columns stay, whatever their names.
    """
    found = _found(spark, docs, id_col, text_col, shingle, percent, rows, bands)
    goes = F.coalesce(F.col("doc_id") != F.col("component"), F.lit(False))
    judged = found.where("doc_id is not null").withColumn("goes", goes)
    ids = judged.groupBy("doc_id").agg(F.min("goes").alias("every"), F.max("goes").alias("some")).where("some")
    # ids of which some rows stay have those that go by mark, the others go by id alone
    marked = judged.where("goes").join(ids.where("not every").select("doc_id"), "doc_id").select("doc_id", "mark").distinct()
    gone = ids.where("every").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("mark")).union(marked)
    packed = docs.select(F.struct("*").alias("row"))
    row_id, row_mark = F.col("row")[id_col], F.md5(F.col("row")[text_col].cast("binary"))
    goes = (row_id == F.col("id")) & (F.col("mark").isNull() | (F.col("mark") == row_mark))
    stay = packed.where(row_id.isNotNull()).join(gone.hint("shuffle_hash"), goes, "left_anti")
    nameless = found.where("doc_id is null and fp is not null").groupBy("fp").agg(F.max("component").alias("named"), F.min("mark").alias("mark"))
    first = nameless.where("named is null").select("mark")
    alone = packed.where(row_id.isNull())
    some = alone.withColumn("mark", row_mark).join(first, "mark").groupBy("mark").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    blank = alone.where(~F.coalesce(F.col("row")[text_col].rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)))
    return stay.unionByName(some.select("row")).unionByName(blank).select("row.*")
