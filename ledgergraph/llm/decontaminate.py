"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into item-sized windows of consecutive words; a window is
the set of its word shingles at their offsets.  Since a window must occur whole, a
document has to hold every one of its shingles, so the window's prefix of
``|x| - |x| + 1 = 1`` rarest shingle decides where to look:

1. every shingle of the benchmark is counted over all documents;
2. each window keeps its rarest shingle (ties by hash) as its prefix token;
3. documents are joined with the prefix tokens at word positions; the token's
   offset gives the only possible start, which must lie inside the document with
   room for the window's length; the hash of the whole window is compared and its
   words are then confirmed one by one.

The benchmark side is joined in blocks of about ``BLOCK_WINDOWS`` windows, each sent
to the workers as one broadcast of bounded size.  A pass over the documents is written
before the next block is collected, so that one block lives at a time; rows carry the
hits found so far, and more blocks mean more passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from ..functions.workspace import Workspace

#: Windows, or shingles, of the benchmark that one broadcast holds at most.
BLOCK_WINDOWS = 1 << 18
_WINDOW_SCHEMA = "item string, win binary, n int, k int, offset int, shingle bigint"


def _windows(window: int, shingle: int):
    """Item texts to a row per window and shingle in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            items = batch.column(0).to_pylist()
            for piece in W.pieces(batch.column(1), W.ALNUM):
                for t in range(len(piece)):
                    a, b = int(piece.bounds[t]), int(piece.bounds[t + 1])
                    n = min(window, b - a)
                    k = min(shingle, n)
                    words = [piece.word(i) for i in range(a, b)]
                    for s in range(b - a - n + 1) if n else ():
                        text = b" ".join(words[s : s + n])
                        for o in range(n - k + 1):
                            h = W.sequence_hash(piece.h[a + s + o : a + s + o + k])
                            rows.append((items[piece.first + t], text, n, k, o, int(h.astype(np.int64))))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                ["item", "win", "n", "k", "offset", "shingle"],
            )

    return run


class Lookup:
    """Membership of hashes in a sorted set, behind a table of their low bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.mask = np.uint64((1 << 22) - 1)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[hashes & self.mask] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose hash is in the set, and its rank there."""
        at = np.flatnonzero(self.seen[hashes & self.mask])
        if not len(at) or not len(self.hashes):
            return at[:0], at[:0]
        rank = np.searchsorted(self.hashes, hashes[at])
        rank[rank == len(self.hashes)] = 0
        same = self.hashes[rank] == hashes[at]
        return at[same], rank[same]


def _count(block: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [(k, Lookup(h)) for k, h in block.value]
        totals = [np.zeros(len(look.hashes), np.int64) for _, look in wanted]
        for batch in batches:
            for piece in W.pieces(batch.column(0), W.ALNUM):
                for (k, look), total in zip(wanted, totals, strict=True):
                    hashes, valid = piece.shingles(k)
                    at, rank = look.find(hashes)
                    total += np.bincount(rank[valid[at]], minlength=len(total))
        for (_, look), total in zip(wanted, totals, strict=True):
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(look.hashes[some].view(np.int64)), pa.array(total[some])], ["shingle", "n"]
            )

    return run


class Index:
    """Windows by prefix token: ``tokens[k]`` and, per token, its windows."""

    def __init__(self, rows: list):
        self.n = np.array([r["n"] for r in rows], np.int64)
        self.offset = np.array([r["offset"] for r in rows], np.int64)
        self.text = [bytes(r["win"]) for r in rows]
        self.items = [r["items"] for r in rows]
        whole = np.array([_text_hash(t) for t in self.text], np.uint64)
        token = np.array([r["shingle"] for r in rows], np.int64).view(np.uint64)
        k = np.array([r["k"] for r in rows], np.int64)
        self.whole, self.groups = whole, []
        for size in np.unique(k).tolist():
            at = np.flatnonzero(k == size)
            at = at[np.argsort(token[at], kind="stable")]
            tokens, first = np.unique(token[at], return_index=True)
            self.groups.append((size, tokens, np.append(first, len(at)), at))


def _text_hash(text: bytes) -> np.uint64:
    data = np.frombuffer(text, np.uint8)
    return W.sequence_hash(W.Piece(0, data, np.array([0, len(data)]), W.ALNUM).h)


def _match(block: Broadcast):
    """Add the block's hits: ``hit`` packs a bit per word, ``items`` lists ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = block.value
        groups = [(k, Lookup(tokens), first, at) for k, tokens, first, at in index.groups]
        for batch in batches:
            words = np.zeros(batch.num_rows, np.int64)
            hits = batch.column(2).to_pylist()
            items = batch.column(3).to_pylist()
            for piece in W.pieces(batch.column(1), W.ALNUM):
                words[piece.first : piece.first + len(piece)] = np.diff(piece.bounds)
                found = _occurrences(piece, index, groups)
                for doc, own in groupby(sorted(found), key=lambda x: x[0]):
                    row, size = piece.first + doc, int(words[piece.first + doc])
                    bits = np.zeros(size, bool)
                    if hits[row]:
                        bits = np.unpackbits(np.frombuffer(hits[row], np.uint8), count=size).astype(bool)
                    names = set(items[row] or ())
                    for _, start, w in own:
                        bits[start : start + int(index.n[w])] = True
                        names.update(index.items[w])
                    hits[row], items[row] = np.packbits(bits).tobytes(), sorted(names)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(hits, pa.binary()),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array(words),
                ],
                ["key", "text", "hit", "items", "n_words"],
            )

    return run


def _occurrences(piece: W.Piece, index: Index, groups: list) -> list[tuple[int, int, int]]:
    """(text, word offset in it, window) of every occurrence in the piece."""
    out: list[tuple[int, int, int]] = []
    for k, look, first, at in groups:
        hashes, valid = piece.shingles(k)
        where, rank = look.find(hashes)
        where, rank = where[valid[where]], rank[valid[where]]
        if not len(where):
            continue
        each = first[rank + 1] - first[rank]
        start = np.repeat(where, each)
        w = at[np.repeat(first[rank], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]
        doc = np.searchsorted(piece.bounds, start, side="right") - 1
        start = start - index.offset[w]
        fits = (start >= piece.bounds[doc]) & (start + index.n[w] <= piece.bounds[doc + 1])
        start, w, doc = start[fits], w[fits], doc[fits]
        for n in np.unique(index.n[w]).tolist():
            of = index.n[w] == n
            acc = np.zeros(of.sum(), np.uint64)
            for j in range(n):
                acc += piece.h[start[of] + j] * W.shingle_factor(j)
            same = W.mix(acc) == index.whole[w[of]]
            for d, s, x in zip(doc[of][same].tolist(), start[of][same].tolist(), w[of][same].tolist(), strict=True):
                if b" ".join(piece.word(i) for i in range(s, s + n)) == index.text[x]:
                    out.append((d, s - int(piece.bounds[d]), x))
    return out


def _digest():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [
                int(np.unpackbits(np.frombuffer(h, np.uint8)).sum()) if h else 0 for h in batch.column(1).to_pylist()
            ]
            items = [x or [] for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(3),
                    pa.array(hits, pa.int64()),
                    pa.array([len(x) for x in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]),
                    pa.array([h > 0 for h in hits]),
                ],
                ["key", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return run


def contamination(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    shingle: int = 5,
) -> DataFrame:
    """Words of each document that lie inside an occurrence of a benchmark window.

    Words are maximal runs of ASCII letters, digits and non-ASCII characters,
    lower-cased A-Z.  A window is ``window`` consecutive words of an item, or all
    words of an item of fewer; an item without words has none.

    Returns ``key, n_words, hit, items`` per input row: ``hit`` (binary) has a bit
    per word, most significant first, and is null without hits; ``items`` are the
    ids of items with an occurring window, as strings in order.
    ``key`` may be any column, structs included, and comes back unchanged.  Null
    and empty texts have no words.  Null item ids are left out; items with equal
    ids count as one.  Empty tables give no rows, or rows without hits.
    """
    work = Workspace(spark, "decontaminate")
    windows = work.cut(
        items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
        .where("item is not null")
        .mapInArrow(_windows(window, shingle), _WINDOW_SCHEMA)
        .distinct(),
        "windows",
    )
    texts = docs.select(F.col(text_col).alias("text"))
    context = spark.sparkContext

    counts = None
    shingles = windows.select("k", "shingle").distinct()
    parts = _parts(shingles.count())
    for part in range(parts):
        rows = shingles.where(_in_part("shingle", part, parts)).collect()
        block = [
            (k, np.unique(np.array([r["shingle"] for r in rows if r["k"] == k], np.int64).view(np.uint64)))
            for k in sorted({r["k"] for r in rows})
        ]
        sent = context.broadcast(block)
        found = texts.mapInArrow(_count(sent), "shingle bigint, n bigint")
        found = work.cut(found.groupBy("shingle").agg(F.sum("n").alias("n_docs")), f"counts-{part}")
        sent.unpersist()
        counts = found if counts is None else counts.unionByName(found)
    prefixes = (
        windows.select("win", "n", "k", "offset", "shingle")
        .distinct()
        .join(counts, "shingle", "left")
        .groupBy("win", "n", "k")
        .agg(F.min(F.struct(F.coalesce("n_docs", F.lit(0)).alias("c"), "shingle", "offset")).alias("rarest"))
        .select("win", "n", "k", "rarest.shingle", "rarest.offset")
    )
    owners = windows.groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items"))
    index = work.cut(prefixes.join(owners, "win"), "index")

    kind = docs.schema[key].dataType
    rows = docs.select(
        F.col(key).alias("key"),
        F.col(text_col).alias("text"),
        F.lit(None).cast("binary").alias("hit"),
        F.lit(None).cast("array<string>").alias("items"),
    )
    schema = T.StructType(
        [
            T.StructField("key", kind),
            T.StructField("text", T.StringType()),
            T.StructField("hit", T.BinaryType()),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("n_words", T.LongType()),
        ]
    )
    parts = _parts(index.count())
    for part in range(parts):
        sent = context.broadcast(Index(index.where(_in_part("win", part, parts)).orderBy("win").collect()))
        rows = rows.select("key", "text", "hit", "items").mapInArrow(_match(sent), schema)
        if part < parts - 1:
            rows = work.cut(rows, f"hits-{part}")
            sent.unpersist()
            if part:
                work.drop(f"hits-{part - 1}")
    return rows.select(
        F.col("key").alias(key),
        "n_words",
        "hit",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _parts(n: int) -> int:
    return max(1, -(-n // BLOCK_WINDOWS))


def _in_part(column: str, part: int, parts: int):
    return F.pmod(F.xxhash64(column), F.lit(parts)) == part


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digest of :func:`contamination`'s rows: ``key, n_words, n_hit,
    n_items, items_sha256`` (of the comma-joined ids) ``, contaminated``."""
    schema = T.StructType([T.StructField("key", found.schema[key].dataType)]).add("n_words", "long")
    schema = schema.add("n_hit", "long").add("n_items", "long").add("items_sha256", "string").add("contaminated", "boolean")
    return (
        found.select(F.col(key).alias("key"), "hit", "items", "n_words")
        .mapInArrow(_digest(), schema)
        .withColumnRenamed("key", key)
    )


def remove_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; all columns stay."""
    packed = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    found = contamination(spark, packed, items, key="row", text_col="text", **options)
    return found.where("hit is null").select("row.*")
