"""Token ids in fixed-width bit-packed segments.

Every id takes the fewest bits that hold the vocabulary.  64 ids fill ``width``
little-endian 64-bit words, so packing and unpacking are a handful of shifts over
whole numpy columns.  A segment is one binary value::

    8 bytes   magic "LGTOKEN1"
    u32 x 2   width, ids in a block
    u64 x 2   number of ids, number of documents
    u64 x B+1 byte offset of each block in the payload, and its end
    u64 x D   id offset at which each document ends
    payload   blocks of packed words

and the Parquet table that holds them has, per segment, its partition, its place
and number of ids there, and the documents' ids.  A segment can be unpacked alone,
and any id range by its blocks alone.  Spark's writer commits whole tasks, so a
lost executor leaves no torn segment.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from ..functions.workspace import Workspace

MAGIC = b"LGTOKEN1"
BLOCK_IDS = 4096
#: A segment is closed once it holds so many ids (a longer document makes a longer one).
SEGMENT_IDS = 1 << 16
#: Distinct chunks, and their characters, that a worker remembers before it forgets all
#: but those of the text at hand.
CACHE_CHUNKS = 300_000
CACHE_CHARS = 8 << 20
PIECE_BYTES = 1 << 21


def width_of(vocabulary: int) -> int:
    """Bits that hold ids below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> np.ndarray:
    """Ids below ``2**width`` as 64-bit words; padded with zeros to 64 ids."""
    groups = -(-len(ids) // 64)
    padded = np.zeros((groups, 64), np.uint64)
    padded.ravel()[: len(ids)] = ids
    out = np.zeros((groups, width), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[:, word] |= padded[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= padded[:, j] >> np.uint64(64 - shift)
    return out.ravel()


def unpack(words: np.ndarray, width: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed words."""
    packed = words.reshape(-1, width)
    out = np.empty((len(packed), 64), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        value = packed[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (packed[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = value & mask
    return out.ravel()[:n]


def write_segment(ids: np.ndarray, ends: np.ndarray, width: int, block_ids: int = BLOCK_IDS) -> bytes:
    """``block_ids`` must be a multiple of 64."""
    words = pack(ids, width).astype("<u8").tobytes()
    blocks = -(-len(ids) // block_ids)
    offsets = np.minimum(np.arange(blocks + 1) * (block_ids // 64 * width * 8), len(words)).astype("<u8")
    head = np.array([width, block_ids], "<u4").tobytes() + np.array([len(ids), len(ends)], "<u8").tobytes()
    return MAGIC + head + offsets.tobytes() + np.asarray(ends).astype("<u8").tobytes() + words


class Segment:
    """Random access to a written segment."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token segment")
        self.data = data
        self.width, self.block_ids = (int(x) for x in np.frombuffer(data, "<u4", 2, 8))
        self.n_ids, docs = (int(x) for x in np.frombuffer(data, "<u8", 2, 16))
        blocks = -(-self.n_ids // self.block_ids)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, 32).astype(np.int64)
        self.ends = np.frombuffer(data, "<u8", docs, 32 + 8 * (blocks + 1)).astype(np.int64)
        self.payload = 32 + 8 * (blocks + 1) + 8 * docs

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``end`` (exclusive), from the blocks that hold them."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        if start >= end:
            return np.zeros(0, np.uint32)
        a, b = start // self.block_ids, -(-end // self.block_ids)
        size = int(self.offsets[b] - self.offsets[a])
        words = np.frombuffer(self.data, "<u8", size // 8, self.payload + int(self.offsets[a]))
        first = a * self.block_ids
        return unpack(words, self.width, min(self.n_ids, b * self.block_ids) - first)[start - first : end - first]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


_BLANKS = np.arange(256, dtype=np.uint8)
_BLANKS[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20
_LOWERED = _BLANKS.copy()
_LOWERED[0x41:0x5B] = _BLANKS[0x61:0x7B]


def _parted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blank the ASCII white space and set a comma or full stop apart from a Latin
    letter that it ends, so that fewer distinct chunks are left.  A letter and a mark
    never share a pre-token, so the ids stay the same."""
    n = len(data)
    if n < 3:
        return data, offsets
    mark = (data == 0x2C) | (data == 0x2E)
    ends = np.ones(n, bool)
    ends[:-1] = data[1:] == 0x20
    letter = np.zeros(n, bool)
    letter[1:] = (data[:-1] >= 0x61) & (data[:-1] <= 0x7A)
    letter[2:] |= (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
    at = np.flatnonzero(mark & ends & letter)
    return np.insert(data, at, 0x20), offsets + np.searchsorted(at, offsets)


class Encoder:
    """Texts to ids, encoding each distinct blank-separated chunk once.

    For a tokenizer that drops white space and merges only within what lies between,
    a text's ids are those of its chunks in order.  Unknown chunks go to the library
    many at a time, set apart by a control character whose single id marks the cuts;
    chunks that hold this character go alone.  If the tokenizer lower-cases, A-Z are
    lowered beforehand, but not in texts that may hold a special token's name.
    """

    MARK = "\x01"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        normalizer = self.tokenizer.normalizer
        self.lowers = normalizer is not None and normalizer.normalize_str("ABCXYZ") == "abcxyz"
        names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = names if all(len(x) > 1 for x in names) else [""]
        self._reset()

    def _reset(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = self.chars = 0
        self.first, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _remember(self, chunks: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        k, n = len(self.place), len(chunks)
        while k + n > len(self.first):
            self.first, self.length = np.append(self.first, self.first), np.append(self.length, self.length)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.append(self.pool, self.pool)
        self.length[k : k + n] = lengths
        self.first[k : k + n] = self.used + np.cumsum(lengths) - lengths
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.chars += sum(map(len, chunks))
        self.place.update(zip(chunks, range(k, k + n), strict=True))

    def _forget_others(self, chunks: list[str]) -> None:
        kept = [c for c in chunks if c and c in self.place]
        at = np.array([self.place[c] for c in kept], np.int64)
        length = self.length[at]
        ids = self.pool[np.repeat(self.first[at] - np.cumsum(length) + length, length) + np.arange(length.sum())]
        self._reset()
        self._remember(kept, ids, length)

    def _learn(self, chunks: list[str]) -> None:
        plain = [c for c in chunks if self.mark is not None and self.MARK not in c]
        for i in range(0, len(plain), 2048):
            some = plain[i : i + 2048]
            ids = self._encode(f" {self.MARK} ".join([*some, ""]))
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(some):
                raise ValueError("the mark does not part chunks in this tokenizer")
            self._remember(some, np.delete(ids, cuts), np.diff(cuts, prepend=-1) - 1)
        for c in set(chunks) - set(plain):
            ids = self._encode(c)
            self._remember([c], ids, np.array([len(ids)]))

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids, ids per text) for runs of texts of bounded size."""
        data, offsets = W.utf8(texts)
        i, n = 0, len(offsets) - 1
        while i < n:
            j = int(np.searchsorted(offsets, offsets[i] + PIECE_BYTES, side="right")) - 1
            j = min(n, max(j, i + 1))
            own = offsets[i : j + 1] - offsets[i]
            raw = data[offsets[i] : offsets[j]]
            heads = {x[:2].encode() for x in self.special}
            text = raw.tobytes()
            lower = self.lowers and not any(h in text for h in heads)
            blank, own = _parted((_LOWERED if lower else _BLANKS)[raw], own)
            strings = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(own.astype(np.int64)), pa.py_buffer(blank))
            lists = pc.split_pattern(strings, " ")
            coded = lists.flatten().dictionary_encode()
            known = coded.dictionary.to_pylist()
            if len(self.place) > CACHE_CHUNKS or self.chars > CACHE_CHARS:
                self._forget_others(known)
            places = list(map(self.place.get, known))
            new = [k for k, x in enumerate(places) if x is None]
            if new:
                self._learn([known[k] for k in new])
                for k in new:
                    places[k] = self.place[known[k]]
            at = np.array(places, np.int64)[coded.indices.to_numpy()]
            length = self.length[at]
            total = np.concatenate([[0], np.cumsum(length)])
            index = np.repeat(self.first[at] - total[:-1], length)
            index += np.arange(total[-1])
            bounds = total[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            yield i, self.pool[index], np.diff(bounds)
            i = j


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _segments(path: str, end_id: int, vocabulary: int, doc_kind: pa.DataType | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc, width = encoder(path), width_of(vocabulary)
        part, before = TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal before, held, size
            ids = np.concatenate([x[1] for x in held])
            ends = np.cumsum(np.concatenate([x[2] for x in held]))
            names = pa.concat_arrays([x[0] for x in held])
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([before], pa.int64()),
                    pa.array([len(ids)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
                    pa.array([write_segment(ids, ends, width)], pa.binary()),
                ],
                ["part", "before", "n_ids", "doc_ids", "segment"],
            )
            before, held, size = before + len(ids), [], 0
            return row

        for batch in batches:
            for first, ids, counts in enc.encode(batch.column(1)):
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
                names = batch.column(0).slice(first, len(counts))
                bounds = np.concatenate([[0], np.cumsum(counts)])
                a = 0
                while a < len(counts):  # as many documents as fill the segment
                    b = int(np.searchsorted(bounds, bounds[a] + SEGMENT_IDS - size))
                    b = min(max(b, a + 1), len(counts))
                    held.append((names.slice(a, b - a), ids[bounds[a] : bounds[b]], counts[a:b]))
                    size += int(bounds[b] - bounds[a])
                    if size >= SEGMENT_IDS:
                        yield close()
                    a = b
        if held:
            yield close()

    return run


def _read(bases: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                segment = Segment(batch.column(4)[r].as_buffer().to_pybytes())
                ids = segment.ids().astype("<u4").tobytes()
                start = bases[batch.column(0)[r].as_py()] + batch.column(1)[r].as_py()
                begins = np.concatenate([[0], segment.ends[:-1]])
                crc = [
                    zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(begins.tolist(), segment.ends.tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(3)[r].values,
                        pa.array(begins + start, pa.int64()),
                        pa.array(segment.ends - begins, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def write_tokens(
    spark: SparkSession,
    docs: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    vocabulary: int | None = None,
    order: list[Column] | None = None,
) -> None:
    """Write the ids of all documents, each followed by ``end_id``, as a table of
    segments below ``path``; ``part`` and then ``before`` order them by the columns
    ``order``, without these by ascending document id (null first, equal ids by a hash
    of the text, so that these can lie in several parts).  ``tokenizer`` is the path of
    a white-space-dropping tokenizer on every machine."""
    if vocabulary is None:
        vocabulary = max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1)
    kind = docs.schema[id_col].dataType
    schema = (
        T.StructType().add("part", "integer").add("before", "long").add("n_ids", "long")
        .add("doc_ids", T.ArrayType(kind)).add("segment", "binary")
    )
    keys = order or [F.col(id_col), F.xxhash64(text_col)]
    names = [f"k{i}" for i in range(len(keys))]
    by = [F.col(n).asc_nulls_first() for n in names]
    (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[k.alias(n) for k, n in zip(keys, names, strict=True)])
        .repartitionByRange(*by)
        .sortWithinPartitions(*by, "text")
        .select("doc_id", "text")
        .mapInArrow(_segments(tokenizer, end_id, vocabulary), schema)
        .write.mode("overwrite")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, start, n_tokens, ids_crc32`` of every document in written segments.

    Only a total per partition comes to the driver, for the first id of each.
    """
    segments = spark.read.parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    bases, total = {}, 0
    for row in totals:
        bases[row["part"]] = total
        total += row["n"]
    kind = segments.schema["doc_ids"].dataType.elementType
    schema = T.StructType().add("doc_id", kind).add("start", "long").add("n_tokens", "long").add("ids_crc32", "long")
    return (
        segments.select("part", "before", "n_ids", "doc_ids", "segment")
        .mapInArrow(_read(bases), schema)
        .withColumnRenamed("doc_id", id_col)
    )


def token_output(
    spark: SparkSession, docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """Write all documents' ids and read them back: :func:`read_tokens`'s rows.

    A null or empty text has the end id alone.  Repeated rows are written as often
    as they occur; other columns are not read; an empty table gives no rows.
    """
    path = f"{Workspace(spark, 'tokens').path}/segments"
    write_tokens(spark, docs, path, tokenizer, id_col, text_col, **options)
    return read_tokens(spark, path, id_col)
