"""Words and word shingles of Arrow string batches as numpy hashes.

Texts are handled as UTF-8 bytes.  Both word classes in use are unions of byte
values (every byte of a non-ASCII character is a word byte), so boundaries,
ASCII lower-casing and a 64-bit hash of every word come out of a few table
look-ups and one prefix sum over the bytes, without a Python object per word.

A word's hash is ``sum(T[byte] * R**offset) mod 2**64`` for a fixed random table
``T`` and an odd ``R``, put through a bit mixer; shingles combine mixed word
hashes with fixed odd factors.  Batches are cut into pieces of bounded size, and
only a single text longer than a piece makes a larger one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE_BYTES = 1 << 20
_R = U(0x9E3779B97F4A7C15)
_SEED = 20240229


def _class(chars: list[tuple[int, int]]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    for lo, hi in chars:
        table[lo : hi + 1] = False
    return table


#: Bytes of words separated by ASCII white space: ``[^\x20\x09-\x0D]+``.
BLANK_SEPARATED = _class([(0x20, 0x20), (0x09, 0x0D)])
#: Bytes of alphanumeric words: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM = _class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    table = np.random.default_rng(_SEED).integers(1, 2**64, 256, dtype=U)
    table[0x41:0x5B] = table[0x61:0x7B]
    return table


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``R**i`` and ``R**-i`` (mod 2**64) for ``i`` up to ``n``; kept per process."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n, PIECE_BYTES) + 1
        inverse = U(pow(int(_R), -1, 2**64))
        _powers[:] = [
            np.cumprod(np.concatenate([np.ones(1, U), np.full(size, f, U)]), dtype=U)
            for f in (_R, inverse)
        ]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    x ^= x >> U(33)
    return x


class Piece:
    """Some consecutive texts: ``h`` the hash of each word, ``start``/``end`` its
    bytes in ``data``, ``bounds[i]:bounds[i+1]`` the words of text ``i``."""

    __slots__ = ("first", "data", "h", "start", "end", "bounds")

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
        n = len(data)
        self.first, self.data = first, data
        inside = word_bytes[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        edge = offsets[(offsets > 0) & (offsets < n)]  # texts adjoin without a separator
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        power, inverse = _power_tables(n)
        sums = np.empty(n + 1, U)
        sums[0] = 0
        np.cumsum(_byte_values()[data] * power[:n], out=sums[1:])
        self.h = mix((sums[self.end] - sums[self.start]) * inverse[self.start])
        self.bounds = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all ``k`` consecutive words at every word position, and which
        of these positions lie within one text."""
        n = len(self.h)
        out = np.zeros(n, U)
        if n < k:
            return out, np.zeros(n, bool)
        acc = np.zeros(n - k + 1, U)
        for j in range(k):
            acc += self.h[j : n - k + 1 + j] * shingle_factor(j)
        out[: n - k + 1] = mix(acc)
        counts = np.diff(self.bounds)
        left = np.repeat(self.bounds[1:], counts) - np.arange(n)
        return out, left >= k

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes().lower()


@lru_cache(maxsize=64)
def shingle_factor(j: int) -> np.uint64:
    return U(int(np.random.default_rng(_SEED + 1 + j).integers(0, 2**63)) * 2 + 1)


def sequence_hash(h: np.ndarray) -> np.uint64:
    """The hash that :meth:`Piece.shingles` gives to these words in a row."""
    acc = np.zeros(1, U)
    for j in range(len(h)):
        acc += h[j : j + 1] * shingle_factor(j)
    return mix(acc)[0]


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the ``n + 1`` offsets of ``n`` texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    if not len(offsets):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(texts: pa.Array, word_bytes: np.ndarray, limit: int | None = None) -> Iterator[Piece]:
    """Cut ``texts`` into pieces of at most ``limit`` bytes, or of one longer text."""
    limit = PIECE_BYTES if limit is None else limit
    data, offsets = utf8(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield Piece(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], word_bytes)
        i = j


def shingle_sets(piece: Piece, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``k``-word shingle hashes of each text, one after another,
    and their ``n + 1`` bounds.  A text of fewer words, but not none, has its whole
    sequence as its one shingle."""
    hashes, valid = piece.shingles(k)
    out, bounds = [], [0]
    for a, b in zip(piece.bounds[:-1].tolist(), piece.bounds[1:].tolist(), strict=True):
        if b - a >= k:
            found = np.unique(hashes[a : b - k + 1])
        elif b > a:
            found = np.array([sequence_hash(piece.h[a:b])], U)
        else:
            found = hashes[:0]
        out.append(found)
        bounds.append(bounds[-1] + len(found))
    return (np.concatenate(out) if out else hashes[:0]), np.array(bounds)


def name_slot(name: str, slots: int) -> int:
    """A stable slot below ``slots`` for a name."""
    return zlib.crc32(name.encode()) % slots
