"""Language identification by bit-sliced Bloom filters of byte n-grams.

Every language has a Bloom filter of the n-grams that most of its training
documents share.  The filters are stored sliced: slot ``i`` of the table holds bit
``i`` of all languages' filters as one mask, so ``k`` look-ups and an AND return the
set of languages that contain an n-gram.  A text's n-grams give each language a
count of set bits; with ``f`` the filter's false-positive rate, measured from its
fill, the count is corrected to ``(hits - n * f) / (1 - f)``, and the language of
the largest corrected count is the answer.

N-grams are 4 bytes of the lower-cased text in which every ASCII character that is
not a letter becomes a blank and two blanks stand at either end; one without a
letter byte is no n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from ..functions.workspace import Workspace, small_batches

#: Bound on training documents of a language, on n-grams of its filter, and slots.
SAMPLE_DOCS = 2000
FILTER_GRAMS = 1 << 14
SLOTS = 1 << 20
PROBES = 3
PIECE_BYTES = 1 << 20
_TO_BLANK = np.full(256, 0x20, np.uint8)
_TO_BLANK[0x61:0x7B] = np.arange(0x61, 0x7B)
_TO_BLANK[0x80:] = np.arange(0x80, 0x100)
UNDETERMINED = "und"


def grams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, n-gram codes, ``n + 1`` bounds) for runs of texts."""
    blank = pa.scalar("  ", pa.large_string())
    lowered = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    padded = pc.binary_join_element_wise(blank, lowered, blank, pa.scalar("", pa.large_string()))
    data, offsets = W.utf8(padded)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + PIECE_BYTES, side="right")) - 1
        j = min(n, max(j, i + 1))
        b = _TO_BLANK[data[offsets[i] : offsets[j]]]
        own = offsets[i : j + 1] - offsets[i]
        wide = b.astype(np.uint32)
        code = wide[:-3] | (wide[1:-2] << 8) | (wide[2:-1] << 16) | (wide[3:] << 24)
        good = code != 0x20202020
        for back in range(1, 4):  # n-grams over the end of a text
            good[own[1:-1] - back] = False
        at = np.flatnonzero(good)
        yield i, code[at], np.searchsorted(at, own)
        i = j


def _slots(code: np.ndarray, probe: int, slots: int) -> np.ndarray:
    factor = np.uint64([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93][probe])
    shift = np.uint64(64 - (slots - 1).bit_length())
    return (((code.astype(np.uint64) + np.uint64(probe + 1)) * factor) >> shift).astype(np.int64)


class LanguageFilters:
    """The sliced filters: ``planes[p][slot]`` holds the bits of 64 languages (of 8,
    16 or 32 if there are no more)."""

    def __init__(self, languages: list[str], members: list[np.ndarray], slots: int = SLOTS, probes: int = PROBES):
        self.languages, self.slots, self.probes = languages, slots, probes
        bits = next((b for b in (8, 16, 32) if len(languages) <= b), 64)
        self.bits, kind = bits, np.dtype(f"uint{bits}")
        self.planes = np.zeros((-(-max(1, len(languages)) // bits), slots), kind)
        self.false_positive = np.zeros(len(languages))
        for i, codes in enumerate(members):
            plane, bit = self.planes[i // bits], kind.type(1 << (i % bits))
            for p in range(probes):
                plane[_slots(codes, p, slots)] |= bit
            self.false_positive[i] = np.mean((plane & bit) != 0) ** probes

    def masks(self, code: np.ndarray) -> np.ndarray:
        """The languages that contain each n-gram, as bits in a row per plane."""
        at = _slots(code, 0, self.slots)
        out = self.planes[:, at]
        for p in range(1, self.probes):
            out &= self.planes[:, _slots(code, p, self.slots)]
        return out

    def score(self, code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Corrected share of each text's n-grams in each language, 0 to 1."""
        n = np.diff(bounds)
        full = np.flatnonzero(n > 0)
        out = np.zeros((len(n), len(self.languages)))
        if not len(full):
            return out
        masks = self.masks(code)
        for i, f in enumerate(self.false_positive):
            hit = (masks[i // self.bits] >> masks.dtype.type(i % self.bits)) & masks.dtype.type(1)
            hits = np.add.reduceat(hit, bounds[:-1][full], dtype=np.int64)
            out[full, i] = np.maximum(0.0, (hits - n[full] * f) / (1 - f)) / n[full] if f < 1 else 0.0
        return np.minimum(out, 1.0)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = np.array(batch.column(0).to_pylist(), object)
        for first, code, bounds in grams(batch.column(1)):
            own = names[first : first + len(bounds) - 1]
            for name in sorted(set(own)):
                sets = [np.unique(code[bounds[i] : bounds[i + 1]]) for i in np.flatnonzero(own == name)]
                found, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n)],
                    ["lang", "gram", "n"],
                )


def fit(
    spark: SparkSession,
    labelled: DataFrame,
    sample_docs: int = SAMPLE_DOCS,
    filter_grams: int = FILTER_GRAMS,
    slots: int = SLOTS,
    probes: int = PROBES,
) -> LanguageFilters:
    """Learn from ``labelled`` (``key, text, lang``; null languages and texts teach
    nothing).

    At most ``sample_docs`` different documents of each language, those of the
    smallest hash of key and text, are read whole; their ``filter_grams`` n-grams of highest document
    frequency (ties by code) make the filter.  The driver gets one row per language
    and at most ``filter_grams`` per filter.
    """
    # the text is hashed too, so that null and repeated keys fall apart
    rows = labelled.where("lang is not null and text is not null").withColumn("h", F.xxhash64("key", "text"))
    # of a uniform hash, four times the sample is left for the exact cut, however large the language
    counted = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("all"))
    low = F.col("h").cast("double") / F.lit(2.0**64) + 0.5 < F.lit(4.0 * sample_docs) / F.col("all")
    by_hash = Window.partitionBy("lang").orderBy("h")
    cuts = (
        rows.select("lang", "h")
        .join(F.broadcast(counted), "lang")  # a row per language, each of which gets a filter on the driver
        .where(low)
        .distinct()
        .withColumn("i", F.row_number().over(by_hash))
        .where(F.col("i") <= sample_docs)
        .groupBy("lang")
        .agg(F.max("h").alias("cut"), F.count(F.lit(1)).alias("n"))
    )
    work = Workspace(spark, "language")
    cuts = work.cut(cuts, "cuts")
    # repeated rows teach once, so a language's sample stays within its bound
    sample = (
        rows.join(F.broadcast(cuts), "lang").where("h <= cut").groupBy("lang", "h").agg(F.first("text").alias("text"))
        .select("lang", "text")
    )
    counts = sample.mapInArrow(_document_frequencies, "lang string, gram bigint, n bigint")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    chosen = counts.withColumn("i", F.row_number().over(best)).where(F.col("i") <= filter_grams)
    members: dict[str, list[int]] = {}
    for row in chosen.select("lang", "gram").collect():
        members.setdefault(row["lang"], []).append(row["gram"])
    # equal scores go to the language with more training documents, then the smaller name
    size = {r["lang"]: r["n"] for r in cuts.collect()}
    order = sorted(size, key=lambda x: (-size[x], x))
    return LanguageFilters(order, [np.array(members.get(x, []), np.uint32) for x in order], slots, probes)


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: LanguageFilters = model.value
        names = np.array([*filters.languages, UNDETERMINED], object)
        for batch in batches:
            lettered = pc.fill_null(pc.match_substring_regex(batch.column(1), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best = np.full(batch.num_rows, len(names) - 1)
            top = np.zeros(batch.num_rows)
            for first, code, bounds in grams(batch.column(1)) if filters.languages else ():
                shares = filters.score(code, bounds)
                best[first : first + len(shares)] = shares.argmax(axis=1)
                top[first : first + len(shares)] = shares.max(axis=1)
            best[~lettered], top[~lettered] = len(names) - 1, 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[best], pa.string()), pa.array(top)], ["key", "lang_pred", "score"]
            )

    return run


def predict(
    spark: SparkSession, filters: LanguageFilters, docs: DataFrame, key: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``key, lang_pred, score`` of whole texts; nothing but the text is looked at.

    ``score`` is the corrected share of the text's n-grams in the language's filter.
    A null text, or one without a letter, is ``und`` with score 0; so is every text
    if nothing was learnt.  ``key`` may be any column, structs included.  The
    filters are broadcast: ``SLOTS`` masks for each 64 languages.
    """
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType)]).add("lang_pred", "string").add("score", "double")
    small_batches(spark)
    model = spark.sparkContext.broadcast(filters)
    return (
        docs.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
        .mapInArrow(_predict(model), schema)
        .withColumnRenamed("key", key)
    )


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options
) -> DataFrame:
    """``id_col, held_out, lang_pred, score`` of every row, learnt from the labelled
    rows that are not held out.  Rows without an id are not held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    filters = fit(spark, rows.where(~held_out("id")).select(F.col("id").alias("key"), "text", "lang"), **options)
    found = predict(spark, filters, rows, key="id")
    return found.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score")


def keep_identified(
    spark: SparkSession,
    docs: DataFrame,
    min_score: float = 0.1,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """``docs`` without rows whose language is ``und`` or scores below ``min_score``;
    all columns stay as they are."""
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    filters = fit(spark, rows.where(~held_out("key")))
    packed = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    found = predict(spark, filters, packed, key="row")
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score)).select("row.*")
