"""Document quality by co-training a text view and a metadata view.

The content view sees the text alone (shape statistics and hashed word counts), the
metadata view sees source, language and length alone.  Starting from labelled
documents, each round calibrates both views on labelled documents kept apart, and lets
either label the unlabelled documents it is surest of for the other view's next training
set: of each class the ``SHARE`` of largest calibrated logit, counted over all of them,
where that logit is on the class's side.  In the end both are calibrated again, a small
logistic model on the two calibrated logits combines them, and every document is scored.

Only labelled documents are a bounded sample: at most ``LABELLED``, those of the
smallest id hash, whose features come to the driver (of a repeated id those of one row).  Unlabelled ones stay in Spark:
the content view is fitted on gradients and curvatures that tasks add up, the
metadata view on counts by its slots, of which there are at most 24 576.  Within a
class, pseudo-labelled documents weigh together at most as much as labelled ones times
their mean calibrated certainty (twice the probability less one), so a view that knows
little teaches little.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from ..functions.workspace import Workspace

LABELLED = 4000
ROUNDS = 4
#: The share of unlabelled documents that a view labels of each class; ties go whole.
SHARE = 0.1
#: Classes of equal width that calibrated logits are counted by, and their range.
_BINS, _REACH = 4096, 32.0
_HASHED = 192
_SHAPES = 10
CONTENT_DIM = _SHAPES + _HASHED
_SOURCES, _LANGS, _LENGTHS = 64, 16, 24
META_DIM = _SOURCES + _LANGS + _LENGTHS

#: Newton steps of a fit that reads the unlabelled documents, and the change that ends it;
#: and the tasks that add up what all tasks found.
_STEPS, _SETTLED, _ADDERS = 16, 1e-4, 4

_LINES = np.ones(256, bool)
_LINES[0x0A] = False


def _byte_class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_CLASSES = [
    _byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    _byte_class("0123456789"),
    _byte_class("#*$%&|<>{}[]\\^~_=+/"),
    _byte_class("!?"),
    _byte_class(".,;:"),
]


def _distinct_share(piece: W.Piece) -> np.ndarray:
    out = np.zeros(len(piece))
    for i, (a, b) in enumerate(zip(piece.bounds[:-1].tolist(), piece.bounds[1:].tolist(), strict=True)):
        if b > a:
            out[i] = len(np.unique(piece.h[a:b])) / (b - a)
    return out


def content_features(texts: pa.Array) -> np.ndarray:
    """A row of ``CONTENT_DIM`` numbers per text; a null text counts as empty."""
    rows = []
    for piece in W.pieces(texts, W.BLANK_SEPARATED):
        n = len(piece)
        counts = np.diff(piece.bounds)
        shapes = np.zeros((n, _SHAPES))
        # bytes of each class from the first word to the last of a text
        full = np.flatnonzero(counts > 0)
        begin = np.zeros(n, np.int64)
        end = np.zeros(n, np.int64)
        begin[full], end[full] = piece.start[piece.bounds[:-1][full]], piece.end[piece.bounds[1:][full] - 1]
        size = np.maximum(end - begin, 1)
        for j, table in enumerate(_CLASSES):
            sums = np.concatenate([[0], np.cumsum(table[piece.data])])
            shapes[:, j] = (sums[end] - sums[begin]) / size
        shapes[:, 5] = size / np.maximum(counts, 1) / 10
        shapes[:, 6] = np.log1p(counts) / 10
        shapes[:, 7] = _distinct_share(piece)
        shapes[:, 9] = 1.0
        hashed = np.zeros((n, _HASHED))
        if len(piece.h):
            doc = np.repeat(np.arange(n), counts)
            slot = (piece.h >> np.uint64(40)).astype(np.int64) % _HASHED
            hashed = np.bincount(doc * _HASHED + slot, minlength=n * _HASHED).reshape(n, _HASHED)
            hashed = np.sqrt(hashed / np.maximum(counts, 1)[:, None])
        rows.append(np.hstack([shapes, hashed]))
    out = np.concatenate(rows) if rows else np.zeros((0, CONTENT_DIM))
    lines = [_distinct_share(p) for p in W.pieces(texts, _LINES)]
    out[:, 8] = np.concatenate(lines) if lines else 0.0
    return out


def meta_slots(sources: pa.Array, langs: pa.Array, lengths: pa.Array) -> np.ndarray:
    """Columns of hashed source and language (null is a value) and length class."""
    out = np.zeros((len(sources), 3), np.int64)
    for j, (values, first, size) in enumerate(((sources, 0, _SOURCES), (langs, _SOURCES, _LANGS))):
        coded = values.dictionary_encode()
        slots = [W.name_slot(x, size) for x in coded.dictionary.to_pylist()]
        index = coded.indices.fill_null(len(slots)).to_numpy()
        out[:, j] = first + np.array([*slots, size - 1])[index]
    length = np.array([0 if x is None else max(0, int(x)) for x in lengths.to_pylist()])
    out[:, 2] = _SOURCES + _LANGS + np.minimum(np.log2(length + 1).astype(int), _LENGTHS - 1)
    return out


def one_hot(slots: np.ndarray) -> np.ndarray:
    out = np.zeros((len(slots), META_DIM))
    out[np.arange(len(slots))[:, None], slots] = 1.0
    return out


def meta_features(sources: pa.Array, langs: pa.Array, lengths: pa.Array) -> np.ndarray:
    """``meta_slots`` as ones among ``META_DIM`` numbers."""
    return one_hot(meta_slots(sources, langs, lengths))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Weights (the last for a constant) by Newton's method with a ridge penalty,
    classes weighted alike."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    share = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-9
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (share * (p - y)) + ridge * w
        curve = (x * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve + 1e-9 * np.eye(len(w)), slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class CoTrained:
    """Weights of both views, their calibrations (slope, offset), and the mix of
    calibrated logits."""

    content: np.ndarray
    meta: np.ndarray
    calibration: np.ndarray
    mix: np.ndarray
    #: By round: documents that the content view, then the metadata view labelled bad and good.
    exchanged: list[tuple[int, int, int, int]] = field(default_factory=list)

    def scores(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Columns: combined, content and metadata probability."""
        views = self._calibrated(content, meta)
        return np.column_stack([sigmoid(logits(views, self.mix)), sigmoid(views)])

    def _calibrated(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        raw = np.column_stack([logits(content, self.content), logits(meta, self.meta)])
        return raw * self.calibration[:, 0] + self.calibration[:, 1]


class Sums:
    """Per class (0, 1): rows, and value, gradient and curvature of the logistic loss."""

    def __init__(self, dim: int):
        self.n, self.loss, self.slope, self.curve = np.zeros(2), np.zeros(2), np.zeros((2, dim)), np.zeros((2, dim, dim))

    def add(self, x: np.ndarray, label: int, w: np.ndarray, times: np.ndarray | float = 1.0) -> None:
        """Rows ``x`` (without the constant), each counted ``times``."""
        x = np.hstack([x, np.ones((len(x), 1))])
        times = np.broadcast_to(times, len(x))
        p = sigmoid(x @ w)
        self.n[label] += times.sum()
        self.loss[label] += times @ np.logaddexp(0.0, x @ w if label == 0 else -(x @ w))
        self.slope[label] += x.T @ (times * (p - label))
        self.curve[label] += (x * (times * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x

    def to_bytes(self) -> bytes:
        return b"".join(x.astype("<f8").tobytes() for x in (self.n, self.loss, self.slope, self.curve))

    def merge(self, data: bytes) -> None:
        found, at = np.frombuffer(data, "<f8"), 0
        for x in (self.n, self.loss, self.slope, self.curve):
            x += found[at : at + x.size].reshape(x.shape)
            at += x.size


def fit_both(x: np.ndarray, y: np.ndarray, free, w: np.ndarray, trust: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """``fit_logistic`` from ``w`` on, with the rows whose :class:`Sums` at given weights
    are ``free(weights)``; these count together at most ``trust`` (by class) times as much
    as their class in ``y``.  A step that raises the loss is halved."""
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-9
    best, step = np.inf, np.zeros(len(w))
    for _ in range(_STEPS):
        known, more = Sums(len(w)), free(w)
        if not more.n.any():
            return fit_logistic(x, y, penalty)
        for label in (0, 1):
            known.add(x[y == label], label, w)
        loss, slope, curve = ridge @ (w * w) / 2, ridge * w, np.diag(ridge) + 1e-9 * np.eye(len(w))
        for label in (0, 1):
            each = min(1.0, trust[label] * known.n[label] / max(more.n[label], 1.0))
            share = 0.5 / (known.n[label] + each * more.n[label])
            loss += share * (known.loss[label] + each * more.loss[label])
            slope = slope + share * (known.slope[label] + each * more.slope[label])
            curve = curve + share * (known.curve[label] + each * more.curve[label])
        if loss > best:
            step = step / 2
            w = w + step
            continue
        best, step = loss, np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < _SETTLED:
            return w
    logging.getLogger(__name__).warning("a fit stopped after %d steps, the last of %.2g", _STEPS, np.abs(step).max())
    return w


def _bin(z: np.ndarray) -> np.ndarray:
    return np.clip(((z + _REACH) * (_BINS / (2 * _REACH))).astype(np.int64), 0, _BINS - 1)


@dataclass
class Sure:
    """What a view is surest of: calibrated logits up to bin ``low`` are bad, those from
    bin ``high`` on good; with the documents and the mean certainty of either class."""

    low: int
    high: int
    n: np.ndarray
    trust: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, share: float) -> Sure:
        """From the number of documents by bin; a class with none has no certainty."""
        wanted, middle = share * counts.sum(), _BINS // 2
        low = min(int(np.searchsorted(np.cumsum(counts), wanted)), middle - 1)
        high = max(_BINS - 1 - int(np.searchsorted(np.cumsum(counts[::-1]), wanted)), middle)
        certain = np.abs(2 * sigmoid((np.arange(_BINS) + 0.5) * (2 * _REACH / _BINS) - _REACH) - 1)
        n = np.array([counts[: low + 1].sum(), counts[high:].sum()], float)
        sums = np.array([(counts * certain)[: low + 1].sum(), (counts * certain)[high:].sum()])
        return cls(low, high, n, sums / np.maximum(n, 1.0))

    def labels(self, z: np.ndarray) -> list[tuple[int, np.ndarray]]:
        bins = _bin(z)
        return [(0, np.flatnonzero(bins <= self.low)), (1, np.flatnonzero(bins >= self.high))]


def calibrated(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The weights whose logits are those of ``w``, calibrated on ``x, y``."""
    slope, offset = fit_logistic(logits(x, w)[:, None], y, 1e-2)
    return np.append(slope * w[:-1], slope * w[-1] + offset)


def _content(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(len(column), CONTENT_DIM).astype(float)


def _slots(code: pa.Array) -> np.ndarray:
    code = code.to_numpy()
    return np.column_stack([code // (META_DIM * META_DIM), code // META_DIM % META_DIM, code % META_DIM])


def _meta_logits(slots: np.ndarray, meta: np.ndarray) -> np.ndarray:
    return meta[slots].sum(axis=1) + meta[-1]


class Unlabelled:
    """Rows ``content, code`` (metadata slots) that stay in Spark."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        codes = rows.groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy("code").collect()
        self._codes = _slots(pa.array([r["code"] for r in codes], pa.int64()))
        self._n = np.array([r["n"] for r in codes], np.int64)

    def meta_sure(self, meta: np.ndarray, share: float) -> Sure:
        """What the metadata view of calibrated weights ``meta`` is surest of."""
        return Sure.of(np.bincount(_bin(_meta_logits(self._codes, meta)), self._n, _BINS), share)

    def content_sure(self, content: np.ndarray, share: float) -> Sure:
        """What the content view of calibrated weights ``content`` is surest of."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(_BINS, np.int64)
            for batch in batches:
                counts += np.bincount(_bin(logits(_content(batch.column(0)), content)), minlength=_BINS)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bin", "n"])

        counts = np.zeros(_BINS)
        found = self.rows.select("content").mapInArrow(part, "bin bigint, n bigint")
        for row in found.groupBy("bin").agg(F.sum("n").alias("n")).collect():
            counts[row["bin"]] = row["n"]
        return Sure.of(counts, share)

    def content_sums(self, meta: np.ndarray, sure: Sure, w: np.ndarray) -> Sums:
        """Of the content view at ``w``, over all rows that the metadata view is sure of."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = Sums(CONTENT_DIM + 1)
            for batch in batches:
                x = _content(batch.column(0))
                for label, at in sure.labels(_meta_logits(_slots(batch.column(1)), meta)):
                    if len(at):
                        sums.add(x[at], label, w)
            yield pa.RecordBatch.from_arrays([pa.array([sums.to_bytes()], pa.binary())], ["sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = Sums(CONTENT_DIM + 1)
            for batch in batches:
                for data in batch.column(0):
                    sums.merge(data.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([sums.to_bytes()], pa.binary())], ["sums"])

        total = Sums(CONTENT_DIM + 1)
        found = self.rows.select("content", "code").mapInArrow(part, "sums binary")
        for row in found.repartition(_ADDERS).mapInArrow(add, "sums binary").collect():
            total.merge(row["sums"])
        return total

    def meta_votes(self, content: np.ndarray, sure: Sure) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots, label and number of all rows that the content view is sure of."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                code = batch.column(1).to_numpy()
                for label, at in sure.labels(logits(_content(batch.column(0)), content)):
                    codes, counts = np.unique(code[at], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(codes), pa.array(np.full(len(codes), label)), pa.array(counts)], ["code", "label", "n"]
                    )

        votes = self.rows.select("content", "code").mapInArrow(part, "code bigint, label bigint, n bigint")
        rows = votes.groupBy("code", "label").agg(F.sum("n").alias("n")).orderBy("code", "label").collect()
        code, label, n = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        return _slots(pa.array(code)), label, n.astype(float)


def co_train(
    content: np.ndarray, meta: np.ndarray, y: np.ndarray, apart: np.ndarray, free: Unlabelled, rounds: int = ROUNDS, share: float = SHARE
) -> CoTrained | None:
    """``apart`` marks labelled rows kept for calibration.  ``None`` if the training
    labels are not of both classes."""
    train = ~apart
    if len(np.unique(y[train])) < 2:
        return None
    views = [content, meta]
    models = [fit_logistic(x[train], y[train]) for x in views]
    held = apart if len(np.unique(y[apart])) == 2 else train
    exchanged = []
    for _ in range(rounds):
        ready = [calibrated(x[held], y[held], w) for x, w in zip(views, models, strict=True)]
        by_content, by_meta = free.content_sure(ready[0], share), free.meta_sure(ready[1], share)
        exchanged.append((*by_content.n.astype(int).tolist(), *by_meta.n.astype(int).tolist()))
        slots, label, n = free.meta_votes(ready[0], by_content)
        voted = one_hot(slots)

        def meta_sums(w: np.ndarray) -> Sums:
            sums = Sums(META_DIM + 1)
            for c in (0, 1):
                sums.add(voted[label == c], c, w, n[label == c])
            return sums

        def content_sums(w: np.ndarray) -> Sums:
            return free.content_sums(ready[1], by_meta, w)

        models = [
            fit_both(content[train], y[train], content_sums, models[0], by_meta.trust),
            fit_both(meta[train], y[train], meta_sums, models[1], by_content.trust),
        ]
    calibration = np.array(
        [fit_logistic(logits(views[v][held], models[v])[:, None], y[held], 1e-2) for v in (0, 1)]
    )
    model = CoTrained(models[0], models[1], calibration, np.array([0.5, 0.5, 0.0]), exchanged)
    model.mix = fit_logistic(model._calibrated(content[held], meta[held]), y[held], 1e-2)
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        content = content_features(batch.column(1)).astype("<f4")
        slots = meta_slots(batch.column(2), batch.column(3), batch.column(4))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([r.tobytes() for r in content], pa.binary()),
                pa.array((slots[:, 0] * META_DIM + slots[:, 1]) * META_DIM + slots[:, 2]),
            ],
            ["key", "content", "code"],
        )


def _score(model: CoTrained | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.full((batch.num_rows, 3), 0.5)
            if model is not None:
                content = content_features(batch.column(1))
                found = model.scores(content, meta_features(batch.column(2), batch.column(3), batch.column(4)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(found[:, i]) for i in range(3))],
                ["key", "score", "content_score", "meta_score"],
            )

    return run


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> CoTrained | None:
    """Fit on a sample of the labelled and on all unlabelled documents.  A document
    labelled more than once counts as good if any label says so; null labels and ids
    teach nothing."""
    work = Workspace(spark, "quality")
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", "source", "lang", "n_chars").where("doc_id is not null")
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(labelled)
    # at most that many rows
    sample = F.broadcast(known.select(F.col("doc_id").alias("key"), F.col("quality").cast("int").alias("quality"), "h"))

    def features(some: DataFrame) -> DataFrame:
        return some.mapInArrow(_features, f"key {kind}, content binary, code bigint")

    taught = docs.join(sample.select(F.col("key").alias("doc_id")), "doc_id", "left_semi")
    # a document that is repeated, with whatever texts, teaches once
    once = features(taught).groupBy("key").agg(F.min(F.struct("content", "code")).alias("x")).select("key", "x.*")
    seen = once.join(sample, "key").select("h", "quality", "content", "code").collect()
    if not seen:
        return None
    seen.sort(key=lambda r: (r["h"], r["content"]))
    y = np.array([float(r["quality"] > 0) for r in seen])
    apart = np.arange(len(seen)) % 4 == 3
    if len(np.unique(y[~apart])) < 2:
        return None
    marked = labels.select(F.col("doc_id").alias("key")).where("key is not null").distinct()
    free = work.cut(features(docs).join(marked, "key", "left_anti").select("content", "code"), "unlabelled")
    model = co_train(
        _content(pa.array([r["content"] for r in seen], pa.binary())), one_hot(_slots(pa.array([r["code"] for r in seen]))),
        y, apart, Unlabelled(free),
    )
    work.drop("unlabelled")
    return model


def classify_quality(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, keep_score: float = 0.5, **options
) -> DataFrame:
    """``doc_id, score, content_score, meta_score, kept`` of every row of ``docs``
    (``doc_id, text, source, lang, n_chars``; others are not read).

    ``kept`` is whether the combined probability of good quality reaches
    ``keep_score``.  Nulls are values of their own (a null text is empty).  Without
    labels of both classes every score is 0.5 and every row is kept.  Repeated rows
    score alike; an empty table gives no rows.
    """
    model = train(spark, docs, labels, **options)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        docs.select("doc_id", "text", "source", "lang", "n_chars")
        .mapInArrow(_score(model), f"key {kind}, score double, content_score double, meta_score double")
        .withColumnRenamed("key", "doc_id")
        .withColumn("kept", F.col("score") >= keep_score)
    )
