"""Mixing sources to target weights along a time-varying curriculum.

Sizes are words.  Every source has a weight; targets share the size of the whole
corpus by weight, stop at ``cap`` times their source's size, and the excess is
shared again by weight (a water level over the sources in order of cap / weight).

Each source lays its documents out in a fixed shuffled order, pass after pass; a
document's copy occupies an interval of the source's token stream and is taken if
its middle lies before the target.  The source's schedule, a piecewise-linear
weight over training time [0, 1], is integrated to the demand up to each moment;
inverting it at a copy's middle gives the copy's training position.  Documents are
then range-sorted by position.

The order within a source is by MD5 of id and text, cut into buckets of bounded size
whose sums give running offsets, so no source's documents meet in one task.  Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.workspace import Workspace

WEIGHTS = (1, 2, 3)
CAP = 3
#: Rows that a bucket of a source's order holds on average, all sources together.
BUCKET_ROWS = 1024
#: Curves that sources take in turn: relative weight at training times; only the
#: shape counts, since demand is scaled to the target.
CURVES: tuple[tuple[tuple[float, float], ...], ...] = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.7, 1.0), (1.0, 1.75)),
)
_WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, curves: int = len(CURVES)) -> DataFrame:
    """From a row per source (``source, source_size``): ``target`` and ``curve``.

    Sources by code point, null last, take ``weights`` and curves in turn.  The
    windows run over one row per source.
    """
    everything = Window.partitionBy(F.lit(0))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        sizes.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("curve", ((F.col("rank") - 1) % curves + 1).cast("int"))
        .withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    )
    filling = everything.orderBy(F.col("limit") / F.col("weight"), "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumn("fills", F.row_number().over(filling))
        .withColumn(
            "level",
            (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
        )
        .withColumn("open", F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("fills")))
        .withColumn("first", F.min("open").over(everything))
        .withColumn("water", F.max(F.when(F.col("fills") == F.col("first"), F.col("level"))).over(everything))
    )
    return level.select(
        "source",
        "source_size",
        F.when(F.col("fills") >= F.col("first"), F.col("water") * F.col("weight"))
        .otherwise(F.col("limit"))
        .alias("target"),
        "curve",
    )


_PIECE = ("t0", "span", "w0", "slope", "before", "after")


def curve_pieces(curve: tuple[tuple[float, float], ...]) -> list[tuple[float, ...]]:
    """The linear pieces of a curve (``_PIECE``), with the share of its integral
    before and after each."""
    pieces, done = [], 0.0
    total = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(curve[:-1], curve[1:], strict=True))
    for (t0, w0), (t1, w1) in zip(curve[:-1], curve[1:], strict=True):
        after = done + (t1 - t0) * (w0 + w1) / 2 / total
        pieces.append((t0, t1 - t0, w0 / total, (w1 - w0) / (t1 - t0) / total, done, after))
        done = after
    return pieces


def _segments(curve: tuple[tuple[float, float], ...]) -> Column:
    return F.array(
        *[
            F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(_PIECE, values, strict=True)])
            for values in curve_pieces(curve)
        ]
    )


def position(share: Column, curve: Column, curves: tuple = CURVES) -> Column:
    """The training time at which the demand reaches ``share`` of its whole: on a
    piece of weight ``w0 + slope * x`` the area ``w0*x + slope*x**2/2`` is solved."""
    pieces = F.element_at(F.array(*[_segments(c) for c in curves]), curve)
    piece = F.element_at(F.filter(pieces, lambda p: (p["after"] >= share) | (p["after"] > 1 - 1e-12)), 1)
    times = F.transform(
        F.array(piece),
        lambda p: p["t0"]
        + F.least(
            p["span"],
            F.when(share <= p["before"], F.lit(0.0)).otherwise(
                2 * (share - p["before"])
                / (p["w0"] + F.sqrt(F.greatest(F.lit(0.0), p["w0"] * p["w0"] + 2 * p["slope"] * (share - p["before"]))))
            ),
        ),
    )
    return times[0]


#: Buckets of a source whose sums one window adds up.
RUN = 4096


def plan(
    spark: SparkSession,
    sized: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    cap: float = CAP,
    curves: tuple = CURVES,
) -> DataFrame:
    """``sized`` (``id, mark, source, size``, and more) with ``source_size, target,
    curve, before`` (words of the source ahead in a pass) and ``copies``.

    A source's order is by MD5 of id and mark.  Buckets of this hash are added up in
    runs of ``RUN`` and the runs in turn, so a window holds a bucket's rows, a run's
    buckets or a source's runs.  Documents without words are not taken.
    """
    work = Workspace(spark, "mixing")
    totals = work.cut(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "sources")
    rows = totals.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-rows // BUCKET_ROWS))
    key = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("mark", F.lit("")))
    dealt = (
        sized.withColumn("h", F.md5(key.cast("binary")))
        .withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)))
        .withColumn("named", F.col("source").isNotNull())
        .withColumn("name", F.coalesce("source", F.lit("")))
    )
    aims = targets(totals.drop("n"), weights, cap, len(curves))
    owns = work.cut(
        dealt.groupBy("named", "name", "bucket").agg(F.sum("size").alias("own")).withColumn("run", F.floor(F.col("bucket") / RUN)),
        "buckets",
    )
    ahead = Window.partitionBy("named", "name").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        owns.groupBy("named", "name", "run").agg(F.sum("own").alias("own"))
        .withColumn("runs_before", F.coalesce(F.sum("own").over(ahead), F.lit(0))).drop("own")
    )
    in_run = Window.partitionBy("named", "name", "run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        owns.withColumn("in_run", F.coalesce(F.sum("own").over(in_run), F.lit(0)))
        .join(runs, ["named", "name", "run"])
        .join(
            aims.select(F.col("source").isNotNull().alias("named"), F.coalesce("source", F.lit("")).alias("name"), "source_size", "target", "curve"),
            ["named", "name"],
        )
        .select("named", "name", "bucket", (F.col("in_run") + F.col("runs_before")).alias("base"), "source_size", "target", "curve")
    )
    inside = (
        Window.partitionBy("named", "name", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = dealt.join(bases, ["named", "name", "bucket"]).withColumn(
        "before", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    )
    passes = F.ceil((F.col("target") - F.col("before") - F.col("size") / 2) / F.col("source_size"))
    copies = F.when(F.col("size") > 0, F.greatest(F.lit(0), passes)).otherwise(0).cast("long")
    return placed.withColumn("copies", copies).drop("h", "bucket", "named", "name", "base", "mark")


def share_of(copy: Column) -> Column:
    """How much of its source's target lies before the middle of a copy (from 0)."""
    return (copy * F.col("source_size") + F.col("before") + F.col("size") / 2) / F.col("target")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    text = F.col(text_col)
    mark = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return docs.select(*more, F.col(id_col).alias("id"), mark.alias("mark"), F.col(source_col).alias("source"), word_count(text).alias("size"))


def mix(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    cap: float = CAP,
    curves: tuple = CURVES,
) -> DataFrame:
    """How much of every document the mix takes, in training order.

    Returns ``id_col, size, source_size, target, taken, copies, first_position`` per
    row, range-sorted by ``first_position`` (training time of the first copy), which is
    null, and last, where nothing is taken.  A null text has size 0 and is not taken;
    null sources are one source; null and repeated ids are told apart by their texts,
    and of equal rows one follows the other.  Whole documents are taken, so a source
    misses its target by half a document at most.  An empty table gives no rows.
    """
    sized = Workspace(spark, "mixing").cut(_sized(docs, id_col, text_col, source_col), "sizes")
    planned = plan(spark, sized, weights, cap, curves)
    first = F.when(F.col("copies") > 0, position(share_of(F.lit(0)), F.col("curve"), curves))
    found = planned.select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
        F.round(first, 9).alias("first_position"),
    )
    by = [F.col("first_position").asc_nulls_last(), F.col(id_col), F.col("size")]
    return found.repartitionByRange(*by).sortWithinPartitions(*by)


def _in_files(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` itself if its rows have a place in files, or else written out."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
        return docs
    except AnalysisException:
        return Workspace(spark, "mixing").cut(docs, "docs")


def take(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    cap: float = CAP,
    curves: tuple = CURVES,
) -> DataFrame:
    """The mixed corpus: ``docs``' columns, a row per taken copy, range-sorted by
    training position (ties by id, copy and place in the files).

    Sizes, order and positions are worked out on rows without texts, known by their
    place in the files of ``docs``; whole rows meet only their copies' positions, so
    neither equal ids nor equal rows gather.
    """
    docs = _in_files(spark, docs)
    place = [F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    sized = Workspace(spark, "mixing").cut(_sized(docs, id_col, text_col, source_col, *place), "sizes")
    planned = plan(spark, sized, weights, cap, curves)
    copies = planned.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    at = copies.select("_file", "_row", "_copy", position(share_of(F.col("_copy")), F.col("curve"), curves).alias("_at"))
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_id"), *place)
    by = ["_at", "_id", "_copy", "_file", "_row"]
    # positions grow with the corpus, so they are shuffled at every size
    placed = whole.join(at.hint("shuffle_merge"), ["_file", "_row"])
    return placed.repartitionByRange(*by).sortWithinPartitions(*by).select("row.*")


def written_order(docs: DataFrame) -> list[Column] | None:
    """Columns that order rows as a range-sorted table was written: part file, then
    place in it.  ``None`` if the rows are not read from files."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return None
    name = F.col("_metadata.file_name")
    part = F.regexp_extract(name, "^part-([0-9]+)", 1).try_cast("long")
    return [part, name, F.col("_metadata.row_index")]


_PIECE_ROWS = ", ".join(
    f"({i}, {', '.join(f'{float(v)!r}::DOUBLE' for v in piece)})"
    for i, curve in enumerate(CURVES, 1)
    for piece in curve_pieces(curve)
)

#: DuckDB's rows for :func:`mix` with the defaults, ``first_position`` to 9 places.
SQL = """
WITH sized AS (
  SELECT doc_id, md5(coalesce(text, '')) AS mark, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM totals),
weighed AS (
  SELECT *, CAST((rank - 1) % 3 + 1 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS lim FROM ranked),
levels AS (
  SELECT *, row_number() OVER f AS fills,
    (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(lim) OVER b, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM weighed
  WINDOW f AS (ORDER BY lim / weight, rank),
    b AS (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (
  SELECT fills AS first, level AS water FROM levels WHERE level * weight <= lim ORDER BY fills LIMIT 1),
aims AS (
  SELECT source, source_size, (rank - 1) % 3 + 1 AS curve,
    CASE WHEN fills >= (SELECT first FROM water) THEN (SELECT water FROM water) * weight ELSE lim END AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, a.curve,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(CAST(s.doc_id AS VARCHAR), '') || ':' || s.mark), s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source),
counted AS (
  SELECT *, CASE WHEN size > 0
    THEN greatest(0, ceil((target - CAST(before AS DOUBLE) - size / 2.0::DOUBLE) / source_size)) ELSE 0 END AS copies
  FROM placed),
pieces(curve, t0, span, w0, slope, done, after) AS (VALUES @pieces),
shares AS (
  SELECT *, CASE WHEN copies > 0 THEN (CAST(before AS DOUBLE) + size / 2.0::DOUBLE) / target END AS share FROM counted)
SELECT s.doc_id, s.size, s.source_size, s.target, CAST(copies * size AS BIGINT) AS taken,
  CAST(copies AS BIGINT) AS copies,
  round(t0 + least(span, CASE WHEN share <= done THEN 0.0::DOUBLE ELSE 2 * (share - done)
    / (w0 + sqrt(greatest(0.0::DOUBLE, w0 * w0 + 2 * slope * (share - done)))) END), 9) AS first_position
FROM shares s LEFT JOIN pieces p
  ON p.curve = s.curve AND share > (CASE WHEN done = 0 THEN -1 ELSE done END)
  AND (share <= after OR after > 1 - 1e-12)
""".replace("@pieces", _PIECE_ROWS)
