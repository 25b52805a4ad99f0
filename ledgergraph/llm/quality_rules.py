"""Quality rules with risk-controlled thresholds.

Fixed counts of every text give five rule signals.  A policy is a cutoff for each rule
or none; it rejects documents of a stratum (their language) of which any signal exceeds
its cutoff.  Policies form one chain, fixed in advance: from no cutoffs at all, one rule
after the other takes its loosest cutoff, then its next one, to the strictest.  Each
rejects what those before it reject.

Which policy is safe is decided on labelled documents.  If a policy rejects ``k`` of a
stratum's ``n`` good ones, a false-rejection rate of all its rules together over ``risk``
is ruled out when the exact binomial bound ``P(X <= k)``, ``X ~ Bin(n, risk)``, is at most
``delta / strata``.  The chain is tested in its order up to the first policy that is not
ruled safe (fixed-sequence testing, which needs no correction along the chain; Bonferroni
corrects over the strata), and the last safe one holds.  With probability ``1 - delta``
no stratum loses more than ``risk`` of its good documents.  A stratum with fewer than
``log(strata / delta) / -log(1 - risk)`` good labelled documents (86 for four) rejects
nothing beyond the base rules.

Only DataFrame functions are used, and a text's windows never leave its row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workspace import Workspace

WINDOW = 8
RISK = 0.05
DELTA = 0.05
#: Cutoffs of each rule's signal, fixed in advance.
CUTOFFS: dict[str, tuple[float, ...]] = {
    "long_words": (8.0, 10.0, 12.0, 15.0, 20.0, 30.0, 50.0),
    "symbols": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0),
    "dup_lines": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7),
    "repeats": (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.29),
    "capitals": (0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7),
}
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for a row."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more, from the windows' hashes."""

    def of_sorted(s: Column) -> Column:
        twice = F.filter(
            s,
            lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False))
            | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)),
        )
        return _let(F.array_sort(F.transform(twice, lambda e: e["i"])), of_positions)

    def of_positions(p: Column) -> Column:
        steps = F.transform(
            p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))
        )
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    entries = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return _let(F.array_sort(entries), of_sorted)


def _repeated_words(words: Column) -> Column:
    def of_hashes(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW)))
        )
        return _let(
            windows,
            lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0)),
        )

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return _let(hashes, lambda w: F.when(F.size(w) > WINDOW, of_hashes(w)).otherwise(F.lit(0)))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``doc_id, stratum``, the base counts, and the helpers of the rule signals.

    Words are runs without ASCII white space; null texts have none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(_without(x, _BLANKS)) > 0)
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), text.alias("text"))
        .withColumn(
            "w",
            _let(
                F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)),
                lambda w: F.struct(F.size(w).alias("n"), _repeated_words(w).alias("r")),
            ),
        )
        .withColumn(
            "l",
            _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))),
        )
        .select(
            "doc_id",
            "stratum",
            F.col("w.n").cast("long").alias("n_words"),
            F.length(_without(F.col("text"), _BLANKS)).cast("long").alias("word_chars"),
            (F.length("text") - F.length(_without(F.col("text"), _SYMBOLS))).cast("long").alias("n_symbols"),
            F.col("l.d").cast("long").alias("n_dup_lines"),
            F.col("w.r").cast("long").alias("n_repeat_words"),
            F.col("l.n").cast("long").alias("n_lines"),
            (F.length("text") - F.length(_without(F.col("text"), _CAPITALS))).cast("long").alias("n_capitals"),
        )
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    )


def _share(a: str, b: str) -> Column:
    return F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")


SIGNALS: dict[str, tuple[str, str]] = {
    "long_words": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
}


def _ln_gamma(x: Column) -> Column:
    """Stirling's series at ``x + 8``, carried back; within 1e-12 for ``x >= 1``."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    product = F.lit(1.0)
    for i in range(8):
        product = product * (x + i)
    # the product of large x is split to stay finite
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """``P(X <= k)`` for ``X ~ Bin(n, p)``; 1 is returned for ``k > n * p``, where it is
    no less than about a half.  Terms over 40 deviations below the mean, together
    under 1e-300, are left out, so the sum has at most ``40 * sqrt(n p q) + 60`` terms.
    """
    n, k = n.cast("double"), k.cast("double")
    low = F.greatest(F.lit(0.0), F.floor(n * p - 40 * F.sqrt(n * p * (1 - p)) - 60).cast("double"))

    def term(i: Column) -> Column:
        choose = _ln_gamma(n + 1) - _ln_gamma(i + 1) - _ln_gamma(n - i + 1)
        return F.exp(choose + i * math.log(p) + (n - i) * math.log1p(-p))

    total = F.aggregate(
        F.sequence(low.cast("long"), k.cast("long")), F.lit(0.0), lambda a, i: a + term(i.cast("double"))
    )
    return F.when(k > n * p, F.lit(1.0)).when(k < low, F.lit(0.0)).otherwise(total)


def chain(cutoffs: dict[str, tuple[float, ...]] = CUTOFFS) -> list[tuple[str, float]]:
    """The chain's steps: the rule that each one tightens, and to what."""
    loose_first = {rule: sorted(values, reverse=True) for rule, values in cutoffs.items()}
    levels = max(map(len, loose_first.values()))
    return [(rule, values[i]) for i in range(levels) for rule, values in loose_first.items() if i < len(values)]


def first_step(cutoffs: dict[str, tuple[float, ...]] = CUTOFFS) -> Column:
    """The first step of the chain from which on a document is rejected; null if none."""
    by_rule: dict[str, Column] = {}
    for step, (rule, cutoff) in enumerate(chain(cutoffs)):
        over, at = _share(*SIGNALS[rule]) > F.lit(float(cutoff)), F.lit(step)
        by_rule[rule] = by_rule[rule].when(over, at) if rule in by_rule else F.when(over, at)
    return F.least(*by_rule.values()) if len(by_rule) > 1 else next(iter(by_rule.values()))


def thresholds(
    counted: DataFrame,
    labels: DataFrame,
    work: Workspace,
    cutoffs: dict[str, tuple[float, ...]] = CUTOFFS,
    risk: float = RISK,
    delta: float = DELTA,
) -> DataFrame:
    """``stratum, step, n, k, tail`` of every tested step, from all labelled documents.

    A step holds, with all before it, if ``tail <= delta / strata`` (``k`` and so the
    tail never fall along the chain, so the steps that pass are its first ones).
    ``labels`` has ``doc_id, quality``; a document is good if any of its labels says
    1.  Documents that fail the base rules are not counted.
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    held = counted.where("not base_failed").join(good, "doc_id", "left_semi").withColumn("first", first_step(cutoffs))
    n_steps = len(chain(cutoffs))
    sums = [F.count_if(F.col("first") <= t).alias(f"k_{t}") for t in range(n_steps)]
    per_stratum = work.cut(held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *sums), "strata")
    strata = max(1, per_stratum.count())
    rows = F.array(*[F.struct(F.lit(t).alias("step"), F.col(f"k_{t}").alias("k")) for t in range(n_steps)])
    tested = per_stratum.select("stratum", "n", F.explode(rows).alias("t")).select("stratum", "n", "t.*")
    tested = tested.withColumn("tail", binomial_tail(F.col("k"), F.col("n"), risk))
    return tested.withColumn("holds", F.col("tail") <= delta / strata)


def quality_verdicts(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    **options,
) -> DataFrame:
    """``id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept`` of every row.

    Null and empty texts have counts of 0 and fail the base rules.  A null stratum
    is one stratum; a stratum without enough good labelled documents rejects
    nothing.  Repeated rows are judged alike; an empty label table rejects nothing;
    an empty table gives no rows.
    """
    work = Workspace(spark, "quality-rules")
    counted = work.cut(counts(docs, id_col, text_col, stratum_col), "counts")
    tested = work.cut(thresholds(counted, labels, work, **options), "thresholds")
    # a row per stratum; strata are few and this join may broadcast by measured size
    last = tested.where("holds").groupBy(F.col("stratum").alias("s")).agg(F.max("step").alias("last"))
    return (
        counted.withColumn("first", first_step(options.get("cutoffs", CUTOFFS)))
        .join(last, F.col("stratum").eqNullSafe(F.col("s")), "left")
        .select(
            F.col("doc_id").alias(id_col),
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            "base_failed",
            (~F.col("base_failed") & ~F.coalesce(F.col("first") <= F.col("last"), F.lit(False))).alias("kept"),
        )
    )


_RULE_ROWS = ", ".join(f"('{rule}', {float(c)!r}::DOUBLE, {step})" for step, (rule, c) in enumerate(chain()))
#: DuckDB's rows for :func:`quality_verdicts` with the defaults.
SQL = f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, lang AS stratum, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
windows AS (
  SELECT r, i, array_to_string(words[i:i + 7], ' ') AS win
  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM texts WHERE len(words) >= 8)),
twice AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
repeats AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 8)) AS word FROM twice) GROUP BY r),
lined AS (
  SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM texts),
counted AS (
  SELECT t.r, t.doc_id, t.stratum, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals
  FROM texts t JOIN lined USING (r) LEFT JOIN repeats p USING (r)),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted),
signals AS (
  SELECT r, stratum, base_failed, doc_id, unnest([
    {{'rule': 'long_words', 'v': word_chars::DOUBLE / greatest(n_words, 1)::DOUBLE}},
    {{'rule': 'symbols', 'v': n_symbols::DOUBLE / greatest(n_words, 1)::DOUBLE}},
    {{'rule': 'dup_lines', 'v': n_dup_lines::DOUBLE / greatest(n_lines, 1)::DOUBLE}},
    {{'rule': 'repeats', 'v': n_repeat_words::DOUBLE / greatest(n_words, 1)::DOUBLE}},
    {{'rule': 'capitals', 'v': n_capitals::DOUBLE / greatest(word_chars, 1)::DOUBLE}}], recursive := true)
  FROM judged),
rules(rule, cutoff, step) AS (VALUES {_RULE_ROWS}),
firsts AS (SELECT r, min(step) AS first FROM signals s JOIN rules c ON s.rule = c.rule AND s.v > c.cutoff GROUP BY r),
good AS (
  SELECT j.stratum, f.first FROM judged j LEFT JOIN firsts f USING (r)
  WHERE NOT base_failed AND j.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
tested AS (
  SELECT stratum, step, count(*) AS n, count(*) FILTER (first <= step) AS k FROM good, rules GROUP BY ALL),
tails AS (
  SELECT *, CASE WHEN k > n * {RISK!r} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
    exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK!r}) + (n - i) * ln(1 - {RISK!r})))) END AS tail
  FROM tested),
lasts AS (
  SELECT stratum, max(step) AS last FROM tails
  WHERE tail <= {DELTA!r} / (SELECT count(*) FROM (SELECT DISTINCT stratum FROM tested)) GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(first <= last, false) AS kept
FROM judged j LEFT JOIN firsts f USING (r) LEFT JOIN lasts l ON j.stratum IS NOT DISTINCT FROM l.stratum
"""
