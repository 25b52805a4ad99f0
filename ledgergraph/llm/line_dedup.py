"""Boilerplate removal by site-relative line frequency.

A page's lines are counted once per page and host; a line found on more than
``ratio`` of a host's pages is boilerplate there.  Since a host's boilerplate lines
number at most its mean lines per page over ``ratio``, they travel as one small
array per host and pages are filtered in place: only line hashes, combined before
the shuffle, ever move.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workspace import Workspace

RATIO = 0.3
MIN_PAGES = 3
_BLOCK_TAGS = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|"
    "li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul"
)


def page_lines(html: Column) -> Column:
    """Visible lines: script, style and comments go, block tags break lines, other
    tags vanish, blanks are squeezed; lines without content are left out."""
    text = F.regexp_replace(html, "(?is)<(script|style)\\b[^>]*>.*?</\\1\\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, f"(?i)</?(?:{_BLOCK_TAGS})(?:\\s[^>]*)?/?>", "\n")
    text = F.regexp_replace(text, "<[^>]*>", "")
    lines = F.transform(F.split(text, "[\\n\\r]+"), lambda x: F.trim(F.regexp_replace(x, "[ \\t\\x0b\\x0c]+", " ")))
    return F.filter(lines, lambda x: x != "")


def host_of(url: Column) -> Column:
    """The lower-cased host without user and port, or an empty string."""
    return F.coalesce(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def drop_boilerplate(
    spark: SparkSession, pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``page_id, host, n_lines, n_dropped, text`` of every page.

    A line is dropped if more than ``ratio`` of its host's pages have it and these
    are at least ``min_pages``.  Lines are compared after squeezing blanks, by 64-bit
    hash.  Null html has no lines; null and host-less urls share the empty host.
    Repeated rows count as pages.  ``pages`` needs ``page_id, url, html``; other
    columns are not read.
    """
    work = Workspace(spark, "line-dedup")
    lined = work.cut(
        pages.select(
            "page_id", host_of(F.col("url")).alias("host"), page_lines(F.coalesce(F.col("html"), F.lit(""))).alias("lines")
        ),
        "lines",
    )
    totals = lined.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    seen = (
        lined.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line"))
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_pages)
    )
    boilerplate = (
        seen.join(totals, "host")
        .where(F.col("n") > F.lit(ratio) * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_list("line").alias("boilerplate"))
    )
    left = F.filter(
        "lines", lambda x: F.coalesce(~F.array_contains(F.col("boilerplate"), F.xxhash64(x)), F.lit(True))
    )
    return (
        lined.join(boilerplate, "host", "left")
        .withColumn("left", left)
        .select(
            "page_id",
            "host",
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size("left")).cast("long").alias("n_dropped"),
            F.array_join("left", "\n").alias("text"),
        )
    )


#: DuckDB's rows for :func:`drop_boilerplate` with the defaults.
SQL = rf"""
WITH stripped AS (
  SELECT page_id, coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
    regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', ' ', 'g'),
      '(?i)</?(?:{_BLOCK_TAGS})(?:\s[^>]*)?/?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS text
  FROM pages),
lined AS (
  SELECT row_number() OVER () AS r, page_id, host,
    list_filter(list_transform(regexp_split_to_array(text, '[\n\r]+'),
      lambda x: trim(regexp_replace(x, '[ \t\x0b\x0c]+', ' ', 'g'))), lambda x: x <> '') AS lines
  FROM stripped),
seen AS (
  SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM lined) GROUP BY ALL),
totals AS (SELECT host, count(*) AS pages FROM lined GROUP BY host),
boilerplate AS (
  SELECT host, list(line) AS gone FROM seen JOIN totals USING (host)
  WHERE n >= {MIN_PAGES} AND n > {RATIO} * pages GROUP BY host)
SELECT page_id, l.host, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(left_over) AS BIGINT) AS n_dropped, array_to_string(left_over, chr(10)) AS text
FROM (SELECT l.*, list_filter(lines, lambda x: NOT coalesce(list_contains(gone, x), false)) AS left_over
  FROM lined l LEFT JOIN boilerplate b ON l.host = b.host) l
"""
