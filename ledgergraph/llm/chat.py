"""Chat formatting of maximal conversations.

Chat logs keep a conversation again after every turn, so most logged conversations
are prefixes of longer ones.  Rolling hashes name every turn prefix: the hash of
``k`` turns is SHA-256 of the hash of ``k - 1`` turns and the ``k``-th turn.  A
conversation whose whole hash is a proper prefix of another is dropped by an
anti-join, equal conversations keep the smallest id, and what is left is rendered.

Prefix hashes are made distinct with map-side combining, so an opening that all
conversations share costs a row per task.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workspace import Workspace

START, END = "<|im_start|>", "<|im_end|>"
_NONE = "-"


def _field(value: Column) -> Column:
    """A value with its length ahead, null apart, so that joined fields stay apart."""
    return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit(_NONE))


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, logged, hashes, rendered``: a row per conversation, ``hashes[k]``
    of its first ``k + 1`` turns.  Turns come by number, then role and text (null
    first); a conversation's turns are gathered because they make up one text.  A turn
    without ``conv_id`` belongs to no other and is a conversation of its own; equal ones
    share a row, and ``logged`` counts them."""
    one = F.struct("turn", "role", "text")
    marked = F.transform(
        "turns", lambda t: F.concat(_field(t["role"]), _field(t["text"]))
    )
    chain = F.aggregate(
        marked,
        F.array().cast("array<string>"),
        lambda acc, t: F.array_append(
            acc, F.sha2(F.concat(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")), t).cast("binary"), 256)
        ),
    )
    shown = F.array_join(
        F.transform(
            "turns",
            lambda t: F.concat(
                F.lit(START), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(END)
            ),
        ),
        "\n",
    )
    turns = turns.select("conv_id", "turn", "role", "text")
    gathered = turns.where("conv_id is not null").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(one)).alias("turns"), F.lit(1).cast("long").alias("logged")
    )
    single = turns.where("conv_id is null").groupBy("conv_id", "role", "text").agg(
        F.min("turn").alias("turn"), F.count(F.lit(1)).alias("logged")
    )
    single = single.select("conv_id", F.array(one).alias("turns"), "logged")
    return (
        gathered.unionByName(single)
        .select("conv_id", F.size("turns").alias("n_turns"), "logged", chain.alias("hashes"), shown.alias("rendered"))
    )


def format_chats(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, copies, rendered`` of every maximal conversation.

    A conversation that equals the opening turns (roles and texts) of a longer one is
    left out; of equal ones the smallest id stays (one without an id if none has any)
    and ``copies`` counts them.  A turn of a null ``conv_id`` is a conversation of its
    own.  A null role or text renders as empty
    but differs from an empty one.  Repeated turn rows are turns of their own.
    ``turns`` needs ``conv_id, turn, role, text``; others are not read.
    """
    found = Workspace(spark, "chat").cut(conversations(turns), "conversations")
    whole = F.col("hashes")[F.col("n_turns") - 1]
    opened = found.where("n_turns > 1").select(F.explode(F.slice("hashes", 1, F.col("n_turns") - 1)).alias("whole")).distinct()
    first = found.groupBy(whole.alias("whole")).agg(
        F.min("conv_id").alias("keeper"), F.sum("logged").alias("copies")
    )
    maximal = first.join(opened, "whole", "left_anti")
    return maximal.join(
        found.select(whole.alias("own"), "conv_id", "n_turns", "rendered"),
        (F.col("whole") == F.col("own")) & F.col("keeper").eqNullSafe(F.col("conv_id")),
    ).select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "copies", "rendered")


#: DuckDB's rows for :func:`format_chats`, comparing serialised conversations.
SQL = """
WITH gathered AS (
  SELECT conv_id, count(*) AS n_turns,
    list({'role': role, 'text': text} ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
  UNION ALL SELECT conv_id, 1, [{'role': role, 'text': text}] FROM conversations WHERE conv_id IS NULL),
keyed AS (
  SELECT conv_id, n_turns,
    array_to_string(list_transform(turns, lambda t: coalesce('r' || length(t.role) || ':' || t.role, '-')
      || coalesce('t' || length(t.text) || ':' || t.text, '-')), '') AS key,
    array_to_string(list_transform(turns, lambda t: '<|im_start|>' || coalesce(t.role, '') || chr(10)
      || coalesce(t.text, '') || '<|im_end|>'), chr(10)) AS rendered
  FROM gathered),
firsts AS (SELECT key, min(conv_id) AS conv_id, count(*) AS copies FROM keyed GROUP BY key)
SELECT DISTINCT k.conv_id, k.n_turns, f.copies, k.rendered
FROM firsts f JOIN keyed k ON k.key = f.key AND k.conv_id IS NOT DISTINCT FROM f.conv_id
WHERE NOT EXISTS (SELECT 1 FROM keyed o WHERE o.n_turns > k.n_turns AND starts_with(o.key, k.key))
"""
