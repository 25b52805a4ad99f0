"""Generated ledgers: licit traffic, rings and injected typologies.

Rows come from ``spark.range`` and hashes of their ids, so a table of any size is
made in parallel and is the same at every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = ("mobile", "atm", "internet", "teller", "qris")


def _pick(n: int, *salt: object) -> Column:
    return F.pmod(F.xxhash64(F.col("id"), *[F.lit(s) for s in salt]), F.lit(n))


def _ledger(rows: DataFrame, prefix: str, typology: str | None) -> DataFrame:
    """Canonical columns from ``id, from_account, to_account, amount, at``."""
    return rows.select(
        F.concat(F.lit(prefix), F.col("id").cast("string")).alias("tx_id"),
        F.col("from_account").cast("bigint").alias("from_account"), F.col("to_account").cast("bigint").alias("to_account"),
        F.col("amount").cast("decimal(18,2)").alias("amount"), F.lit("IDR").alias("currency"),
        F.element_at(F.array(*map(F.lit, CHANNELS)), (_pick(5, prefix, "c") + 1).cast("int")).alias("channel"),
        F.lit("Transfer").alias("payment_format"), F.timestamp_seconds("at").cast("timestamp_ntz").alias("tx_timestamp"),
        F.concat(F.lit("DEV-"), F.pmod("from_account", F.lit(997)).cast("string")).alias("device_id"),
        F.concat(F.lit("BANK_"), F.pmod("from_account", F.lit(8)).cast("string")).alias("institution_id"),
        F.lit(int(typology is not None)).alias("is_laundering"), F.lit(typology).cast("string").alias("typology"),
    )


def licit(spark: SparkSession, n: int, accounts: int = 2000, start: int = 1_735_689_600, days: int = 90) -> DataFrame:
    """Day-time transfers between hashed accounts."""
    rows = spark.range(n).select(
        "id", _pick(accounts, "f").alias("from_account"), _pick(accounts, "t").alias("to_account"),
        (F.lit(10_000) + _pick(5_000_000, "a")).alias("amount"),
        (F.lit(start) + _pick(days, "d") * 86_400 + (8 + _pick(15, "h")) * 3600 + _pick(3600, "s")).alias("at"),
    )
    return _ledger(rows, "N-", None)


def gambling_ring(spark: SparkSession, n: int = 5000, players: int = 300, collectors: int = 2, base: int = 1_000_000, start: int = 1_735_689_600, days: int = 90) -> DataFrame:
    """Small night deposits to collectors, and a collection every third day."""
    deposits = spark.range(n).select(
        "id", (F.lit(base) + _pick(players, "p")).alias("from_account"), (F.lit(base + players) + _pick(collectors, "k")).alias("to_account"),
        (F.lit(50_000) + _pick(450_000, "a")).alias("amount"),
        (F.lit(start) + _pick(days, "d") * 86_400 + F.pmod(22 + _pick(6, "h"), F.lit(24)) * 3600 + _pick(3600, "s")).alias("at"),
    )
    exits = spark.range(days // 3 * collectors).select(
        "id", (F.lit(base + players) + F.col("id") % collectors).alias("from_account"), F.lit(base + players + collectors).alias("to_account"),
        F.lit(n * 275_000 // (days // 3 * collectors)).alias("amount"), (F.lit(start) + F.floor(F.col("id") / collectors) * 3 * 86_400 + 40_000).alias("at"),
    )
    return _ledger(deposits, "J-", "judol").unionByName(_ledger(exits, "X-", "judol"))


def motif(spark: SparkSession, kind: str, groups: int, width: int = 10, base: int = 2_000_000, start: int = 1_735_689_600) -> DataFrame:
    """``groups`` copies of a laundering motif of ``width`` accounts each: fan_out,
    fan_in, layering (a chain), cycle, or scatter_gather (out and in again)."""
    ids = spark.range(groups * width).withColumn("g", F.floor(F.col("id") / width)).withColumn("k", F.col("id") % width)
    hub = F.lit(base) + F.col("g") * (width + 2)
    leaf, nxt = hub + 1 + F.col("k"), hub + 1 + (F.col("k") + 1) % width
    ends = {"fan_out": (hub, leaf), "fan_in": (leaf, hub), "layering": (leaf, leaf + 1), "cycle": (leaf, nxt)}
    at = F.lit(start) + F.col("g") * 7200 + F.col("k") * 300
    amount = F.lit(4_900_000) - F.col("k") * 1000
    if kind == "scatter_gather":
        out = ids.select("id", hub.alias("from_account"), leaf.alias("to_account"), amount.alias("amount"), at.alias("at"))
        back = ids.select("id", leaf.alias("from_account"), (hub + width + 1).alias("to_account"), amount.alias("amount"), (at + 3600).alias("at"))
        return _ledger(out, "SO-", kind).unionByName(_ledger(back, "SI-", kind))
    a, b = ends[kind]
    return _ledger(ids.select("id", a.alias("from_account"), b.alias("to_account"), amount.alias("amount"), at.alias("at")), f"{kind}-", kind)


def inject(ledger: DataFrame, *extra: DataFrame) -> DataFrame:
    """Append generated rows, times clipped to the ledger's last."""
    last = ledger.agg(F.max("tx_timestamp").alias("last_"))
    for rows in extra:
        clipped = rows.crossJoin(F.broadcast(last)).withColumn("tx_timestamp", F.least("tx_timestamp", "last_")).drop("last_")
        ledger = ledger.unionByName(clipped)
    return ledger


def gen_mini(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small reference set: 50 000 licit transfers and a ring."""
    return inject(licit(spark, 50_000), gambling_ring(spark))


def gen_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("fan_out", "fan_in", "layering", "cycle", "scatter_gather")
    return inject(licit(spark, 5_000), *[motif(spark, k, 20, base=2_000_000 + 100_000 * i) for i, k in enumerate(kinds)])


QUERIES = {"gen_mini": gen_mini, "gen_motifs": gen_motifs}
COVERS = {"gen_mini": "S8 S24 S28", "gen_motifs": ""}
SQL: dict[str, str] = {}
