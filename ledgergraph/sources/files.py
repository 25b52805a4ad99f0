"""Reading landing files, reloading tables, and checkpoints with signatures."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANDING = (
    "tx_id string, from_account string, to_account string, amount string, currency string, channel string, "
    "payment_format string, tx_timestamp string, device_id string, institution_id string, is_laundering string, typology string"
)


def read_landing_csv(spark: SparkSession, path: str) -> DataFrame:
    """Canonical rows of landing CSV files; numbers and times that do not parse become
    null and rows without a key, an amount or a time are dropped."""
    raw = spark.read.schema(LANDING).option("header", True).option("mode", "PERMISSIVE").csv(path)
    typed = raw.select(
        "tx_id", "from_account", "to_account",
        F.expr("try_cast(amount as decimal(18,2))").alias("amount"),
        F.coalesce(F.expr("nullif(currency, '')"), F.lit("IDR")).alias("currency"), "channel", "payment_format",
        F.expr("cast(try_to_timestamp(tx_timestamp) as timestamp_ntz)").alias("tx_timestamp"), "device_id", "institution_id",
        F.coalesce(F.expr("try_cast(is_laundering as int)"), F.lit(0)).alias("is_laundering"),
        F.expr("nullif(lower(trim(typology)), 'nan')").alias("typology"),
    )
    return typed.na.drop(subset=["tx_id", "from_account", "to_account", "amount", "tx_timestamp"])


def reload_table(df: DataFrame, path: str) -> None:
    """Full reload: the table at ``path`` is replaced."""
    df.write.mode("overwrite").parquet(path)


def append_new(spark: SparkSession, df: DataFrame, path: str, key: str) -> int:
    """Append rows whose key is not stored yet, one per key; the number appended."""
    old = spark.read.parquet(path).select(key)
    new = df.dropDuplicates([key]).join(old, key, "left_anti").cache()
    count = new.count()
    new.write.mode("append").parquet(path)
    return count


def write_keyed(df: DataFrame, path: str, key: str = "from_account") -> None:
    """Rows of a key in one file, as a keyed log keeps them in one partition."""
    df.repartition(key).write.mode("overwrite").parquet(path)


def save_checkpoint(df: DataFrame, path: str, signature: dict) -> None:
    """A table with the signature that a reader must ask for, and its row count."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    rows = df.sparkSession.read.parquet(f"{path}/data").count()
    text = json.dumps({"signature": signature, "rows": rows}, sort_keys=True)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/signature")


def load_checkpoint(spark: SparkSession, path: str, signature: dict, expected_rows: int | None = None) -> DataFrame | None:
    """The table, or ``None`` if its signature differs or its rows miss the expected
    number by over one per cent."""
    found = json.loads(spark.read.text(f"{path}/signature").first()[0])
    if found["signature"] != signature:
        return None
    if expected_rows is not None and abs(found["rows"] - expected_rows) > 0.01 * expected_rows:
        return None
    return spark.read.parquet(f"{path}/data")
