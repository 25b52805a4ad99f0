"""Generated typologies have their shape; stream signals follow hand-made transfers."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgergraph.functions.workspace import Workspace
from ledgergraph.sources import typologies
from ledgergraph.streaming import account_signals
from ledgergraph.streaming.account_state import stage_slices


@pytest.fixture(scope="module")
def made(spark):
    found = typologies.gen_typologies(spark, "").cache()
    yield found
    found.unpersist()

TX_SCHEMA = "tx_id string, from_account bigint, to_account bigint, device_id string, ts timestamp"


def test_all_typologies_and_unique_ids(made):
    kinds = {r.typology: r.n for r in made.groupBy("typology").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(kinds) == {None, *typologies.TYPOLOGIES}
    assert made.count() == made.select("tx_id").distinct().count()
    assert made.where("amount <= 0 or (typology is not null) <> (is_laundering = 1)").count() == 0


def test_dormant_accounts_sleep_before_they_burst(made):
    base = typologies.BASES["dormant"]
    gaps = (
        made.where(f"to_account between {base} and {base + 199}")
        .groupBy("to_account").agg(F.datediff(F.max("tx_timestamp"), F.min("tx_timestamp")).alias("gap"), F.count(F.lit(1)).alias("n"))
    )
    assert gaps.where("gap >= 180 and n = 2").count() == 200


def test_chains_run_on_within_a_day(made):
    hops = made.where("tx_id like 'SCM-C%'").select(F.split("tx_id", "-")[2].alias("chain"), "tx_timestamp", "from_account", "to_account")
    spans = hops.groupBy("chain").agg((F.max("tx_timestamp").cast("timestamp").cast("long") - F.min("tx_timestamp").cast("timestamp").cast("long")).alias("s"))
    assert spans.where("s >= 86400").count() == 0 and spans.count() == 100
    linked = hops.alias("a").join(hops.alias("b"), F.expr("a.chain = b.chain and a.to_account = b.from_account"))
    assert linked.count() == 200


def test_vendors_come_together_again(made):
    rows = made.where("typology = 'vendor'")
    ends = rows.select(F.col("to_account").alias("a")).distinct().join(rows.select(F.col("from_account").alias("a")).distinct(), "a", "left_anti")
    assert ends.count() == 60


def test_signals_of_hand_made_transfers(spark):
    def t(h, m):
        return datetime(2025, 3, 1, h, m)

    rows = [("1", 1, 2, "D1", t(9, 0)), ("2", 2, 3, "D2", t(9, 10)), ("3", 2, 4, "D2", t(9, 5)), ("4", 1, 2, "D3", t(8, 0)), ("5", 5, 5, None, t(9, 0))]
    work = Workspace(spark, "t-signals")
    stage_slices(spark.createDataFrame(rows, TX_SCHEMA), f"{work.path}/in", 2)
    spark.createDataFrame([(2, 7, 3)], "account_id bigint, device_sharing_count bigint, n_institutions bigint").write.parquet(f"{work.path}/net")
    ends = account_signals.endpoints(spark.readStream.schema(TX_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{work.path}/in"))
    updates = account_signals.run_with_network(account_signals.signals(ends), work, "out", f"{work.path}/net")
    found = {r.account_id: r for r in updates.groupBy("account_id").agg(F.max_by(F.struct("*"), "batch").alias("s")).select("s.*").collect()}
    assert found[2].velocity_1h == 2 and found[2].rapid_inout  # ten minutes are within
    assert found[1].velocity_1h == 2 and not found[1].rapid_inout  # an hour is within
    assert found[5].rapid_inout and found[5].velocity_1h == 1  # a self-transfer is both
    assert (found[2].device_sharing_count, found[2].n_institutions, found[1].device_sharing_count) == (7, 3, 0)
    asked = spark.createDataFrame([("9", 2), ("10", 99)], "tx_id string, from_account bigint")
    again = {r.tx_id: r.velocity_1h for r in account_signals.replay(spark, updates.where("account_id = 2"), asked).collect()}
    assert again["10"] is None and again["9"] is not None
