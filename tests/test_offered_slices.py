"""Slices that a stream takes one a batch, of as many files as wrote them."""

from pyspark.sql import functions as F

from ledgergraph.functions.workspace import Workspace
from ledgergraph.streaming import account_state, keyed_log


def test_a_slice_is_a_batch_of_many_files(spark):
    work = Workspace(spark, "t-offered")
    rows = spark.range(400, numPartitions=4).repartition(4).select("id", F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("ts"))
    rows = work.cut(rows, "rows").repartition(4)
    stream = spark.readStream.schema("id bigint, ts timestamp").parquet(work.folder("in"))
    found = account_state.run_to_parquet(stream, work, "out", "update", account_state.offered(work, rows, "in", 3))
    batches = found.groupBy("batch").agg(F.count("id").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).orderBy("batch").collect()
    assert [(r.low, r.high) for r in batches] == [(0, 132), (133, 265), (266, 399)] and sum(r.n for r in batches) == 400
    files = len(spark.read.parquet(f"{work.path}/in").inputFiles())
    assert files > 3  # a file a slice was a task a slice


def test_no_query_stages_a_slice_by_one_task(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("a slice in one task")

    monkeypatch.setattr(account_state, "stage_slices", refuse)
    monkeypatch.setattr(keyed_log, "stage_slices", refuse, raising=False)
    sf = "/root/testdata/sf0.001"
    assert keyed_log.stream_json_events(spark, sf).count() and account_state.stream_account_features(spark, sf).count()
