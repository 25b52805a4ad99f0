"""Landing files, loads, checkpoints, generators, extraction and streams."""

import pytest
from pyspark.sql import functions as F

from ledgergraph.functions.workspace import Workspace, shared_root
from ledgergraph.operators.extraction import osint_extract_accounts
from ledgergraph.plans import registry
from ledgergraph.sources import files, generate
from ledgergraph.streaming import account_state, node_memory

SF = "/root/testdata/sf0.001"


def test_landing_csv_drops_what_does_not_parse(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "tx_id,from_account,to_account,amount,currency,channel,payment_format,tx_timestamp,device_id,institution_id,is_laundering,typology\n"
        "T1,A,B,10.50,,atm,Wire,2025-01-02 03:04:05,D,I,1,judol\n"
        "T2,A,B,ten,IDR,atm,Wire,2025-01-02 03:04:05,D,I,0,NaN\n"
        "T3,A,B,3,IDR,atm,Wire,yesterday,D,I,0,NaN\n"
        "T4,A,B,4,IDR,atm,Wire,2025-01-02 03:04:05,D,I,,NaN\n"
    )
    found = {r.tx_id: r for r in files.read_landing_csv(spark, str(tmp_path)).collect()}
    assert set(found) == {"T1", "T4"}
    assert found["T1"].currency == "IDR" and found["T4"].is_laundering == 0 and found["T4"].typology is None


def test_append_new_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    files.reload_table(spark.range(3).withColumnRenamed("id", "tx_id"), path)
    more = spark.range(5).union(spark.range(5)).withColumnRenamed("id", "tx_id")
    assert files.append_new(spark, more, path, "tx_id") == 2
    assert files.append_new(spark, more, path, "tx_id") == 0
    assert spark.read.parquet(path).count() == 5


def test_checkpoint_needs_its_signature(spark, tmp_path):
    path = str(tmp_path / "c")
    files.save_checkpoint(spark.range(100), path, {"version": 2})
    assert files.load_checkpoint(spark, path, {"version": 1}) is None
    assert files.load_checkpoint(spark, path, {"version": 2}, expected_rows=102) is None
    assert files.load_checkpoint(spark, path, {"version": 2}, expected_rows=100).count() == 100


def test_workspace_lies_in_the_checkpoint_folder(spark):
    work = Workspace(spark, "t")
    assert work.path.startswith(shared_root(spark))
    assert work.cut(spark.range(4), "x").count() == 4


def test_generated_ledgers_repeat(spark):
    a, b = (generate.gambling_ring(spark, n=500) for _ in range(2))
    assert a.exceptAll(b).count() == 0
    cycle = generate.motif(spark, "cycle", 2, width=4)
    assert cycle.groupBy("from_account").count().where("count = 1").count() == 8
    mixed = generate.inject(generate.licit(spark, 100), cycle)
    assert mixed.count() == 108 and mixed.agg(F.max("tx_timestamp")).first() == generate.licit(spark, 100).agg(F.max("tx_timestamp")).first()


@pytest.mark.parametrize(
    "text,wanted",
    [
        ("BCA : 1234.567.890", [("1234567890", "BCA", "bank", 1.0)]),
        ("DANA 0812-3456-7890 ok", [("081234567890", "DANA", "ewallet", 0.9)]),
        ("mandiri 123 456", []),
        ("call 0812 3456 7890", []),
        ("bri 1 bni 1234567890", [("1234567890", "BNI", "bank", 1.0)]),
    ],
)
def test_accounts_in_text(spark, text, wanted):
    pages = spark.createDataFrame([(1, text, "html")], "page_id bigint, html string, origin string")
    found = osint_extract_accounts.apply(spark, {"page_texts": pages}).collect()
    assert [(r.rekening, r.bank, r.account_type, r.confidence) for r in found] == wanted


def test_memory_scores_are_the_same_in_stream_and_batch(spark):
    batch = {r.event_id: r.score for r in node_memory.score_batch(spark.read.parquet(f"{SF}/events.parquet")).collect()}
    stream = {r.event_id: r.score for r in node_memory.stream_node_memory(spark, SF).collect()}
    assert batch.keys() == stream.keys()
    assert max(abs(batch[k] - stream[k]) for k in batch) < 1e-9


def test_sessions_and_repeats(spark):
    work, stream = account_state._staged(spark, SF, "t-sessions")
    found = account_state.run_to_parquet(account_state.sessions(stream), work, "out")
    assert found.where("n < 1 or end <= start").count() == 0
    once, twice = (account_state.stream_dedup(spark, SF).count() for _ in range(2))
    assert once == twice == spark.read.parquet(f"{SF}/events.parquet").count()


def test_inventory_is_covered():
    left_out = {"S22", "G14", "R21", "E23", "N15", "F28"}  # transport, presentation, plumbing, dead code, crawling
    by_functions = {"S5", "S15", "S29"}  # tested above
    sizes = {"S": 29, "P": 18, "J": 13, "F": 29, "B": 8, "G": 14, "R": 21, "T": 16, "E": 23, "N": 15, "W": 7, "L": 4, "U": 4, "A": 15}
    ids = {f"{k}{i}" for k, n in sizes.items() for i in range(1, n + 1)} | {f"D-{i:02d}" for i in range(1, 14)}
    assert ids - set(registry.coverage()) - left_out - by_functions - {"A13"} == set()


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(cluster)
