"""The features of an account read a ledger that is written once, narrow, and need no ids of transfers."""

import pytest
from pyspark.sql import functions as F

from ledgergraph.functions.workspace import Workspace
from ledgergraph.operators import iterative, models
from ledgergraph.plans.catalog import OPERATORS, Operator
from ledgergraph.plans.dialect import SPARK
from ledgergraph.plans.fixtures import fixture
from ledgergraph.streaming import account_store


def test_the_view_is_run_once_for_all_features(spark, monkeypatch):
    seen, cut = [], Workspace.cut

    def noted(self, df, name):
        seen.append((name, [f for f in df.inputFiles() if "lineitem" in f]))
        return cut(self, df, name)

    monkeypatch.setattr(Workspace, "cut", noted)
    monkeypatch.setattr(iterative, "pagerank", lambda spark, pairs: pairs.select(F.col("src").alias("account_id"), F.lit(1.0).alias("pagerank")).distinct())
    monkeypatch.setattr(iterative, "kcore", lambda spark, pairs: pairs.select(F.col("src").alias("account_id"), F.lit(1).alias("kcore_number")).distinct())
    found = iterative.full_feature_table(spark, fixture(spark, "/root/testdata/sf0.001", "tx"))
    assert [name for name, files in seen if files] == ["tx"] and not [f for f in found.inputFiles() if "lineitem" in f]


def test_no_side_doubles_the_rows_for_distinct_peers():
    for name in ("feat_incoming", "feat_outgoing", "feat_account_table"):
        text = OPERATORS[name].build(SPARK)
        assert "count(distinct from_account)" not in text and "count(distinct to_account)" not in text and "tx_id" not in text


def test_a_training_writes_one_ledger(spark, monkeypatch):
    seen, cut = [], Workspace.cut

    def noted(self, df, name):
        seen.append((name, [f for f in df.inputFiles() if "lineitem" in f]))
        return cut(self, df, name)

    class Done(Exception):
        pass

    def stop(spark, ledger):
        raise Done(ledger.columns, [f for f in ledger.inputFiles() if "lineitem" in f])

    monkeypatch.setattr(Workspace, "cut", noted)
    monkeypatch.setattr(models, "features_of", stop)
    monkeypatch.setattr(models, "_TRAINED", {})
    with pytest.raises(Done) as found:
        models.ml_gbt_scores(spark, "/root/testdata/sf0.001")
    assert found.value.args == (list(iterative.LEDGER_COLUMNS), []) and [name for name, files in seen if files] == ["tx"]


def test_a_refresh_of_the_store_computes_network_columns_alone(spark, monkeypatch):
    tx = fixture(spark, "/root/testdata/sf0.001", "tx")
    applied, apply = [], Operator.apply
    monkeypatch.setattr(Operator, "apply", lambda self, *a, **k: applied.append(self.name) or apply(self, *a, **k))
    found = account_store.network_sources(spark, tx, True)
    assert applied == ["feat_device_sharing", "feat_institutions"] and [list(f.columns) for f in found.values()] == [["account_id", c] for c in found]
    monkeypatch.setattr(account_store, "causal_network", lambda spark, tx: ("ranks", "cores"))
    assert account_store.network_sources(spark, tx, False) == {"pagerank": "ranks", "kcore_number": "cores"} and len(applied) == 2
