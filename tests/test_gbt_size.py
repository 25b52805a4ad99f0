"""The registered boosted trees have the operator's own size."""

import pytest
from pyspark.sql import functions as F

from ledgergraph.operators import models
from ledgergraph.operators.models import train_gbt
from ledgergraph.plans.catalog import OPERATORS
from ledgergraph.plans.fixtures import fixture


class Caught(Exception):
    pass


def table(spark, n=200):
    """Accounts whose label follows one feature, the last ones in another range of it."""
    rows = spark.range(n).withColumn("label_", (F.hash("id") % 4 == 0).cast("int"))
    columns = [(F.col("label_") * 5 + F.rand(3) if c == "burst_ratio" else F.rand(i)).alias(c) for i, c in enumerate(models.INPUTS)]
    split = F.when(F.col("id") < 0.7 * n, "train").when(F.col("id") < 0.85 * n, "val").otherwise("test")
    return rows.select(F.col("id").alias("account_id"), *columns, F.col("label_").alias("is_laundering_label"), split.alias("split"))


def test_trained_on_the_first_accounts_and_judged_on_the_last(spark):
    accounts = table(spark)
    model, rows = train_gbt(accounts, trees=3, depth=2)
    found = models.evaluation(spark, model, rows).first()
    held = accounts.where("split = 'test'")
    assert found.accounts == held.count() == 30 and found.illicit == held.where("is_laundering_label = 1").count()
    assert found.average_precision == found.recall == found.precision_ == 1.0
    assert models.importances(spark, model).first().feature == "burst_ratio"
    # what is learnt does not see the other splits
    broken = accounts.withColumn("is_laundering_label", F.when(F.col("split") == "train", F.col("is_laundering_label")).otherwise(0))
    again, _ = train_gbt(broken, trees=3, depth=2)
    assert again.featureImportances == model.featureImportances


def test_the_table_has_the_temporal_split_and_all_columns(spark):
    tx = fixture(spark, "/root/testdata/sf0.001", "tx")
    found = models.training_table(spark, tx)
    assert set(models.INPUTS) <= set(found.columns) and len(models.INPUTS) == 24
    seen = {r.account_id: r.first_seen for r in OPERATORS["feat_first_seen"].apply(spark, {"tx": tx}).collect()}
    by = {s: [seen[r.account_id] for r in found.where(F.col("split") == s).select("account_id").collect()] for s in ("train", "val", "test")}
    assert max(by["train"]) <= min(by["val"]) and max(by["val"]) <= min(by["test"])
    assert [len(by[s]) for s in ("train", "val", "test")] == [140, 30, 30]


@pytest.mark.parametrize("name", ["ml_gbt_scores", "ml_gbt_importance"])
def test_registered_with_300_trees_of_depth_6(spark, monkeypatch, name):
    def fit(self, rows):
        raise Caught(self.getMaxIter(), self.getMaxDepth(), self.getStepSize(), self.getSubsamplingRate())

    monkeypatch.setattr(models.GBTClassifier, "fit", fit)
    monkeypatch.setattr(models, "_TRAINED", {})
    monkeypatch.setattr(models, "training_table", lambda spark, tx: table(spark))
    with pytest.raises(Caught) as found:
        models.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert found.value.args == (300, 6, 0.05, 0.8) and train_gbt.__defaults__ == (300, 6, 0.05, 0.8)
