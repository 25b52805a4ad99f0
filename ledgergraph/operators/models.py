"""Learned scorers over account features.

The boosted trees are trained on the accounts that appear first (70 per cent), never on
the 15 per cent of validation or the last 15 per cent, on which they are judged.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workspace import Workspace, shared_root
from ..plans.catalog import OPERATORS
from ..plans.fixtures import fixture
from . import scoring  # noqa: F401  (registers the split and the metrics)
from .features import FEATURE_COLUMNS
from .iterative import features_of, narrow_ledger

#: All 24 columns of the feature contract.
INPUTS = FEATURE_COLUMNS


def training_table(spark: SparkSession, tx: DataFrame) -> DataFrame:
    """The features, label and temporal split (``train, val, test``) of every account,
    written once for all passes of a training."""
    ledger = narrow_ledger(spark, tx)
    split = OPERATORS["ml_node_split"].apply(spark, {"tx": ledger})
    found = features_of(spark, ledger).join(split, "account_id")
    return Workspace(spark, "training").cut(found, "accounts")


def train_gbt(table: DataFrame, trees: int = 300, depth: int = 6, step: float = 0.05, subsample: float = 0.8):
    """Boosted trees on the accounts of the training split, rare positives weighted up
    by the class ratio, and the rows of ``table`` with their vectors.

    Lineage is cut every ten trees where the context has a checkpoint folder; it gets the
    shared one if it has none.
    """
    context = table.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(f"{shared_root(table.sparkSession)}/ledgergraph/trees")
    rows = VectorAssembler(inputCols=list(INPUTS), outputCol="x").transform(table)
    rows = rows.withColumn("label", F.col("is_laundering_label").cast("double"))
    train = rows.where("split = 'train'")
    counts = train.agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n")).first()
    ratio = (counts["n"] - (counts["p"] or 0)) / max(counts["p"] or 0, 1)
    weighted = train.withColumn("w", F.when(F.col("label") == 1, F.lit(float(ratio))).otherwise(F.lit(1.0)))
    model = GBTClassifier(
        featuresCol="x", weightCol="w", maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=subsample,
        featureSubsetStrategy="0.8", checkpointInterval=10, seed=1,
    ).fit(weighted)
    return model, rows


def evaluation(spark: SparkSession, model, rows: DataFrame, split: str = "test") -> DataFrame:
    """One row over the accounts of a split: ``accounts, illicit``, the exact average
    precision of ``ml_metrics``, and precision, recall and F1 at 0.5."""
    held = rows.where(F.col("split") == split)
    scored = Workspace(spark, "evaluation").cut(predict(model, held).join(held.select("account_id", "label"), "account_id"), "scored")
    scored = scored.select("label", F.col("risk_score").alias("score"))
    size = scored.agg(F.count(F.lit(1)).alias("accounts"), F.sum("label").cast("long").alias("illicit"))
    return size.crossJoin(OPERATORS["ml_metrics"].apply(spark, {"scored": scored.withColumn("label", F.col("label").cast("int"))}))  # one row each


def predict(model, rows: DataFrame) -> DataFrame:
    """``account_id, risk_score, risk_level`` with right-closed level bins."""
    score = vector_to_array(F.col("probability"))[1]
    level = F.when(F.col("risk_score") > 0.8, "HIGH").when(F.col("risk_score") > 0.5, "MEDIUM").otherwise("LOW")
    return model.transform(rows).select("account_id", score.alias("risk_score")).withColumn("risk_level", level)


def importances(spark: SparkSession, model, top: int = 10) -> DataFrame:
    pairs = sorted(zip(INPUTS, map(float, model.featureImportances.toArray()), strict=True), key=lambda p: (-p[1], p[0]))
    return spark.createDataFrame(pairs[:top], "feature string, importance double")


#: The trained model and its rows by application and folder: the queries share one.
_TRAINED: dict[tuple[str, str], tuple] = {}


def _trained(spark: SparkSession, sf_dir: str) -> tuple:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TRAINED:
        _TRAINED[key] = train_gbt(training_table(spark, fixture(spark, sf_dir, "tx")))
    return _TRAINED[key]


def ml_gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(*_trained(spark, sf_dir))


def ml_gbt_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importances(spark, _trained(spark, sf_dir)[0])


def ml_gbt_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the scorer does on the accounts that appear last."""
    return evaluation(spark, *_trained(spark, sf_dir))


def ml_typology_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-layer perceptron over vectors; UNKNOWN below 0.40 confidence."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("x"), F.col("label").cast("double").alias("label")
    )
    width, classes = len(rows.first()["x"]), int(rows.agg(F.max("label")).first()[0]) + 1
    model = MultilayerPerceptronClassifier(featuresCol="x", layers=[width, 16, classes], maxIter=30, seed=1).fit(rows)
    p = vector_to_array(F.col("probability"))
    found = model.transform(rows).select("vec_id", p.alias("p"))
    return found.select(
        "vec_id", F.array_max("p").alias("confidence"),
        F.when(F.array_max("p") < 0.40, "UNKNOWN")
        .otherwise(F.concat(F.lit("T"), (F.array_position("p", F.array_max("p")) - 1).cast("string"))).alias("typology"),
    )


QUERIES = {"ml_gbt_scores": ml_gbt_scores, "ml_gbt_importance": ml_gbt_importance, "ml_gbt_evaluation": ml_gbt_evaluation, "ml_typology_mlp": ml_typology_mlp}
COVERS = {"ml_gbt_scores": "E7 E8", "ml_gbt_importance": "E21", "ml_gbt_evaluation": "E7 E13", "ml_typology_mlp": "E9"}
SQL: dict[str, str] = {}
