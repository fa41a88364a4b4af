"""Boosted-tree scoring of k-mers and its evaluation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.lineage import cut

FEATURES = ["in_long", "short_cov", "strand_ratio", "hp_loss", "entropy", "gc"]
THREE = ["short_cov", "strand_ratio", "entropy"]


def train(rows: DataFrame, iterations: int = 200, features: list[str] | None = None, seed: int = 7) -> PipelineModel:
    """A boosted-tree model of ``label``: depth 4, at least 5 rows a leaf, steps of 0.05, logistic loss.

    Rows of the same features and label count as one row of their number's weight, so each round passes over the distinct ones.
    """
    names = features or FEATURES
    held = cut(rows.groupBy(*names, "label").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    total = held.agg(F.sum("weight")).first()[0] or 1.0
    assemble = VectorAssembler(inputCols=names, outputCol="features")
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxDepth=4, minWeightFractionPerNode=min(5 / total, 0.49), stepSize=0.05, maxIter=iterations, seed=seed, cacheNodeIds=False)
    return Pipeline(stages=[assemble, trees]).fit(held)


def score(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """``rows`` with ``score``, the probability of label 1."""
    out = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction", "probability", "prediction")


def confusion(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: counts of outcomes at a threshold, accuracy, precision, recall and F1 (0 where undefined)."""
    hit, true = F.col("score") > threshold, F.col("label") > 0.5
    counts = rows.agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & ~true).alias("tn"), F.count_if(~hit & true).alias("fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.select("*", share(tp + tn, tp + fp + tn + fn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def roc(rows: DataFrame, steps: int = 100) -> DataFrame:
    """``threshold, fpr, tpr`` for thresholds 0, 1/steps, ...; a score counts as a hit where it is over the threshold.

    Scores fall into one bin each, and rates are sums over the bins from a threshold up, so rows are read once.
    """
    # the number of thresholds below the score
    below = F.greatest(F.least(F.ceil(F.round(F.col("score") * steps, 9)), F.lit(steps)), F.lit(0)).cast("int")
    bins = rows.groupBy(below.alias("bin")).agg(F.count_if(F.expr("label > 0.5")).alias("p"), F.count_if(F.expr("label <= 0.5")).alias("n"))
    spark = rows.sparkSession
    grid = spark.range(0, steps + 1).select(F.col("id").cast("int").alias("bin"))
    full = grid.join(bins, "bin", "left").na.fill(0, ["p", "n"])
    every = Window.partitionBy().orderBy("bin")
    after = every.rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rates = full.select("bin", F.sum("p").over(after).alias("tp"), F.sum("n").over(after).alias("fp"), F.sum("p").over(whole).alias("p"), F.sum("n").over(whole).alias("n")).where(F.col("bin") < steps)
    return rates.select((F.col("bin") / steps).alias("threshold"), F.when(F.col("n") > 0, F.col("fp") / F.col("n")).otherwise(0.0).alias("fpr"), F.when(F.col("p") > 0, F.col("tp") / F.col("p")).otherwise(0.0).alias("tpr"))


def save(model: PipelineModel, path: str) -> None:
    """Write a model."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    """Read a model back."""
    return PipelineModel.load(path)
