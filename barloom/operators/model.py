"""Boosted-tree classifier on standardized features.

The default is one panel model over all tickers: its cost grows with rows, not with the number of
tickers, and Spark ML trains it distributed. A model per ticker is the same call on a filtered
frame.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom import contracts as K
from barloom.session import cut_lineage


#: training rows per task; a boosting step is short, so that few rows in many tasks cost more than they help
ROWS_PER_TASK = 20_000


class SingleClass(ValueError):
    """Training rows that show one class, or none."""


def fit(
    train: DataFrame, columns: list[str], trees: int = K.GBT_TREES, depth: int = K.GBT_DEPTH,
    step: float = K.GBT_STEP, seed: int = K.GBT_SEED, materialized: bool = False,
) -> PipelineModel:
    """Fit on rows with ``Target`` 0/1; positives weigh as much as all negatives together. ``materialized`` rows
    come from a table and are read again instead of being kept."""
    train = train.select(*columns, F.col("Target").cast("double").alias("Target"))
    train = train if materialized else cut_lineage(train)
    counts = train.agg(F.count(F.lit(1)).alias("n"), F.sum("Target").alias("pos")).first()
    if not counts["pos"] or counts["pos"] == counts["n"]:
        raise SingleClass("training rows show a single class")
    weight = (counts["n"] - counts["pos"]) / counts["pos"]
    weighted = train.coalesce(-(-counts["n"] // ROWS_PER_TASK)).withColumn("weight", F.when(F.col("Target") == 1, weight).otherwise(1.0))
    stages = [
        VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="error"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        GBTClassifier(
            labelCol="Target", featuresCol="features", weightCol="weight", maxIter=trees, maxDepth=depth,
            stepSize=step, seed=seed, checkpointInterval=10,
        ),
    ]
    return Pipeline(stages=stages).fit(weighted)


def probability(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with ``score``, the probability of the positive class."""
    scored = model.transform(df).withColumn("score", vector_to_array("probability")[1])
    return scored.drop("raw", "features", "rawPrediction", "probability", "prediction")


def top_features(model: PipelineModel, columns: list[str], count: int = 10) -> list[tuple[int, str, float]]:
    """(rank, feature, importance) of the most important features; one number per column."""
    importances = model.stages[-1].featureImportances.toArray()
    ranked = sorted(zip(columns, importances), key=lambda pair: -pair[1])[:count]
    return [(i, name, float(value)) for i, (name, value) in enumerate(ranked, start=1)]
