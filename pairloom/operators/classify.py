"""User classification from embedding vectors with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame, functions as F

from pairloom.functions import keys as K


def with_features(df: DataFrame, values: str = "vals", label: str = "class_id") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(values).cast("array<double>"))).withColumn(
        "label", F.col(label).cast("double")
    )


def split_rows(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Repeatable train / test split by a hash of the row key."""
    cut = int(test_share * (1 << 60))
    place = K.hash_number(K.seeded_hash(seed, F.col(key)))
    return df.filter(place >= cut), df.filter(place < cut)


def train_classifier(
    train: DataFrame,
    num_features: int,
    num_classes: int,
    hidden: Sequence[Sequence[int]] = ((64,),),
    max_iter: Sequence[int] = (50,),
    step_size: Sequence[float] = (0.03,),
    seed: int = 0,
):
    """Fits a multilayer perceptron; with more than one setting the best by validation accuracy."""
    base = MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", seed=seed)
    grid = (
        ParamGridBuilder()
        .addGrid(base.layers, [[num_features, *h, num_classes] for h in hidden])
        .addGrid(base.maxIter, list(max_iter))
        .addGrid(base.stepSize, list(step_size))
        .build()
    )
    if len(grid) == 1:
        return base.fit(train, grid[0])
    search = TrainValidationSplit(
        estimator=base,
        estimatorParamMaps=grid,
        evaluator=MulticlassClassificationEvaluator(metricName="accuracy"),
        seed=seed,
    )
    return search.fit(train).bestModel


def predict_logits(model, rows: DataFrame) -> DataFrame:
    """Adds the class scores as `logits`."""
    scored = model.transform(rows)
    return scored.withColumn("logits", vector_to_array("rawPrediction")).drop("rawPrediction", "probability", "features")
