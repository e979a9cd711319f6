"""Splits, class checks and Spark ML models on descriptors and embeddings."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank import functions as fn
from lumenrank.operators.fingerprints import DESCRIPTORS
from lumenrank.operators.metrics import regression_metrics
from lumenrank.operators.positions import order_by_score
from lumenrank.sources.items import missing_classes

# Forest parameters.
FOREST = {"numTrees": 100, "maxDepth": 10, "seed": 42}


def split_train_test(df: DataFrame, test_size: float = 0.2, seed: int = 42, key: str = "item_id") -> DataFrame:
    """Append ``split``; a row's side depends on its key and the seed only."""
    share = fn.hash_bits(F.col(key), str(seed)) / F.lit(2.0**32)
    return df.withColumn("split", F.when(share < test_size, F.lit("test")).otherwise(F.lit("train")))


def check_classes(labelled: DataFrame, label: str = "label", strict: bool = False) -> DataFrame:
    """Table of classes without examples; ``strict`` raises when there is one."""
    missing = missing_classes(labelled, label)
    if strict:
        names = [r.report_name for r in missing.collect()]  # at most six
        if names:
            raise ValueError(f"classes without examples: {sorted(names)}")
    return missing


def train_quality_forest(
    labelled: DataFrame, features: list[str] | None = None, label: str = "label", test_size: float = 0.2,
    **params: object,
) -> tuple[PipelineModel, DataFrame]:
    """Random forest on descriptor columns; returns the model and its test metrics."""
    parts = split_train_test(labelled, test_size)
    assembler = VectorAssembler(inputCols=features or DESCRIPTORS, outputCol="features_vec")
    forest = RandomForestRegressor(
        featuresCol="features_vec", labelCol="_y", predictionCol="prediction", **{**FOREST, **params}
    )
    train = parts.filter("split = 'train'").withColumn("_y", F.col(label).cast("double"))
    model = Pipeline(stages=[assembler, forest]).fit(train)
    test = model.transform(parts.filter("split = 'test'"))
    return model, regression_metrics(test, label, "prediction")


def predict_quality_forest(model: PipelineModel, rows: DataFrame, item: str = "item_id") -> DataFrame:
    """Limited and rounded score with its category, best first."""
    scored = model.transform(rows).withColumn("predicted_quality", fn.clip_round_score(F.col("prediction")))
    named = scored.select(
        item, "predicted_quality", fn.score_category(F.col("predicted_quality")).alias("quality_category")
    )
    return order_by_score(named, "predicted_quality", item)


def train_quality_head(
    labelled: DataFrame, features: str = "features", label: str = "label", weight_decay: float = 0.01, max_iter: int = 50
) -> PipelineModel:
    """Six-class linear head on fixed embeddings."""
    rows = _vectors(labelled, features).withColumn("_y", F.col(label).cast("double"))
    head = LogisticRegression(
        featuresCol="features_vec", labelCol="_y", family="multinomial", regParam=weight_decay, maxIter=max_iter
    )
    return Pipeline(stages=[head]).fit(rows)


def predict_quality_head(model: PipelineModel, rows: DataFrame, features: str = "features") -> DataFrame:
    """Probabilities, class and confidence of every row."""
    scored = model.transform(_vectors(rows, features))
    probs = vector_to_array("probability")
    return scored.select(
        *rows.columns,
        probs.alias("all_probabilities"),
        F.col("prediction").cast("int").alias("predicted_quality"),
        F.array_max(probs).alias("confidence"),
    )


def _vectors(rows: DataFrame, features: str) -> DataFrame:
    doubles = F.transform(F.col(features), lambda x: x.cast("double"))
    return rows.withColumn("features_vec", array_to_vector(doubles))
