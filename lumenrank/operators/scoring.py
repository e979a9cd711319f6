"""Batch scoring with a caller's function.

The caller supplies ``make_predict``, called once per Python worker, whose
result maps a list of inputs to a list of outputs (logits, a distribution, or a
number in a one-element list). A batch that raises is retried row by row, so a
bad item becomes a failed row and its neighbours keep their scores.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.model_cache import ModelCache
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lumenrank import functions as fn
from lumenrank.schemas import struct
from lumenrank.tiers import tier_label

PredictBatch = Callable[[list], Sequence[Sequence[float]]]


def _doubles(row: Sequence[float]) -> np.ndarray:
    """One output as a vector of doubles; anything else is the model's failure."""
    values = np.asarray(row, dtype="float64")
    if values.ndim != 1:
        raise ValueError("an output is a list of numbers")
    return values


def score_batches(
    items: DataFrame,
    make_predict: Callable[[], PredictBatch],
    input_col: str,
    item: str = "item_id",
    batch_size: int = 100,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``item_id, output array<double>, success, error`` for every input row, and the columns in ``keep``."""
    kept = list(keep)
    own = [StructField("item_id", items.schema[item].dataType), *struct("output array<double>, success boolean, error string").fields]
    clash = [c for c in kept if c == "value" or c in (f.name for f in own)]
    if clash:
        raise ValueError(f"rename the columns {clash} before they are kept")
    schema = StructType(own + [StructField(c, items.schema[c].dataType) for c in kept])
    key = uuid.uuid4()

    def load() -> PredictBatch:
        """The model, kept between the tasks of a reused worker."""
        predict = ModelCache.get(key)
        if predict is None:
            predict = make_predict()
            ModelCache.add(key, predict)
        return predict

    def one(predict: PredictBatch, value: object) -> tuple:
        try:
            return _doubles(predict([value])[0]), True, None
        except Exception as exc:  # noqa: BLE001 - any failure becomes a row
            return None, False, f"{type(exc).__name__}: {exc}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for pdf in batches:
            values = pdf["value"].tolist()
            results: list[tuple] = []
            for at in range(0, len(values), batch_size):
                chunk = values[at : at + batch_size]
                try:
                    out = predict(chunk)
                    if len(out) != len(chunk):
                        raise ValueError("one output per input expected")
                    results += [(_doubles(row), True, None) for row in out]
                except Exception:  # noqa: BLE001 - isolate the failing rows
                    results += [one(predict, v) for v in chunk]
            output, success, error = zip(*results) if results else ((), (), ())
            scored = {"item_id": pdf["item_id"], "output": list(output), "success": list(success), "error": list(error)}
            yield pd.DataFrame(scored | {c: pdf[c] for c in kept}, index=pdf.index)

    rows = items.select(F.col(item).alias("item_id"), F.col(input_col).alias("value"), *kept)
    return rows.mapInPandas(run, schema)


def class_predictions(scored: DataFrame, logits: str = "output") -> DataFrame:
    """Logits -> probabilities, tier, label and confidence; failures keep nulls."""
    probs = fn.softmax(F.col(logits))
    return (
        scored.withColumn("all_probabilities", F.when(F.col("success"), probs))
        .withColumn("predicted_quality", fn.argmax(F.col("all_probabilities")))
        .withColumn("confidence", fn.confidence(F.col("all_probabilities")))
        .withColumn(
            "quality_label", F.when(F.col("success"), tier_label(F.col("predicted_quality")))
        )
        .drop(logits)
    )


def distribution_scores(scored: DataFrame, probs: str = "output") -> DataFrame:
    """Rating distribution -> mean grade, deviation and assessment."""
    mean = fn.expected_score(F.col(probs))
    return scored.withColumns(
        {"mean_score": mean, "std_dev": fn.score_std(F.col(probs))}
    ).withColumn("assessment", F.when(F.col("success"), fn.assessment(F.col("mean_score"))))


def scalar_scores(scored: DataFrame, output: str = "output") -> DataFrame:
    return scored.withColumn("score", F.get(F.col(output), F.lit(0))).drop(output)
