"""Evaluation of predicted classes and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank.tiers import N_TIERS, REPORT_PREFIX, tier_table


def align(predictions: DataFrame, truth: DataFrame, on: str = "item_id") -> DataFrame:
    """Predictions next to the true class of the same item."""
    return predictions.join(truth, on)


def confusion_counts(scored: DataFrame, truth: str = "truth", predicted: str = "predicted_quality") -> DataFrame:
    """Count per (truth, predicted) over the full 6 x 6 table, zeros included."""
    counts = scored.groupBy(
        F.col(truth).cast("int").alias("truth"), F.col(predicted).cast("int").alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))
    tiers = F.sequence(F.lit(0), F.lit(N_TIERS - 1))
    grid = (
        tier_table(scored.sparkSession)
        .select(F.col("tier").alias("truth"), F.explode(tiers).alias("predicted"))
    )
    return grid.join(counts, ["truth", "predicted"], "left").select(
        "truth", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def confusion_matrix(scored: DataFrame, truth: str = "truth", predicted: str = "predicted_quality") -> DataFrame:
    """One row per true class, one column per predicted class."""
    cells = confusion_counts(scored, truth, predicted)
    columns = [
        F.sum(F.when(F.col("predicted") == i, F.col("n")).otherwise(0)).alias(f"predicted_{i}") for i in range(N_TIERS)
    ]
    return cells.groupBy("truth").agg(*columns)


def classification_report(scored: DataFrame, truth: str = "truth", predicted: str = "predicted_quality") -> DataFrame:
    """Precision, recall, F1 and support per class plus the average rows.

    Works on the 36 counted cells; undefined ratios are 0.
    """
    cells = confusion_counts(scored, truth, predicted)
    n = F.col("n")

    def total(flag: Column) -> Column:
        return F.sum(F.when(flag, n).otherwise(0))

    diagonal = F.col("truth") == F.col("predicted")
    aggs = []
    for i in range(N_TIERS):
        t, p = F.col("truth") == i, F.col("predicted") == i
        aggs += [
            total(t & diagonal).alias(f"tp_{i}"), total(t).alias(f"support_{i}"), total(p).alias(f"picked_{i}"),
        ]
    wide = cells.agg(*aggs, F.sum("n").alias("total"), total(diagonal).alias("hits"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    per_class = []
    for i in range(N_TIERS):
        tp, support, picked = F.col(f"tp_{i}"), F.col(f"support_{i}"), F.col(f"picked_{i}")
        per_class.append(
            F.struct(
                F.lit(f"{REPORT_PREFIX} {i}").alias("class"),
                ratio(tp, picked).alias("precision"),
                ratio(tp, support).alias("recall"),
                ratio(2 * tp, picked + support).alias("f1"),
                support.cast("bigint").alias("support"),
            )
        )
    listed = wide.select(F.array(*per_class).alias("rows"), "total", "hits")

    def mean(field: str, weighted: bool) -> Column:
        def term(r: Column) -> Column:
            return r[field] * r["support"] if weighted else r[field]

        s = F.aggregate("rows", F.lit(0.0), lambda acc, r: acc + term(r))
        return ratio(s, F.col("total")) if weighted else s / N_TIERS

    def average(name: str, weighted: bool) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            mean("precision", weighted).alias("precision"),
            mean("recall", weighted).alias("recall"),
            mean("f1", weighted).alias("f1"),
            F.col("total").cast("bigint").alias("support"),
        )

    accuracy = ratio(F.col("hits"), F.col("total"))
    accuracy_row = F.struct(
        F.lit("accuracy").alias("class"),
        accuracy.alias("precision"),
        accuracy.alias("recall"),
        accuracy.alias("f1"),
        F.col("total").cast("bigint").alias("support"),
    )
    rows = F.concat(
        "rows", F.array(accuracy_row, average("macro avg", False), average("weighted avg", True))
    )
    return listed.select(F.inline(rows))


def accuracy_mse_rmse(scored: DataFrame, truth: str = "truth", predicted: str = "predicted_quality") -> DataFrame:
    diff = (F.col(predicted) - F.col(truth)).cast("double")
    mse = F.avg(diff * diff)
    return scored.agg(
        F.avg((F.col(predicted) == F.col(truth)).cast("double")).alias("accuracy"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
    )


def regression_metrics(scored: DataFrame, truth: str = "truth", predicted: str = "prediction") -> DataFrame:
    """Mean squared error and R2 of a continuous prediction, in one pass."""
    y = F.col(truth).cast("double")
    err = F.col(predicted).cast("double") - y
    return scored.agg(
        F.avg(err * err).alias("mse"),
        F.coalesce(
            F.lit(1.0) - F.try_divide(F.sum(err * err), F.var_pop(y) * F.count(y)), F.lit(0.0)
        ).alias("r2"),
    )
