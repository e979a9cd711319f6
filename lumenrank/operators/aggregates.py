"""Summaries of predictions, labels, clusters and ratings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank.operators.keys import attach
from lumenrank.operators.positions import with_batch_id
from lumenrank.tiers import tier_table


def prediction_summary(predictions: DataFrame) -> DataFrame:
    """Counts of good and failed rows, mean tier and mean confidence of the good ones."""
    ok = F.col("success")
    return predictions.agg(
        F.count_if(ok).alias("n_success"),
        F.count_if(~ok).alias("n_failed"),
        F.avg(F.when(ok, F.col("predicted_quality"))).alias("mean_quality"),
        F.avg(F.when(ok, F.col("confidence"))).alias("mean_confidence"),
    ).withColumn(
        "status", F.when(F.col("n_success") == 0, F.lit("nothing processed")).otherwise(F.lit("ok"))
    )


def tier_distribution(predictions: DataFrame) -> DataFrame:
    """Count and share of every tier 0..5 among the good rows, zeros included."""
    counts = predictions.filter("success").groupBy(
        F.col("predicted_quality").cast("int").alias("tier")
    ).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    tiers = tier_table(predictions.sparkSession).select("tier", "label")
    return tiers.join(counts, "tier", "left").select(
        "tier",
        "label",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        F.round(F.coalesce(F.try_divide(F.col("n") * 100.0, total), F.lit(0.0)), 6).alias("percent"),
    )


def score_stats(df: DataFrame, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Count, min, max, mean and population deviation of the non-null scores."""
    s = F.col(score)
    return df.groupBy(*by).agg(
        F.count(s).alias("n"),
        F.min(s).alias("min_score"),
        F.max(s).alias("max_score"),
        F.avg(s).alias("mean_score"),
        F.stddev_pop(s).alias("std_score"),
    )


def batch_stats(items: DataFrame, order: Sequence[str | Column], score: str = "score", size: int = 100) -> DataFrame:
    """Min, mean and count per batch of consecutive files.

    Rows with a null score (unreadable files) take a slot in their batch; a
    batch without any score is left out.
    """
    s = F.col(score)
    return (
        with_batch_id(items, order, size)
        .groupBy("batch")
        .agg(F.count(s).alias("n"), F.min(s).alias("min_score"), F.avg(s).alias("mean_score"))
        .filter("n > 0")
    )


def dashboard_summary(rows: DataFrame) -> DataFrame:
    """Totals of a prediction table whose columns may be missing or textual."""
    ok = F.col("success").cast("boolean") if "success" in rows.columns else F.lit(True)
    tier = (
        F.col("predicted_quality").try_cast("double")
        if "predicted_quality" in rows.columns
        else F.lit(None).cast("double")
    )
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("n_success"),
        (F.count(F.lit(1)) - F.count_if(ok)).alias("n_failed"),
        F.avg(tier).alias("mean_quality"),
    )


def label_histogram(labels: DataFrame, label: str = "label") -> DataFrame:
    """Count per label from 0 to the largest one, zeros included."""
    counts = labels.groupBy(F.col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max("label").alias("top")).filter("top is not null")
    axis = top.select(F.explode(F.sequence(F.lit(0), F.col("top"))).alias("label"))
    return axis.join(counts, "label", "left").select(
        "label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def cluster_stats(labelled: DataFrame, label: str = "cluster") -> DataFrame:
    """Clusters without noise, noise rows and clustered rows.

    Labels are counted first, so the distinct works on one row per label.
    """
    sizes = cluster_sizes(labelled, label)
    real = F.col(label) != -1
    return sizes.agg(
        F.count_if(real).alias("n_clusters"),
        F.coalesce(F.sum(F.when(~real, F.col("size"))), F.lit(0)).cast("bigint").alias("n_noise"),
        F.coalesce(F.sum(F.when(real, F.col("size"))), F.lit(0)).cast("bigint").alias("n_clustered"),
        F.max(F.when(real, F.col("size"))).alias("largest"),
    )


def cluster_sizes(labelled: DataFrame, label: str = "cluster") -> DataFrame:
    return labelled.groupBy(label).agg(F.count(F.lit(1)).alias("size"))


def latest_label(log: DataFrame, order: Sequence[str] = ("ts", "row_num"), item: str = "item_id") -> DataFrame:
    """The last label of every item in log order; combines map-side."""
    return log.groupBy(item).agg(F.max_by("label", F.struct(*order)).alias("label"))


def annotation_progress(items: DataFrame, annotated: DataFrame, on: str = "item_id") -> DataFrame:
    """Done, remaining and total over the listing; foreign annotations do not count."""
    done = annotated.select(on).distinct().withColumn("_done", F.lit(1))
    marked = items.select(on).join(done, on, "left")
    return marked.agg(
        F.count("_done").alias("done"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("_done").isNull()).alias("remaining"),
    )


def bounded_stats(ratings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Items in play, at the lower bound and at the upper bound."""
    s = F.col("score")
    return ratings.groupBy(*by).agg(
        F.count_if((s > 0) & (s < 5)).alias("n_active"),
        F.count_if(s <= 0).alias("n_at_min"),
        F.count_if(s >= 5).alias("n_at_max"),
    )


def score_distribution(ratings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count per score rounded to one decimal."""
    return ratings.groupBy(*by, F.bround("score", 1).alias("score")).agg(F.count(F.lit(1)).alias("n"))


def min_max_normalise(
    ratings: DataFrame, by: Sequence[str] = (), raw: str = "raw_score", out: str = "score"
) -> DataFrame:
    """Map raw scores of each key linearly on 0..5, three decimals; equal scores give 2.5."""
    by = list(by)
    bounds = ratings.groupBy(*by).agg(F.min(raw).alias("_lo"), F.max(raw).alias("_hi"))
    if by:
        joined = attach(ratings, bounds, by)
    else:
        joined = ratings.select(
            "*", bounds.select("_lo").scalar().alias("_lo"), bounds.select("_hi").scalar().alias("_hi")
        )
    lo, hi, x = F.col("_lo"), F.col("_hi"), F.col(raw)
    scaled = F.round(F.try_divide(F.lit(5.0) * (x - lo), hi - lo), 3)
    return joined.withColumn(out, F.when(hi == lo, F.lit(2.5)).otherwise(scaled)).drop("_lo", "_hi")


def groups_of_two_or_more(members: DataFrame, group: str = "leader_id") -> DataFrame:
    return members.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
