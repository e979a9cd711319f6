"""Whole workflows: scoring, duplicates, semantic groups, votes, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank.operators.aggregates import cluster_stats, prediction_summary, tier_distribution
from lumenrank.operators.filters import filter_confidence
from lumenrank.operators.fingerprints import image_descriptors, phash
from lumenrank.operators.grouping import density_clusters, leader_groups
from lumenrank.operators.layout import layout_by_cluster, layout_by_dup_group
from lumenrank.operators.learning import check_classes, train_quality_forest
from lumenrank.operators.metrics import accuracy_mse_rmse, align, classification_report, confusion_matrix
from lumenrank.operators.positions import with_position
from lumenrank.operators.ranking import process_votes, rankings, session_status
from lumenrank.operators.scoring import class_predictions, score_batches
from lumenrank.session import materialise
from lumenrank.sources.items import label_from_folder, labels_from_folders, split_readable


class ScoreReport(NamedTuple):
    predictions: DataFrame
    summary: DataFrame
    distribution: DataFrame


def score_library(
    items: DataFrame, make_predict: Callable, input_col: str, threshold: float | None = None, item: str = "item_id",
    keep: Sequence[str] = (),
) -> ScoreReport:
    """Score every item, apply the confidence threshold, summarise; the columns in ``keep`` stay with their item."""
    # summary and distribution read the scores again; the model runs once
    scored = score_batches(items, make_predict, input_col, item, keep=keep)
    predictions = materialise(class_predictions(scored), "scores")
    kept = filter_confidence(predictions, threshold)
    return ScoreReport(kept, prediction_summary(kept), tier_distribution(kept))


def duplicate_report(images: DataFrame, threshold: int = 5, hash_size: int = 8) -> tuple[DataFrame, DataFrame]:
    """Decoded images -> near-duplicate groups in path order and their layout."""
    if hash_size != 8:
        raise ValueError("grouping works on 64-bit hashes; hash_size must be 8")
    good, _ = split_readable(images)
    hashed = phash(good)
    placed = with_position(hashed, ["item_id"], name="ord")
    groups = leader_groups(placed, threshold)
    paths = placed.select("item_id", F.col("item_id").alias("path"))
    return groups, layout_by_dup_group(groups, paths)


def semantic_grouping(
    vectors: DataFrame, eps: float = 0.5, min_samples: int = 2, item: str = "item_id", path: str = "path"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Feature vectors -> clusters, their layout and their statistics.

    The vectors need not have unit length: the cosine join normalises them in
    its tasks.
    """
    order = item if "ord" not in vectors.columns else "ord"
    # the layout and the statistics share the labels; the clustering runs once
    labelled = materialise(density_clusters(vectors, eps, min_samples, item, order), "labels")
    located = labelled.join(vectors.select(F.col(item).alias("item_id"), path), "item_id")
    return labelled, layout_by_cluster(located, path=path), cluster_stats(labelled)


def vote_report(duels: DataFrame, items: DataFrame, method: str = "elo") -> tuple[DataFrame, DataFrame]:
    """Votes -> export ranking and session status."""
    rated = process_votes(duels, items, method)
    return rankings(rated, method), session_status(duels, rated, method)


class Evaluation(NamedTuple):
    matrix: DataFrame
    report: DataFrame
    errors: DataFrame


def evaluate_predictions(predictions: DataFrame, truth: DataFrame, on: str = "item_id") -> Evaluation:
    """Confusion matrix, per-class report and error measures of a test set."""
    scored = align(predictions.filter("success"), truth, on)
    return Evaluation(confusion_matrix(scored), classification_report(scored), accuracy_mse_rmse(scored))


def evaluate_classifier(
    items: DataFrame, make_predict: Callable, input_col: str, truth: DataFrame, item: str = "item_id"
) -> Evaluation:
    """Score a test set with any batch classifier and evaluate it."""
    predictions = class_predictions(score_batches(items, make_predict, input_col, item))
    # the three reports share the scores; the model runs once
    scores = materialise(predictions.select("item_id", "success", "predicted_quality"), "scores")
    return evaluate_predictions(scores, truth)


def train_forest_from_images(images: DataFrame, strict: bool = False, **params: object) -> tuple[PipelineModel, DataFrame]:
    """Images in ``quality_N`` folders -> descriptor forest and test metrics."""
    good, _ = split_readable(images)
    labelled = labels_from_folders(good)
    check_classes(labelled, strict=strict)
    # a forest reads its training rows once per depth; the images are decoded once
    described = materialise(image_descriptors(labelled), "descriptors").withColumn(
        "label", label_from_folder(F.col("item_id"))
    )
    return train_quality_forest(described, **params)
