"""Row predicates and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank.tiers import N_TIERS


def filter_confidence(predictions: DataFrame, threshold: float | None = None) -> DataFrame:
    """Keep failures and rows at or above the threshold; no threshold keeps all."""
    if not threshold:
        return predictions
    return predictions.filter(confidence_passes(threshold))


def confidence_passes(threshold: float) -> Column:
    return ~F.col("success") | (F.col("confidence") >= threshold)


def confidence_report(predictions: DataFrame, threshold: float | None = None) -> DataFrame:
    """Rows kept and dropped by the threshold, in one pass."""
    keep = confidence_passes(threshold) if threshold else F.lit(True)
    return predictions.agg(
        F.count_if(keep).alias("n_kept"), F.count_if(~keep).alias("n_dropped")
    )


def valid_label(label: Column) -> Column:
    number = F.trim(label.cast("string")).try_cast("int")
    return F.coalesce(number.between(0, N_TIERS - 1), F.lit(False))


def spread_probs(predictions: DataFrame, arr: str = "all_probabilities") -> DataFrame:
    """Array of probabilities -> one column per tier."""
    return predictions.select(
        *[c for c in predictions.columns if c != arr],
        *[F.get(F.col(arr), F.lit(i)).alias(f"prob_quality_{i}") for i in range(N_TIERS)],
    )


def pack_probs(flat: DataFrame, arr: str = "all_probabilities") -> DataFrame:
    """One column per tier -> array; rows without any probability get null."""
    names = [f"prob_quality_{i}" for i in range(N_TIERS)]
    any_set = F.coalesce(*[F.col(n) for n in names]).isNotNull()
    return flat.select(
        *[c for c in flat.columns if c not in names],
        F.when(any_set, F.array(*[F.col(n) for n in names])).alias(arr),
    )


def eligible_items(ratings: DataFrame, method: str = "elo") -> DataFrame:
    """Items still in play: strictly inside the bounds for bounded scores."""
    if method == "elo":
        return ratings
    return ratings.filter((F.col("score") > 0) & (F.col("score") < 5))


def union_listings(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Distinct rows of several listings."""
    merged = first
    for other in others:
        merged = merged.unionByName(other)
    return merged.distinct()


def append_rows(first: DataFrame, *others: DataFrame) -> DataFrame:
    merged = first
    for other in others:
        merged = merged.unionByName(other)
    return merged


def pending_items(items: DataFrame, done: DataFrame, on: str = "item_id") -> DataFrame:
    """Items that have no annotation yet."""
    return items.join(done.select(on), on, "left_anti")


def split_by_existence(rows: DataFrame, listing: DataFrame, col: str = "path") -> tuple[DataFrame, DataFrame]:
    """Rows whose source is listed, and rows whose source is missing."""
    known = listing.select(col)
    return rows.join(known, col, "left_semi"), rows.join(known, col, "left_anti")
