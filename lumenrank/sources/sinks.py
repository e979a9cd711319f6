"""Writers. Every writer is a plain distributed ``DataFrame.write``."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lumenrank import functions as fn
from lumenrank.operators.aggregates import prediction_summary
from lumenrank.operators.filters import spread_probs
from lumenrank.schemas import require_columns
from lumenrank.tiers import tier_folder

# Column order of the exported tables.
PREDICTION_COLUMNS = [
    "image_path", "predicted_quality", "quality_label", "confidence", "success", "error",
]
RANKING_COLUMNS = ["rank", "image", "image_path", "raw_score", "score_0_to_5"]
HISTORY_COLUMNS = [
    "timestamp", "image1", "image2", "winner",
    "score1_before", "score2_before", "score1_after", "score2_after",
]
ANNOTATION_COLUMNS = ["timestamp", "image_path", "label", "class_name"]


def write_predictions(predictions: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """CSV (one column per probability), JSON Lines with a manifest, or Parquet."""
    require_columns(predictions, PREDICTION_COLUMNS)
    if fmt == "csv":
        flat = spread_probs(predictions.select(*PREDICTION_COLUMNS, "all_probabilities"))
        flat.write.mode(mode).option("header", True).csv(path)
    elif fmt == "json":
        rows = predictions.select(*PREDICTION_COLUMNS, "all_probabilities")
        seen = Observation()  # counted while the rows are written; a model behind them runs once
        counted = rows.observe(seen, F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"))
        counted.write.mode(mode).option("ignoreNullFields", False).json(f"{path}/results")
        totals = rows.sparkSession.range(1, numPartitions=1).select(
            F.lit(seen.get["ok"]).alias("n_success"), F.lit(seen.get["failed"]).alias("n_failed")
        )
        _manifest_row(totals).write.mode(mode).json(f"{path}/manifest")
    elif fmt == "parquet":
        predictions.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unsupported output format {fmt!r}; use csv, json or parquet")


def manifest(predictions: DataFrame) -> DataFrame:
    """One row of totals that accompanies the JSON rows."""
    return _manifest_row(prediction_summary(predictions))


def _manifest_row(totals: DataFrame) -> DataFrame:
    return totals.select(
        F.current_timestamp().alias("timestamp"),
        (F.col("n_success") + F.col("n_failed")).cast("bigint").alias("total_images"),
        F.col("n_success").cast("bigint").alias("successful_predictions"),
    )


def annotation_rows(labels: DataFrame) -> DataFrame:
    """Log rows for validated labels: UTC time and the tier's class name."""
    utc = F.to_utc_timestamp(F.coalesce(F.col("ts"), F.current_timestamp()), F.current_timezone())
    return labels.select(
        F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        "image_path",
        F.col("label").cast("int").alias("label"),
        tier_folder(F.col("label")).alias("class_name"),
    )


def append_annotations(labels: DataFrame, path: str) -> None:
    """Append to the log folder; each new file carries its own header."""
    if "ts" not in labels.columns:
        labels = labels.withColumn("ts", F.lit(None).cast("timestamp"))
    annotation_rows(labels).write.mode("append").option("header", True).csv(path)


def write_rankings(rankings: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Ranking rows; the keys in ``by`` are further columns. ``write_by_group`` makes folders of groups."""
    rankings.select(*RANKING_COLUMNS, *(by or [])).write.mode("overwrite").option("header", True).csv(path)


def write_duel_history(history: DataFrame, path: str) -> None:
    """Duel history with the base names of the items."""
    named = {c: fn.basename(F.col(c)) for c in ("image1", "image2", "winner")}
    columns = [c for c in HISTORY_COLUMNS if c in history.columns]
    history.withColumns(named).select("session_id", *columns).write.mode("overwrite").option("header", True).csv(path)


def write_by_group(records: DataFrame, path: str, group_col: str = "dest_dir", fmt: str = "parquet") -> None:
    """One folder per group value.

    The rebalance hint gathers small groups in few files and splits a large
    group into several tasks by its measured size.
    """
    balanced = records.hint("rebalance", F.col(group_col))
    balanced.write.mode("overwrite").partitionBy(group_col).format(fmt).save(path)


def write_ml_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_ml_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
