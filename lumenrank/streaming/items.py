"""Streams of annotations, new files and predictions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lumenrank.sources.items import keep_supported, list_paths
from lumenrank.streaming.keyed import KeyedRuns

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def _annotations(spark: SparkSession, path: str, item: str, fanout: int) -> KeyedRuns:
    return KeyedRuns(spark, path, [item], ["ts", "row_num", "label"], fanout)


def stream_annotations(log: DataFrame, path: str, item: str = "item_id", fanout: int = 8) -> DataStreamWriter:
    """Keep the latest label per item of an annotation stream.

    The state is a table of merged runs (:class:`KeyedRuns`): its files grow
    with the items, not with the micro-batches, and a replayed batch changes
    nothing. Read it with :func:`annotation_state`.
    """
    rows = log.select(item, "label", "ts", "row_num")

    def save(batch: DataFrame, batch_id: int) -> None:
        _annotations(batch.sparkSession, path, item, fanout).absorb(batch, batch_id)

    return rows.writeStream.outputMode("update").foreachBatch(save)


def annotation_state(spark: SparkSession, path: str, item: str = "item_id", fanout: int = 8) -> DataFrame:
    """``item, label``: the last label of every item so far."""
    return _annotations(spark, path, item, fanout).table().select(item, "label")


def stream_new_items(
    spark: SparkSession, root: str, extensions: str | list[str] = "scoring", max_files: int = 1000
) -> DataFrame:
    """Files as they arrive, each one once; the checkpoint is the set already seen. Spark lists no empty files."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(root)
    )
    return keep_supported(list_paths(files), extensions).select(
        F.col("path").alias("item_id"), "path", "name", "dir", "ext", "length",
        F.col("modificationTime").alias("mtime"), "content",
    )


def stream_summary(predictions: DataFrame) -> DataFrame:
    """Running tier counts of good rows (complete mode)."""
    return predictions.filter("success").groupBy(
        F.col("predicted_quality").cast("int").alias("tier")
    ).agg(F.count(F.lit(1)).alias("n"))


def stream_scores(
    files: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    path: str,
) -> DataStreamWriter:
    """Score arriving items, each one once.

    ``score`` maps a batch of items to its scored rows (for example
    :func:`~lumenrank.operators.scoring.score_batches` followed by
    ``class_predictions``). A micro-batch overwrites its own ``batch`` folder,
    so a batch repeated after a failure is scored again but stored once. Read
    the rows with :func:`scored_items`.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return files.writeStream.foreachBatch(save)


def scored_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")
