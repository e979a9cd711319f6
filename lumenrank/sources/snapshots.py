"""Rating snapshots: versions of all ratings with the last vote they contain."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.session import list_folders, path_exists


class Snapshot(NamedTuple):
    """Ratings after some votes and how far each session has come.

    ``ratings`` has ``session_id, item, raw_score``; ``progress`` has
    ``session_id, last_seq, n_duels`` for every session with a vote.
    """

    method: str
    ratings: DataFrame
    progress: DataFrame


def _folder(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/version={version}"


def snapshot_versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of ``path``, oldest first."""
    found = [int(v) for v in list_folders(spark, path, "version=")]
    return sorted(v for v in found if path_exists(spark, f"{_folder(path, v)}/commit/_SUCCESS"))


def write_snapshot(spark: SparkSession, snapshot: Snapshot, path: str, version: int) -> None:
    """Write one version; its commit row comes last, so a version is complete or not seen.

    A complete version is left as it is, so a repeated job changes nothing; one
    that was cut short is written anew.
    """
    if version in snapshot_versions(spark, path):
        return
    target = _folder(path, version)
    ratings = snapshot.ratings.select("session_id", "item", F.col("raw_score").cast("double").alias("raw_score"))
    ratings.write.mode("overwrite").parquet(f"{target}/ratings")
    snapshot.progress.select("session_id", "last_seq", "n_duels").write.mode("overwrite").parquet(f"{target}/progress")
    commit = spark.range(1, numPartitions=1).select(
        F.lit(snapshot.method).alias("method"), F.current_timestamp().alias("written")
    )
    commit.write.mode("overwrite").parquet(f"{target}/commit")


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The given version, or the newest complete one."""
    versions = snapshot_versions(spark, path)
    if not versions or (version is not None and version not in versions):
        raise ValueError(f"{path} has the complete versions {versions}, not {version}")
    target = _folder(path, versions[-1] if version is None else version)
    return Snapshot(
        spark.read.parquet(f"{target}/commit").first()["method"],
        spark.read.parquet(f"{target}/ratings"),
        spark.read.parquet(f"{target}/progress"),
    )
