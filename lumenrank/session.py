"""Session settings and shared scratch storage.

Intermediate results that must not be recomputed (range-partitioned row
positions, rounds of an iteration) are written as Parquet tables below the
folder named by ``spark.checkpoint.dir``. That folder is shared by all
executors, so the tables survive the loss of any of them, and reading them
back cuts the lineage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # call-site capture makes every Column operation several times slower
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # image and vector rows are wide: keep Arrow batches small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def get_session(app: str = "lumenrank", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder for this application's intermediate tables.

    The session's ``spark.checkpoint.dir`` is used as it is. Only a local
    master without that setting gets a temporary folder; a cluster without it
    is an error, because machine-local storage is lost with its executor.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="lumenrank-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/lumenrank-{sc.applicationId}"


def materialise(df: DataFrame, name: str = "t", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to shared storage and return a scan of the result."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """The current table of an iteration.

    ``save`` writes the next one and then deletes the one before, so a long
    iteration holds two tables on shared storage at most. Only for tables that
    nothing but the next round reads.
    """

    def __init__(self, name: str):
        self.name, self.path = name, None

    def save(self, df: DataFrame) -> DataFrame:
        spark, previous = df.sparkSession, self.path
        self.path = f"{scratch_root(spark)}/{self.name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        if previous:
            delete_path(spark, previous)
        return spark.read.schema(df.schema).parquet(self.path)


def _file_system(spark: SparkSession, path: str):
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(sc._jsc.hadoopConfiguration()), target


def delete_path(spark: SparkSession, path: str) -> None:
    fs, target = _file_system(spark, path)
    fs.delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target)


def list_folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """The rests of the names of the folders in ``path`` that begin with ``prefix``; for folders of few entries."""
    fs, target = _file_system(spark, path)
    if not fs.exists(target):
        return []
    names = [entry.getPath().getName() for entry in fs.listStatus(target) if entry.isDirectory()]
    return sorted(name[len(prefix):] for name in names if name.startswith(prefix))


def release_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table of this application."""
    delete_path(spark, scratch_root(spark))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
