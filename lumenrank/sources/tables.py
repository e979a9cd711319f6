"""Readers for prediction tables, mappings, annotation logs and vote logs."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank import schemas
from lumenrank import functions as fn
from lumenrank.operators.filters import pack_probs
from lumenrank.operators.positions import with_position
from lumenrank.tiers import as_tier


def _headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """First line -> files that begin with it. A folder has few kinds of headers, however many files."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("i"),
    )
    first = lines.filter("at = 0").groupBy("f").agg(F.min_by("value", "i").alias("header"))
    found: dict[str, list[str]] = {}
    for r in first.collect():
        found.setdefault(r["header"], []).append(unquote(r["f"]))
    return found


def _csv(spark: SparkSession, path: str, ddl: str, required: list[str]) -> DataFrame:
    """Columns are matched by header name in each file, so files may order or omit them."""
    wanted = schemas.struct(ddl)
    found = _headers(spark, path)
    sources = [path] if len(found) <= 1 else sorted(found.values())
    parts = []
    for source in sources:
        table = spark.read.option("header", True).csv(source)  # header only, all strings
        schemas.require_columns(table, required)
        parts.append(table.select(
            *[
                (F.col(f.name).try_cast(f.dataType) if f.name in table.columns else F.lit(None).cast(f.dataType)).alias(f.name)
                for f in wanted.fields
            ]
        ))
    return reduce(DataFrame.unionByName, parts)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Flat prediction CSV -> prediction rows with the probabilities as an array."""
    flat = _csv(spark, path, schemas.PREDICTIONS_CSV, ["image_path", "quality_label"])
    return pack_probs(flat).withColumn("predicted_quality", as_tier(F.col("predicted_quality")))


def read_predictions_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PREDICTIONS).json(path)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """``path,dir`` rows, stripped, with file row numbers starting at 2.

    Spark does not expose line numbers, so the order is the one of the file
    splits (path, block offset, row inside the block).
    """
    rows = schemas.require_columns(spark.read.option("header", True).csv(path), ["path", "dir"])
    located = rows.select(
        F.trim("path").alias("path"),
        F.trim("dir").alias("dir"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    numbered = with_position(located, ["_file", "_block", "_id"], name="row_num", start=2)
    return numbered.select("row_num", "path", "dir")


def clean_annotations(log: DataFrame) -> DataFrame:
    """Drop log rows with an empty item or a label that is not a whole number.

    Log times are UTC without a zone.
    """
    item = F.trim("image_path")
    return log.select(
        F.from_utc_timestamp(F.col("timestamp").try_cast("timestamp"), F.current_timezone()).alias("ts"),
        item.alias("image_path"),
        F.trim("label").try_cast("int").alias("label"),
        "class_name",
    ).filter((F.col("image_path") != "") & F.col("label").isNotNull())


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    log = _csv(spark, path, schemas.ANNOTATIONS_CSV, ["image_path", "label"])
    return clean_annotations(log)


def read_vote_state(spark: SparkSession, path: str) -> DataFrame:
    """Saved ratings of one or many JSON state files as long rows; both maps are matched in one pass."""
    state = spark.read.option("multiLine", True).schema(schemas.VOTE_STATE_JSON).json(path)
    rated = F.transform_values("raw_scores", lambda _, v: F.struct(v.alias("v")))
    shown = F.coalesce("scores", F.create_map().cast("map<string,double>"))
    pairs = F.map_zip_with(rated, shown, lambda _, r, s: F.struct(r.alias("raw"), s.alias("score")))
    return state.select("method", "comparisons_count", F.explode(pairs).alias("item", "_s")).filter(
        F.col("_s.raw").isNotNull()
    ).select(
        "method",
        "comparisons_count",
        "item",
        fn.basename(F.col("item")).alias("name"),
        F.col("_s.raw.v").alias("raw_score"),
        F.col("_s.score").alias("score"),
    )


def read_duel_log(spark: SparkSession, path: str) -> DataFrame:
    """Duel history held inside JSON state files, numbered in log order."""
    state = spark.read.option("multiLine", True).schema(schemas.VOTE_STATE_JSON).json(path)
    duel = F.posexplode("comparisons").alias("_pos", "duel")
    return state.select(F.input_file_name().alias("session_id"), duel).select(
        "session_id",
        (F.col("_pos") + 1).cast("bigint").alias("seq"),
        F.col("duel.winner").alias("winner"),
        F.when(F.col("duel.winner") == F.col("duel.image1"), F.col("duel.image2"))
        .otherwise(F.col("duel.image1"))
        .alias("loser"),
    )


def read_duels(spark: SparkSession, path: str) -> DataFrame:
    return schemas.require_columns(spark.read.parquet(path), ["session_id", "seq", "winner", "loser"])
