"""Item listings and decoded images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank import functions as fn
from lumenrank.schemas import require_columns
from lumenrank.tiers import N_TIERS, in_profile, profile, tier_table

# Folder fragments that mark tool and version-control folders.
PRUNED_DIRS = [".venv", ".git"]


def list_paths(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Path pieces of any table with a path column."""
    require_columns(paths, [path_col])
    path = F.col(path_col)
    return paths.select(
        "*",
        fn.basename(path).alias("name"),
        fn.dirname(path).alias("dir"),
        F.lower(fn.extension(fn.basename(path))).alias("ext"),
    )


def keep_supported(
    items: DataFrame, extensions: str | list[str] = "scoring", prune_dirs: bool = False
) -> DataFrame:
    """Rows whose suffix is in a profile, optionally outside pruned folders."""
    kept = items.filter(in_profile(F.col("ext"), extensions))
    if prune_dirs:
        for fragment in PRUNED_DIRS:
            kept = kept.filter(~F.col("dir").contains(fragment))
    return kept


def _name_glob(extensions: str | list[str]) -> str:
    """File name pattern of a profile in any case, applied while listing."""
    either = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in profile(extensions)]
    return "*.{" + ",".join(either) + "}"


def scan_items(
    spark: SparkSession,
    root: str,
    recursive: bool = False,
    extensions: str | list[str] = "scoring",
    prune_dirs: bool = False,
) -> DataFrame:
    """Files below ``root`` (or one file), without reading their content.

    Spark lists no empty file, and no file or folder whose name starts with a dot or underscore.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", _name_glob(extensions))
        .option("recursiveFileLookup", str(recursive).lower())
        .load(root)
        .select("path", "length", F.col("modificationTime").alias("mtime"))
    )
    listed = keep_supported(list_paths(files), extensions, prune_dirs)
    return listed.select(
        F.col("path").alias("item_id"), "path", "name", "dir", "ext", "length", "mtime"
    )


def scan_images(
    spark: SparkSession, root: str, recursive: bool = True, extensions: str | list[str] = "scoring"
) -> DataFrame:
    """Decoded pixels; unreadable files stay as rows with ``ok = false``."""
    images = (
        spark.read.format("image")
        .option("pathGlobFilter", _name_glob(extensions))
        .option("recursiveFileLookup", str(recursive).lower())
        .load(root)
    )
    return images.select(
        F.col("image.origin").alias("path"),
        "image",
        (F.col("image.height") > 0).alias("ok"),
    )


def split_readable(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decoded images and the table of unreadable files."""
    good = images.filter("ok").drop("ok")
    bad = images.filter("not ok").select("path", F.lit("cannot decode").alias("error"))
    return good, bad


def label_from_folder(path: Column) -> Column:
    """N of ``.../quality_N/file``; null for anything else."""
    found = F.regexp_extract(path, r"(?:^|/)quality_([0-5])/[^/]+$", 1)
    return F.when(found != "", found.cast("int"))


def labels_from_folders(items: DataFrame, path_col: str = "path") -> DataFrame:
    label = label_from_folder(F.col(path_col))
    return items.withColumn("label", label).filter("label is not null")


def missing_classes(labelled: DataFrame, label_col: str = "label") -> DataFrame:
    """Tiers without a single labelled row."""
    seen = labelled.select(F.col(label_col).cast("int").alias("tier")).distinct()
    tiers = tier_table(labelled.sparkSession).select("tier", "report_name")
    # at most six tiers survive the distinct on either side
    seen = seen.filter(F.col("tier").between(0, N_TIERS - 1))
    return tiers.join(F.broadcast(seen), "tier", "left_anti")


def labels_from_names(items: DataFrame, path_col: str = "path") -> DataFrame:
    """Label from all digits of the file stem: ``image3`` -> 2, limited to 0..5."""
    digits = F.regexp_replace(fn.stem(F.col(path_col)), "[^0-9]", "")
    # more than 38 digits overflow every number type and mean "above the top"
    significant = F.regexp_replace(digits, "^0+(?=.)", "")
    value = F.when(F.length(significant) > 2, F.lit(99)).otherwise(significant.try_cast("int"))
    label = F.least(F.lit(N_TIERS - 1), F.greatest(F.lit(0), value - 1))
    return items.withColumn("label", F.when(digits != "", label)).filter("label is not null")
