"""The quality-tier dimension, file-type profiles and lookups on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tier labels, folder names and file-type profiles.
TIER_LABELS = ["Tres mauvaise", "Mauvaise", "Mediocre", "Correcte", "Bonne", "Excellente"]
TIER_FOLDERS = ["0_VeryPoor", "1_Poor", "2_Medium", "3_Good", "4_VeryGood", "5_Excellent"]
UNKNOWN_FOLDER = "Unknown_Quality"
REPORT_PREFIX = "Qualité"
EXTENSION_PROFILES = {
    "scoring": ["jpg", "jpeg", "png", "bmp", "tiff", "webp"],
    "distribution": ["jpg", "jpeg", "png", "bmp", "webp"],
    "duplicates": ["jpg", "jpeg", "png", "bmp", "gif", "tiff", "webp"],
    "voting": ["jpg", "jpeg", "png", "bmp", "gif", "tiff", "webp"],
    "semantic": ["png", "jpg", "jpeg", "bmp", "gif"],
    "training": ["jpg", "jpeg", "png", "bmp"],
}
BATCH_PROFILE = ["png"]  # lower case only

N_TIERS = len(TIER_LABELS)


def tier_table(spark: SparkSession) -> DataFrame:
    """Six constant rows, always small enough to broadcast."""
    code = F.explode(F.sequence(F.lit(0), F.lit(N_TIERS - 1)))
    return spark.range(1).select(code.alias("tier")).select(
        F.col("tier").cast("int").alias("tier"),
        _pick(TIER_LABELS, F.col("tier")).alias("label"),
        _pick(TIER_FOLDERS, F.col("tier")).alias("folder"),
        F.format_string(f"{REPORT_PREFIX} %d", "tier").alias("report_name"),
    )


def _pick(values: list[str], code: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), code.cast("int"))


def as_tier(value: Column) -> Column:
    """Tier code of a value: whole numbers 0..5 (also ``3.0``), else null."""
    number = value.try_cast("double")
    return F.when((number == F.floor(number)) & number.between(0, N_TIERS - 1), number.cast("int"))


def tier_label(code: Column) -> Column:
    return F.coalesce(_pick(TIER_LABELS, as_tier(code)), F.lit(UNKNOWN_FOLDER))


def tier_folder(code: Column) -> Column:
    return F.coalesce(_pick(TIER_FOLDERS, as_tier(code)), F.lit(UNKNOWN_FOLDER))


def with_tier_names(df: DataFrame, code: str = "predicted_quality") -> DataFrame:
    """Left join on the tier table; codes outside 0..5 become unknown."""
    tiers = tier_table(df.sparkSession)
    return (
        df.withColumn("tier", as_tier(F.col(code)))
        .join(F.broadcast(tiers), "tier", "left")
        .fillna(UNKNOWN_FOLDER, ["label", "folder", "report_name"])
    )


def profile(name_or_list: str | list[str]) -> list[str]:
    """Suffixes of a named profile, or a caller's list with dots dropped."""
    if isinstance(name_or_list, str):
        return EXTENSION_PROFILES[name_or_list]
    return [e.strip().lstrip(".").lower() for e in name_or_list]


def in_profile(ext: Column, name_or_list: str | list[str]) -> Column:
    """Case-insensitive membership of a suffix in a profile."""
    return F.lower(ext).isin(profile(name_or_list))
