"""Column helpers shared by the text operators; all compile to built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"  # 0x20 and 0x09 to 0x0D separate words
SPACE_RUN = "[ \\t\\n\\x0B\\f\\r]+"

Expr = Callable[[Column], Column]


def let(value: Column, body: Expr) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A lambda variable is bound once, where an expression repeated inside
    another lambda would be evaluated for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Maximal runs of characters other than white space; none for null."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, SPACE_RUN))


def lower_words(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits; none for null."""
    core = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{M}\\p{N}]+", " ")
    core = F.btrim(core)
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, " "))


def indexes(n: Column) -> Column:
    """0 .. n - 1, empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def solid(df: DataFrame, condition: Column) -> DataFrame:
    """``df`` filtered after its columns are computed.

    A plain filter is moved below the projections with all their expressions
    put in, where an array computed once is computed for each element of a
    lambda. The partition number, which can't be moved, holds it in place.
    """
    held = df.withColumn("_held", F.spark_partition_id())
    return held.filter(condition & (F.col("_held") >= 0)).drop("_held")
