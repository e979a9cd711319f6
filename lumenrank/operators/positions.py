"""Row positions, ranks and limits that never gather a large group in one task.

A window partitioned by a key sends every row of that key to one task. Here
the rows are range-partitioned by (key, order) instead, so a key that holds a
large share of the table is spread over many partitions. Each partition is
sorted and numbered locally; a small table of per-partition counts supplies
the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenrank.operators.keys import attach
from lumenrank.session import materialise, shuffle_partitions

SALTS = 32  # parts that a key is dealt into before its first rows are sought
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row index in the low bits


def with_position(
    df: DataFrame,
    order: Sequence[str | Column],
    by: Sequence[str] = (),
    name: str = "pos",
    start: int = 0,
) -> DataFrame:
    """Append the position of each row under ``order`` inside its ``by`` key.

    ``order`` must be unique inside a key. The numbered rows are written to
    shared storage, because a second evaluation could choose other range
    boundaries. Tables of any size take this path.
    """
    by = list(by)
    ordering = [F.col(o) if isinstance(o, str) else o for o in order]
    keys = [F.col(c).asc_nulls_first() for c in by] + ordering
    ranged = (
        df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    numbered = materialise(ranged, "positions").withColumn(
        "_slice", F.shiftright("_mid", _LOCAL_BITS)
    )
    slices = numbered.groupBy(*by, "_slice").agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    # one row per (key, partition): a key has at most as many rows here as
    # there are shuffle partitions
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = slices.select(
        *by,
        "_slice",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + start).alias("_shift"),
    )
    return attach(numbered, offsets, ["_slice", *by]).select(
        *df.columns, (F.col("_mid") + F.col("_shift")).alias(name)
    )


def with_batch_id(df: DataFrame, order: Sequence[str | Column], size: int = 100) -> DataFrame:
    """One-based batch number of ``size`` consecutive rows in ``order``."""
    placed = with_position(df, order, name="_pos")
    return placed.withColumn("batch", (F.floor(F.col("_pos") / size) + 1).cast("bigint")).drop("_pos")


def rank_by_score(
    df: DataFrame, score: str = "score", item: str = "item", by: Sequence[str] = (), name: str = "rank"
) -> DataFrame:
    """Positions 1..n from the best score down, ties in item order."""
    order = [F.col(score).desc_nulls_last(), F.col(item).asc()]
    return with_position(df, order, by, name, start=1)


def order_by_score(df: DataFrame, score: str = "score", item: str = "item_id") -> DataFrame:
    return df.orderBy(F.col(score).desc_nulls_last(), F.col(item).asc())


def _first_per_key(df: DataFrame, n: int, by: Sequence[str], order: list[Column], name: str) -> DataFrame:
    """Rows 1..n of each key, found in two steps.

    A key is dealt into ``SALTS`` parts by the values that order it, and each
    part is cut to its first ``n`` rows, so no task ranks more than that many
    times ``SALTS`` rows of one key. The planner cuts the parts to ``n`` rows
    in each map task before the exchange as well.
    """
    dealt = [F.col(c) for c, kind in df.dtypes if "map<" not in kind]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*dealt), F.lit(SALTS)))
    part = F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order))
    some = salted.withColumn("_part", part).filter(F.col("_part") <= n).drop("_part", "_salt")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return some.withColumn(name, place).filter(F.col(name) <= n).withColumn(name, F.col(name).cast("bigint"))


def top_board(
    df: DataFrame, n: int = 15, score: str = "score", item: str = "item", by: Sequence[str] = ()
) -> DataFrame:
    """The best ``n`` rows per key with the number of remaining rows."""
    order = [F.col(score).desc_nulls_last(), F.col(item).asc()]
    if by:
        best = _first_per_key(df, n, by, order, "rank")
        counted = attach(best, df.groupBy(*by).agg(F.count(F.lit(1)).alias("_total")), by)
    else:
        total = df.agg(F.count(F.lit(1)).alias("_total")).scalar()
        best = df.orderBy(*order).limit(n)
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))  # n rows
        counted = best.withColumn("rank", place.cast("bigint")).withColumn("_total", total)
    rest = F.greatest(F.col("_total") - n, F.lit(0)).cast("bigint")
    return counted.withColumn("n_others", rest).drop("_total")


def first_by_name(items: DataFrame, n: int = 10, name: str = "name", by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows by case-insensitive name, overall or per key."""
    order = [F.lower(F.col(name)).asc(), F.col(name).asc()]
    if not by:
        return items.orderBy(*order).limit(n)
    return _first_per_key(items, n, by, order, "_rn").drop("_rn")


def first_pending(items: DataFrame, done: DataFrame, start: int = 0, idx: str = "idx", on: str = "item_id") -> DataFrame:
    """Smallest index at or after ``start`` without an annotation; -1 when none."""
    waiting = items.filter(F.col(idx) >= start).join(done.select(on), on, "left_anti")
    return waiting.agg(F.coalesce(F.min(idx), F.lit(-1)).cast("bigint").alias("next_idx"))


def random_order(items: DataFrame, seed: int = 0, item: str = "item_id") -> DataFrame:
    """A reproducible shuffle of the listing."""
    return items.orderBy(F.xxhash64(F.col(item), F.lit(seed)), F.col(item))
