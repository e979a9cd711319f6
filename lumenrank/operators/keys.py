"""Joins back on group keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(rows: DataFrame, per_key: DataFrame, by: Sequence[str]) -> DataFrame:
    """Append the columns of a one-row-per-key table; a null key is a key too.

    No hint: the planner broadcasts ``per_key`` when its measured size allows,
    and splits skewed keys of ``rows`` otherwise.
    """
    named = per_key.select(
        *[F.col(c).alias(f"_key_{c}") for c in by], *[c for c in per_key.columns if c not in by]
    )
    match = F.lit(True)
    for i, c in enumerate(by):
        same = F.col(c).eqNullSafe(F.col(f"_key_{c}"))
        match = same if i == 0 else match & same
    return rows.join(named, match, "inner").drop(*[f"_key_{c}" for c in by])
