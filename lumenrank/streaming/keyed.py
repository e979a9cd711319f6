"""A keyed table kept up to date by the micro-batches of a stream.

The table is a small set of runs, each with at most one row per key: the
newest of a span of batches. Every ``fanout`` neighbouring runs are merged into
one of the next level, so after B batches there are at most
``(fanout - 1) * log(B)`` runs, and a row is rewritten ``log(B)`` times,
however large the table grows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.session import delete_path, list_folders, path_exists


class Run(NamedTuple):
    """The batches ``index * fanout**level`` up to the next multiple."""

    level: int
    index: int

    def span(self, fanout: int) -> tuple[int, int]:
        width = fanout**self.level
        return self.index * width, (self.index + 1) * width

    def within(self, other: Run, fanout: int) -> bool:
        lo, hi = self.span(fanout)
        other_lo, other_hi = other.span(fanout)
        return self != other and other_lo <= lo and hi <= other_hi


class KeyedRuns:
    """The newest row of every key of a stream of rows.

    ``order`` says which of two rows of a key is newer and must be unique
    within a key but for equal rows. A run counts once its write has
    been committed. A batch that a counted run holds is never taken again, so a
    replayed batch changes nothing; a run whose write was cut short is written
    anew by the replay. Merged runs are deleted one batch later, for readers
    that began before the merge. Rows with a null key are kept under
    that key; an empty batch writes an empty run. ``fanout`` belongs to the
    folder: use one value for its whole life.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], order: Sequence[str], fanout: int = 8):
        if fanout < 2:
            raise ValueError("fanout is 2 or more")
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        self.key, self.order = list(key), list(order)

    def _folder(self, run: Run) -> str:
        return f"{self.path}/level={run.level}/run={run.index}"

    def committed(self) -> list[Run]:
        """All runs whose write ended, merged ones included."""
        found = []
        for level in list_folders(self.spark, self.path, "level="):
            for index in list_folders(self.spark, f"{self.path}/level={level}", "run="):
                run = Run(int(level), int(index))
                if path_exists(self.spark, f"{self._folder(run)}/_SUCCESS"):
                    found.append(run)
        return sorted(found)

    def runs(self) -> list[Run]:
        """The runs that make up the table."""
        found = self.committed()
        return [r for r in found if not any(r.within(o, self.fanout) for o in found)]

    def newest(self, rows: DataFrame) -> DataFrame:
        """One row per key; combines map-side, so a hot key costs one row per task."""
        values = [c for c in rows.columns if c not in self.key]
        picked = F.max_by(F.struct(*values), F.struct(*self.order)).alias("_row")
        return rows.groupBy(*self.key).agg(picked).select(
            *[F.col(c) if c in self.key else F.col(f"_row.{c}").alias(c) for c in rows.columns]
        )

    def _read(self, runs: Sequence[Run]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(self._folder(r)) for r in runs])

    def absorb(self, batch: DataFrame, batch_id: int) -> None:
        """Take one micro-batch: the body of ``foreachBatch``."""
        before = self.committed()

        def held(run: Run) -> bool:
            return run in before or any(run.within(r, self.fanout) for r in before)

        merged = [r for r in before if any(r.within(o, self.fanout) for o in before)]
        own = Run(0, batch_id)
        if not held(own):
            self.newest(batch).write.mode("overwrite").parquet(self._folder(own))
        level = 1
        while (batch_id + 1) % self.fanout**level == 0:
            target = Run(level, batch_id // self.fanout**level)
            if not held(target):
                parts = [r for r in self.runs() if r.within(target, self.fanout)]
                self.newest(self._read(parts)).write.mode("overwrite").parquet(self._folder(target))
            level += 1
        for run in merged:
            delete_path(self.spark, self._folder(run))

    def table(self) -> DataFrame:
        """The newest row of every key of all batches so far."""
        runs = self.runs()
        if not runs:
            raise ValueError(f"no batch has been written to {self.path}")
        return self.newest(self._read(runs))
