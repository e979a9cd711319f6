"""Ratings as keyed state over a stream of votes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from lumenrank.operators.ranking import (
    BOUNDED_MAX, BOUNDED_MIN, BOUNDED_START, BOUNDED_STEP, ELO_K, ELO_START,
)
from lumenrank.schemas import struct
from lumenrank.sources.snapshots import Snapshot

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "item string, raw_score double, last_seq bigint"
BLOCK = 256  # numbers whose held votes are one entry of the state
BLOCKS_AT_ONCE = 64  # entries of a session in memory


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed map state lives in RocksDB; call before starting the query."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _name(item: object) -> str | None:
    """An item, or None for a missing one of any kind."""
    return item if isinstance(item, str) else None


def _in_order(*columns: list) -> list[tuple]:
    """``seq, winner, loser`` by number; of votes with one number those with two different items first."""

    def place(vote: tuple) -> tuple:
        seq, winner, loser = vote
        some = _name(winner) is not None and _name(loser) is not None and winner != loser
        return (seq, 0, winner, loser) if some else (seq, 1, "", "")

    return sorted(zip(*columns), key=place)


class _Held:
    """Held votes of one session by number.

    A call to the state costs far more than a vote, so the votes of ``BLOCK``
    neighbouring numbers are read and written as one entry.
    """

    def __init__(self, state):
        self.state, self.blocks, self.changed = state, {}, set()

    def _block(self, seq: int) -> dict:
        at = seq // BLOCK
        if at not in self.blocks:
            if len(self.blocks) >= BLOCKS_AT_ONCE:
                self.save()
            found = self.state.getValue((at,))
            self.blocks[at] = {} if found is None else {n: (a, b) for n, a, b in json.loads(found[0])}
        return self.blocks[at]

    def hold(self, seq: int, winner: str | None, loser: str | None) -> bool:
        """Whether the vote is the first with its number."""
        block = self._block(seq)
        if seq in block:
            return False
        block[seq] = (winner, loser)
        self.changed.add(seq // BLOCK)
        return True

    def take(self, seq: int) -> tuple[str | None, str | None] | None:
        block = self._block(seq)
        if seq not in block:
            return None
        self.changed.add(seq // BLOCK)
        return block.pop(seq)

    def numbers(self) -> list[int]:
        """All numbers, in order; only for the votes of a session that its timer gives up on."""
        self.save()
        return sorted(n for (votes,) in self.state.values() for n, _, _ in json.loads(votes))

    def save(self) -> None:
        for at in sorted(self.changed):
            votes = [[n, a, b] for n, (a, b) in sorted(self.blocks[at].items())]
            if votes:
                self.state.updateValue((at,), (json.dumps(votes),))
            elif self.state.containsKey((at,)):
                self.state.removeKey((at,))
        self.blocks, self.changed = {}, set()


class _Ratings(StatefulProcessor):
    """Applies the votes of a session in ``seq`` order.

    The first vote has the number ``start``. A vote at or below the last
    applied number is a repeat and ignored. A vote beyond the next number waits
    in state until the gap is filled, or until ``gap_timeout_ms`` has passed
    since it was held. A vote without two different items changes no rating
    but counts as a number, so the votes after it don't wait. A session of the
    initial state goes on after the last number of that state.
    """

    def __init__(self, method: str, gap_timeout_ms: int | None, start: int = 1):
        self.method, self.gap_timeout_ms, self.start = method, gap_timeout_ms, start
        # parsed here, on the driver: workers have no session to parse with
        self.seq, self.item, self.score = struct("seq bigint"), struct("item string"), struct("score double")
        self.block, self.votes = struct("block bigint"), struct("votes string")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.seq)
        self.scores = handle.getMapState("scores", self.item, self.score)
        self.held = handle.getMapState("held_votes", self.block, self.votes)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Take over the saved ratings of a session, before its first vote arrives."""
        for item, score, last in zip(*(initialState[c].tolist() for c in ("item", "raw_score", "last_seq"))):
            if _name(item) is not None:
                self.scores.updateValue((item,), (float(score),))
            self.last.update((int(last),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = last = self._applied()
        cache, holding, held = {}, False, _Held(self.held)
        for pdf in rows:
            for seq, winner, loser in _in_order(*(pdf[c].tolist() for c in ("seq", "winner", "loser"))):
                if seq <= last:
                    continue
                if seq == last + 1:
                    self._duel(cache, winner, loser)
                    last = seq
                elif held.hold(seq, _name(winner), _name(loser)):
                    holding = True
            last = self._drain(cache, held, last)
        held.save()
        if holding and self.gap_timeout_ms is not None and self.held.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.gap_timeout_ms)
        yield from self._commit(key, cache, before, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Give up on the missing votes and apply everything held."""
        before = last = self._applied()
        cache, held = {}, _Held(self.held)
        for seq in held.numbers():
            winner, loser = held.take(seq)
            if seq > last:
                self._duel(cache, winner, loser)
                last = seq
        held.save()
        yield from self._commit(key, cache, before, last)

    def close(self) -> None:
        pass

    def _applied(self) -> int:
        last = self.last.get()
        return self.start - 1 if last is None else last[0]

    def _drain(self, cache: dict, held: _Held, last: int) -> int:
        while (vote := held.take(last + 1)) is not None:
            self._duel(cache, *vote)
            last += 1
        return last

    def _score(self, cache: dict, item: str) -> float:
        if item not in cache:
            saved = self.scores.getValue((item,))
            start = ELO_START if self.method == "elo" else BOUNDED_START / 10
            cache[item] = start if saved is None else saved[0]
        return cache[item]

    def _duel(self, cache: dict, winner: str, loser: str) -> None:
        winner, loser = _name(winner), _name(loser)
        if winner is None or loser is None or winner == loser:
            return
        a, b = self._score(cache, winner), self._score(cache, loser)
        if self.method == "elo":
            gain = ELO_K * (1.0 - 1.0 / (1.0 + 10.0 ** ((b - a) / 400.0)))
            cache[winner], cache[loser] = a + gain, b - gain
        else:
            cache[winner] = min(BOUNDED_MAX, round(a * 10) + BOUNDED_STEP) / 10
            cache[loser] = max(BOUNDED_MIN, round(b * 10) - BOUNDED_STEP) / 10

    def _commit(self, key, cache: dict, before: int, last: int) -> Iterator[pd.DataFrame]:
        if last != before:
            self.last.update((last,))
        if not cache:
            return
        for item, score in cache.items():
            self.scores.updateValue((item,), (score,))
        yield pd.DataFrame(
            {"session_id": key[0], "item": list(cache), "raw_score": list(cache.values()), "last_seq": last}
        )


def stream_ratings(
    votes: DataFrame,
    method: str = "elo",
    gap_timeout_ms: int | None = None,
    start: int = 1,
    initial: Snapshot | None = None,
) -> DataFrame:
    """Changed ratings per micro-batch of a vote stream (update mode); a session's first vote has the number ``start``.

    ``initial`` seeds the state of a new query with a snapshot: its sessions go
    on after their last number, and votes that it contains are ignored. A query
    that restarts from its checkpoint keeps its own state. Ratings that no vote
    changes are not emitted; ``plans.ratings_after`` adds them.
    """
    key_type = votes.schema["session_id"].dataType.simpleString()
    out: StructType = struct(f"session_id {key_type}, {OUTPUT}")
    seeds = None
    if initial is not None:
        if initial.method != method:
            raise ValueError(f"the snapshot holds {initial.method!r} ratings, not {method!r}")
        # a session whose votes changed no rating still has its last number
        held = initial.progress.select("session_id", "last_seq").join(initial.ratings, "session_id", "left")
        seeds = held.select(F.col("session_id").cast(key_type).alias("session_id"), "item", "raw_score", "last_seq").groupBy(
            "session_id"
        )
    return votes.select("session_id", "seq", "winner", "loser").groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=_Ratings(method, gap_timeout_ms, start),
        outputStructType=out,
        outputMode="Update",
        timeMode="None" if gap_timeout_ms is None else "ProcessingTime",
        initialState=seeds,
    )


def latest_ratings(updates: DataFrame) -> DataFrame:
    """Final rating per item of the emitted updates."""
    return updates.groupBy("session_id", "item").agg(F.max_by("raw_score", "last_seq").alias("raw_score"))
