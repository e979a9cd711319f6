"""Vote sessions that stop and go on: in batch, from saved ratings, and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank.operators.ranking import bounded_ratings, elo_ratings
from lumenrank.sources.snapshots import Snapshot


def vote_progress(duels: DataFrame) -> DataFrame:
    """``session_id, last_seq, n_duels``; a number counts once, with or without two different items."""
    numbers = duels.select("session_id", "seq").distinct()
    return numbers.groupBy("session_id").agg(F.max("seq").alias("last_seq"), F.count("seq").alias("n_duels"))


def votes_after(duels: DataFrame, progress: DataFrame) -> DataFrame:
    """Votes that the sessions have not taken yet."""
    last = progress.select("session_id", F.col("last_seq").alias("_last"))
    ahead = duels.join(last, "session_id", "left").filter(F.col("_last").isNull() | (F.col("seq") > F.col("_last")))
    return ahead.select(*duels.columns)


def rate_votes(duels: DataFrame, method: str = "elo", after: Snapshot | None = None) -> Snapshot:
    """Ratings and progress after ``duels``, on top of a snapshot if one is given.

    Votes at or below a session's last number are in the snapshot already and
    are left out, so handing over all votes or only the new ones is the same.
    Items without a new vote keep their ratings.
    """
    if method not in ("elo", "condorcet"):
        raise ValueError("method is 'elo' or 'condorcet'")
    if after is None:
        rated = elo_ratings(duels) if method == "elo" else bounded_ratings(duels)
        return Snapshot(method, rated.select("session_id", "item", "raw_score"), vote_progress(duels))
    if after.method != method:
        raise ValueError(f"the snapshot holds {after.method!r} ratings, not {method!r}")
    ahead = votes_after(duels, after.progress)
    if method == "elo":
        rated = elo_ratings(ahead, after.ratings)
    else:
        rated = bounded_ratings(ahead, after.ratings.withColumn("score", F.col("raw_score")))
    moved = after.progress.unionByName(vote_progress(ahead)).groupBy("session_id").agg(
        F.max("last_seq").alias("last_seq"), F.sum("n_duels").alias("n_duels")
    )
    return Snapshot(method, rated.select("session_id", "item", "raw_score"), moved)


def ratings_after(snapshot: Snapshot, updates: DataFrame) -> DataFrame:
    """Ratings of a snapshot with the changes of a stream that began with it."""
    changed = updates.groupBy("session_id", "item").agg(F.max_by("raw_score", "last_seq").alias("_new"))
    joined = snapshot.ratings.join(changed, ["session_id", "item"], "full")
    return joined.select("session_id", "item", F.coalesce("_new", "raw_score").alias("raw_score"))
