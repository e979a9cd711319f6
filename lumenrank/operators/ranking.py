"""Ratings from ordered pairwise duels.

``duels`` has ``session_id, seq, winner, loser``; ``seq`` orders the duels of a
session. Bounded scores are held in integer tenths, so twenty wins from 3.0
reach exactly 5.0.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank import functions as fn
from lumenrank.operators.aggregates import min_max_normalise
from lumenrank.operators.filters import eligible_items
from lumenrank.operators.positions import rank_by_score, with_position
from lumenrank.session import materialise

# Rating parameters.
ELO_K = fn.ELO_K
ELO_START, ELO_START_SHOWN = 0.0, 2.5
BOUNDED_START, BOUNDED_STEP, BOUNDED_MIN, BOUNDED_MAX = 30, 1, 0, 50  # tenths
STEPS_IN_PART = 200_000
MAX_COMPARISONS = 100  # planned length of a session where one is asked for


def unique_duels(duels: DataFrame) -> DataFrame:
    """One row per (session, seq); repeats of a vote are dropped map-side.

    A vote time ``ts`` is kept where there is one: that of the vote that
    counts, the earliest of its repeats.
    """
    vote = ["winner", "loser", *(["ts"] if "ts" in duels.columns else [])]
    first = F.min(F.struct(*vote)).alias("d")
    valid = duels.filter(F.col("winner") != F.col("loser"))
    return valid.groupBy("session_id", "seq").agg(first).select("session_id", "seq", *[f"d.{c}" for c in vote])


def limit_duels(duels: DataFrame, n: int = MAX_COMPARISONS) -> DataFrame:
    """The duels of a session up to its planned length."""
    return duels.filter(F.col("seq") <= n)


def init_ratings(items: DataFrame, method: str = "elo") -> DataFrame:
    raw, shown = (ELO_START, ELO_START_SHOWN) if method == "elo" else (BOUNDED_START / 10, BOUNDED_START / 10)
    return items.withColumns({"raw_score": F.lit(raw), "score": F.lit(shown)})


def reset_ratings(ratings: DataFrame, session_id: object, method: str = "elo") -> DataFrame:
    """Start values for one session, the others unchanged."""
    hit = F.col("session_id") == F.lit(session_id)
    raw, shown = (ELO_START, ELO_START_SHOWN) if method == "elo" else (BOUNDED_START / 10, BOUNDED_START / 10)
    return ratings.withColumns(
        {
            "raw_score": F.when(hit, F.lit(raw)).otherwise(F.col("raw_score")),
            "score": F.when(hit, F.lit(shown)).otherwise(F.col("score")),
        }
    )


# ---------------------------------------------------------------- Elo


def _elo_fold(k: float, start: float):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state = None, {}

        def flush():
            return pd.DataFrame(
                {"session_id": [session] * len(state), "item": list(state), "raw_score": list(state.values())}
            )

        for pdf in batches:
            columns = (pdf["session_id"], pdf["winner"], pdf["loser"], pdf["rating"])
            for sid, winner, loser, rating in zip(*(c.tolist() for c in columns)):
                if sid != session:
                    if state:
                        yield flush()
                    session, state = sid, {}
                if loser is None:  # a saved rating precedes the duels
                    state[winner] = rating
                    continue
                a, b = state.get(winner, start), state.get(loser, start)
                gain = k * (1.0 - 1.0 / (1.0 + 10.0 ** ((b - a) / 400.0)))
                state[winner], state[loser] = a + gain, b - gain
        if state:
            yield flush()

    return fold


def elo_ratings(
    duels: DataFrame, initial: DataFrame | None = None, k: float = ELO_K, block: int = 1_000_000
) -> DataFrame:
    """Elo ratings after all duels, in ``seq`` order per session.

    A rating depends on every earlier duel of both items, so one session is a
    sequential fold. Sessions are folded in parallel from sorted partitions
    with the ratings of one session in memory. A session longer than ``block``
    duels is worked off in rounds of one block each, carrying only the ratings
    of the items that play in the block; no task ever reads more than a block
    of a session.
    """
    d = unique_duels(duels)
    seeds = initial.select("session_id", "item", F.col("raw_score").cast("double")) if initial is not None else None
    sizes = materialise(d.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n")), "elo-sizes")
    longest = sizes.agg(F.max("_n")).first()[0]
    if longest is None:
        return seeds if seeds is not None else d.selectExpr(
            "session_id", "winner as item", "cast(0 as double) as raw_score"
        )
    if longest <= block:
        return _fold_block(d, seeds, k)
    blocks = (longest - 1) // block + 1
    once, long = (sizes.filter(c).select("session_id") for c in (F.col("_n") <= block, F.col("_n") > block))
    # sessions without a new duel keep their saved ratings
    resting = None if seeds is None else seeds.join(long, "session_id", "left_anti")
    done = _fold_block(d.join(once, "session_id", "left_semi"), resting, k)
    placed = with_position(d.join(long, "session_id", "left_semi"), ["seq"], ["session_id"], "_pos")
    blocked = placed.withColumn("_block", F.floor(F.col("_pos") / block))
    blocked = materialise(blocked.drop("_pos"), "elo-duels", ["_block"])
    ratings = _of(seeds, long.select("session_id"))
    for i in range(blocks):
        part = blocked.filter(F.col("_block") == i)
        players = _players(part)
        moving = _of(ratings, players, ["session_id", "item"])
        folded = _fold_block(part, moving, k)
        if ratings is not None:
            resting = ratings.join(players, ["session_id", "item"], "left_anti")
            folded = materialise(folded.unionByName(resting), "elo-ratings")
        ratings = folded
    return done.unionByName(ratings)


def _span(duels: DataFrame):
    return duels.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count(F.lit(1)).alias("n")).first()


def _of(ratings: DataFrame | None, keys: DataFrame, on: str | list[str] = "session_id") -> DataFrame | None:
    return None if ratings is None else ratings.join(keys, on, "left_semi")


def _players(duels: DataFrame) -> DataFrame:
    return duels.select("session_id", F.explode(F.array("winner", "loser")).alias("item")).distinct()


def _fold_block(duels: DataFrame, seeds: DataFrame | None, k: float) -> DataFrame:
    rows = duels.select("session_id", "seq", "winner", "loser", F.lit(None).cast("double").alias("rating"))
    if seeds is not None:
        rows = rows.unionByName(
            seeds.select(
                "session_id",
                F.lit(None).cast("bigint").alias("seq"),
                F.col("item").alias("winner"),
                F.lit(None).cast("string").alias("loser"),
                F.col("raw_score").alias("rating"),
            )
        )
    ordered = rows.repartition("session_id").sortWithinPartitions("session_id", F.col("seq").asc_nulls_first())
    sid = duels.schema["session_id"].dataType.simpleString()
    folded = ordered.mapInPandas(_elo_fold(k, ELO_START), f"session_id {sid}, item string, raw_score double")
    # normalising and ranking read the ratings more than once; the fold runs once
    return materialise(folded, "elo-ratings")


# ---------------------------------------------------------------- bounded scores


def _steps(duels: DataFrame) -> DataFrame:
    """Two rows per duel: +1 tenth for the winner, -1 for the loser."""
    sides = F.explode(
        F.array(
            F.struct(F.col("winner").alias("item"), F.lit(BOUNDED_STEP).alias("step")),
            F.struct(F.col("loser").alias("item"), F.lit(-BOUNDED_STEP).alias("step")),
        )
    )
    own = ["session_id", "seq", *(["ts"] if "ts" in duels.columns else [])]
    return duels.select(*own, sides.alias("s")).select(*own, "s.item", "s.step")


def _compose(runs: Column) -> Column:
    """One clamp for a run of clamps in time order.

    A clamp x -> min(hi, max(lo, x + shift)) followed by another is a clamp
    again, so any run of steps shrinks to one triple.
    """
    triple = "struct<shift:int,lo:int,hi:int>"
    identity = F.struct(F.lit(0).alias("shift"), F.lit(BOUNDED_MIN).alias("lo"), F.lit(BOUNDED_MAX).alias("hi"))

    def then(acc: Column, nxt: Column) -> Column:
        def through(x: Column) -> Column:
            return F.least(nxt["hi"], F.greatest(nxt["lo"], x + nxt["shift"]))

        return F.struct(
            (acc["shift"] + nxt["shift"]).alias("shift"),
            through(acc["lo"]).alias("lo"),
            through(acc["hi"]).alias("hi"),
        ).cast(triple)

    return F.aggregate(runs, identity.cast(triple), then)


def _apply(clamp: Column, x: Column) -> Column:
    return F.least(clamp["hi"], F.greatest(clamp["lo"], x + clamp["shift"]))


def _single_clamps(steps: DataFrame, base: int) -> DataFrame:
    clamp = F.struct(F.col("step").alias("shift"), F.lit(BOUNDED_MIN).alias("lo"), F.lit(BOUNDED_MAX).alias("hi"))
    return steps.select("session_id", "item", (F.col("seq") - base).alias("at"), clamp.alias("clamp"))


def _parts(duels: int) -> int:
    """Partitions for the two steps of every duel.

    Steps compress so well that partitions sized by their bytes would hold too
    many of them for a task's memory.
    """
    return max(1, -(-2 * duels // STEPS_IN_PART))


def _clamp_levels(single: DataFrame, width: int, fanout: int, parts: int) -> list[DataFrame]:
    """Clamps of aligned ranges of ``at`` in 0..width-1: level 0 spans
    ``fanout`` values, each further level ``fanout`` ranges of the one below,
    the last covers all."""
    rows, levels = single, []
    while True:
        if levels:
            rows = levels[-1] = materialise(rows, "clamps")  # read by the next level, and by the scan down
        run = F.array_sort(F.collect_list(F.struct("at", "clamp")))
        rows = (
            rows.withColumn("range", F.floor(F.col("at") / fanout))
            .repartition(parts, "session_id", "item", "range")
            .groupBy("session_id", "item", "range")
            .agg(run.alias("run"))
            .select(
                "session_id", "item", F.col("range").alias("at"),
                _compose(F.transform("run", lambda r: r["clamp"])).alias("clamp"),
            )
        )
        levels.append(rows)
        width = -(-width // fanout)
        if width <= 1:
            return levels


def bounded_ratings(
    duels: DataFrame, initial: DataFrame | None = None, fanout: int = 4096
) -> DataFrame:
    """Bounded scores after all duels: +0.1 / -0.1 kept inside 0..5.

    An item's path does not depend on its opponents, so the steps are composed
    per aligned range of ``seq`` and the ranges again, level by level. A group
    never holds more than ``fanout`` rows, however often an item plays.
    """
    span = _span(duels)
    base, width = (span.lo, span.hi - span.lo + 1) if span.lo is not None else (0, 1)
    single = _single_clamps(_steps(unique_duels(duels)), base)
    total = _clamp_levels(single, width, fanout, _parts(span.n))[-1].select("session_id", "item", "clamp")
    if initial is None:
        tenths = _apply(F.col("clamp"), F.lit(BOUNDED_START))
        scored = total.select("session_id", "item", tenths.alias("tenths"))
    else:
        before = F.coalesce(F.round(F.col("score") * 10), F.lit(BOUNDED_START)).cast("int")
        joined = initial.select("session_id", "item", "score").join(total, ["session_id", "item"], "full")
        after = F.when(F.col("clamp").isNull(), before).otherwise(_apply(F.col("clamp"), before))
        scored = joined.select("session_id", "item", after.alias("tenths"))
    score = F.col("tenths") / 10.0
    return scored.select("session_id", "item", score.alias("raw_score"), score.alias("score"))


def _scan_clamps(out_name: str):
    """Running value before each row of a sorted (session, item, group) run."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, value = None, 0
        for pdf in batches:
            before = []
            columns = [pdf[c].tolist() for c in ("session_id", "item", "grp", "start", "shift", "lo", "hi")]
            for sid, item, grp, start, shift, lo, hi in zip(*columns):
                if (sid, item, grp) != key:
                    key, value = (sid, item, grp), start
                before.append(value)
                value = min(hi, max(lo, value + shift))
            yield pdf[["session_id", "item", "at", "shift"]].assign(**{out_name: before})

    return scan


def duel_history(duels: DataFrame, initial: DataFrame | None = None, fanout: int = 4096) -> DataFrame:
    """Scores of both sides before and after every duel (bounded method).

    The range clamps of :func:`bounded_ratings` give each range its start
    value from the top level down; the last scan then runs inside ranges of at
    most ``fanout`` duels. Duels with a vote time ``ts`` give a ``timestamp``.
    """
    span = _span(duels)
    base, width = (span.lo, span.hi - span.lo + 1) if span.lo is not None else (0, 1)
    unique, parts = unique_duels(duels), _parts(span.n)
    steps = _steps(unique)
    single = _single_clamps(steps, base)
    levels = _clamp_levels(single, width, fanout, parts)
    keys = ["session_id", "item"]
    top = levels[-1].select(*keys, F.col("at").alias("grp"))
    if initial is None:
        starts = top.withColumn("start", F.lit(BOUNDED_START))
    else:
        saved = initial.select(*keys, F.round(F.col("score") * 10).cast("int").alias("start"))
        starts = top.join(saved, keys, "left").fillna(BOUNDED_START, ["start"])
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in steps.select(*keys).schema)
    scanned = None
    for rows in [*reversed(levels[:-1]), single]:
        if scanned is not None:
            starts = scanned.select(*keys, F.col("at").alias("grp"), F.col("before").alias("start"))
        run = rows.select(*keys, "at", F.floor(F.col("at") / fanout).alias("grp"), "clamp.*")
        # no broadcast: the steps are more and wider than the duels that the planner measures
        run, starts = (x.repartition(parts, *keys, "grp") for x in (run, starts))
        ordered = run.join(starts.hint("merge"), [*keys, "grp"]).sortWithinPartitions(*keys, "grp", "at")
        scanned = ordered.mapInPandas(_scan_clamps("before"), f"{types}, at bigint, shift int, before int")
    sides = scanned.select(*keys, (F.col("at") + base).alias("seq"), F.col("shift").alias("step"), "before")
    won, lost = F.col("step") > 0, F.col("step") < 0
    after = F.least(F.lit(BOUNDED_MAX), F.greatest(F.lit(BOUNDED_MIN), F.col("before") + F.col("step")))

    def side(flag: Column, value: Column, name: str) -> Column:
        return F.max(F.when(flag, value)).alias(name)

    history = sides.repartition(parts, "session_id", "seq").groupBy("session_id", "seq").agg(
        side(won, F.col("item"), "image1"),
        side(lost, F.col("item"), "image2"),
        side(won, F.col("item"), "winner"),
        side(won, F.col("before") / 10.0, "score1_before"),
        side(lost, F.col("before") / 10.0, "score2_before"),
        side(won, after / 10.0, "score1_after"),
        side(lost, after / 10.0, "score2_after"),
    )
    if "ts" not in steps.columns:
        return history
    times = unique.select("session_id", "seq", F.col("ts").alias("timestamp")).repartition(parts, "session_id", "seq")
    own = ["session_id", "seq", "timestamp"]
    return history.join(times.hint("merge"), own[:2]).select(*own, *[c for c in history.columns if c not in own])


# ---------------------------------------------------------------- sessions and reports


def process_votes(
    duels: DataFrame, items: DataFrame, method: str = "elo", max_comparisons: int | None = None
) -> DataFrame:
    """Ratings of every listed item of a session after its votes.

    All recorded votes count; ``max_comparisons`` cuts Elo sessions to a
    planned length where that is wanted.
    """
    if method == "elo":
        rated = elo_ratings(duels if max_comparisons is None else limit_duels(duels, max_comparisons))
    else:
        rated = bounded_ratings(duels).select("session_id", "item", "raw_score")
    start = ELO_START if method == "elo" else BOUNDED_START / 10
    all_items = items.select("session_id", "item").join(rated, ["session_id", "item"], "left")
    raw = all_items.fillna(start, ["raw_score"])
    if method == "elo":
        return min_max_normalise(raw, ["session_id"])
    return raw.withColumn("score", F.col("raw_score"))


def session_status(
    duels: DataFrame, ratings: DataFrame, method: str = "elo", max_comparisons: int | None = None
) -> DataFrame:
    """Duel count, items in play and the completion flag of each session."""
    limited = method == "elo" and max_comparisons is not None
    d = unique_duels(limit_duels(duels, max_comparisons) if limited else duels)
    counted = d.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_duels"))
    active = eligible_items(ratings, method).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_active"))
    joined = ratings.select("session_id").distinct().join(counted, "session_id", "left").join(
        active, "session_id", "left"
    )
    filled = joined.fillna(0, ["n_duels", "n_active"])
    few = F.col("n_active") < 2
    complete = (F.col("n_duels") >= max_comparisons) | few if limited else few
    return filled.withColumn("complete", complete)


def rankings(rated: DataFrame, method: str = "elo") -> DataFrame:
    """Export table: Elo scores are normalised here, bounded scores kept."""
    scored = min_max_normalise(rated, ["session_id"]) if method == "elo" else rated
    ranked = rank_by_score(scored, "score", "item", ["session_id"])
    return ranked.select(
        "session_id",
        "rank",
        fn.basename(F.col("item")).alias("image"),
        F.col("item").alias("image_path"),
        F.round("raw_score", 3).alias("raw_score"),
        F.round("score", 3).alias("score_0_to_5"),
    )


def renormalise(rated: DataFrame, method: str = "elo") -> DataFrame:
    if method != "elo":
        raise ValueError("min-max normalisation does not apply to bounded scores")
    return min_max_normalise(rated, ["session_id"])


def carry_over(items: DataFrame, saved: DataFrame, method: str = "elo") -> DataFrame:
    """Saved ratings follow a file by base name; unknown names start fresh.

    ``saved`` may hold a name more than once (``pos`` orders the entries, the
    last one wins).
    """
    raw, shown = (ELO_START, ELO_START_SHOWN) if method == "elo" else (BOUNDED_START / 10, BOUNDED_START / 10)
    last = saved.groupBy(fn.basename(F.col("item")).alias("name")).agg(
        F.max_by(F.struct("raw_score", "score"), F.struct("pos", "item")).alias("s")
    )
    named = items.withColumn("name", fn.basename(F.col("item")))
    return (
        named.join(last, "name", "left")
        .select(*[c for c in items.columns], "name", "s.raw_score", "s.score")
        .fillna({"raw_score": raw, "score": shown})
    )


def draw_pairs(
    eligible: DataFrame, n_pairs: int | DataFrame, seed: str = "0", by: str = "session_id", item: str = "item"
) -> DataFrame:
    """Reproducible random pairs of different items of a session.

    ``n_pairs`` is a number per session or a table ``(by, pair_id)``. Both
    picks are positions derived from digest bits of the pair id, so a pair is
    two equi-joins, not a product of items.
    """
    placed = with_position(eligible.select(by, item), [item], [by], "i")
    sizes = placed.groupBy(by).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    if isinstance(n_pairs, int):
        ids = sizes.select(by, "n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n_pairs).cast("bigint"))).alias("pair_id"))
    else:
        ids = n_pairs.join(sizes, by)
    key = F.concat_ws(":", F.col(by).cast("string"), F.col("pair_id").cast("string"))
    u = fn.hash_bits(key, seed, 0) / F.lit(2.0**32)
    v = fn.hash_bits(key, seed, 1) / F.lit(2.0**32)
    drawn = ids.select(by, "pair_id", "n", F.floor(u * F.col("n")).alias("ia"), v.alias("v")).withColumn(
        "ib", (F.col("ia") + 1 + F.floor(F.col("v") * (F.col("n") - 1))) % F.col("n")
    )
    a = placed.select(by, F.col("i").alias("ia"), F.col(item).alias("item_a"))
    b = placed.select(by, F.col("i").alias("ib"), F.col(item).alias("item_b"))
    return drawn.join(a, [by, "ia"]).join(b, [by, "ib"]).select(by, "pair_id", "item_a", "item_b")
