"""Ratings against plain loops, including hot sessions and hot items."""

import random

import pytest
from pyspark.sql import functions as F

from lumenrank.operators import ranking

DUELS = "session_id bigint, seq bigint, winner string, loser string"


def make(seed, sessions, items, n):
    rng = random.Random(seed)
    rows = []
    for s in range(sessions):
        for q in range(1, (n if s == 0 else n // 20) + 1):  # session 0 is the hot one
            a, b = rng.sample(range(items), 2)
            rows.append((s, q, f"i{a}", f"i{b}"))
    rng.shuffle(rows)
    return rows


def loop_elo(rows):
    state = {}
    for s, _, w, l in sorted(rows):
        a, b = state.get((s, w), 0.0), state.get((s, l), 0.0)
        g = 32 * (1 - 1 / (1 + 10 ** ((b - a) / 400)))
        state[s, w], state[s, l] = a + g, b - g
    return state


def loop_bounded(rows):
    state, history = {}, {}
    for s, q, w, l in sorted(rows):
        a, b = state.get((s, w), 30), state.get((s, l), 30)
        state[s, w], state[s, l] = min(50, a + 1), max(0, b - 1)
        history[s, q] = (w, l, a, b, state[s, w], state[s, l])
    return state, history


@pytest.fixture(scope="module")
def rows():
    return make(5, sessions=4, items=9, n=700)


@pytest.fixture(scope="module")
def duels(spark, rows):
    return spark.createDataFrame(rows, DUELS)


@pytest.mark.parametrize("block", [1_000_000, 100])
def test_elo_is_bit_identical_to_a_loop(duels, rows, block):
    got = {(r.session_id, r.item): r.raw_score for r in ranking.elo_ratings(duels, block=block).collect()}
    assert got == loop_elo(rows)


def test_elo_does_not_depend_on_partitioning(spark, duels, rows):
    got = {(r.session_id, r.item): r.raw_score for r in ranking.elo_ratings(duels.repartition(3)).collect()}
    assert got == loop_elo(rows)


def test_elo_sums_to_zero(duels):
    total = ranking.elo_ratings(duels).agg(F.sum("raw_score")).first()[0]
    assert abs(total) < 1e-6


def test_elo_without_duels(spark):
    assert ranking.elo_ratings(spark.createDataFrame([], DUELS)).count() == 0


def test_repeated_votes_count_once(spark, duels, rows):
    twice = duels.unionByName(duels.limit(50))
    got = {(r.session_id, r.item): r.raw_score for r in ranking.elo_ratings(twice).collect()}
    assert got == loop_elo(rows)


@pytest.mark.parametrize("fanout", [4096, 8])
def test_bounded_scores_match_a_loop(duels, rows, fanout):
    state, history = loop_bounded(rows)
    got = {(r.session_id, r.item): round(r.score * 10) for r in ranking.bounded_ratings(duels, fanout=fanout).collect()}
    assert got == state
    steps = {
        (r.session_id, r.seq): (
            r.image1, r.image2, *(round(v * 10) for v in (r.score1_before, r.score2_before, r.score1_after, r.score2_after))
        )
        for r in ranking.duel_history(duels, fanout=fanout).collect()
    }
    assert steps == history


def test_unanimous_winner_reaches_the_bound_after_twenty_wins(spark):
    rows = [(1, q, "a", "b") for q in range(1, 31)]
    got = {r.item: r.score for r in ranking.bounded_ratings(spark.createDataFrame(rows[:20], DUELS)).collect()}
    assert got == {"a": 5.0, "b": 1.0}
    got = {r.item: r.score for r in ranking.bounded_ratings(spark.createDataFrame(rows, DUELS)).collect()}
    assert got == {"a": 5.0, "b": 0.0}


def test_two_halves_equal_the_whole(duels, rows):
    first, second = duels.filter("seq <= 33"), duels.filter("seq > 33")
    elo = ranking.elo_ratings(second, ranking.elo_ratings(first))
    assert {(r.session_id, r.item): r.raw_score for r in elo.collect()} == loop_elo(rows)
    bounded = ranking.bounded_ratings(second, ranking.bounded_ratings(first))
    assert {(r.session_id, r.item): round(r.score * 10) for r in bounded.collect()} == loop_bounded(rows)[0]


def test_history_continues_saved_scores(spark):
    duels = spark.createDataFrame([(1, 1, "a", "b")], DUELS)
    saved = spark.createDataFrame([(1, "a", 4.9, 4.9)], "session_id bigint, item string, raw_score double, score double")
    r = ranking.duel_history(duels, saved).first()
    assert (r.score1_before, r.score1_after, r.score2_before, r.score2_after) == (4.9, 5.0, 3.0, 2.9)


def test_rankings_are_positions_with_ties_in_path_order(spark):
    rated = spark.createDataFrame(
        [(1, "/d/b.jpg", 0.0), (1, "/d/a.jpg", 0.0), (1, "/d/c.jpg", 10.0)], "session_id int, item string, raw_score double"
    )
    got = [(r["rank"], r.image, r.score_0_to_5) for r in ranking.rankings(rated).orderBy("rank").collect()]
    assert got == [(1, "c.jpg", 5.0), (2, "a.jpg", 0.0), (3, "b.jpg", 0.0)]


def test_normalisation_is_for_elo_only(spark):
    with pytest.raises(ValueError):
        ranking.renormalise(spark.range(1), "condorcet")


def test_session_completes_when_no_pair_is_left(spark):
    duels = spark.createDataFrame([(1, q, "a", "b") for q in range(1, 31)], DUELS)
    items = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b")], "session_id bigint, item string")
    rated = ranking.process_votes(duels, items, "condorcet")
    status = {r.session_id: (r.n_duels, r.n_active, r.complete) for r in ranking.session_status(duels, rated, "condorcet").collect()}
    assert status == {1: (30, 0, True), 2: (0, 2, False)}


def test_elo_session_completes_at_its_length(spark):
    duels = spark.createDataFrame([(1, q, "a", "b") for q in range(1, 8)], DUELS)
    items = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "session_id bigint, item string")
    rated = ranking.process_votes(duels, items, "elo", max_comparisons=5)
    r = ranking.session_status(duels, rated, "elo", max_comparisons=5).first()
    assert (r.n_duels, r.n_active, r.complete) == (5, 3, True)


def test_pairs_are_different_items_and_reproducible(spark):
    items = spark.range(50).select((F.col("id") % 3).alias("session_id"), F.concat(F.lit("i"), "id").alias("item"))
    lone = spark.createDataFrame([(9, "x")], "session_id bigint, item string")
    draw = lambda: sorted(map(tuple, ranking.draw_pairs(items.unionByName(lone), 20, "s").collect()))
    first = draw()
    assert first == draw() and len(first) == 60
    assert all(a != b for _, _, a, b in first)


def test_long_sessions_are_not_cut_by_default(spark):
    duels = spark.createDataFrame([(1, q, "a" if q % 3 else "b", "b" if q % 3 else "a") for q in range(1, 151)], DUELS)
    items = spark.createDataFrame([(1, "a"), (1, "b")], "session_id bigint, item string")
    rated = {r.item: r.raw_score for r in ranking.process_votes(duels, items, "elo").collect()}
    assert rated == pytest.approx({r.item: r.raw_score for r in ranking.elo_ratings(duels).collect()})
    assert ranking.session_status(duels, ranking.process_votes(duels, items, "elo"), "elo").first().n_duels == 150


def test_blocks_follow_votes_and_not_their_numbers(spark, monkeypatch):
    """Sparse numbers, as of time stamps, make no empty rounds."""
    rows = [(1, 1_000_000 * q * q, "abc"[q % 3], "abc"[(q + 1) % 3]) for q in range(1, 26)]
    duels, folds, fold = spark.createDataFrame(rows, DUELS), [], ranking._fold_block
    monkeypatch.setattr(ranking, "_fold_block", lambda *a: folds.append(1) or fold(*a))
    got = {r.item: r.raw_score for r in ranking.elo_ratings(duels, block=10).collect()}
    assert len(folds) == 4  # short sessions, and three blocks
    assert got == pytest.approx({r.item: r.raw_score for r in ranking.elo_ratings(duels).collect()})


def test_history_keeps_the_time_of_the_vote_that_counts(spark):
    rows = [(1, 1, "a", "b", 10), (1, 1, "a", "b", 50), (1, 2, "b", "a", 20), (1, 3, "a", "a", 30)]
    duels = spark.createDataFrame(rows, DUELS + ", t bigint").select(
        "session_id", "seq", "winner", "loser", F.timestamp_seconds("t").alias("ts")
    )
    got = ranking.duel_history(duels).select("seq", F.unix_seconds("timestamp").alias("t"), "score1_after").collect()
    assert sorted(map(tuple, got)) == [(1, 10, 3.1), (2, 20, 3.0)]


def test_steps_are_never_broadcast_or_gathered(spark, duels, monkeypatch):
    """Joins of the steps of all duels: no side goes through the driver, and partitions follow the rows."""
    plan = ranking.duel_history(duels, fanout=4)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    monkeypatch.setattr(ranking, "STEPS_IN_PART", 100)
    want = sorted(map(tuple, ranking.duel_history(duels).collect()))
    many = ranking.duel_history(duels, fanout=4)
    assert many.rdd.getNumPartitions() >= 2 * duels.count() // 100
    assert sorted(map(tuple, many.collect())) == want
