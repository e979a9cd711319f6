"""Streams equal their batch twins, also across restarts, repeats and gaps."""

import os

import pytest
from pyspark.sql import functions as F

from lumenrank import plans, sources, streaming
from lumenrank.operators import ranking
from test_ranking import DUELS, loop_bounded, loop_elo, make


class Votes:
    """A folder of vote files and a query that reads what is new."""

    def __init__(self, spark, root, method, gap_timeout_ms=None, start=1, initial=None):
        streaming.use_rocksdb(spark)
        self.spark, self.root, self.method, self.gap, self.start = spark, root, method, gap_timeout_ms, start
        self.initial = initial
        (root / "in").mkdir()

    def add(self, rows):
        self.spark.createDataFrame(rows, DUELS).coalesce(1).write.mode("append").parquet(str(self.root / "in"))

    def query(self):
        votes = self.spark.readStream.schema(DUELS).parquet(str(self.root / "in"))
        out = str(self.root / "out")

        def save(batch, batch_id):
            batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

        return (
            streaming.stream_ratings(votes, self.method, self.gap, self.start, self.initial)
            .writeStream.outputMode("update").foreachBatch(save)
            .option("checkpointLocation", str(self.root / "checkpoint"))
        )

    def run(self):
        self.query().trigger(availableNow=True).start().awaitTermination()
        return self.read()

    def read(self):
        latest = streaming.latest_ratings(self.spark.read.parquet(str(self.root / "out")))
        return {(r.session_id, r.item): r.raw_score for r in latest.collect()}


@pytest.mark.parametrize("method", ["elo", "condorcet"])
def test_restart_repeats_and_gaps(spark, tmp_path, method):
    rows = sorted(make(3, sessions=3, items=5, n=60))
    late = [r for r in rows if r[1] % 7 == 3]
    early = [r for r in rows if r[1] % 7 != 3]
    votes = Votes(spark, tmp_path, method)
    votes.add(early)
    votes.run()
    votes.add(late + early[:10])  # the gaps arrive after a restart, with repeats
    got = votes.run()
    if method == "elo":
        assert got == loop_elo(rows)
    else:
        assert {k: round(v * 10) for k, v in got.items()} == loop_bounded(rows)[0]


def test_gap_is_released_after_the_timeout(spark, tmp_path):
    votes = Votes(spark, tmp_path, "condorcet", gap_timeout_ms=500)
    votes.add([(1, 1, "a", "b"), (1, 3, "a", "b")])
    q = votes.query().trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(120):
            if q.lastProgress and (tmp_path / "out").exists() and votes.read().get((1, "a")) == 3.2:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert votes.read() == {(1, "a"): 3.2, (1, "b"): 2.8}


def test_stream_equals_batch(spark, tmp_path):
    rows = make(8, sessions=2, items=4, n=40)
    votes = Votes(spark, tmp_path, "elo")
    votes.add(rows)
    batch = ranking.elo_ratings(spark.createDataFrame(rows, DUELS)).collect()
    assert votes.run() == {(r.session_id, r.item): r.raw_score for r in batch}


@pytest.mark.parametrize("method", ["elo", "condorcet"])
@pytest.mark.parametrize("start", [0, 1, 40])
def test_votes_without_two_items_and_other_starts(spark, tmp_path, method, start):
    """A self-vote and a missing side take their number and nothing else, as in the batch operators."""
    pairs = [("a", "b"), ("a", "a"), ("b", "c"), (None, "c"), ("c", "a"), ("b", None), ("b", "a"), ("c", "b")]
    rows = [(1, start + i, w, l) for i, (w, l) in enumerate(pairs)]
    votes = Votes(spark, tmp_path, method, start=start)
    votes.add(rows[:4] + rows[5:6])  # one gap
    votes.run()
    votes.add(rows[4:])
    got = votes.run()
    duels = spark.createDataFrame(rows, DUELS)
    rated = ranking.elo_ratings(duels) if method == "elo" else ranking.bounded_ratings(duels)
    assert got == pytest.approx({(r.session_id, r.item): r.raw_score for r in rated.collect()})


@pytest.mark.parametrize("method", ["elo", "condorcet"])
def test_a_stream_goes_on_from_a_snapshot(spark, tmp_path, method):
    """Half in batch, half streamed, a restart between: equal to all votes in batch."""
    rows = sorted(make(4, sessions=3, items=6, n=80)) + [(9, 1, "x", "y"), (9, 2, "y", "y"), (8, 1, "z", "z"), (8, 2, "z", "a")]
    early = [r for r in rows if r[1] <= 30 and r != (8, 2, "z", "a")]
    duels = spark.createDataFrame(rows, DUELS)
    saved = plans.rate_votes(spark.createDataFrame(early, DUELS), method)
    sources.write_snapshot(spark, saved, str(tmp_path / "snapshots"), 7)
    snapshot = sources.read_snapshot(spark, str(tmp_path / "snapshots"))
    votes = Votes(spark, tmp_path, method, initial=snapshot)
    votes.add([r for r in rows if 25 < r[1] <= 50])  # some of them are in the snapshot
    votes.run()
    votes.add([r for r in rows if r[1] > 50 or r[0] == 8])
    votes.run()
    updates = spark.read.parquet(str(tmp_path / "out"))
    got = {(r.session_id, r.item): r.raw_score for r in plans.ratings_after(snapshot, updates).collect()}
    whole = plans.rate_votes(duels, method).ratings.collect()
    assert got == pytest.approx({(r.session_id, r.item): r.raw_score for r in whole}, abs=1e-9)


def test_a_snapshot_is_complete_or_not_seen(spark, tmp_path):
    path = str(tmp_path / "s")
    rated = plans.rate_votes(spark.createDataFrame([(1, 1, "a", "b"), (1, 2, "b", "a")], DUELS), "elo")
    with pytest.raises(ValueError):
        sources.read_snapshot(spark, path)
    sources.write_snapshot(spark, rated, path, 1)
    later = plans.rate_votes(spark.createDataFrame([(1, 3, "a", "b")], DUELS), "elo", rated)
    sources.write_snapshot(spark, later, path, 2)
    os.remove(f"{path}/version=2/commit/_SUCCESS")  # as if the job had been cut short
    assert sources.snapshot_versions(spark, path) == [1]
    assert sources.read_snapshot(spark, path).progress.collect() == [(1, 2, 2)]
    sources.write_snapshot(spark, later, path, 2)
    sources.write_snapshot(spark, rated, path, 2)  # complete already: left as it is
    assert sources.read_snapshot(spark, path).progress.collect() == [(1, 3, 3)]
    assert sources.read_snapshot(spark, path, 1).progress.collect() == [(1, 2, 2)]
    with pytest.raises(ValueError):
        plans.rate_votes(spark.createDataFrame([(1, 4, "a", "b")], DUELS), "condorcet", rated)


@pytest.mark.parametrize("block", [1_000_000, 10])
def test_sessions_without_new_votes_keep_their_ratings(spark, block):
    from lumenrank.operators import ranking as r

    first = r.elo_ratings(spark.createDataFrame([(1, 1, "a", "b"), (2, 1, "c", "d")], DUELS))
    more = spark.createDataFrame([(1, q, "a", "b") for q in range(2, 40)], DUELS)
    assert {x.session_id for x in r.elo_ratings(more, first, block=block).collect()} == {1, 2}


ROWS = "item_id string, label int, ts timestamp, row_num bigint"


def _batch(spark, rows):
    return spark.createDataFrame(rows, "item_id string, label int, at bigint, row_num bigint").select(
        "item_id", "label", F.timestamp_seconds("at").alias("ts"), "row_num"
    )


def _runs(spark, path, fanout=4):
    return streaming.KeyedRuns(spark, path, ["item_id"], ["ts", "row_num", "label"], fanout)


def test_many_batches_leave_few_files(spark, tmp_path):
    """50 micro-batches; some come out of order in time, some hold repeats, one is empty."""
    path, newest = str(tmp_path / "t"), {}
    runs = _runs(spark, path)
    for b in range(50):
        rows = [(f"i{(b * 7 + k) % 23}", b % 6, (b * 37) % 50, b * 10 + k) for k in range(0 if b == 20 else 5)]
        rows.append((None, b % 3, b, b)) if b % 10 == 0 else None
        runs.absorb(_batch(spark, rows + rows[:2]).coalesce(1), b)
        for item, label, at, num in rows:
            newest[item] = max(newest.get(item, (-1, -1, -1)), (at, num, label))
    got = {r.item_id: r.label for r in runs.table().collect()}
    assert got == {k: v[2] for k, v in newest.items()}
    # 50 = 3 * 16 + 0 * 4 + 2
    assert [tuple(r) for r in runs.runs()] == [(0, 48), (0, 49), (2, 0), (2, 1), (2, 2)]
    assert len(runs.committed()) == 5  # merged runs are gone


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    runs = _runs(spark, path, 2)
    for b in range(4):
        runs.absorb(_batch(spark, [("a", b, b, b), (f"only{b}", b, b, b)]), b)
    before = sorted(runs.table().collect())
    for b in (3, 1, 0):  # other rows under an old number are not taken
        runs.absorb(_batch(spark, [("a", 5, 99, 99)]), b)
    assert sorted(runs.table().collect()) == before
    # a merge that was cut short: its run is not counted, the replay writes it anew
    runs.absorb(_batch(spark, [("a", 4, 4, 4)]), 4)
    runs.absorb(_batch(spark, [("b", 1, 5, 5)]), 5)
    os.remove(f"{path}/level=1/run=2/_SUCCESS")
    assert {tuple(r) for r in runs.runs()} == {(0, 4), (0, 5), (2, 0)}
    runs.absorb(_batch(spark, [("b", 1, 5, 5)]), 5)
    assert {tuple(r) for r in runs.runs()} == {(1, 2), (2, 0)}
    assert {r.item_id: r.label for r in runs.table().collect()} == {
        "a": 4, "b": 1, "only0": 0, "only1": 1, "only2": 2, "only3": 3
    }


def test_no_batch_yet(spark, tmp_path):
    with pytest.raises(ValueError):
        streaming.annotation_state(spark, str(tmp_path / "none"))


def test_scores_of_a_repeated_batch_are_stored_once(spark, tmp_path):
    """The same batch number twice, as after a failure: one set of rows; a file the model refuses is a failed row."""
    from lumenrank.operators import scoring

    def make_predict():
        def predict(files):
            if any(f == b"bad" for f in files):
                raise ValueError("bad file")
            return [[len(f), 1] for f in files]

        return predict

    inbox, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), tmp_path / "checkpoint"
    inbox.mkdir()

    def run():
        files = streaming.stream_new_items(spark, str(inbox), ["txt"])
        scored = streaming.stream_scores(
            files, lambda f: scoring.score_batches(f, make_predict, "content", keep=["name", "length"]), out
        )
        scored.option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()
        return {r.name: (r.output, r.success, r.length) for r in streaming.scored_items(spark, out).collect()}

    (inbox / "a.txt").write_bytes(b"abc")
    (inbox / "b.txt").write_bytes(b"bad")
    (inbox / "c.png").write_bytes(b"no")
    assert run() == {"a.txt": ([3.0, 1.0], True, 3), "b.txt": (None, False, 3)}
    os.remove(checkpoint / "commits" / "0")  # the batch ran, its commit was lost
    (checkpoint / "commits" / ".0.crc").unlink(missing_ok=True)
    (inbox / "d.txt").write_bytes(b"d")
    assert run() == {"a.txt": ([3.0, 1.0], True, 3), "b.txt": (None, False, 3), "d.txt": ([1.0, 1.0], True, 1)}
    assert streaming.scored_items(spark, out).count() == 3


def test_kept_columns_do_not_clash(spark):
    from lumenrank.operators import scoring

    items = spark.createDataFrame([(1, [1.0], "x")], "item_id bigint, v array<double>, output string")
    with pytest.raises(ValueError):
        scoring.score_batches(items, lambda: None, "v", keep=["output"])


class _CountedState:
    """A value or map state that counts the calls."""

    def __init__(self, calls):
        self.calls, self.held = calls, {}

    def get(self):
        return self.getValue(())

    def update(self, value):
        self.updateValue((), value)

    def exists(self):
        self.calls.append("exists")
        return bool(self.held)

    def containsKey(self, key):
        self.calls.append("contains")
        return key in self.held

    def getValue(self, key):
        self.calls.append("get")
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls.append("update")
        self.held[key] = value

    def removeKey(self, key):
        self.calls.append("remove")
        del self.held[key]


def test_held_votes_cost_few_calls_to_the_state():
    """400 votes, every second one first: the calls follow the items and blocks, not the votes."""
    import pandas as pd

    from lumenrank.streaming import votes

    calls, states = [], {}

    class Handle:
        def getValueState(self, name, *schemas):
            return states.setdefault(name, _CountedState(calls))

        getMapState = getValueState

    processor = votes._Ratings.__new__(votes._Ratings)
    processor.method, processor.gap_timeout_ms, processor.start = "elo", None, 1
    processor.seq = processor.item = processor.score = processor.vote = processor.block = processor.votes = None
    processor.init(Handle())
    rows = pd.DataFrame([(n, *(("a", "b") if n % 3 else ("b", "c"))) for n in range(1, 401)], columns=["seq", "winner", "loser"])
    late, early = rows[rows.seq % 2 == 1], rows[rows.seq % 2 == 0]
    assert list(processor.handleInputRows((1,), iter([early]), None)) == []
    (got,) = processor.handleInputRows((1,), iter([late[:100], late[100:]]), None)
    want = {}
    for _, winner, loser in rows.itertuples(index=False):
        a, b = want.get(winner, 0.0), want.get(loser, 0.0)
        gain = votes.ELO_K * (1.0 - 1.0 / (1.0 + 10.0 ** ((b - a) / 400.0)))
        want[winner], want[loser] = a + gain, b - gain
    assert dict(zip(got["item"], got["raw_score"])) == want and set(got["last_seq"]) == {400}
    assert len(calls) <= 40
