"""Pairwise votes: ratings, histories, rankings, draws."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import derived, query
from lumenrank import plans, sources
from lumenrank.operators import aggregates, filters, positions, ranking
from lumenrank.plans import vote_report
from lumenrank.session import scratch_root


@query("select session_id, item, 0.0::double raw_score, 2.5::double score from players", uses="players")
def initial_ratings(spark, sf):
    return ranking.init_ratings(derived.players(spark, sf))


@query("select session_id, item, round(raw_score, 6) raw_score from elo", uses="elo")
def elo_ratings(spark, sf):
    rated = ranking.elo_ratings(derived.duels(spark, sf))
    return rated.select("session_id", "item", F.round("raw_score", 6).alias("raw_score"))


@query("select session_id, item, round(raw_score, 6) raw_score from elo", uses="elo")
def elo_ratings_in_blocks(spark, sf):
    """Sessions longer than a block are folded block by block."""
    rated = ranking.elo_ratings(derived.duels(spark, sf), block=16)
    return rated.select("session_id", "item", F.round("raw_score", 6).alias("raw_score"))


@query("select session_id, item, round(raw_score, 6) raw_score from elo", uses="elo")
def elo_ratings_resumed(spark, sf):
    """A second half of the votes on top of the saved ratings of the first."""
    duels = derived.duels(spark, sf)
    saved = ranking.elo_ratings(duels.filter("seq <= 10"))
    rated = ranking.elo_ratings(duels.filter("seq > 10"), saved)
    return rated.select("session_id", "item", F.round("raw_score", 6).alias("raw_score"))


@query("select session_id, item, round(raw_score, 1) raw_score, round(score, 1) score from bounded", uses="bounded")
def bounded_ratings(spark, sf):
    return ranking.bounded_ratings(derived.duels(spark, sf))


@query("select session_id, item, round(raw_score, 1) raw_score, round(score, 1) score from bounded", uses="bounded")
def bounded_ratings_in_levels(spark, sf):
    """The clamp tree with a small fan-out, so that several levels are used."""
    return ranking.bounded_ratings(derived.duels(spark, sf), fanout=4)


@query("select session_id, item, round(raw_score, 1) raw_score, round(score, 1) score from bounded", uses="bounded")
def bounded_ratings_resumed(spark, sf):
    duels = derived.duels(spark, sf)
    saved = ranking.bounded_ratings(duels.filter("seq <= 10"))
    return ranking.bounded_ratings(duels.filter("seq > 10"), saved)


_HISTORY = """select session_id, seq, winner image1, loser image2, winner, wb / 10.0::double score1_before, lb / 10.0::double score2_before,
 wa / 10.0::double score1_after, la / 10.0::double score2_after from bounded_walk where seq > 0"""


@query(_HISTORY, uses="bounded_walk")
def duel_history(spark, sf):
    return ranking.duel_history(derived.duels(spark, sf))


@query(
    f"""with h as ({_HISTORY}) select *, timestamp '2024-01-01 00:00:00' + (session_id * 1000 + seq) * interval 1 second as timestamp from h""",
    uses="bounded_walk",
)
def timed_duel_history(spark, sf):
    """Votes with a time; a late repeat of a vote changes neither the scores nor its time."""
    ts = F.timestamp_seconds(F.lit(derived.JANUARY) + F.col("session_id") * 1000 + F.col("seq"))
    duels = derived.duels(spark, sf).withColumn("ts", ts)
    again = duels.filter("seq % 3 = 0").withColumn("ts", F.col("ts") + F.expr("interval 1 hour"))
    return ranking.duel_history(duels.unionByName(again))


@query("select session_id, item, round(raw_score, 6) raw_score from elo", uses="elo")
def elo_ratings_from_snapshots(spark, sf):
    """Three parts of the votes, each on top of the snapshot of the part before; parts overlap."""
    return _in_parts(spark, sf, "elo").select("session_id", "item", F.round("raw_score", 6).alias("raw_score"))


@query("select session_id, item, raw_score from bounded", uses="bounded")
def bounded_ratings_from_snapshots(spark, sf):
    return _in_parts(spark, sf, "condorcet")


def _in_parts(spark, sf, method: str):
    duels, path = derived.duels(spark, sf), f"{scratch_root(spark)}/snapshots-{uuid.uuid4().hex}"
    sources.write_snapshot(spark, plans.rate_votes(duels.filter("seq <= 5"), method), path, 1)
    for version, upto in ((2, "seq <= 15"), (3, "true")):
        rated = plans.rate_votes(duels.filter(upto), method, sources.read_snapshot(spark, path))
        sources.write_snapshot(spark, rated, path, version)
    return sources.read_snapshot(spark, path).ratings


@query(
    "select session_id, max(seq) last_seq, count(distinct seq) n_duels from duels group by 1", uses="duels"
)
def session_progress(spark, sf):
    """How far each session has come, kept up through two snapshots."""
    duels = derived.duels(spark, sf)
    half = plans.rate_votes(duels.filter("seq <= 9"), "condorcet")
    return plans.rate_votes(duels.filter("seq > 4"), "condorcet", half).progress


@query(_HISTORY, uses="bounded_walk")
def duel_history_in_levels(spark, sf):
    return ranking.duel_history(derived.duels(spark, sf), fanout=4)


@query(
    """select p.session_id, p.item, round(coalesce(raw_score, 3.0), 1) raw_score, round(coalesce(score, 3.0), 1) score
 from players p left join bounded using (session_id, item)""",
    uses="players bounded",
)
def bounded_session_votes(spark, sf):
    """Ratings of all items of a session, items without a duel included."""
    return ranking.process_votes(derived.duels(spark, sf), derived.players(spark, sf), "condorcet")


@query(
    """with s as (select p.session_id, coalesce(score, 3.0) score from players p left join bounded using (session_id, item)),
 n as (select session_id, count(*) n_duels from duels group by 1),
 a as (select session_id, count(*) filter (where score > 0 and score < 5) n_active from s group by 1)
 select session_id, coalesce(n_duels, 0) n_duels, n_active, n_active < 2 complete from a left join n using (session_id)""",
    uses="players bounded",
)
def session_status(spark, sf):
    return vote_report(derived.duels(spark, sf), derived.players(spark, sf), "condorcet")[1]


@query(
    """select session_id, item, round(raw_score, 3) raw_score, score from elo_scored""", uses="elo_scored"
)
def normalised_ratings(spark, sf):
    """Min-max scaling of Elo ratings to 0..5 per session."""
    rated = ranking.renormalise(ranking.elo_ratings(derived.duels(spark, sf)))
    return rated.select("session_id", "item", F.round("raw_score", 3).alias("raw_score"), "score")


_RANKED = """select session_id, row_number() over (partition by session_id order by score desc, item) as rank, item image, item image_path,
 round(raw_score, 3) raw_score, score score_0_to_5 from elo_scored"""


@query(_RANKED, uses="elo_scored")
def rankings(spark, sf):
    return ranking.rankings(ranking.elo_ratings(derived.duels(spark, sf)))


@query(
    """select item, round(raw_score, 3) raw_score, row_number() over (order by raw_score desc, item) as rank,
 (select count(*) from e) - 15 n_others from e qualify rank <= 15""".replace(
        "select item, round", "with e as (select session_id || '/' || item item, raw_score from elo) select item, round", 1
    ),
    uses="elo",
)
def top_board(spark, sf):
    """The best 15 of all sessions with the number of the others."""
    rated = ranking.elo_ratings(derived.duels(spark, sf)).select(
        F.concat_ws("/", F.col("session_id").cast("string"), "item").alias("item"), "raw_score"
    )
    return positions.top_board(rated, 15, "raw_score").withColumn("raw_score", F.round("raw_score", 3))


@query(
    """with o as (select l_suppkey, l_orderkey || '/' || l_linenumber || '/' || l_partkey item, l_extendedprice,
  row_number() over (partition by l_suppkey order by l_extendedprice desc, item) as rank, count(*) over (partition by l_suppkey) c from lineitem)
 select l_suppkey, item, l_extendedprice, rank, greatest(c - 15, 0) n_others from o where rank <= 15"""
)
def top_board_per_key(spark, sf):
    rows = derived.table(spark, sf, "lineitem").select(
        "l_suppkey", F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey").alias("item"), "l_extendedprice"
    )
    return positions.top_board(rows, 15, "l_extendedprice", by=["l_suppkey"])


@query(
    """select l_suppkey, l_orderkey || '/' || l_linenumber || '/' || l_partkey item,
 row_number() over (partition by l_suppkey order by l_extendedprice desc, item) as rank from lineitem"""
)
def rank_within_key(spark, sf):
    rows = derived.table(spark, sf, "lineitem").select(
        "l_suppkey", F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey").alias("item"), "l_extendedprice"
    )
    return positions.rank_by_score(rows, "l_extendedprice", "item", ["l_suppkey"]).select("l_suppkey", "item", "rank")


@query("select event_id, row_number() over (order by ts, event_id) - 1 pos from events")
def global_position(spark, sf):
    events = derived.table(spark, sf, "events").select("ts", "event_id")
    placed = positions.with_position(events, ["ts", "event_id"])
    return placed.select("event_id", "pos")


@query(
    """select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as pos from events"""
)
def position_within_key(spark, sf):
    events = derived.table(spark, sf, "events").select("ts", "event_id", "user_id")
    placed = positions.with_position(events, ["ts", "event_id"], ["user_id"], start=1)
    return placed.select("event_id", "user_id", "pos")


@query("select event_id, (row_number() over (order by ts, event_id) - 1) // 100 + 1 batch from events")
def batch_numbers(spark, sf):
    events = derived.table(spark, sf, "events").select("ts", "event_id")
    return positions.with_batch_id(events, ["ts", "event_id"]).select("event_id", "batch")


@query("select doc_id, name from (select doc_id, lang || '_' || doc_id as name from documents) order by lower(name), name limit 10")
def first_by_name(spark, sf):
    """First ten files by name (a top-k report)."""
    items = derived.table(spark, sf, "documents").select(
        "doc_id", F.concat_ws("_", "lang", F.col("doc_id").cast("string")).alias("name")
    )
    return positions.first_by_name(items, 10)


@query(
    """select source, name from (select source, lang || '_' || doc_id as name from documents)
 qualify row_number() over (partition by source order by lower(name), name) <= 10"""
)
def first_by_name_per_folder(spark, sf):
    items = derived.table(spark, sf, "documents").select(
        "source", F.concat_ws("_", "lang", F.col("doc_id").cast("string")).alias("name")
    )
    return positions.first_by_name(items, 10, by=["source"])


@query("select doc_id item_id, lang from documents")
def random_order(spark, sf):
    items = derived.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "lang")
    return positions.random_order(items, seed=7)


@query(
    """with p as (select session_id, item, row_number() over (partition by session_id order by item) - 1 i from players),
 n as (select session_id, count(*) n from p group by 1 having count(*) >= 2),
 d as (select session_id, n, r.i pair_id, md5(session_id || ':' || r.i || '|7') m from n, range(1,4) r(i)),
 k as (select *, floor(('0x'||substr(m,1,8))::bigint / 4294967296.0::double * n)::bigint ia, ('0x'||substr(m,9,8))::bigint / 4294967296.0::double v from d),
 j as (select *, (ia + 1 + floor(v * (n - 1))::bigint) % n ib from k)
 select j.session_id, j.pair_id, a.item item_a, b.item item_b from j join p a on a.session_id = j.session_id and a.i = ia
 join p b on b.session_id = j.session_id and b.i = ib""",
    uses="players",
)
def random_pairs(spark, sf):
    """Three reproducible draws of two different items per session."""
    return ranking.draw_pairs(derived.players(spark, sf), 3, seed="7")


@query("select * from duels where seq <= 5", uses="duels")
def session_limit(spark, sf):
    """Only the planned number of duels counts."""
    return ranking.limit_duels(derived.duels(spark, sf), 5)


@query(
    """select session_id, item, raw_score, score from bounded where score > 0 and score < 5""", uses="bounded"
)
def eligible_items(spark, sf):
    return filters.eligible_items(ranking.bounded_ratings(derived.duels(spark, sf)), "condorcet")


_OVERALL = """with w as (select user_id, event_type, round(least(5.0, greatest(0.0, round(avg(value) - 45, 2))), 2) score from events group by 1, 2)"""


def _bounded_board(spark, sf):
    """Mean event values shifted onto the scale, so that both bounds are met."""
    mean = F.round(F.avg("value") - 45, 2)
    score = F.least(F.lit(5.0), F.greatest(F.lit(0.0), mean))
    return derived.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.round(score, 2).alias("score"))


@query(
    _OVERALL + """ select count(*) filter (where score > 0 and score < 5) n_active, count(*) filter (where score <= 0) n_at_min,
 count(*) filter (where score >= 5) n_at_max from w"""
)
def bounded_statistics(spark, sf):
    return aggregates.bounded_stats(_bounded_board(spark, sf))


@query("select score, count(*) n from bounded group by 1", uses="bounded")
def score_distribution(spark, sf):
    return aggregates.score_distribution(ranking.bounded_ratings(derived.duels(spark, sf)))


@query(
    """select session_id, item, case when session_id = 8 then 0.0 else round(raw_score, 6) end raw_score,
 case when session_id = 8 then 2.5 else score end score from elo_scored""",
    uses="elo_scored",
)
def reset_session(spark, sf):
    rated = ranking.renormalise(ranking.elo_ratings(derived.duels(spark, sf)))
    reset = ranking.reset_ratings(rated, 8)
    return reset.withColumn("raw_score", F.round("raw_score", 6))


@query(
    """with s as (select lang || '.png' as name, arg_max(n_chars::double, doc_id) raw_score, arg_max(doc_id::double, doc_id) score
  from documents where n_chars % 2 = 0 group by 1)
 select d.doc_id, s2.name, coalesce(raw_score, 0.0) raw_score, coalesce(score, 2.5) score from documents d
 join (select doc_id, case when n_chars % 5 = 0 then source else lang end || '.png' as name from documents) s2 using (doc_id) left join s using (name)"""
)
def ratings_carried_over(spark, sf):
    """Saved ratings follow items by base name, the last entry of a name wins."""
    docs = derived.table(spark, sf, "documents")
    items = docs.select(
        "doc_id",
        F.concat(F.lit("/new/"), F.when(F.col("n_chars") % 5 == 0, F.col("source")).otherwise(F.col("lang")), F.lit(".png")).alias("item"),
    )
    saved = docs.filter("n_chars % 2 = 0").select(
        F.concat(F.lit("/old/"), "lang", F.lit(".png")).alias("item"),
        F.col("n_chars").cast("double").alias("raw_score"),
        F.col("doc_id").cast("double").alias("score"),
        F.col("doc_id").alias("pos"),
    )
    return ranking.carry_over(items, saved).select("doc_id", "name", "raw_score", "score")
