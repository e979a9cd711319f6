"""Streams over the derived tables, run until all available input is read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import derived, query
from lumenrank import plans, sources, streaming
from lumenrank.operators import scoring
from lumenrank.session import scratch_root


def _folder(spark, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _as_stream(spark, df, name: str, files_per_trigger: int = 2):
    path = _folder(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _rating_updates(spark, votes, method: str, initial=None):
    """All updates of a stream of votes that arrive in a mixed order: late ones fill gaps held in state."""
    streaming.use_rocksdb(spark)
    updates = streaming.stream_ratings(_as_stream(spark, votes.repartition(4, "seq"), "votes"), method, initial=initial)
    out, checkpoint = _folder(spark, "updates"), _folder(spark, "checkpoint")

    def save(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (
        updates.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(out)


def _run_ratings(spark, sf, method: str):
    return streaming.latest_ratings(_rating_updates(spark, derived.duels(spark, sf), method))


def _snapshot_then_stream(spark, sf, method: str):
    """Two versions of a snapshot in batch, then a stream that begins with the newer one."""
    duels, path = derived.duels(spark, sf), _folder(spark, "snapshots")
    first = plans.rate_votes(duels.filter("seq <= 6"), method)
    sources.write_snapshot(spark, first, path, 1)
    second = plans.rate_votes(duels.filter("seq <= 12"), method, sources.read_snapshot(spark, path))
    sources.write_snapshot(spark, second, path, 2)
    saved = sources.read_snapshot(spark, path)
    # the votes 10 to 12 are in the snapshot and arrive once more
    updates = _rating_updates(spark, duels.filter("seq >= 10"), method, saved)
    return plans.ratings_after(saved, updates)


@query("select session_id, item, round(raw_score, 6) raw_score from elo", uses="elo")
def streamed_elo_ratings(spark, sf):
    rated = _run_ratings(spark, sf, "elo")
    return rated.select("session_id", "item", F.round("raw_score", 6).alias("raw_score"))


@query("select session_id, item, raw_score from bounded", uses="bounded")
def streamed_bounded_ratings(spark, sf):
    return _run_ratings(spark, sf, "condorcet")


@query("select session_id, item, round(raw_score, 6) raw_score from elo", uses="elo")
def streamed_elo_after_snapshot(spark, sf):
    rated = _snapshot_then_stream(spark, sf, "elo")
    return rated.select("session_id", "item", F.round("raw_score", 6).alias("raw_score"))


@query("select session_id, item, raw_score from bounded", uses="bounded")
def streamed_bounded_after_snapshot(spark, sf):
    return _snapshot_then_stream(spark, sf, "condorcet")


@query("select item_id, arg_max(label, row_num) as label from annotation_log group by 1", uses="annotation_log")
def streamed_annotations(spark, sf):
    log = _as_stream(spark, derived.annotation_log(spark, sf).repartition(4), "annotations", 1)
    out = _folder(spark, "labels")
    q = (
        streaming.stream_annotations(log, out)
        .option("checkpointLocation", _folder(spark, "checkpoint")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return streaming.annotation_state(spark, out)


@query(
    """select predicted_quality tier, count(*) n from predictions where success group by 1""", uses="predictions"
)
def streamed_tier_summary(spark, sf):
    rows = derived.predictions(spark, sf).select("success", "predicted_quality").repartition(4)
    out = _folder(spark, "summary")

    def save(batch, batch_id):
        batch.write.mode("overwrite").parquet(out)

    q = (
        streaming.stream_summary(_as_stream(spark, rows, "predictions"))
        .writeStream.outputMode("complete").foreachBatch(save)
        .option("checkpointLocation", _folder(spark, "checkpoint")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(out)


def _in_two_rounds(spark, sf, root: str, read) -> None:
    """Write texts into ``root`` as one folder per kind, half before and half after a restart of the query ``read``."""
    rows = derived.table(spark, sf, "documents").select(
        F.concat_ws("_", "source", "lang").alias("kind"), "n_chars", F.coalesce("text", F.lit("")).alias("value")
    )
    for half in (0, 1):
        part = rows.filter(F.col("n_chars") % 2 == half).select("kind", "value")
        part.repartition(3).write.mode("append").partitionBy("kind").text(root)
        read().trigger(availableNow=True).start().awaitTermination()


def _kind():
    return F.regexp_extract("dir", "/kind=([^/]*)$", 1).alias("kind")


@query(
    """select concat_ws('_', source, lang) kind, sum(strlen(coalesce(text, '')) + 1)::bigint bytes, true each_once
 from documents group by 1"""
)
def streamed_new_files(spark, sf):
    """Files appear in a folder in two rounds; each one is picked up once, with its length."""
    root, out, checkpoint = _folder(spark, "inbox"), _folder(spark, "seen"), _folder(spark, "checkpoint")

    def read():
        files = streaming.stream_new_items(spark, root, ["txt"]).drop("content")
        return files.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)

    _in_two_rounds(spark, sf, root, read)
    return spark.read.parquet(out).groupBy(_kind()).agg(
        F.sum("length").alias("bytes"), (F.count(F.lit(1)) == F.count_distinct("path")).alias("each_once")
    )


def make_byte_counter():
    """Model over whole files: how many bytes, and how many of some of them."""
    return lambda files: [[len(f), f.count(b"e"), f.count(b" "), f.count(b"\n")] for f in files]


@query(
    """with t as (select concat_ws('_', source, lang) kind, coalesce(text, '') || chr(10) t from documents)
 select kind, sum(strlen(t))::double bytes, sum(strlen(t) - strlen(replace(t, 'e', '')))::double e,
  sum(strlen(t) - strlen(replace(t, ' ', '')))::double spaces, sum(strlen(t) - strlen(replace(t, chr(10), '')))::double line_ends,
  true all_scored from t group by 1"""
)
def streamed_scores(spark, sf):
    """Files scored as they arrive, with a restart between; each one is scored once."""
    root, out, checkpoint = _folder(spark, "inbox"), _folder(spark, "scores"), _folder(spark, "checkpoint")

    def score(files):
        return scoring.score_batches(files, make_byte_counter, "content", keep=["dir"])

    def read():
        files = streaming.stream_new_items(spark, root, ["txt"])
        return streaming.stream_scores(files, score, out).option("checkpointLocation", checkpoint)

    _in_two_rounds(spark, sf, root, read)
    names = ("bytes", "e", "spaces", "line_ends")
    return streaming.scored_items(spark, out).groupBy(_kind()).agg(
        *[F.sum(F.get("output", F.lit(i))).alias(c) for i, c in enumerate(names)], F.bool_and("success").alias("all_scored")
    )
