"""Listings, readers and writers; writers are checked by reading back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import derived, query
from lumenrank import functions as fn
from lumenrank import sources
from lumenrank.operators import aggregates, filters, positions, ranking
from lumenrank.session import scratch_root
from lumenrank.tiers import EXTENSION_PROFILES, in_profile


def _target(spark, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    """select quality::int as label, 'quality_' || quality folder, sum(strlen(coalesce(text, '')) + 1)::bigint bytes, true named
 from labels join documents using (doc_id) group by 1, 2"""
)
def library_scan(spark, sf):
    """Write labelled texts into quality_N folders, scan the folder tree, count the bytes of its files."""
    path = _target(spark, "library")
    docs = derived.table(spark, sf, "documents").join(derived.table(spark, sf, "labels"), "doc_id")
    placed = docs.select("quality", F.coalesce("text", F.lit("")).alias("value"))
    for folder in ("quality_0", "quality_1"):
        part = placed.filter(F.concat(F.lit("quality_"), F.col("quality").cast("string")) == folder)
        part.select("value").write.mode("overwrite").text(f"{path}/{folder}")
    items = sources.scan_items(spark, path, recursive=True, extensions=["txt"])
    labelled = sources.labels_from_folders(items)
    return labelled.groupBy("label", fn.basename(F.col("dir")).alias("folder")).agg(
        F.sum("length").alias("bytes"), F.bool_and(F.col("name").endswith(F.col("ext"))).alias("named")
    )


@query(
    """select path from paths where lower(regexp_extract(path, '\\.([^./]*)$', 1)) in ('jpg','jpeg','png','bmp','webp')
 and path not like '%/.git%/%' and path not like '%/.venv%/%'""",
    uses="paths",
)
def pruned_listing(spark, sf):
    """Supported files outside tool folders."""
    items = sources.list_paths(derived.paths(spark, sf))
    return sources.keep_supported(items, "distribution", prune_dirs=True).select("path")


@query(
    """select path, regexp_extract(path, '([^/]+)$', 1) as name, regexp_extract(path, '^(.*)/', 1) dir,
 lower(regexp_extract(path, '\\.([^./]*)$', 1)) ext, regexp_extract(path, '([^/]+)\\.[^.]*$', 1) stem from paths""",
    uses="paths",
)
def path_pieces(spark, sf):
    items = sources.list_paths(derived.paths(spark, sf))
    return items.select("path", "name", "dir", "ext", fn.stem(F.col("path")).alias("stem"))


@query(
    """with e as (select lower(regexp_extract(path, '\\.([^./]*)$', 1)) ext from paths),
 p as (select unnest(['scoring','distribution','duplicates','voting','semantic','training']) profile,
  unnest(['jpg jpeg png bmp tiff webp','jpg jpeg png bmp webp','jpg jpeg png bmp gif tiff webp','jpg jpeg png bmp gif tiff webp','png jpg jpeg bmp gif','jpg jpeg png bmp']) exts)
 select profile, count(*) n from e, p where list_contains(string_split(exts, ' '), ext) group by 1""",
    uses="paths",
)
def extension_profiles(spark, sf):
    """Supported files per named profile, in one pass."""
    items = sources.list_paths(derived.paths(spark, sf))
    counts = items.agg(*[F.count_if(in_profile(F.col("ext"), p)).alias(p) for p in EXTENSION_PROFILES])
    return counts.unpivot([], list(EXTENSION_PROFILES), "profile", "n")


@query("select doc_id, ['.jpg', '.' || lower(lang), '.webp'] exts from documents")
def extension_lists(spark, sf):
    """Caller's suffix lists: trimmed, lower case, with a dot."""
    rows = derived.table(spark, sf, "documents")
    listed = F.concat(F.lit(" JPG, ."), F.upper("lang"), F.lit(",webp "))
    return rows.select("doc_id", fn.normalise_exts(listed).alias("exts"))


@query(
    """select path, regexp_extract(path, '/quality_([0-5])/[^/]+$', 1)::int as label from paths
 where regexp_matches(path, '/quality_([0-5])/[^/]+$')""",
    uses="paths",
)
def labels_from_folders(spark, sf):
    return sources.labels_from_folders(derived.paths(spark, sf)).select("path", "label")


@query(
    """with s as (select path, regexp_replace(regexp_extract(path, '([^/]+)\\.[^.]*$', 1), '[^0-9]', '', 'g') d from paths)
 select path, greatest(0, least(5, d::hugeint - 1))::int as label from s where d <> ''""",
    uses="paths",
)
def labels_from_names(spark, sf):
    """All digits of the stem as a number, minus one, limited to the scale."""
    return sources.labels_from_names(derived.paths(spark, sf)).select("path", "label")


@query(
    """select cast(i as int) tier, 'Qualité ' || i report_name from range(0,6) r(i) where i not in (select quality from labels)"""
)
def missing_classes(spark, sf):
    return sources.missing_classes(derived.table(spark, sf, "labels"), "quality")


@query(
    """select image_path, predicted_quality, quality_label, round(confidence, 6) confidence, success, error,
 list_transform(all_probabilities, lambda x: round(x, 6)) probs from predictions""",
    uses="predictions",
)
def predictions_as_csv(spark, sf):
    """Prediction table written as CSV and read back."""
    path = _target(spark, "predictions-csv")
    sources.write_predictions(derived.predictions(spark, sf), path, "csv")
    return _shown(sources.read_predictions(spark, path))


@query(
    """select image_path, predicted_quality, quality_label, round(confidence, 6) confidence, success, error,
 list_transform(all_probabilities, lambda x: round(x, 6)) probs from predictions""",
    uses="predictions",
)
def predictions_as_json(spark, sf):
    path = _target(spark, "predictions-json")
    sources.write_predictions(derived.predictions(spark, sf), path, "json")
    return _shown(sources.read_predictions_json(spark, f"{path}/results"))


def _shown(df):
    return df.select(
        "image_path", "predicted_quality", "quality_label", F.round("confidence", 6).alias("confidence"),
        "success", "error", F.transform("all_probabilities", lambda x: F.round(x, 6)).alias("probs"),
    )


@query(
    """select count(*) total_images, count(*) filter (where success) successful_predictions from predictions""",
    uses="predictions",
)
def prediction_manifest(spark, sf):
    return sources.manifest(derived.predictions(spark, sf)).drop("timestamp")


@query("select row_num, path, dir from mapping", uses="mapping")
def mapping_as_csv(spark, sf):
    """Mapping CSV with padded values, read back with its row numbers."""
    path = _target(spark, "mapping-csv")
    padded = derived.mapping(spark, sf).orderBy("row_num").select(
        F.concat(F.lit(" "), "path", F.lit(" ")).alias("path"), F.concat("dir", F.lit("  ")).alias("dir")
    )
    padded.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    return sources.read_mapping(spark, path)


@query(
    """with l as (select item_id, arg_max(label, row_num) as label from annotation_log group by 1)
 select 'doc_' || item_id image_path, label, ['0_VeryPoor','1_Poor'][label+1] class_name from l""",
    uses="annotation_log",
)
def annotations_as_csv(spark, sf):
    """Annotation log appended in two parts; bad rows are skipped, the last label wins."""
    path = _target(spark, "annotations-csv")
    log = derived.annotation_log(spark, sf).select(
        F.format_string("doc_%d", "item_id").alias("image_path"), "label", "ts"
    )
    cut = F.timestamp_seconds(F.lit(derived.FEBRUARY))
    sources.append_annotations(log.filter(F.col("ts") < cut), path)
    sources.append_annotations(log.filter(F.col("ts") >= cut), path)
    bad = derived.table(spark, sf, "labels").select(
        F.lit("2025-01-01T00:00:00").alias("timestamp"), F.format_string("doc_%d", "doc_id").alias("image_path"),
        F.lit("not a number").alias("label"), F.lit("").alias("class_name"),
    )
    bad.write.mode("append").option("header", True).csv(path)
    clean = sources.read_annotations(spark, path)
    latest = clean.groupBy("image_path").agg(F.max_by(F.struct("label", "class_name"), "ts").alias("r"))
    return latest.select("image_path", "r.label", "r.class_name")


@query("select session_id, seq, winner, loser from duels", uses="duels")
def duels_as_parquet(spark, sf):
    path = _target(spark, "duels")
    derived.duels(spark, sf).write.parquet(path)
    return sources.read_duels(spark, path)


@query(
    """select session_id::int session_id, (row_number() over (partition by session_id order by score desc, item))::int as rank, item image,
 item image_path, round(raw_score, 3) raw_score, score score_0_to_5 from elo_scored""",
    uses="elo_scored",
)
def rankings_as_csv(spark, sf):
    path = _target(spark, "rankings")
    sources.write_rankings(ranking.rankings(ranking.elo_ratings(derived.duels(spark, sf))), path, ["session_id"])
    return spark.read.option("header", True).schema(
        "rank int, image string, image_path string, raw_score double, score_0_to_5 double, session_id int"
    ).csv(path)


@query(
    """select session_id, winner image1, loser image2, winner, wb / 10.0::double score1_before, lb / 10.0::double score2_before,
 wa / 10.0::double score1_after, la / 10.0::double score2_after from bounded_walk where seq > 0""",
    uses="bounded_walk",
)
def duel_history_as_csv(spark, sf):
    path = _target(spark, "history")
    sources.write_duel_history(ranking.duel_history(derived.duels(spark, sf)), path)
    return spark.read.option("header", True).schema(
        "session_id bigint, image1 string, image2 string, winner string, score1_before double, score2_before double, "
        "score1_after double, score2_after double"
    ).csv(path)


@query(
    """select source || '/' || lang dest_dir, count(*) n, sum(n_chars)::bigint chars from documents group by 1"""
)
def records_by_folder(spark, sf):
    """Records written into one folder per group and counted from the files."""
    path = _target(spark, "by-group")
    rows = derived.table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    sources.write_by_group(rows, path, "source")
    stored = spark.read.parquet(path)
    return stored.groupBy(F.concat_ws("/", "source", "lang").alias("dest_dir")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")
    )


@query(
    """select distinct path from (select path from paths union all select upper(path) from paths union all select path from paths)""",
    uses="paths",
)
def merged_listings(spark, sf):
    """Distinct union of several listings."""
    listing = derived.paths(spark, sf).select("path")
    return filters.union_listings(listing, listing.select(F.upper("path").alias("path")), listing)


@query(
    """select item_id, label, ts, row_num from annotation_log union all select item_id, label, ts, row_num from annotation_log""",
    uses="annotation_log",
)
def appended_logs(spark, sf):
    log = derived.annotation_log(spark, sf)
    return filters.append_rows(log, log)


@query("select doc_id item_id from documents where doc_id not in (select doc_id from labels)")
def listing_difference(spark, sf):
    """Everything listed minus everything annotated."""
    items = derived.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"))
    return filters.pending_items(items, aggregates.latest_label(derived.annotation_log(spark, sf)))


@query("select count(*) n, count(distinct item_id) n_items, true ordered from annotation_log", uses="annotation_log")
def stamped_annotations(spark, sf):
    """Annotations stamped at ingestion: every row carries the same query time."""
    log = derived.annotation_log(spark, sf).withColumn("stamp", fn.event_time())
    return log.agg(
        F.count("stamp").alias("n"), F.count_distinct("item_id").alias("n_items"),
        (F.min("stamp") <= F.max("stamp")).alias("ordered"),
    )


@query(
    """select (row_number() over (order by path) - 1) // 100 + 1 batch, path from paths""", uses="paths"
)
def listing_batches(spark, sf):
    """The listing in path order, cut into batches of 100."""
    return positions.with_batch_id(derived.paths(spark, sf).select("path"), ["path"]).select("batch", "path")
