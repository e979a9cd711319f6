"""Layout tables: where each item goes and under which name.

The rows are plans (``src_path, dest_dir, dest_name, status``); copying bytes
is left to the storage system or to :func:`lumenrank.sources.write_by_group`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank import functions as fn
from lumenrank.operators.filters import split_by_existence
from lumenrank.operators.positions import with_position
from lumenrank.session import materialise
from lumenrank.tiers import tier_folder

# Folder and name patterns.
NOISE_FOLDER = "noise"
CLUSTER_FOLDER = "cluster_%d"
GROUP_FOLDER = "groupe_%03d"
GROUP_MEMBER = "%02d_%s"
NUMBERED_STEM = r"^(.+)_([1-9][0-9]{0,17})$"


def layout_by_tier(
    predictions: DataFrame,
    on_conflict: str = "suffix",
    order: str = "item_id",
    score: str = "predicted_quality",
    rounding: bool = False,
    listing: DataFrame | None = None,
) -> DataFrame:
    """``tier folder / base name`` for every item whose source exists."""
    rows = predictions
    if listing is not None:
        rows, _ = split_by_existence(
            predictions, listing.select(F.col("path").alias("image_path")), "image_path"
        )
    code = F.bround(F.col(score).cast("double"), 0) if rounding else F.col(score)
    placed = rows.select(
        F.col(order).alias("row_num"),
        F.col("image_path").alias("src_path"),
        tier_folder(code).alias("dest_dir"),
        fn.basename(F.col("image_path")).alias("name"),
    )
    if on_conflict == "overwrite":
        last = placed.groupBy("dest_dir", "name").agg(F.max(F.struct("row_num", "src_path")).alias("r"))
        return last.select("r.row_num", "r.src_path", "dest_dir", F.col("name").alias("dest_name"))
    if on_conflict != "suffix":
        raise ValueError("on_conflict is 'suffix' or 'overwrite'")
    return resolve_names(placed)


def layout_by_cluster(labelled: DataFrame, handle_noise: bool = True, path: str = "path") -> DataFrame:
    """``cluster_N / base name``; noise goes to its own folder."""
    label = F.col("cluster")
    folder = F.format_string(CLUSTER_FOLDER, label)
    if handle_noise:
        folder = F.when(label == -1, F.lit(NOISE_FOLDER)).otherwise(folder)
    return labelled.select(
        "item_id",
        F.col(path).alias("src_path"),
        folder.alias("dest_dir"),
        fn.basename(F.col(path)).alias("dest_name"),
    )


def layout_by_dup_group(groups: DataFrame, paths: DataFrame, path: str = "path") -> DataFrame:
    """``groupe_NNN / MM_name`` with the leader as member 0."""
    located = groups.join(paths.select("item_id", path), "item_id")
    return located.select(
        "item_id",
        F.col(path).alias("src_path"),
        F.format_string(GROUP_FOLDER, "group_no").alias("dest_dir"),
        F.format_string(GROUP_MEMBER, F.col("member_pos"), fn.basename(F.col(path))).alias("dest_name"),
    )


def layout_from_mapping(
    mapping: DataFrame, listing: DataFrame, existing: DataFrame | None = None, mode: str = "copy"
) -> DataFrame:
    """Destination of every mapping row, error rows included.

    Missing sources are errors; when moving, so are later rows of a source that
    an earlier row has moved. Taken names get ``_1``, ``_2``, ...
    """
    rows = mapping.select("row_num", F.trim("path").alias("path"), F.trim("dir").alias("dest_dir"))
    found, missing = split_by_existence(rows, listing, "path")
    errors = missing.withColumn("status", F.lit("source not found"))
    if mode == "move":
        first = found.groupBy("path").agg(F.min("row_num").alias("_first"))
        marked = found.join(first, "path")
        errors = errors.unionByName(
            marked.filter("row_num <> _first").drop("_first").withColumn("status", F.lit("source moved"))
        )
        found = marked.filter("row_num = _first").drop("_first")
    elif mode != "copy":
        raise ValueError("mode is 'copy' or 'move'")
    named = found.select(
        "row_num", F.col("path").alias("src_path"), "dest_dir", fn.basename(F.col("path")).alias("name")
    )
    done = resolve_names(named, existing).withColumn("status", F.lit("ok"))
    failed = errors.select(
        "row_num", F.col("path").alias("src_path"), "dest_dir", F.lit(None).cast("string").alias("dest_name"), "status"
    )
    return done.unionByName(failed)


# ---------------------------------------------------------------- name conflicts


def _numbered(name: Column, k: Column) -> Column:
    ext = F.regexp_extract(name, r".(\.[^.]*)$", 1)
    return F.concat(fn.stem(name), F.lit("_"), k.cast("string"), ext)


def resolve_names(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Unique ``dest_name`` per ``dest_dir`` for rows taken in ``row_num`` order.

    A row keeps its name when it is free, else it gets the first free
    ``stem_k``. ``existing`` (``dest_dir, name``) holds names already in place.

    The conflicts of one name take k = 1, 2, ... in row order. Only a row or
    file that is itself called ``stem_k`` disturbs the count, so the work is
    split by name: a position per (folder, name), plus corrections for the
    names that have such siblings. No folder or name is handled as a whole by
    one task.
    """
    spark = rows.sparkSession
    if existing is None:
        existing = spark.createDataFrame([], "dest_dir string, name string")
    key = ["dest_dir", "name"]
    placed = with_position(rows, ["row_num"], key, "_rank")
    names = placed.groupBy(*key).agg(F.min("row_num").alias("first"))
    taken = existing.select(*key).distinct().withColumn("existing", F.lit(True))
    names = names.join(taken, key, "full").withColumn("existing", F.coalesce("existing", F.lit(False)))
    names = materialise(names, "names")
    links = materialise(_sibling_links(names), "links")
    flags = names.filter("first is not null").select(*key, F.col("existing").alias("clash"))
    no_siblings = links.isEmpty()
    if not no_siblings:
        siblings = materialise(_settle_siblings(placed, names, links), "siblings")
        settled = siblings.select("dest_dir", F.col("child").alias("name"), F.col("clash").alias("_clash"))
        flags = flags.join(settled, key, "left").select(*key, F.coalesce("_clash", "clash").alias("clash"))
    # one row per name with a clashing first row; usually few
    clashing = flags.filter("clash").select(*key, F.lit(1).alias("_one"))
    counted = placed.join(clashing, key, "left").withColumn(
        "_k", F.col("_rank") + F.coalesce("_one", F.lit(0))
    )
    if not no_siblings:
        counted = _skip_taken(counted, siblings)
    dest = F.when(F.col("_k") == 0, F.col("name")).otherwise(_numbered(F.col("name"), F.col("_k")))
    return counted.withColumn("dest_name", dest).select(
        *[c for c in rows.columns if c != "name"], "dest_name"
    )


def _sibling_links(names: DataFrame) -> DataFrame:
    """Names of the form ``stem_k.ext`` whose ``stem.ext`` also occurs as a row."""
    stem = fn.stem(F.col("name"))
    ext = F.regexp_extract("name", r".(\.[^.]*)$", 1)
    child = names.withColumns(
        {
            "_base": F.regexp_extract(stem, NUMBERED_STEM, 1),
            "k": F.regexp_extract(stem, NUMBERED_STEM, 2).try_cast("bigint"),
        }
    ).filter(F.col("k").isNotNull())
    child = child.select(
        "dest_dir", F.concat("_base", ext).alias("parent"), F.col("name").alias("child"), "k", "first", "existing"
    )
    parent = names.filter("first is not null").select("dest_dir", F.col("name").alias("parent"))
    return child.join(parent, ["dest_dir", "parent"])


def _rows_before(placed: DataFrame, links: DataFrame) -> DataFrame:
    """Append ``before``: rows of the parent ahead of the first row of the child."""
    key = ["dest_dir", "parent"]
    rows = placed.join(
        links.select("dest_dir", F.col("parent").alias("name")).distinct(), ["dest_dir", "name"], "left_semi"
    ).select("dest_dir", F.col("name").alias("parent"), F.col("row_num").alias("t"), F.lit(None).cast("bigint").alias("k"))
    markers = links.filter("not existing").select(*key, F.col("first").alias("t"), "k")
    merged = with_position(rows.unionByName(markers), ["t"], key, "_all").filter("k is not null")
    among = with_position(merged, ["t"], key, "_among")
    counts = among.select(*key, "k", (F.col("_all") - F.col("_among")).alias("before"))
    # a name already in place is ahead of every row
    return links.join(counts, [*key, "k"], "left").fillna(0, ["before"])


def _walk_siblings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Decide in k order which siblings own their name.

    ``r`` conflict rows of the parent come before the sibling; together with
    the siblings skipped so far they have used the numbers below r + skipped + 1.
    """
    parent, skipped = None, 0
    for pdf in batches:
        owns, index = [], []
        for d, p, k, r in zip(*(pdf[c].tolist() for c in ("dest_dir", "parent", "k", "r"))):
            if (d, p) != parent:
                parent, skipped = (d, p), 0
            own = r + skipped < k
            skipped += own
            owns.append(own)
            index.append(skipped)
        out = pdf[["dest_dir", "parent", "child", "k", "existing"]].copy()
        yield out.assign(owns=owns, nth=index)


def _settle_siblings(placed: DataFrame, names: DataFrame, links: DataFrame) -> DataFrame:
    """``owns`` and ``clash`` of every linked name, parents before children."""
    timed = materialise(_rows_before(placed, links), "timed")
    parents = timed.select("dest_dir", "parent").distinct()
    child_names = timed.select("dest_dir", F.col("child").alias("parent"))
    clash = names.select("dest_dir", F.col("name").alias("parent"), F.col("existing").alias("clash"))
    frontier = parents.join(child_names, ["dest_dir", "parent"], "left_anti").join(clash, ["dest_dir", "parent"])
    settled = None
    while True:
        # the parent's first row conflicts only when its own name was taken
        r = F.col("before") - F.when(F.col("clash"), F.lit(0)).otherwise(F.least(F.lit(1), F.col("before")))
        part = (
            timed.join(frontier, ["dest_dir", "parent"])
            .select("dest_dir", "parent", "child", "k", "existing", r.cast("bigint").alias("r"))
            .repartition("dest_dir", "parent")
            .sortWithinPartitions("dest_dir", "parent", "k")
            .mapInPandas(
                _walk_siblings,
                "dest_dir string, parent string, child string, k bigint, existing boolean, owns boolean, nth bigint",
            )
            .withColumn("clash", F.col("existing") | ~F.col("owns"))
        )
        part = materialise(part, "level")
        if part.isEmpty():
            return settled if settled is not None else part
        settled = part if settled is None else settled.unionByName(part)
        frontier = part.select("dest_dir", F.col("child").alias("parent"), "clash").join(
            parents, ["dest_dir", "parent"], "left_semi"
        )


def _skip_taken(counted: DataFrame, siblings: DataFrame) -> DataFrame:
    """Shift the numbers of conflict rows past the siblings that own theirs.

    The j-th conflict row passes the i-th owner (number s) when s - i < j, so
    rows and owners merge into one order and the position is the number.
    """
    key = ["dest_dir", "name"]
    owners = siblings.filter("owns").select(
        "dest_dir", F.col("parent").alias("name"), (F.col("k") - F.col("nth")).alias("at"),
        F.lit(1).alias("kind"), F.col("k").alias("row_num"),
    )
    touched = owners.select(*key).distinct()
    moving = (F.col("_k") > 0) & F.col("_touched").isNotNull()
    marked = counted.join(touched.withColumn("_touched", F.lit(1)), key, "left")
    rows = marked.filter(moving).select(
        *key, F.col("_k").alias("at"), F.lit(0).alias("kind"), "row_num"
    )
    merged = with_position(rows.unionByName(owners), ["at", "kind", "row_num"], key, "_new", start=1)
    moved = merged.filter("kind = 0").select(*key, "row_num", "_new")
    return (
        marked.join(moved, [*key, "row_num"], "left")
        .withColumn("_k", F.coalesce("_new", "_k"))
        .drop("_new", "_touched")
    )
