"""Search for short texts inside long ones by size-partitioned MinHash and exact containment.

The items looked for (test items, licence notices) and the sets searched (the
shingles of whole documents, or of overlapping windows) are partitioned by
size into classes ``2^c .. 2^(c+1) - 1``. Of a document only the shingles that
occur in some item matter; a bit filter, which never loses one, keeps these
and a few others, and the sets hold what is left. A set with fewer shingles
than the smallest item of a class needs is not searched for that class, which
loses nothing.

A set of x shingles that holds the share t of an item's n has a Jaccard
similarity of ``t n / (x + (1 - t) n)`` at least. For every pair of classes
the number of one-row bands is chosen so that such a pair meets in a band with
probability ``1 - MISS`` or more. What meets is verified by intersecting the
shingle sets, and nothing else is.

Windows are cut for each class of items by the positions of their shingles:
windows of ``2^(c+2)`` positions at steps of half that, so a passage of the
item lies in one window whole, with all its inner repeats.

Whole documents more than ``2^SPREAD`` times as large as an item would need
too many bands. For these pairs of classes alone, an exact search follows: a
document with ``m`` of an item's ``n`` shingles has one of any ``n - m + 1`` of
them, so of every item those in the fewest such documents are looked up.

A shingle is a run of ``k`` words; of an item with fewer words, the run of all
its words, and documents are cut into runs of that length too. All is built-in
functions. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank.llm.bits import bit_table, filter_bits, in_table
from lumenrank.llm.text import indexes, lower_words, solid
from lumenrank.session import materialise

SHINGLE = 5
THRESHOLD = 0.8
MISS = 1e-4
SPREAD = 4


def runs(words: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words in order."""
    return F.transform(indexes(F.size(words) - (k - 1)), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))


def _log2(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double"))).cast("int")


def items_of(texts: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """``item_id, hs, n, d, c, k``: distinct shingles, their number, its class, that of their places, and their words.

    Items without words are left out.
    """
    rows = texts.select(F.col(id_col).alias("item_id"), lower_words(F.col(text)).alias("_words"))
    cut = runs(F.col("_words"), k)
    for short in range(k - 1, 0, -1):
        cut = F.when(F.size("_words") == short, runs(F.col("_words"), short)).otherwise(cut)
    sets = rows.select("item_id", cut.alias("_all"), F.least(F.size("_words"), F.lit(k)).alias("k"))
    sets = solid(sets.select("item_id", "k", F.size("_all").alias("p"), F.array_distinct("_all").alias("hs")), F.size("hs") > 0)
    return sets.select("item_id", "hs", F.size("hs").alias("n"), _log2(F.size("hs")).alias("d"), _log2(F.col("p")).alias("c"), "k")


def shared_shingles(docs: DataFrame, table: Column, bits: int, id_col: str, text: str, lengths: list[int]) -> DataFrame:
    """``doc_id, t, hits``: places and hashes of the document's runs that pass the filter.

    ``t`` tells rows of one id with different texts apart.
    """
    words = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("t"), lower_words(F.col(text)).alias("_words")
    )
    hashed = words.select("doc_id", "t", table.alias("_table"), *[runs(F.col("_words"), k).alias(f"_h{k}") for k in lengths])

    def hits(h: Column) -> Column:
        passing = F.filter(indexes(F.size(h)), lambda i: in_table(F.col("_table"), F.get(h, i), bits))
        return F.transform(passing, lambda i: F.struct(i.alias("i"), F.get(h, i).alias("h")))

    return hashed.select("doc_id", "t", F.concat(*[hits(F.col(f"_h{k}")) for k in lengths]).alias("hits"))


def windows(hits: DataFrame, least: dict[int, int], threshold: float) -> DataFrame:
    """``doc_id, t, part, hs``: the distinct shingles of every window that could hold an item of class ``part``."""
    steps = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(1 << (c + 1)).alias("step")) for c in least])
    # explode() would let the planner test the computed array first, which evaluates it anew for every element
    placed = (
        hits.select("doc_id", "t", F.explode_outer("hits").alias("x"))
        .filter(F.col("x").isNotNull())
        .select("doc_id", "t", "x.i", "x.h", F.explode(steps).alias("s"))
        .select(
            "doc_id", "t", "h", F.col("s.c").alias("part"),
            F.explode(F.array(F.floor(F.col("i") / F.col("s.step")), F.floor(F.col("i") / F.col("s.step")) - 1)).alias("w"),
        )
        .filter("w >= 0")
    )
    sets = placed.groupBy("doc_id", "t", "part", "w").agg(F.collect_set("h").alias("hs"))
    return sets.filter(F.size("hs") >= _needed(least, threshold)).select("doc_id", "t", "part", "hs")


def _needed(least: dict[int, int], threshold: float) -> Column:
    """Shingles that the smallest item of the class ``part`` needs."""
    needed = F.lit(0)
    for part, d in least.items():
        needed = F.when(F.col("part") == part, math.ceil((1 << d) * threshold)).otherwise(needed)
    return needed


def band_count(d: int, e: int, threshold: float, miss: float = MISS) -> int:
    """Bands for items of ``2^d`` shingles or more in sets of ``2^e .. 2^(e+1) - 1``."""
    n, x = 1 << d, (1 << (e + 1)) - 1
    least = min(threshold * n / (x + (1 - threshold) * n), 1 - 1e-9)
    return max(1, math.ceil(math.log(miss) / math.log(1 - least)))


def _min_hashes(hs: Column, bands: Column) -> Column:
    return F.transform(indexes(bands), lambda j: F.array_min(F.transform(hs, lambda h: F.xxhash64(h, j))))


def _by_bands(sets: DataFrame, items: DataFrame, classes: dict[int, tuple[int, int]], threshold: float, miss: float) -> DataFrame:
    """``doc_id, t, item_id, n_shingles, n_found`` of the sets that share a band with an item and hold enough of it.

    ``classes`` has, for each ``part`` of sets and items, the class of its
    smallest item and that of its largest set.
    """
    bands, item_bands = F.lit(1), F.lit(1)
    for part, (d, largest) in classes.items():
        counts = [band_count(d, e, threshold, miss) for e in range(largest + 1)]
        own = F.get(F.array(*map(F.lit, counts)), _log2(F.size("hs")))
        bands = F.when(F.col("part") == part, own).otherwise(bands)
        item_bands = F.when(F.col("part") == part, max(counts)).otherwise(item_bands)
    # "band" and "value" are the join key with the class; equal values of many sets are one skewed key, which the
    # planner splits, as the items' side has few rows per key
    seen = sets.select("doc_id", "t", "part", "hs", F.posexplode(_min_hashes(F.col("hs"), bands)).alias("band", "value"))
    asked = items.select("item_id", "part", F.posexplode(_min_hashes(F.col("hs"), item_bands)).alias("band", "value"))
    met = seen.join(asked, ["part", "band", "value"]).select("doc_id", "t", "hs", "item_id").distinct()
    wanted = items.select("item_id", F.col("hs").alias("_item"), F.col("n").cast("bigint").alias("n_shingles"))
    n_found = F.size(F.array_intersect("hs", "_item")).cast("bigint")
    checked = met.join(wanted, "item_id").select("doc_id", "t", "item_id", "n_shingles", n_found.alias("n_found"))
    return checked.filter(F.col("n_found") >= F.col("n_shingles") * threshold)


def _by_lookup(sets: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """The same, without a miss, for sets so large that bands don't serve: by the rarest shingles of every item."""
    seen = sets.select("doc_id", "t", "part", F.explode("hs").alias("h"))
    spread = seen.groupBy("part", "h").agg(F.count(F.lit(1)).alias("docs"))
    spare = F.col("n") - F.ceil(F.col("n") * threshold).cast("int") + 1
    place = F.struct("docs", "h")
    rarest = (
        items.select("item_id", "part", "n", F.explode("hs").alias("h")).join(spread, ["part", "h"], "left")
        .withColumn("docs", F.coalesce("docs", F.lit(0)))
        .groupBy("item_id", "part", "n").agg(F.sort_array(F.collect_list(place)).alias("_hs"))
    )
    asked = rarest.select("item_id", "part", F.explode(F.slice("_hs", F.lit(1), F.greatest(spare, F.lit(1)))).alias("x"))
    met = seen.join(asked.filter("x.docs > 0").select("item_id", "part", "x.h"), ["part", "h"]).select("doc_id", "t", "part", "item_id").distinct()
    wanted = met.join(items.select("item_id", F.col("hs").alias("_item"), F.col("n").cast("bigint").alias("n_shingles")), "item_id")
    wanted = wanted.withColumnsRenamed({"doc_id": "_d", "t": "_t", "part": "_p"})
    both = wanted.join(sets, (F.col("_t") == F.col("t")) & (F.col("_p") == F.col("part")) & F.col("_d").eqNullSafe(F.col("doc_id")))
    n_found = F.size(F.array_intersect("hs", "_item")).cast("bigint")
    counted = both.select("doc_id", "t", "item_id", "n_shingles", n_found.alias("n_found"))
    return counted.filter(F.col("n_found") >= F.col("n_shingles") * threshold)


def find_inside(
    docs: DataFrame, texts: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD, miss: float = MISS, windowed: bool = False,
) -> DataFrame:
    """``doc_id, t, item_id, n_shingles, n_found``: items inside whole documents or, ``windowed``, inside one window.

    ``n_found`` is the document's or the best window's count. Rows of one id
    with unlike texts give rows with unlike ``t``. Null, empty and blank texts
    hold nothing and are found nowhere.
    """
    spark = docs.sparkSession
    every = materialise(items_of(texts, item_id, item_text, k).withColumn("v", F.xxhash64("hs")), "items")
    found = every.groupBy("c", "d", "k").agg(F.count(F.lit(1)).alias("n")).collect()  # logarithms and lengths: a few rows
    if not found:
        kinds = docs.schema[id_col].dataType.simpleString(), texts.schema[item_id].dataType.simpleString()
        return spark.createDataFrame([], "doc_id %s, t long, item_id %s, n_shingles long, n_found long" % kinds)
    # items of equal shingles are searched once, under the number of their set
    items = every.select(F.col("v").alias("item_id"), "hs", "n", "c", "d").dropDuplicates(["item_id"])
    shingles = materialise(items.select(F.explode("hs").alias("h")), "item-shingles")
    bits = filter_bits(shingles.count())
    table = bit_table(shingles, "h", bits)
    hits = materialise(solid(shared_shingles(docs, table, bits, id_col, text, sorted({r.k for r in found})), F.size("hits") > 0), "hits")
    if windowed:
        least = {c: min(r.d for r in found if r.c == c) for c in {r.c for r in found}}
        held = materialise(windows(hits, least, threshold), "windows")
        met = _by_bands(held, items.withColumn("part", F.col("c")), {c: (d, c + 2) for c, d in least.items()}, threshold, miss)
    else:
        held = materialise(
            hits.select("doc_id", "t", F.array_distinct(F.transform("hits", lambda x: x.h)).alias("hs")).distinct(), "sets"
        )
        sizes = sorted({r.d for r in found})
        parted = held.select("doc_id", "t", "hs", _log2(F.size("hs")).alias("e"), F.explode(F.array(*map(F.lit, sizes))).alias("part"))
        parted = parted.filter(F.size("hs") >= _needed({d: d for d in sizes}, threshold))
        near, far = parted.filter(F.col("e") <= F.col("part") + SPREAD), parted.filter(F.col("e") > F.col("part") + SPREAD)
        own = items.withColumn("part", F.col("d"))
        met = _by_bands(near.drop("e"), own, {d: (d, d + SPREAD) for d in sizes}, threshold, miss).union(
            _by_lookup(far.drop("e"), own, threshold)
        )
    best = met.groupBy("doc_id", "t", "item_id", "n_shingles").agg(F.max("n_found").alias("n_found"))
    named = every.select("v", F.col("item_id").alias("_name"))
    return best.join(named, F.col("item_id") == F.col("v")).select("doc_id", "t", F.col("_name").alias("item_id"), "n_shingles", "n_found")
