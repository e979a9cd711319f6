"""Exact self-join of 64-bit fingerprints within a Hamming radius.

Equal fingerprints are collapsed first: the join works on distinct values and
``copies`` maps every item to the first item with its value. A pair of distinct
values is listed once, however many copies stand behind it.

Distinct values are compared only when they agree on a band of bits: of ``m``
bands, values at distance ``t`` or less agree on at least ``m - t``, so every
combination of ``m - t`` bands is a join key. More bands give longer keys and
fewer candidates at the price of more keys per value.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank import functions as fn
from lumenrank.session import materialise

WORD = 64
KEY_COST = 32
FEW_BLOCKS = 4
MOST_IN_BLOCK = 4096


def copies(items: DataFrame, item: str = "item_id", order: str = "ord", h: str = "h") -> DataFrame:
    """``item, ord, h, rep_ord``: every item with the order of its first copy.

    The first copies come from an aggregation, so a value shared by a third of
    all items is combined map-side and joined back as one row.
    """
    reps = distinct_values(items, order, h)
    rows = items.select(F.col(item).alias("item_id"), F.col(order).alias("ord"), F.col(h).alias("h"))
    return rows.join(reps.select("h", F.col("ord").alias("rep_ord")), "h")


def distinct_values(items: DataFrame, order: str = "ord", h: str = "h") -> DataFrame:
    return items.groupBy(F.col(h).alias("h")).agg(
        F.min(order).alias("ord"), F.count(F.lit(1)).alias("n_copies")
    )


def _bands(m: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``m`` near-equal bands."""
    edges = [WORD * i // m for i in range(m + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << WORD) if mask >> (WORD - 1) else mask


def _mask(bands: list[tuple[int, int]], combo: int) -> int:
    """Bits covered by the bands in ``combo``."""
    total = 0
    for i, (lo, width) in enumerate(bands):
        if combo >> i & 1:
            total |= ((1 << width) - 1) << lo
    return _signed(total)


def _combos(m: int, t: int) -> list[int]:
    return [sum(1 << i for i in c) for c in combinations(range(m), m - t)]


def _keyed(values: DataFrame, m: int, t: int) -> DataFrame:
    """One row per (value, band combination) with the masked bits as key."""
    bands = _bands(m)
    keys = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("combo"), F.col("h").bitwiseAND(F.lit(_mask(bands, c)).cast("bigint")).alias("bits"))
                for c in _combos(m, t)
            ]
        )
    )
    return values.select("h", "ord", keys.alias("k")).select("h", "ord", "k.combo", "k.bits")


def bucket_stats(values: DataFrame, m: int, t: int) -> tuple[int, int]:
    """Pairs that share a key under ``m`` bands, and the largest key; nothing is paired."""
    sizes = _keyed(values, m, t).groupBy("combo", "bits").agg(F.count(F.lit(1)).cast("double").alias("n"))
    n = F.col("n")
    r = sizes.agg(F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0)), F.coalesce(F.max(n), F.lit(0.0))).first()
    return int(r[0]), int(r[1])


def choose_bands(values: DataFrame, t: int, per_value: int = 64, max_keys: int = 128) -> tuple[int, int]:
    """The number of bands at the least cost, with the size of its largest key.

    A key of a value is shuffled and sorted, and costs as much as
    ``KEY_COST`` candidate pairs; a ``per_value`` below that asks for few pairs
    at any price. Starts where evenly spread values have ``per_value`` pairs
    each, and goes on while there are more and the keys of another band can
    pay.
    """
    n = values.count()
    budget, per_key = per_value * n, KEY_COST * n if per_value >= KEY_COST else 0
    m = t + 1
    while comb(m, t) * n / 2 ** (WORD * (m - t) // m) > per_value and comb(m + 1, t) <= max_keys:
        m += 1
    best = None
    while best is None or comb(m, t) <= max_keys:
        pairs, largest = bucket_stats(values, m, t)
        cost = pairs + per_key * comb(m, t)
        if best is None or cost < best[0]:
            best = (cost, m, largest)
        if pairs <= budget or per_key * (comb(m + 1, t) - comb(m, t)) >= pairs:
            break
        m += 1
    return best[1], best[2]


def tiled(rows: DataFrame, key: list[str], tile: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of an equi-join that splits large keys into tiles.

    The rows of a key with more than ``tile`` rows are dealt to blocks; block
    pairs (i, j) with i <= j become join keys of their own, so no task holds
    more than two blocks of a key and every pair still meets once. A row is
    copied once per block of its key: blocks grow from ``tile`` up to
    ``MOST_IN_BLOCK`` rows before a key is cut into more than ``FEW_BLOCKS``.
    """
    size = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > tile)
    block = F.greatest(F.lit(tile), F.least(F.ceil(F.col("_n") / FEW_BLOCKS), F.lit(MOST_IN_BLOCK)))
    placed = rows.join(size.hint("merge"), key, "left").withColumn(
        "_blocks", F.coalesce(F.ceil(F.col("_n") / block), F.lit(1)).cast("int")
    )
    placed = placed.withColumn("_own", F.pmod(F.xxhash64("h"), F.col("_blocks")).cast("int"))
    left = placed.withColumn("_other", F.explode(F.sequence(F.col("_own"), F.col("_blocks") - 1)))
    left = left.withColumns({"_i": F.col("_own"), "_j": F.col("_other")})
    right = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_own"))))
    right = right.withColumns({"_i": F.col("_other"), "_j": F.col("_own")})
    drop = ["_n", "_blocks", "_own", "_other"]
    # an explicit exchange on the full key: a partitioning by the bare key
    # would satisfy the join and leave a large key in one task
    full = [*key, "_i", "_j"]
    return left.drop(*drop).repartition(*full), right.drop(*drop).repartition(*full)


def _first_agreeing(diff: Column, bands: list[tuple[int, int]], combo: Column) -> Column:
    """True when ``combo`` holds the lowest agreeing bands of a pair, which
    makes one of the several keys a pair may share the one that reports it."""
    agree = F.lit(0)
    for i, _ in enumerate(bands):
        differs = diff.bitwiseAND(F.lit(_mask(bands, 1 << i)).cast("bigint")) != 0
        agree = agree + F.when(differs, F.lit(0)).otherwise(F.lit(1 << i))
    # all bits up to the highest one of the combination
    below = F.lit(0)
    for i, _ in enumerate(bands):
        below = F.when(combo >= (1 << i), F.lit((1 << (i + 1)) - 1)).otherwise(below)
    return agree.bitwiseAND(below) == combo


def hamming_pairs(
    items: DataFrame, threshold: int, order: str = "ord", h: str = "h", bands: int | None = None, tile: int = 4096
) -> DataFrame:
    """Pairs of distinct values within ``threshold`` bits: ``ord_a < ord_b, distance``.

    ``ord`` is the order of the first item with the value.
    """
    return value_pairs(materialise(distinct_values(items, order, h), "values"), threshold, bands, tile)


def value_pairs(values: DataFrame, threshold: int, bands: int | None = None, tile: int = 4096) -> DataFrame:
    """:func:`hamming_pairs` on a table of distinct values ``h, ord``."""
    if threshold < 1:
        empty = values.filter(F.lit(False))
        return empty.select(
            F.col("ord").alias("ord_a"), F.col("ord").alias("ord_b"), F.lit(0).cast("int").alias("distance")
        )
    if bands:
        m, largest = bands, bucket_stats(values, bands, threshold)[1]
    else:
        m, largest = choose_bands(values, threshold)
    keyed = _keyed(values, m, threshold)
    on = ["combo", "bits"]
    ahead = F.col("o_a") < F.col("o_b")
    if largest > tile:
        left, right = tiled(keyed, on, tile)
        on = [*on, "_i", "_j"]
        ahead = (F.col("_i") != F.col("_j")) | ahead
    else:
        left = right = keyed
    a = left.select(*on, F.col("h").alias("h_a"), F.col("ord").alias("o_a"))
    b = right.select(*on, F.col("h").alias("h_b"), F.col("ord").alias("o_b"))
    distance = fn.hamming(F.col("h_a"), F.col("h_b"))
    diff = F.col("h_a").bitwiseXOR(F.col("h_b"))
    # no broadcast: the planner sizes a keyed side by its values, without the rows that the keys add
    return (
        a.hint("merge").join(b.hint("merge"), on)
        .filter(ahead)
        .filter(distance <= threshold)
        .filter(_first_agreeing(diff, _bands(m), F.col("combo")))
        .select(
            F.least("o_a", "o_b").alias("ord_a"),
            F.greatest("o_a", "o_b").alias("ord_b"),
            distance.cast("int").alias("distance"),
        )
    )
