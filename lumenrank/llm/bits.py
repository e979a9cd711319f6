"""Bit filters: a table of bits that tells most hashes outside a set from those inside, and never loses one.

The table has 16 bits for every hash it holds, between 2^16 and 2^26 bits (8
MB). Beyond four million hashes more and more others pass; what passes is
joined to the set itself afterwards, so the result never depends on the size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 16, 26
_PER_HASH = 16
_STEP = 19  # three probes of 26 bits are spread over a hash of 64
_WORD, _BLOCK = 6, 10


def filter_bits(n: int) -> int:
    """Binary logarithm of the bits for ``n`` hashes."""
    return min(max((_PER_HASH * max(n, 1) - 1).bit_length(), LEAST_BITS), MOST_BITS)


def _probes(h: Column, bits: int) -> list[Column]:
    """Three places in the bit table, from different bits of a hash."""
    return [F.shiftrightunsigned(h, _STEP * j).bitwiseAND(F.lit((1 << bits) - 1)) for j in range(3)]


def bit_table(hashes: DataFrame, h: str, bits: int) -> Column:
    """The filter as one value (a scalar subquery): blocks of 2^10 words of 2^6 bits."""
    spark = hashes.sparkSession
    places = hashes.select(F.explode(F.array(*_probes(F.col(h), bits))).alias("_p"))
    words = places.groupBy(F.shiftright("_p", _WORD).alias("id")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST(_p & {(1 << _WORD) - 1} AS INT))")).alias("_b")
    )
    every = spark.range(1 << (bits - _WORD)).join(words, "id", "left").select("id", F.coalesce("_b", F.lit(0).cast("bigint")).alias("b"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("id", "b"))), lambda w: w.b).alias("b")
    blocks = every.groupBy(F.shiftright("id", _BLOCK).alias("_k")).agg(in_order).select(F.col("_k").alias("id"), "b")
    return blocks.agg(in_order).scalar()  # 2^10 blocks at most, so one task


def in_table(table: Column, h: Column, bits: int) -> Column:
    def word(p: Column) -> Column:
        block = F.get(table, F.shiftright(p, _WORD + _BLOCK).cast("int"))
        return F.get(block, F.shiftright(p, _WORD).bitwiseAND(F.lit((1 << _BLOCK) - 1)).cast("int"))

    tests = [F.getbit(word(p), p.bitwiseAND(F.lit((1 << _WORD) - 1)).cast("int")) == 1 for p in _probes(h, bits)]
    return reduce(lambda a, b: a & b, tests)


def passing(rows: DataFrame, written: DataFrame, h: str) -> DataFrame:
    """The rows whose hash ``h`` may be among those of ``written``, a table on shared storage."""
    bits = filter_bits(written.count())
    table = bit_table(written, h, bits)
    return rows.withColumn("_table", table).filter(in_table(F.col("_table"), F.col(h), bits)).drop("_table")
