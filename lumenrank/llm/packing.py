"""Operator 6, best-fit packing by minimum bin slack.

1. Texts become token ids plus an end id. A document longer than the
   capacity is cut into pieces of the capacity, the last may be shorter. The
   piece table (ids, places, lengths, checksums, no text) is written once.
2. Pieces of one length are interchangeable, so the bins are planned on the
   histogram of lengths, which has ``capacity`` rows at most at any size of
   the corpus. A bin is the fullest feasible combination of the remaining
   lengths, found by a bitset over subset sums; it is taken as often as its
   lengths last, so a plan step uses up a length and the number of steps
   follows the number of lengths, not of pieces.
3. Every piece gets its number among the pieces of its length, from counts
   per (slice of the table, length), and the plan's ranges turn the number
   into a sequence and an offset.

Only the histogram and the plan (bounded by the capacity) pass the driver.

Defined results: a null or empty text is one piece holding the end id alone.
Rows with the same id are packed independently; an empty table gives an empty
result. Other columns of ``docs`` are not read.
"""

from __future__ import annotations

import bisect
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenrank.llm.registry import documents, query
from lumenrank.llm.tokens import batches, default_vocabulary, piece_ids
from lumenrank.session import materialise

CAPACITY = 2048
END_ID = 0
_SLICE_BITS = 33  # monotonically_increasing_id keeps the row index in the low bits


def token_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = docs.schema[id_col].dataType
    schema = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long"
    empty = docs.sparkSession.createDataFrame([], schema)
    arrow_schema = to_arrow_schema(empty.schema)

    def cut(table):
        import zlib

        encoder, end, width = piece_ids(vocabulary), int(end_id).to_bytes(4, "little"), 4 * capacity
        for batch in table:
            ids, texts = batch.column(0), batch.column(1)
            rows, number, start, length, crc = [], [], [], [], []
            for lo, hi in batches(texts):
                flat, borders = encoder.encode(texts.slice(lo, hi - lo))
                for row in range(lo, hi):
                    codes = flat[borders[row - lo] : borders[row - lo + 1]].tobytes() + end
                    for k, at in enumerate(range(0, len(codes), width)):
                        own = codes[at : at + width]
                        rows.append(row)
                        number.append(k)
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ],
                schema=arrow_schema,
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


class Step(NamedTuple):
    """``bins`` equal bins from number ``first``; ``parts`` are (length, pieces per bin)."""

    first: int
    bins: int
    parts: tuple[tuple[int, int], ...]


def _layers(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int, int]]:
    """(length, copies, sums reachable before it) with copies in binary portions, for subset sums up to ``room``."""
    mask, sums, layers = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        left, portion = min(counts[length], room // length), 1
        while left:
            used = min(portion, left)
            layers.append((length, used, sums))
            sums |= (sums << (length * used)) & mask
            left -= used
            portion *= 2
            if sums >> room & 1:
                break
        if sums >> room & 1:
            break
    layers.append((0, 0, sums))
    return layers


def fullest(counts: dict[int, int], lengths: list[int], capacity: int) -> dict[int, int]:
    """The fullest bin holding the longest remaining length: length -> copies.

    Fixing the longest length costs nothing in the number of bins, since it
    must go somewhere, and leaves the short lengths that fill gaps. Shorter
    lengths are offered in falling order until a combination closes the bin.
    """
    longest = lengths[0]
    chosen = {longest: 1}
    room = capacity - longest
    if room:
        rest = {**counts, longest: counts[longest] - 1}
        layers = _layers(rest, [x for x in lengths if x <= room and rest[x]], room)
        best = layers[-1][2].bit_length() - 1
        for length, copies, before in reversed(layers[:-1]):
            if best and not before >> best & 1:
                chosen[length] = chosen.get(length, 0) + copies
                best -= length * copies
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Step]:
    """Minimum bin slack over a histogram of lengths."""
    counts = {int(k): int(v) for k, v in histogram.items() if v}
    lengths = sorted(counts, reverse=True)
    steps, first = [], 0
    while lengths:
        bin_ = fullest(counts, lengths, capacity)
        bins = min(counts[x] // m for x, m in bin_.items())
        steps.append(Step(first, bins, tuple(bin_.items())))
        first += bins
        for x, m in bin_.items():
            counts[x] -= m * bins
        lengths = [x for x in lengths if counts[x]]
    return steps


def ranges(steps: list[Step]) -> dict[int, tuple[list[int], list[tuple[int, int, int]]]]:
    """Per length: starts of its number ranges, and (first sequence, pieces per bin, offset in the bin) of each."""
    table: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {}
    used: dict[int, int] = {}
    for step in steps:
        offset = 0
        for length, per_bin in step.parts:
            starts, places = table.setdefault(length, ([], []))
            starts.append(used.get(length, 0))
            places.append((step.first, per_bin, offset))
            used[length] = used.get(length, 0) + per_bin * step.bins
            offset += length * per_bin
    return table


def number_by_length(pieces: DataFrame) -> DataFrame:
    """``_nth``, the zero-based number of a piece among those of its length.

    Slices of the written table are numbered on their own, so pieces of one
    length never meet in one task; their counts supply the offsets.
    """
    sliced = pieces.withColumn("_slice", F.shiftright("_row", _SLICE_BITS))
    counts = sliced.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_slice", "length").orderBy("_row"))
    return (
        sliced.withColumn("_in", inside.cast("long") - 1)
        .join(offsets, ["_slice", "length"])
        .withColumn("_nth", F.col("_in") + F.col("_before"))
    )


def pack(
    docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
    id_col: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; sequences hold at most ``capacity`` tokens, gapless."""
    import pyarrow as pa

    cut = token_pieces(docs, vocabulary or default_vocabulary(), capacity, end_id, id_col, text)
    pieces = materialise(cut.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # <= capacity rows
    table = ranges(plan(histogram, capacity))

    def place(batches_):
        for batch in batches_:
            lengths, nth = batch.column(3).to_pylist(), batch.column(5).to_pylist()
            sequence, offset = [], []
            for length, n in zip(lengths, nth):
                starts, places = table[length]
                k = bisect.bisect_right(starts, n) - 1
                first, per_bin, at = places[k]
                bin_, slot = divmod(n - starts[k], per_bin)
                sequence.append(first + bin_)
                offset.append(at + slot * length)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    out = f"doc_id {cut.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    numbered = number_by_length(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "_nth")
    return numbered.mapInArrow(place, out)


@query()
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
