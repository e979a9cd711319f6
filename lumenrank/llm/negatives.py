"""Operator 12, hard negatives by Four-Russians scoring.

Components become integers, ``floor(scale * c)``, in as many bits as the table
needs. A row is indexed by its bit planes: for each bit one byte per group of
eight dimensions. For an anchor the 256 sums over the subsets of a group's
components are tabulated once; a row's exact inner product is then lookups of
its bytes, planes shifted and added, the sign plane subtracted.

Anchors and rows meet in cells of at most some ``GROUP`` anchors and
``SLICE`` rows, dealt by a hash of the row, so a label with a third of all
rows is many cells and no task holds more than a cell. Two passes:

1. cells of one label each give every anchor's best rows there; the best over
   all cells are its positives;
2. cells of all rows give, for every anchor and positive, the best rows with
   another label whose score is within the bounds; the best over all cells
   are its negatives.

Every anchor meets every row once in each role; only each cell's best go on.
Nothing but the greatest and smallest component and the counts of rows reaches
the driver.

Defined results: a row takes no part if its label or vector is null or the
vector holds a null or an entry that is not finite. Shorter vectors count as
padded with zeros; without any component all scores are 0. Repeated rows are
rows of their own: a copy of an anchor is one of its positives, and an anchor
that is there twice gives its rows twice. A row without id is no anchor and
comes after the others among equal scores. Rows with equal score and id come
in the order of their label and bits. Too few rows of a label, or none within
the bounds, give fewer rows. Components so large that a score leaves the range
of a long are refused with an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenrank.llm.registry import embeddings, query
from lumenrank.llm.whitening import _matrix, usable
from lumenrank.session import materialise

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # per cent of the positive's score
GROUP = 4096  # anchors of a cell
SLICE = 4096  # rows of a cell
_BLOCK = 256  # anchors and rows scored at once, so that tables and sums stay in the processor's cache


def packed_rows(rows: DataFrame, scale: int) -> tuple[DataFrame, int, int]:
    """``row, id, label, anchor, planes`` written once, the bits per component and the groups of eight dimensions."""
    import pyarrow as pa

    whole = rows.withColumn("v", F.transform("v", lambda c: F.floor(c.cast("double") * scale).cast("long")))
    most = whole.agg(F.max(F.size("v")), F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    width, top, low = (x or 0 for x in most)
    bits = max(top, -low - 1, 1).bit_length() + 1
    if max(1, width) * max(top, -low) ** 2 * 100 >= 2**63:
        raise ValueError(f"components from {low} to {top} give scores beyond a long")
    groups = -(-width // 8)

    def pack(batches):
        import numpy as np

        for batch in batches:
            v = np.zeros((batch.num_rows, 8 * groups), np.int64)
            v[:, :width] = _matrix(batch.column(3), width)
            planes = np.concatenate(
                [np.packbits((v >> p & 1).astype(np.uint8), axis=1, bitorder="little") for p in range(bits)], axis=1
            )
            size = bits * groups
            data = planes.tobytes()
            packed = pa.array([data[at : at + size] for at in range(0, size * len(v), size)] if size else [b""] * len(v), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], names=["id", "label", "anchor", "planes"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"id {kinds['id']}, label {kinds['label']}, anchor boolean, planes binary"
    packed = whole.select("id", "label", "anchor", "v").mapInArrow(pack, schema)
    return materialise(packed.select(F.monotonically_increasing_id().alias("row"), "*"), "planes"), bits, groups


def cells(packed: DataFrame, anchors: DataFrame, keys: list[str], group: int, slice_: int):
    """Rows and anchors with the cell they meet in: ``keys``, a group of anchors and a slice of rows."""
    counts = [F.count(F.lit(1)).alias("_n"), F.count_if("anchor").alias("_m")]
    parts_of = [F.ceil(F.col("_n") / slice_).alias("_slices"), F.ceil(F.col("_m") / group).alias("_groups")]
    if keys:
        sizes = packed.groupBy(*keys).agg(*counts).filter("_m > 0").select(*keys, *parts_of)
    else:
        one = packed.agg(*counts).select(*parts_of).first()

    def sized(df: DataFrame) -> DataFrame:
        if keys:
            return df.join(sizes, keys)
        return df.withColumns({"_slices": F.lit(max(1, one[0])), "_groups": F.lit(max(1, one[1]))})

    def dealt(parts: str) -> Column:
        return F.pmod(F.xxhash64("row"), F.col(parts)).cast("int")

    def all_of(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), (F.col(parts) - 1).cast("int")))

    left = sized(packed).withColumn("_s", dealt("_slices")).withColumn("_g", all_of("_groups"))
    right = sized(anchors).withColumn("_g", dealt("_groups")).withColumn("_s", all_of("_slices"))
    left, right = left.drop("_slices", "_groups"), right.drop("_slices", "_groups")
    return left, right.toDF(*right.columns)  # columns of its own


def planes_of(column, bits: int, groups: int):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), bits, groups)


def values_of(planes):
    """The components of rows from their bit planes."""
    import numpy as np

    n, bits, groups = planes.shape
    unpacked = np.unpackbits(planes, axis=2, bitorder="little").astype(np.int64)
    weights = np.array([1 << p for p in range(bits - 1)] + [-(1 << (bits - 1))], np.int64)
    return (unpacked * weights[None, :, None]).sum(axis=1).reshape(n, 8 * groups)


def subset_sums(values, kind):
    """Tables (group, subset, anchor): sums of a group's components over each subset of its eight."""
    import numpy as np

    n, width = values.shape
    tables = np.zeros((width // 8, 256, n), kind)
    for g in range(width // 8):
        for k in range(8):
            tables[g, 1 << k : 2 << k] = tables[g, : 1 << k] + values[:, 8 * g + k].astype(kind)
    return tables


def scores(planes, tables):
    """Exact inner products (row, anchor) by lookups, shifts and additions."""
    import numpy as np

    n, bits, groups = planes.shape
    out = np.zeros((n, tables.shape[2]), tables.dtype)
    for at in range(0, n, _BLOCK):
        own = planes[at : at + _BLOCK]
        total, found = out[at : at + _BLOCK], np.empty((len(own), tables.shape[2]), tables.dtype)
        for p in range(bits - 1, -1, -1):
            for g in range(groups):
                np.take(tables[g], own[:, p, g], axis=0, out=found, mode="clip")
                total += found
            if p == bits - 1:
                np.negative(total, out=total)
            if p:
                np.left_shift(total, 1, out=total)
    return out


def _ordered(table):
    """The rows of a cell by id, then label and bits; rows without id last."""
    import pyarrow.compute as pc

    order = pc.sort_indices(
        table, sort_keys=[("id", "ascending"), ("label", "ascending"), ("planes", "ascending")], null_placement="at_end"
    )
    return table.take(order)


def _scored(rows, anchors, bits: int, groups: int):
    """(first anchor, scores (anchor, row)) for blocks of the anchors of a cell."""
    import numpy as np

    planes, values = planes_of(rows["planes"], bits, groups), values_of(planes_of(anchors["planes"], bits, groups))
    kind = np.int32 if 8 * groups << (2 * bits) < 2**31 else np.int64
    for at in range(0, len(values), _BLOCK):
        yield at, np.ascontiguousarray(scores(planes, subset_sums(values[at : at + _BLOCK], kind)).T)


def _best(points, n: int):
    """Places of the ``n`` greatest of each row of ``points``, equal ones in their order, greatest first."""
    import numpy as np

    m = points.shape[1]
    keys = points.astype(np.int64)
    if n < m:
        cut = np.partition(keys, m - n, axis=1)[:, m - n]
    else:
        cut = keys.min(axis=1)
    who, where = np.nonzero(keys >= cut[:, None])
    order = np.lexsort((where, -keys[who, where], who))
    who, where = who[order], where[order]
    first = np.searchsorted(who, np.arange(len(points)))
    keep = np.arange(len(who)) - first[who] < n
    return who[keep], where[keep]


def find_positives(packed: DataFrame, bits: int, groups: int, n: int = POSITIVES, group: int = GROUP, slice_: int = SLICE) -> DataFrame:
    """The best rows of each anchor's label but itself: ``row, rank, positive, score``."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(packed.schema["id"].dataType)
    id_kind = packed.schema["id"].dataType.simpleString()
    empty = pa.schema([("row", pa.int64()), ("other", pa.int64()), ("positive", id_type), ("score", pa.int64()), ("planes", pa.binary())]).empty_table()

    def meet(rows, anchors):
        import numpy as np

        parts = []
        if rows.num_rows and anchors.num_rows:
            rows = _ordered(rows)
            places, owners = rows["row"].to_numpy(), anchors["row"].to_numpy()
            for at, points in _scored(rows, anchors, bits, groups):
                points = points.astype(np.int64)
                points[places[None, :] == owners[at : at + len(points), None]] = np.iinfo(np.int64).min + 1
                who, where = _best(points, n)
                keep = places[where] != owners[at + who]
                who, where = who[keep], where[keep]
                parts.append(
                    pa.table(
                        {
                            "row": anchors["row"].take(pa.array(at + who)), "other": rows["row"].take(pa.array(where)),
                            "positive": rows["id"].take(pa.array(where)), "score": pa.array(points[who, where]),
                            "planes": rows["planes"].take(pa.array(where)),
                        }
                    )
                )
        return pa.concat_tables(parts) if parts else empty

    anchors = packed.filter("anchor").select("row", "label", "planes")
    left, right = cells(packed, anchors, ["label"], group, slice_)
    keys = ["label", "_g", "_s"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        meet, f"row long, other long, positive {id_kind}, score long, planes binary"
    )
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("positive"), "planes", "other")
    ranked = met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)
    return ranked.select("row", "rank", "positive", "score")


def find_negatives(
    packed: DataFrame, positives: DataFrame, bits: int, groups: int, n: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    group: int = GROUP, slice_: int = SLICE,
) -> DataFrame:
    """The best rows of other labels within the bounds of each anchor and positive."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(packed.schema["id"].dataType)
    id_kind = packed.schema["id"].dataType.simpleString()
    empty = pa.schema([("row", pa.int64()), ("place", pa.int32()), ("other", pa.int64()), ("negative", id_type), ("negative_score", pa.int64())]).empty_table()

    def meet(rows, anchors):
        import numpy as np

        if not (rows.num_rows and anchors.num_rows):
            return empty
        rows, parts = _ordered(rows), []
        codes = pa.chunked_array([*rows["label"].chunks, *anchors["label"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
        labels, own = codes[: rows.num_rows], codes[rows.num_rows :]
        wanted = anchors["scores"].to_pylist()
        for at, points in _scored(rows, anchors, bits, groups):
            m = len(points)
            bounds = [[(-(-low * s // 100), high * s // 100) for s in wanted[at + k]] for k in range(m)]
            least = np.array([min(a for a, _ in b) for b in bounds], np.int64)
            most = np.array([max(z for _, z in b) for b in bounds], np.int64)
            fits = (points >= least[:, None]) & (points <= most[:, None]) & (labels[None, :] != own[at : at + m, None])
            who, where = np.nonzero(fits)
            values = points[who, where].astype(np.int64)
            order = np.lexsort((where, -values, who))
            who, where, values = who[order], where[order], -values[order]  # falling scores, negated for the search
            starts = np.searchsorted(who, np.arange(m + 1))
            picks, places, anchors_at = [], [], []
            for k in range(m):
                mine = values[starts[k] : starts[k + 1]]
                for place, (a, z) in enumerate(bounds[k]):
                    first = int(np.searchsorted(mine, -z))
                    last = min(int(np.searchsorted(mine, -a, side="right")), first + n)
                    picks += range(starts[k] + first, starts[k] + last)
                    places += [place] * max(0, last - first)
                    anchors_at += [at + k] * max(0, last - first)
            picks = np.array(picks, np.int64)
            parts.append(
                pa.table(
                    {
                        "row": anchors["row"].take(pa.array(anchors_at, pa.int64())), "place": pa.array(places, pa.int32()),
                        "other": rows["row"].take(pa.array(where[picks])), "negative": rows["id"].take(pa.array(where[picks])),
                        "negative_score": pa.array(-values[picks]),
                    }
                )
            )
        return pa.concat_tables(parts)

    lists = positives.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "positive", "score"))).alias("found"))
    anchors = packed.filter("anchor").join(lists, "row").select("row", "label", "planes", F.col("found.score").alias("scores"))
    left, right = cells(packed, anchors, [], group, slice_)
    met = left.groupBy("_g", "_s").cogroup(right.groupBy("_g", "_s")).applyInArrow(
        meet, f"row long, place int, other long, negative {id_kind}, negative_score long"
    )
    best = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative"), "other")
    ranked = met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n).drop("other")
    found = F.col("found")[F.col("place")]
    return ranked.join(lists, "row").select(
        "row", found["positive"].alias("positive"), "rank", "negative", found["score"].alias("positive_score"), "negative_score"
    )


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = SCALE,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, group: int = GROUP, slice_: int = SLICE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``is_anchor`` holds."""
    rows = vectors.filter(F.col(label).isNotNull() & usable(F.col(vector))).select(
        F.col(id_col).alias("id"), F.col(label).alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vector).alias("v")
    )
    packed, bits, groups = packed_rows(rows, scale)
    best = materialise(find_positives(packed, bits, groups, positives, group, slice_), "positives")
    found = find_negatives(packed, best, bits, groups, negatives, low, high, group, slice_)
    ids = packed.filter("anchor").select("row", F.col("id").alias("anchor_id"))
    return found.join(ids, "row").select(
        "anchor_id", F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("negative").alias("negative_id"), "positive_score", "negative_score",
    )


@query()
def op12_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = embeddings(spark, sf_dir)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)
