"""Operator 10, SimHash near-duplicates by pigeonhole blocks.

1. Texts become 64-bit fingerprints in Arrow batches; only ids and
   fingerprints go on. Equal fingerprints are one node from here.
2. Of seven bit blocks, two fingerprints with four differing bits or fewer
   agree on three at least, so each of the 35 block triples is a join key of
   27 bits or more. A larger ``blocks`` lengthens the keys of a larger table.
3. A dense group of near copies would give a quadratic number of pairs, so
   its members are first chained: sorted by (key, fingerprint), every row
   links to the nearest of its predecessors that is close enough. The sort is
   by range, so a hot key is spread over many tasks.
4. Only keys that still hold more than one component are joined, and there
   only rows outside the key's largest component against the others; this
   finds every link that the chains have missed. Components are complete.

Defined results: null, empty and blank texts have fingerprint zero, which
links like any other. Rows with the same id are judged by their own texts; a
component whose ids are all null has a null id. An empty table gives an empty
result. Other columns of ``docs`` are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.llm.components import components, with_labels
from lumenrank.llm.registry import documents, query
from lumenrank.session import materialise, shuffle_partitions

WORD_BITS = 64
SHINGLE = 4
SEED = 42
RADIUS = 4
BLOCKS = 7
LOOK_BACK = 8  # predecessors tried for a chain link; only the amount of later work depends on it


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles of a text, A-Z in lower case, as an unsigned number."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(len(words) - shingle + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    last = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    counts = np.zeros(WORD_BITS, np.int64)
    for lo in range(0, n, 1 << 15):
        hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(first[lo : lo + (1 << 15)], last[lo : lo + (1 << 15)])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * counts > n)))


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED
) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every row as a signed 64-bit number."""
    import pyarrow as pa

    def run(table):
        import numpy as np

        for batch in table:
            texts = batch.column(1).cast(pa.large_binary())
            values = np.array([fingerprint(t.as_py() or b"", shingle, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def block_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Bit masks, as signed numbers, such that a close pair agrees on all bits of one at least."""
    edges = [WORD_BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - radius)]
    return [m - (1 << WORD_BITS) if m >> (WORD_BITS - 1) else m for m in masks]


def block_keys(values: DataFrame, blocks: int = BLOCKS, radius: int = RADIUS) -> DataFrame:
    """``k, key`` and the columns of ``values``: one row per fingerprint ``fp`` and mask."""
    keys = [
        F.struct(F.lit(i).cast("short").alias("k"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("key"))
        for i, m in enumerate(block_masks(blocks, radius))
    ]
    return values.select(F.explode(F.array(*keys)).alias("_b"), "*").select("_b.k", "_b.key", *values.columns)


def _near(a: Column, b: Column, radius: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def chain_links(keyed: DataFrame, radius: int = RADIUS, look_back: int = LOOK_BACK) -> DataFrame:
    """``a, b``: each row with the nearest preceding row of its key that is within the radius."""
    import pyarrow as pa

    def run(table):
        import numpy as np

        held = None
        for batch in table:
            rows = [np.asarray(batch.column(i)) for i in range(3)]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            known = 0 if held is None else len(held[0])
            k, key, fp = rows
            open_ = np.ones(len(fp), bool)
            open_[:known] = False
            for d in range(1, min(look_back, len(fp) - 1) + 1):
                close = (k[d:] == k[:-d]) & (key[d:] == key[:-d]) & (np.bitwise_count((fp[d:] ^ fp[:-d]).view(np.uint64)) <= radius)
                hit = np.flatnonzero(close & open_[d:]) + d
                open_[hit] = False
                yield pa.RecordBatch.from_arrays([pa.array(fp[hit - d]), pa.array(fp[hit])], names=["a", "b"])
            held = [x[-look_back:] for x in rows]

    parts = shuffle_partitions(keyed.sparkSession)
    ranged = keyed.select("k", "key", "fp").repartitionByRange(parts, "k", "key", "fp").sortWithinPartitions("k", "key", "fp")
    return ranged.mapInArrow(run, "a long, b long").distinct()


def cross_links(keyed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: labels linked by a close pair with different ``label`` under one key.

    Under each key the most frequent label is left out on one side, so the
    work is (rows outside the largest component) x (rows of the key).
    """
    keys = ["k", "key"]
    mixed = keyed.groupBy(*keys).agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo < _hi")
    rows = materialise(keyed.join(mixed.select(*keys), keys, "left_semi"), "mixed")
    sizes = rows.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_n"))
    main = sizes.groupBy(*keys).agg(F.max_by("label", F.struct("_n", "label")).alias("_main"))
    placed = rows.join(main, keys)
    left = placed.filter(F.col("label") != F.col("_main")).select(*keys, F.col("fp").alias("fa"), F.col("label").alias("a"))
    right = placed.select(*keys, F.col("fp").alias("fb"), F.col("label").alias("b"), (F.col("label") == F.col("_main")).alias("_is_main"))
    return (
        left.join(right, keys)
        .filter((F.col("a") != F.col("b")) & (F.col("_is_main") | (F.col("fa") < F.col("fb"))))
        .filter(_near(F.col("fa"), F.col("fb"), radius))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def fingerprint_components(values: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``fp, component``: every distinct fingerprint with a representative of its component."""
    chained = components(chain_links(block_keys(values.select("fp"), blocks, radius), radius), "chains")
    first = with_labels(values.select("fp"), "fp", chained, "label")
    merged = components(cross_links(block_keys(first, blocks, radius), radius), "merged")
    return with_labels(first, "label", merged, "component").select("fp", "component")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, blocks: int = BLOCKS,
    shingle: int = SHINGLE,
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row; the component is named by its smallest id."""
    marked = materialise(fingerprints(docs, id_col, text, shingle), "fingerprints")
    values = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("_first")), "values")
    placed = materialise(values.join(fingerprint_components(values, radius, blocks), "fp"), "placed")
    names = placed.groupBy("component").agg(F.min("_first").alias("component_id"))
    named = placed.join(names, "component").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, the one with the smallest id; rows without an id stay.

    Rows of one id are told apart by their texts, so unlike ones are judged
    each by its own; of rows with the same id and text one stays.
    """
    own = F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("t")))
    found = near_duplicates(docs.select(own.alias("key"), F.col(text).alias("body")), "key", "body")
    keep = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_key"))
    held = docs.select(own.alias("_key"), F.struct("*").alias("row"))
    first = held.join(keep, "_key", "left_semi").groupBy("_key").agg(F.first("row").alias("row"))
    return first.select("row").union(held.filter(F.col("_key").isNull()).select("row")).select("row.*")


@query()
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
