"""Operator 7, line dedup by a segment-partition edit join.

Two lines of ``min_chars`` characters or more are alike when their edit
distance is ``tau`` or less; classes are the connected groups of alike lines.
Of each class the first occurrence, by (document, line number), stays and the
others are removed from their documents. Shorter lines of ``exact_chars``
characters or more are classes of equal lines only: so few characters make
two edits too many. Lines below that are never touched.

1. A line is cut into tau + 1 even segments. A line within ``tau`` edits, at
   most ``tau`` characters longer, holds one of them unchanged near its place,
   so every line is entered in the index under its own segments and looks up
   the few substrings that can match lines of each length (the length is part
   of the key). Only hashes are shuffled, never texts.
2. Keys of a single line, nearly all, fall away in one aggregation. Further
   scans ship only rows that pass a bit filter sized for what is left.
3. Dense groups don't become all their pairs: first every line is compared to
   one line of its key, then only keys that still hold several classes are
   joined, rows outside the key's largest class against the others.
4. Pairs whose letter counts differ in more parities than ``tau`` edits can
   change are passed over. The others are verified by the edit distance in a diagonal band of 2 tau + 1
   cells, one bit each, moved along the line with a few word operations per
   character.

All is built-in functions. Lines are identified by 63-bit hashes.

Defined results: a null text stays null, an empty one empty; a text all of
whose lines are removed becomes empty. Identical rows (same id and text) are
one document and treated alike; rows of one id with unlike texts are distinct.
Nulls come first in the order of ids. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.llm.components import components, with_labels
from lumenrank.llm.bits import passing
from lumenrank.llm.registry import documents, query
from lumenrank.llm.text import let
from lumenrank.session import materialise

MIN_CHARS = 50
EXACT_CHARS = 20
TAU = 2
PARITY_LETTERS = "abcdefghijklmnopqrstuvwxyz ,.0"


def line_rows(docs: DataFrame, id_col: str, text: str, min_chars: int) -> DataFrame:
    """``doc_id, t, n, line, id``: the lines long enough, with a hash of the text and of the line."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("t"), F.posexplode_outer(F.split(text, "\n", -1)).alias("n", "line")
    )
    long_lines = rows.filter(F.length("line") >= min_chars)
    return long_lines.withColumn("id", F.shiftrightunsigned(F.xxhash64("line"), 1))


def _measured(lines: DataFrame, tau: int) -> DataFrame:
    """What all keys of a line share: its bytes, its length, and how segments of lines ``d`` characters shorter are cut.

    Cuts are even, the longer segments last: ``size{d}`` characters, one more from segment ``short{d}`` on.
    """
    length = F.length("line")
    sizes = [F.floor((length - d) / (tau + 1)).cast("int").alias(f"size{d}") for d in range(tau + 1)]
    shorts = [(F.lit(tau + 1) - (length - d) % (tau + 1)).alias(f"short{d}") for d in range(tau + 1)]
    ascii_only = (F.octet_length("line") == length).alias("ascii")
    return lines.select("id", "line", F.col("line").cast("binary").alias("raw"), length.alias("length"), ascii_only, *sizes, *shorts)


def segment_keys(tau: int) -> Column:
    """All keys of a line as longs: a hash of 63 bits, and whether it is of an own segment or of a substring that could be one of others.

    For a line ``d`` characters shorter and its segment ``i``, the matching
    substring starts within ``i`` edits from the left and ``tau - i`` from
    the right. Lines of ASCII characters are cut as bytes, without counting
    characters from the start; the bytes and so the hashes are the same.
    """
    keys = []
    for d in range(tau + 1):
        short = F.col(f"short{d}")
        for i in range(tau + 1):
            size = F.col(f"size{d}") + (F.lit(i) >= short).cast("int")
            start = F.col(f"size{d}") * i + F.greatest(F.lit(i) - short, F.lit(0))
            for shift in range(max(-i, d - (tau - i)), min(i, d + (tau - i)) + 1):
                at = start + (shift + 1)
                piece = F.when(F.col("ascii"), F.substr("raw", at, size)).otherwise(F.substr("line", at, size).cast("binary"))
                own = F.lit(int(d == 0 and shift == 0)).cast("bigint")
                keys.append(F.shiftleft(F.xxhash64(F.col("length") - d, F.lit(i), piece), 1).bitwiseOR(own))
    return F.array(*keys)


def keyed_lines(lines: DataFrame, tau: int) -> DataFrame:
    """``key, id, own`` of every line and key, written once as two numbers each."""
    packed = materialise(_measured(lines, tau).select("id", F.explode(segment_keys(tau)).alias("k")), "line-keys")
    return packed.select(F.shiftright("k", 1).alias("key"), "id", F.col("k").bitwiseAND(F.lit(1)).alias("own"))


def letter_parity(line: Column) -> Column:
    """Which of 30 frequent characters occur an odd number of times; one edit changes two of these bits at most."""
    bits = [
        (F.length(line) - F.length(F.replace(line, F.lit(c)))).bitwiseAND(F.lit(1)).cast("bigint") * (1 << i)
        for i, c in enumerate(PARITY_LETTERS)
    ]
    return reduce(lambda a, b: a + b, bits)


def _may_match(a: Column, b: Column, tau: int) -> Column:
    """False only for lines more than ``tau`` edits apart."""
    return F.bit_count(a.bitwiseXOR(b)) <= 2 * tau


def edit_distance(a: Column, b: Column, tau: int) -> Column:
    """Edit distance of two strings if it is ``tau`` or less, else a larger number; ``tau`` is 31 at most.

    Bit ``k`` of a word stands for the cell in row ``column - tau + k``.
    """
    width, ones = 2 * tau + 1, (1 << (2 * tau + 1)) - 1

    def chars(s: Column) -> Column:
        return F.filter(F.split(s, ""), lambda c: c != "")

    def run(x: Column) -> Column:
        gap = F.size(x.a) - F.size(x.b)
        cell = F.lit(tau) + gap  # the diagonal that ends in the last cell

        def column(acc: Column, j: Column) -> Column:
            here = F.get(x.b, j)
            same = reduce(
                lambda m, k: m + F.when(F.get(x.a, j + (k - tau)) == here, F.lit(1 << k)).otherwise(F.lit(0)),
                range(width), F.lit(0).cast("bigint"),
            )
            return F.when(acc.d > tau, acc).otherwise(
                let(
                    same,
                    lambda eq: let(
                        (eq.bitwiseAND(acc.vp) + acc.vp).bitwiseXOR(acc.vp).bitwiseOR(eq).bitwiseOR(acc.vn).bitwiseAND(F.lit(ones)),
                        lambda zero: let(
                            F.struct(
                                acc.vn.bitwiseOR(F.bitwise_not(zero.bitwiseOR(acc.vp)).bitwiseAND(F.lit(ones))).alias("hp"),
                                zero.bitwiseAND(acc.vp).alias("hn"), F.shiftright(zero, 1).alias("next"),
                            ),
                            lambda h: F.struct(
                                h.hn.bitwiseOR(F.bitwise_not(h.next.bitwiseOR(h.hp)).bitwiseAND(F.lit(ones))).alias("vp"),
                                h.next.bitwiseAND(h.hp).alias("vn"),
                                (acc.d + 1 - F.call_function("shiftright", zero, cell).bitwiseAND(F.lit(1)).cast("int")).alias("d"),
                            ),
                        ),
                    ),
                )
            )

        start = F.struct(
            F.lit((ones >> tau) << tau).cast("bigint").alias("vp"), F.lit(0).cast("bigint").alias("vn"), gap.alias("d")
        )
        steps = F.when(F.size(x.b) > 0, F.sequence(F.lit(0), F.size(x.b) - 1)).otherwise(F.array().cast("array<int>"))
        return F.when(gap > tau, F.lit(tau + 1)).otherwise(F.aggregate(steps, start, column).d)

    longer, shorter = F.when(F.length(a) >= F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), b).otherwise(a)
    return let(F.struct(chars(longer).alias("a"), chars(shorter).alias("b")), run)


def _verified(pairs: DataFrame, texts: DataFrame, tau: int) -> DataFrame:
    """``x, y`` of the pairs of line ids whose texts are within ``tau`` edits."""
    one = texts.select(F.col("id").alias("x"), F.col("line").alias("_a"))
    two = texts.select(F.col("id").alias("y"), F.col("line").alias("_b"))
    both = pairs.join(one, "x").join(two, "y").withColumn("_d", edit_distance(F.col("_a"), F.col("_b"), tau))
    return both.filter(F.col("_d") <= tau)


def alike_lines(docs: DataFrame, id_col: str, text: str, tau: int, min_chars: int) -> DataFrame:
    """``node, label``: line ids that belong to the class of another, smaller id."""
    lines = line_rows(docs, id_col, text, min_chars)
    keyed = keyed_lines(lines, tau)
    spread = keyed.groupBy("key").agg(F.min("id").alias("_lo"), F.max("id").alias("_hi"))
    shared = materialise(spread.filter("_lo < _hi").select("key"), "shared-keys")
    maybe = passing(keyed, shared, "key")
    some = maybe.groupBy("key", "id").agg(F.max("own").alias("own")).join(shared, "key", "left_semi")
    rows = materialise(some, "shared-rows")

    ids = materialise(rows.select("id").distinct(), "shared-ids")
    candidates = passing(lines.select("id", "line"), ids, "id")
    once = candidates.groupBy("id").agg(F.min("line").alias("line")).join(ids, "id", "left_semi")
    texts = materialise(once.withColumn("parity", letter_parity(F.col("line"))), "texts")
    marked = materialise(rows.join(texts.select("id", "parity"), "id"), "marked-rows")

    # every line against one line of each of its keys
    heads = marked.filter("own = 1").groupBy("key").agg(F.min(F.struct("id", "parity")).alias("h"))
    near = marked.join(heads, "key").filter((F.col("id") != F.col("h.id")) & _may_match(F.col("parity"), F.col("h.parity"), tau))
    stars = near.select(F.col("h.id").alias("x"), F.col("id").alias("y")).distinct()
    links = _verified(stars, texts, tau).select(F.col("x").alias("a"), F.col("y").alias("b"))
    first = components(links, "line-stars")

    # what the stars have missed: keys with several classes left
    labelled = with_labels(marked, "id", first, "label")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo < _hi")
    left = materialise(labelled.join(mixed.select("key"), "key", "left_semi"), "mixed-keys")
    sizes = left.groupBy("key", "label").agg(F.count(F.lit(1)).alias("_n"))
    main = sizes.groupBy("key").agg(F.max_by("label", F.struct("_n", "label")).alias("_main"))
    placed = left.join(main, "key").withColumn("_is_main", F.col("label") == F.col("_main"))
    one = placed.filter(~F.col("_is_main")).select("key", F.col("id").alias("x"), F.col("label").alias("_lx"), F.col("own").alias("_ox"), F.col("parity").alias("_px"))
    two = placed.select("key", F.col("id").alias("y"), F.col("label").alias("_ly"), F.col("own").alias("_oy"), F.col("parity").alias("_py"), "_is_main")
    pairs = (
        one.join(two, "key")
        .filter(_may_match(F.col("_px"), F.col("_py"), tau))
        .filter((F.col("_lx") != F.col("_ly")) & (F.col("_is_main") | (F.col("x") < F.col("y"))) & (F.col("_ox") + F.col("_oy") > 0))
        .select("x", "y", "_lx", "_ly").distinct()
    )
    crossed = _verified(pairs, texts, tau).select(F.col("_lx").alias("a"), F.col("_ly").alias("b"))
    merged = components(crossed, "line-classes")  # of labels alone; the lines below a label go with it
    below = with_labels(first.withColumnRenamed("label", "first"), "first", merged, "label").select("node", "label")
    return below.union(merged)


def removals(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", tau: int = TAU, min_chars: int = MIN_CHARS,
    exact_chars: int = EXACT_CHARS,
) -> DataFrame:
    """``doc_id, t, removed``: zero-based numbers of the lines that repeat an earlier one, for documents with any."""
    if min_chars <= 3 * tau:
        raise ValueError("lines must be longer than three times the edit distance")
    classes = materialise(alike_lines(docs, id_col, text, tau, min_chars), "line-labels")
    lines = materialise(line_rows(docs, id_col, text, min(min_chars, exact_chars)).select("doc_id", "t", "n", "id"), "lines")
    place = F.struct("doc_id", "t", "n")
    own = materialise(lines.groupBy("id").agg(F.min(place).alias("lo"), F.max(place).alias("hi")), "line-places")
    classed = with_labels(own, "id", classes, "label")
    firsts = classed.groupBy("label").agg(F.min("lo").alias("keep"), F.max("hi").alias("last")).filter("keep < last")
    repeated = materialise(classed.join(firsts.select("label", "keep"), "label").select("id", "keep"), "repeated")
    later = passing(lines, repeated, "id").join(repeated, "id").filter(F.struct("doc_id", "t", "n") != F.col("keep"))
    return later.groupBy("doc_id", "t").agg(F.collect_set("n").alias("removed"))


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", tau: int = TAU, min_chars: int = MIN_CHARS,
    exact_chars: int = EXACT_CHARS,
) -> DataFrame:
    """``row`` (the input row), ``removed`` (sorted line numbers) and ``cleaned`` (the text without them)."""
    gone = removals(docs, id_col, text, tau, min_chars, exact_chars).select(
        F.col("doc_id").alias("_d"), F.col("t").alias("_t"), F.sort_array("removed").alias("removed")
    )
    held = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h"), F.struct("*").alias("row"))
    both = held.join(gone, (F.col("_h") == F.col("_t")) & F.col("_id").eqNullSafe(F.col("_d")), "left")
    old = F.col("row")[text]
    cleaned = let(
        F.split(old, "\n", -1),
        lambda all_: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col("removed")), lambda i: F.get(all_, i)), "\n"
        ),
    )
    none = F.array().cast("array<int>")
    return both.select(
        "row", F.coalesce("removed", none).alias("removed"), F.when(F.col("removed").isNull(), old).otherwise(cleaned).alias("cleaned")
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with repeated lines removed from the text; all other columns as they are."""
    cleaned = without_repeats(docs, id_col, text)
    return cleaned.select(*[F.col("cleaned").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


SQL = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, n - 1 AS n, x AS line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents
  ) WHERE length(x) >= {EXACT_CHARS}
),
d AS (SELECT row_number() OVER (ORDER BY line) AS id, line, length(line) AS len FROM (SELECT DISTINCT line FROM l)),
link AS (
  SELECT a.id AS a, b.id AS b FROM d a JOIN d b ON b.len BETWEEN a.len AND a.len + {TAU} AND a.id != b.id
  WHERE a.len >= {MIN_CHARS} AND levenshtein(a.line, b.line) <= {TAU}
),
e AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(x, y) AS (SELECT id, id FROM d WHERE id IN (SELECT a FROM e) UNION SELECT x, e.b FROM reach JOIN e ON e.a = y),
class AS (SELECT d.id, d.line, coalesce(min(y), d.id) AS c FROM d LEFT JOIN reach ON x = d.id GROUP BY d.id, d.line),
o AS (SELECT doc_id, n, row_number() OVER (PARTITION BY c ORDER BY doc_id, n) AS k FROM l JOIN class USING (line)),
gone AS (SELECT doc_id, string_agg(n, ',' ORDER BY n) AS removed, count(*) AS k, list(n) AS ns FROM o WHERE k > 1 GROUP BY doc_id),
s AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
SELECT doc_id, len(ls)::BIGINT AS n_lines, coalesce(k, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed,
       sha256(CASE WHEN k IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x, i: NOT list_contains(ns, i - 1)), chr(10)) END) AS text_sha256
FROM s LEFT JOIN gone USING (doc_id)
"""


@query(SQL)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, what is removed, and the digest of the text that stays."""
    cleaned = without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return cleaned.select(
        "row.doc_id", F.size(F.split(F.coalesce("row.text", F.lit("")), "\n", -1)).cast("bigint").alias("n_lines"),
        F.size("removed").cast("bigint").alias("n_removed"), F.array_join("removed", ",").alias("removed"),
        F.sha2(F.coalesce("cleaned", F.lit("")), 256).alias("text_sha256"),
    )
