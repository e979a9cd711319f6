"""Operator 9, language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (one to three
letters, words bounded by a space) of a language, most frequent first. A
document's own list is compared to every profile by the out-of-place
distance: the sum over its n-grams of the difference of ranks, at most the
profile length, which also counts for an n-gram the profile lacks.

Training counts cover every labelled document that is not held out: tasks
count their Arrow batches, Spark adds the counts up, and the first
``size`` n-grams per language are all that reaches the driver (a bounded
table). Every row of ``docs`` is then scored in one pass without a shuffle.

Defined results: a text that is null, empty or without letters, and any text
when nothing was learned, is ``und`` with score 0. Repeated rows are scored
alike, row by row; ties in rank go to the smaller n-gram and ties in distance
to the smaller language name. A null id is not held out. An empty table gives
an empty result. Other columns of ``docs`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenrank.llm.registry import documents, query

PROFILE = 400  # n-grams per profile
UNDETERMINED = "und"
CHUNK = 4_000_000  # characters counted at once
_WIDTH = 21  # bits of a code point


def held_out(id_: Column) -> Column:
    """A quarter of the ids, by their checksum."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _letters():
    """A table that maps code points to their lower-case letter, others to a space."""
    import sys
    import unicodedata

    import numpy as np

    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        if c.isalpha() or unicodedata.category(c)[0] == "M":
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


_TABLE = []


def gram_codes(text: str):
    """Codes of all n-grams of a text: up to three code points of 21 bits. Words are bounded by one space."""
    import numpy as np

    if not _TABLE:
        _TABLE.append(_letters())
    points = _TABLE[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    points = np.concatenate([[32], points, [32]]).astype(np.uint64)
    blank = points == 32
    points = points[~(blank & np.concatenate([[False], blank[:-1]]))]
    if len(points) < 3:
        return np.zeros(0, np.uint64)
    two = (points[:-1] << np.uint64(_WIDTH)) | points[1:]
    three = (two[:-1] << np.uint64(_WIDTH)) | points[2:]
    inner = points[1:-1] != 32  # no n-gram reaches over a word's end
    return np.concatenate([points[points != 32], two, three[inner]])


def count_grams(text: str):
    """Distinct n-gram codes of a whole text and their counts."""
    import numpy as np

    if len(text) <= CHUNK:
        return np.unique(gram_codes(text), return_counts=True)
    total: dict[int, int] = {}
    at = 0
    while at < len(text):
        end = min(at + CHUNK, len(text))
        while end < len(text) and text[end].isalpha() and end - at < 2 * CHUNK:  # cut between words
            end += 1
        codes, counts = np.unique(gram_codes(text[at:end]), return_counts=True)
        for c, n in zip(codes.tolist(), counts.tolist()):
            total[c] = total.get(c, 0) + n
        at = end
    codes = np.array(sorted(total), np.uint64)
    return codes, np.array([total[c] for c in codes.tolist()], np.int64)


def learn_profiles(docs: DataFrame, lang: str = "lang", text: str = "text", size: int = PROFILE) -> dict[str, list[int]]:
    """The ``size`` most frequent n-grams of every language in ``docs``."""
    import pyarrow as pa

    def count(table):
        import numpy as np

        for batch in table:
            by: dict[str, list] = {}
            for label, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                by.setdefault(label, []).append(count_grams(body.as_py()))
            labels, codes, counts = [], [], []
            for label, found in by.items():
                grams, place = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                sums = np.zeros(len(grams), np.int64)
                np.add.at(sums, place, np.concatenate([n for _, n in found]))
                labels += [label] * len(grams)
                codes.append(grams.view(np.int64))
                counts.append(sums)
            if labels:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(labels, pa.string()), pa.array(np.concatenate(codes)), pa.array(np.concatenate(counts))],
                    names=["lang", "gram", "n"],
                )

    labelled = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).dropna()
    sums = labelled.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram"))
    best = sums.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for r in sorted(best.select("lang", "rank", "gram").collect()):  # size rows per language
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def identify(
    docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text: str = "text", size: int = PROFILE
) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row; the score is the share of the worst distance that is saved."""
    import pyarrow as pa

    names = sorted(profiles)

    def run(table):
        import numpy as np

        grams = np.unique(np.array([g for n in names for g in profiles[n]], np.int64).astype(np.uint64))
        ranks = np.full((len(names), len(grams)), -1, np.int64)
        for i, name in enumerate(names):
            ranks[i, np.searchsorted(grams, np.array(profiles[name], np.int64).astype(np.uint64))] = np.arange(len(profiles[name]))

        def one(body):
            codes, counts = count_grams(body) if body and any(map(str.isalpha, body)) else ([], [])
            if not len(codes) or not names:
                return UNDETERMINED, 0.0
            top = np.lexsort((codes, -counts))[:size] if len(codes) <= 4 * size else None
            if top is None:  # the same order, without sorting all
                bound = -np.partition(-counts, size - 1)[size - 1]
                some = np.flatnonzero(counts >= bound)
                top = some[np.lexsort((codes[some], -counts[some]))[:size]]
            own = codes[top]
            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            known = grams[at] == own
            theirs = ranks[:, at]
            away = np.abs(theirs - np.arange(len(own)))
            away = np.where(known & (theirs >= 0), np.minimum(away, size), size).sum(axis=1)
            best = int(np.argmin(away))
            return names[best], 1.0 - float(away[best]) / (size * len(own))

        for batch in table:
            found = [one(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


@query()
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = learn_profiles(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, profiles).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
