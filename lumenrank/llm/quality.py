"""Operator 1, quality rules: a threshold table compiled into one projection.

A rule bounds a ratio of two counts of a text. The counts are built-in
functions of the text alone, so the whole operator is a projection over the
scan: no shuffle, no user function, no state. Rows pass through with all
their columns, held in one struct so that no column name can clash.

Defined results: a null, empty or blank text has no words and fails. Repeated
rows are judged alike, row by row; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.llm.registry import documents, query
from lumenrank.llm.text import SPACE, indexes, solid, words

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from have he i in is it not of on or that the they this to was we were which with you "
    "au aux avec ce dans de des du elle en est et il la le les ne ou par pas pour que qui se sur un une "
    "als auf das dem den der die ein eine für ich im ist mit nicht sich sie und von zu "
    "al como con del el lo los las más no o para por si su una y"
).split()

_INDEX_BITS = 30  # a string has fewer than 2^30 words


class Rule(NamedTuple):
    """``low <= numerator / denominator <= high``; an open end is None. A zero denominator counts as one."""

    name: str
    numerator: str
    denominator: str
    low: float | None
    high: float | None


# Words per text are bounded below by the base rule; there is no upper bound.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.5, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("exclamations_per_word", "n_exclamations", "n_words", None, 0.25),
    Rule("stop_words", "n_stop_words", "n_words", 0.04, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("list_lines", "n_list_lines", "n_lines", None, 0.9),
)


def repeated_words(tokens: Column) -> tuple[Column, Column]:
    """Two steps: (sorted window keys of ``tokens``, count from ``_tokens`` and ``_keys``).

    A window's key packs hash bits above its index, so one primitive sort
    brings equal windows together. Windows whose neighbours share the hash
    bits are compared by their words, so the count is exact.
    """
    keys = F.sort_array(
        F.transform(
            indexes(F.size(tokens) - 2),
            lambda i: F.shiftleft(
                F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2)), _INDEX_BITS
            ).bitwiseOR(i.cast("bigint")),
        )
    )
    sorted_keys, held = F.col("_keys"), F.col("_tokens")

    def same(a: Column, b: Column) -> Column:
        return F.shiftright(a, _INDEX_BITS) == F.shiftright(b, _INDEX_BITS)

    maybe = F.filter(
        sorted_keys,
        lambda x, k: same(x, F.get(sorted_keys, k - 1)) | same(x, F.get(sorted_keys, k + 1)),
    )
    spelled = F.sort_array(
        F.transform(
            F.transform(maybe, lambda x: x.bitwiseAND(F.lit((1 << _INDEX_BITS) - 1)).cast("int")),
            lambda i: F.struct(
                F.concat_ws(" ", F.get(held, i), F.get(held, i + 1), F.get(held, i + 2)).alias("g"), i.alias("i")
            ),
        )
    )
    twice = F.get(
        F.transform(
            F.array(spelled),
            lambda s: F.filter(s, lambda x, k: (x.g == F.get(s, k - 1).g) | (x.g == F.get(s, k + 1).g)),
        ),
        F.lit(0),
    )
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x.i, x.i + 1, x.i + 2))))
    return keys, F.size(covered).cast("bigint")


def _count(col: Column) -> Column:
    return col.cast("bigint")


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (the input row as a struct) and the counts the rules refer to."""
    body = F.coalesce(F.col("row")[text], F.lit(""))
    stop = [F.lit(w) for w in STOP_WORDS]
    keys, repeated = repeated_words(F.col("_tokens"))
    tokens, lines = F.col("_tokens"), F.col("_lines")
    split = docs.select(F.struct("*").alias("row")).select(
        "row",
        words(body).alias("_tokens"),
        F.filter(F.split(body, "\n"), lambda x: F.ltrim(x, F.lit(SPACE)) != "").alias("_lines"),
    )
    return split.select("*", keys.alias("_keys")).select(
        "row",
        _count(F.size(tokens)).alias("n_words"),
        _count(F.length(F.concat_ws("", tokens))).alias("word_chars"),
        _count(F.regexp_count(body, F.lit("[#*$%&|<>]"))).alias("n_symbols"),
        _count(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        _count(F.size(lines)).alias("n_lines"),
        _count(F.regexp_count(body, F.lit("!"))).alias("n_exclamations"),
        _count(F.size(F.filter(tokens, lambda w: F.lower(w).isin(*stop)))).alias("n_stop_words"),
        _count(F.size(F.filter(lines, lambda x: x.rlike("^[ \\t]*[-*\\u2022]")))).alias("n_list_lines"),
    )


def compile_rules(rules: Sequence[Rule] = RULES) -> Column:
    """One boolean expression over the counts; true when every rule holds."""
    tests = [F.lit(True)]
    for rule in rules:
        ratio = F.col(rule.numerator) / F.greatest(F.col(rule.denominator), F.lit(1))
        if rule.low is not None:
            tests.append(ratio >= rule.low)
        if rule.high is not None:
            tests.append(ratio <= rule.high)
    return reduce(lambda a, b: a & b, tests)


def judge(
    docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, min_words: int = 50, max_repeat_percent: int = 50
) -> DataFrame:
    """``row``, the counts, ``base_failed`` and ``kept`` for every row of ``docs``."""
    few = F.col("n_words") < min_words
    repetitive = F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent
    counted = text_counts(docs, text).withColumn("base_failed", few | repetitive)
    return counted.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that every rule accepts, with their own columns."""
    return solid(judge(docs, text, rules).select("row", "kept"), F.col("kept")).select("row.*")


SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents
),
g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM t)
),
r AS (
  SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g), (VALUES (0), (1), (2)) AS s(d)
  WHERE c > 1 GROUP BY doc_id
),
c AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(body, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(l)::BIGINT AS n_lines,
         len(regexp_extract_all(body, '!'))::BIGINT AS n_exclamations,
         len(list_filter(w, lambda x: list_contains([:stop:], lower(x))))::BIGINT AS n_stop_words,
         len(list_filter(l, lambda x: regexp_matches(x, '^[ \\t]*[-*\\x{2022}]')))::BIGINT AS n_list_lines
  FROM t LEFT JOIN r USING (doc_id)
),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND :rules: AS kept,
       n_lines, n_exclamations, n_stop_words, n_list_lines
FROM b
""".replace(":stop:", ", ".join(f"'{w}'" for w in STOP_WORDS)).replace(
    ":rules:",
    " AND ".join(
        f"{r.numerator} / greatest({r.denominator}, 1) {sign} {bound}"
        for r in RULES
        for sign, bound in ((">=", r.low), ("<=", r.high))
        if bound is not None
    ),
)


@query(SQL)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_exclamations", "n_stop_words", "n_list_lines",
    )
