"""Operator 8, benchmark decontamination by size-partitioned MinHash containment search.

A document leaks a test item when it holds 80 % of the item's distinct
five-word shingles or more, in one passage or in parts that stand apart (lower
case, letters and digits only, so case and punctuation don't hide a leak). An
item of fewer words leaks where all its words stand in a row. See
``containment`` for the search.

Defined results: null, empty and blank texts leak nothing and are leaked
nowhere. Rows with the same id are searched by their own texts and reported
once; without documents or items nothing is found. Documents without an id
are searched like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.llm.containment import SHINGLE, THRESHOLD, find_inside
from lumenrank.llm.registry import benchmark, documents, query


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_found``: every leak, with the shingles of the item that the document holds."""
    found = find_inside(docs, items, k=shingle, threshold=threshold)
    return found.groupBy("doc_id", "item_id", "n_shingles").agg(F.max("n_found").alias("n_found"))


def drop_leaky(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text leaks no item, with their own columns."""
    found = find_inside(docs, items, id_col, text).select(F.col("t").alias("_leaky")).distinct()
    held = docs.select(F.xxhash64(text).alias("_t"), F.struct("*").alias("row"))
    return held.join(found, F.col("_t") == F.col("_leaky"), "left_anti").select("row.*")


WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{M}\\p{N}]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), {SHINGLE}) AS k FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bs AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i + 1 : i + k], ' ') AS g
  FROM (SELECT item_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM b)
),
ds AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[i + 1 : i + k], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(0, greatest(len(w) - k + 1, 0))) AS i FROM d, (SELECT DISTINCT k FROM b))
),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_found
FROM ds JOIN bs USING (g, k) JOIN n USING (item_id) GROUP BY ALL HAVING count(*) >= {THRESHOLD} * n
"""


@query(SQL)
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), benchmark(spark, sf_dir))
