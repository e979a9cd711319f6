"""Counts against a plain version; what the rules keep."""

import re
from collections import Counter

from lumenrank.llm import quality

SF = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + d for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        len(w) < 50 or 100 * len(covered) > 50 * len(w),
    )


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]

ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\f\r "), (4, "a b c a b c a"), (5, "é😀 \x85 x y z\x1cq"), (6, "the cat sat " * 40_000),
    (6, "x"), (6, "x"), (None, "a\n\na\n \n\na"), (7, "one two three one two four one two three"), (8, "\n".join(["same line"] * 300)),
    (9, "# * $ % & | < >"), (10, "x" * 200_000),
]


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in quality.op1_quality_rules(spark, SF).collect():
        assert tuple(r[c] for c in COUNTS) == plain(texts[r.doc_id]), r.doc_id


def test_odd_texts(docs):
    rows = quality.judge(docs(ODD)).select("row.doc_id", *COUNTS).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted([(i, *plain(t)) for i, t in ODD], key=repr)


def test_empty_table(docs):
    assert quality.judge(docs([])).collect() == [] and quality.keep_good(docs([])).collect() == []


def test_kept_rows_keep_their_columns(docs):
    good = " ".join(f"the w{i} v{i} of x{i}" for i in range(40)) + "."
    table = docs([(1, good), (2, good.upper().replace(" ", "!! ")), (3, " | ".join(f"w{i} the" for i in range(90))), (4, "few words"), (1, good)])
    kept = quality.keep_good(table)
    assert kept.columns == table.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, good), (1, good)]


def test_good_documents_are_kept(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = quality.op1_quality_rules(spark, SF).join(labels, "doc_id")
    rows = judged.filter("n_words >= 50").select("kept", "quality").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert all(good) and sum(bad) <= 0.1 * len(bad)
