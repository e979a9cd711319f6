"""Decontamination and licence scans against plain set intersections."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lumenrank.llm import containment, decontaminate, licence


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def runs(words, k):
    return [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


def plain_leaks(rows, items, k=5, threshold=0.8, windowed=False):
    """All pairs by set intersection: over whole documents, or the best window of the item's size class."""
    out, cut = set(), {}
    for item, text in items:
        words = words_of(text)
        if not words:
            continue
        size = min(k, len(words))
        places = runs(words, size)
        want, step = set(places), 2 << (len(places).bit_length() - 1)
        for n, (doc, body) in enumerate(rows):
            own = cut.setdefault((n, size), runs(words_of(body), size))
            if windowed:
                best = max((len(want & set(own[s : s + 2 * step])) for s in range(0, max(len(own), 1), step)), default=0)
            else:
                best = len(want & set(own))
            if best >= threshold * len(want):
                out.add((doc, item, len(want), best))
    return out


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture()
def items(spark):
    def make(rows):
        return spark.createDataFrame(rows, "item_id long, text string").withColumn("hs", F.lit(1)).withColumn("n", F.lit(2))

    return make


def test_planted_passages(docs, items):
    rng = random.Random(9)
    tests = [(i, prose(rng, n)) for i, n in enumerate([6, 9, 15, 17, 33, 40, 64, 70, 130, 300])]
    tests.append((90, tests[3][1]))
    rows = []
    for i in range(120):
        body = [prose(rng, rng.randint(0, 900))]
        for _ in range(rng.randint(0, 3)):
            words = rng.choice(tests)[1].split()
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = "changed"
            body += [" ".join(words).upper() + "!", prose(rng, rng.randint(0, 300))]
        rows.append((i, " ".join(body)))
    got = {tuple(r) for r in decontaminate.leaks(docs(rows), items(tests)).collect()}
    want = plain_leaks(rows, tests)
    assert got == want and len(want) > 60
    found = containment.find_inside(docs(rows), items(tests), windowed=True).select("doc_id", "item_id", "n_shingles", "n_found").collect()
    want = plain_leaks(rows, tests, windowed=True)
    assert {tuple(r) for r in found} == want and len(want) > 60


def test_odd_texts(docs, items):
    rng = random.Random(2)
    passage = prose(rng, 30)
    rows = [
        (1, None), (2, ""), (3, "!!! ... \n"), (4, "one two"), (5, "One, TWO!"), (6, passage), (6, passage), (None, passage.upper()),
        (7, prose(rng, 30_000) + " " + passage), (8, "one two three"), (9, "x" * 100_000),
    ]
    tests = [(1, None), (2, ""), (3, "..."), (4, "one two"), (5, passage), (6, passage)]
    got = sorted([tuple(r) for r in decontaminate.leaks(docs(rows), items(tests)).collect()], key=repr)
    assert got == sorted(plain_leaks(rows, tests), key=repr)
    table = docs(rows)
    kept = decontaminate.drop_leaky(table, items(tests))
    assert kept.columns == table.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 2, 3, 9]


def test_empty_tables(docs, items):
    assert decontaminate.leaks(docs([]), items([(1, "a b c d e f")])).collect() == []
    assert decontaminate.leaks(docs([(1, "a b c d e f")]), items([])).collect() == []
    assert [r.doc_id for r in decontaminate.drop_leaky(docs([(1, "a")]), items([])).collect()] == [1]
    assert licence.licence_notices(docs([])).collect() == []


def test_bands_hold_their_promise():
    for c in range(8):
        for e in range(c + 5):
            n, x = 1 << c, (2 << e) - 1
            least = min(1.0, 0.8 * n / (x + 0.2 * n))
            assert (1 - least) ** containment.band_count(c, e, 0.8) <= 1e-4 * 1.0001


def test_notices(docs):
    rows = [
        (1, "Some prose.\nLicensed under the Apache License, Version 2.0."), (2, "ALL RIGHTS RESERVED"), (3, "no notice in here at all"), (4, None),
        (5, "word " * 3000 + "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License "
            "as published by the Free Software Foundation" + " word" * 3000), (None, "Released under the MIT License."), (6, "licensed under"), (8, "some words before all rights reserved and after"), (7, "Licensed under CC BY-NC 4.0."),
    ]
    found, whole = {}, set()
    for r in licence.licence_notices(docs(rows)).collect():
        found.setdefault(r.doc_id, set()).add(r.licence)
        if r.n_found == r.n_shingles:
            whole.add((r.doc_id, r.licence))
    # the three notices of this family differ in a word or two; one is there in full
    assert found.pop(5) == {"gpl", "lgpl", "agpl-3.0"} and {x for i, x in whole if i == 5} == {"gpl"}
    assert found == {1: {"apache-2.0"}, 2: {"all-rights-reserved"}, None: {"mit"}, 8: {"all-rights-reserved"}, 7: {"cc-by-nc-4.0"}}


def test_parts_apart_and_inner_repeats(docs, items):
    """The halves of an item far apart, and a passage longer than its distinct shingles tell."""
    rng = random.Random(5)
    tests = [(1, prose(rng, 40)), (2, " ".join([prose(rng, 15), "again " * 60 + prose(rng, 15)])), (3, prose(rng, 40))]
    halves = tests[0][1].split()
    rows = [
        (1, " ".join([prose(rng, 50), *halves[:20], prose(rng, 300), *halves[20:], prose(rng, 50)])),
        (2, " ".join([prose(rng, 37), tests[1][1], prose(rng, 500)])), (None, " ".join([*halves[20:], prose(rng, 2000), *halves[:20]])),
        (3, " ".join([*halves[:20], prose(rng, 300), *halves[26:]])), (4, prose(rng, 500)), (5, prose(rng, 90) + " " + tests[2][1]),
    ]
    want = plain_leaks(rows, tests)
    assert {(d, i) for d, i, *_ in want} == {(1, 1), (2, 2), (None, 1), (5, 3)}
    table = docs(rows)
    assert {tuple(r) for r in decontaminate.leaks(table, items(tests)).collect()} == want
    assert sorted(r.doc_id for r in decontaminate.drop_leaky(table, items(tests)).collect()) == [3, 4]


def test_bands_decide(docs, items, monkeypatch):
    """Without the bands nothing is found; the exact search serves only sets far larger than an item."""
    rng = random.Random(8)
    tests = [(i, prose(rng, 24)) for i in range(60)]
    rows = [(i, " ".join([prose(rng, 100), t, prose(rng, 50)])) for i, t in tests]
    dump = (1000, " ".join(t for _, t in tests))  # holds 60 items: more than 16 times each
    assert {tuple(r) for r in decontaminate.leaks(docs([*rows, dump]), items(tests)).collect()} == plain_leaks([*rows, dump], tests)
    monkeypatch.setattr(containment, "_by_bands", lambda sets, items, *_: containment._by_lookup(sets.limit(0), items, 0.8))
    assert {r.doc_id for r in decontaminate.leaks(docs([*rows, dump]), items(tests)).collect()} == {1000}


def test_recall(docs, items):
    """Passages with as many changes as the threshold allows; 0.9999 of them are promised."""
    rng = random.Random(12)
    tests = [(i, prose(rng, 34)) for i in range(40)]  # 30 shingles, of which 24 must stay: one changed word
    rows = []
    for i in range(1500):
        words = rng.choice(tests)[1].split()
        words[rng.randrange(5, 29)] = "changed"
        rows.append((i, " ".join([prose(rng, 30), *words, *rng.choice(tests)[1].split()[: rng.randint(0, 30)]])))
    for windowed in (False, True):
        want = {(d, i) for d, i, *_ in plain_leaks(rows, tests, windowed=windowed)}
        got = {(r.doc_id, r.item_id) for r in containment.find_inside(docs(rows), items(tests), windowed=windowed).collect()}
        assert got <= want and len(got) >= 0.999 * len(want) > 1400


def test_items_of_few_words(docs, items):
    rows = [(1, "one two three four"), (2, "x one, two! y"), (3, "two one"), (4, "say one two three four five six"), (5, "One"), (6, None)]
    tests = [(1, "one"), (2, "one two"), (3, "one two three four"), (4, "two three four five six seven"), (5, "three four five six seven")]
    assert {tuple(r) for r in decontaminate.leaks(docs(rows), items(tests)).collect()} == plain_leaks(rows, tests)


def test_repeated_rows_and_empty_templates(docs):
    row = (1, "Released under the MIT License.")
    assert len(licence.licence_notices(docs([row, row])).collect()) == 1
    assert licence.licence_notices(docs([row]), []).collect() == []
    assert licence.licence_notices(docs([row]), [("none", ""), ("odd", "...")]).collect() == []
