"""Held-out accuracy, and the distance against a plain version."""

from collections import Counter

from pyspark.sql import functions as F

from lumenrank.llm import language

SF = "/root/testdata/sf0.01"


def plain_grams(text):
    words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
    return Counter(w[i : i + n] for w in (f" {x} " for x in words) for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n] != " ")


def plain_profile(counts, size):
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return [code(g) for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:size]]


def test_held_out_accuracy(spark):
    langs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = language.op9_language_id(spark, SF).join(langs, "doc_id").filter("held_out").collect()
    assert len(rows) > 200
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_quarter(spark):
    import zlib

    rows = spark.range(200).select("id", language.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_profiles_and_distances(spark, docs):
    rows = [(i, t) for i, t in enumerate(["the cat and the dog", "der Hund und die Katze", "Ça va été là", "a the an", "und die der"])]
    table = docs(rows).withColumn("lang", F.when(F.col("doc_id").isin(0, 3), "en").when(F.col("doc_id").isin(1, 4), "de").otherwise("fr"))
    profiles = language.learn_profiles(table, size=40)
    want = {"en": Counter(), "de": Counter(), "fr": Counter()}
    for (i, t), lang in zip(rows, ["en", "de", "fr", "en", "de"]):
        want[lang] += plain_grams(t)
    assert profiles == {k: plain_profile(c, 40) for k, c in want.items()}
    for r in language.identify(table, profiles, size=40).collect():
        own = plain_profile(plain_grams(rows[r.doc_id][1]), 40)
        away = {n: sum(min(abs(p.index(g) - k), 40) if g in p else 40 for k, g in enumerate(own)) for n, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        assert (r.lang_pred, round(r.score, 9)) == (best, round(1 - away[best] / (40 * len(own)), 9))


ODD = [(1, None), (2, ""), (3, "123 !? \n"), (4, "the"), (4, "the"), (None, "the and of"), (5, "the of and " * 60_000), (6, "日本語 текст"), (7, "x" * 9_000_000)]


def test_odd_texts(docs):
    profiles = {"en": plain_profile(plain_grams("the of and to in that"), 400), "de": plain_profile(plain_grams("der die und zu in das"), 400)}
    rows = language.identify(docs(ODD), profiles).collect()
    assert len(rows) == len(ODD)
    und = sorted([r.doc_id for r in rows if r.lang_pred == "und"])
    assert und == [1, 2, 3]
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")


def test_nothing_learned(docs):
    profiles = language.learn_profiles(docs([(1, None)]))
    assert profiles == {}
    assert [tuple(r) for r in language.identify(docs([(1, "the")]), profiles).collect()] == [(1, "und", 0.0)]
    assert language.identify(docs([]), profiles).collect() == []


def test_long_text_is_counted_whole(monkeypatch):
    text = "abc déf ghi " * 500
    whole = language.count_grams(text)
    monkeypatch.setattr(language, "CHUNK", 100)
    parts = language.count_grams(text)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def test_texts_without_letters_are_undetermined(docs):
    rows = [(1, "\u0301"), (2, "\u0e31 \u0e34"), (3, "\u2764\ufe0f"), (4, "12\u20e3"), (5, "12 !?"), (6, "12 the"), (7, "e\u0301te\u0301")]
    profiles = language.learn_profiles(docs([(i, "the cat and the dog and the fish ate the food") for i in range(3)]))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs(rows), profiles).collect()}
    assert all(got[i] == ("und", 0.0) for i in range(1, 6)) and got[6][0] == got[7][0] == "en"
