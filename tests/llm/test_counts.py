"""The ledger against plain recounts."""

import random

import pytest
from tokenizers import Tokenizer

from lumenrank.llm import counts, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def ledger(spark, tmp_path):
    return counts.TokenLedger(spark, str(tmp_path / "ledger"))


def feed(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, op string, source string, lang string, version string, tokens long")


def totals(ledger):
    return sorted([tuple(r) for r in ledger.totals().collect()], key=repr)


def test_random_batches(spark, ledger):
    rng, state = random.Random(3), {}
    for batch in range(5):
        rows = {}
        for _ in range(40):
            key = (rng.choice([None, *range(25)]), rng.choice(["v1", "v2"]))
            op = rng.choice([counts.INSERT, counts.DELETE, counts.REVISE])
            rows[key] = (op, rng.choice(["a", "b", None]), rng.choice(["en", None]), rng.randint(0, 50))
        df = feed(spark, [(i, op, s, la, v, n) for (i, v), (op, s, la, n) in rows.items()])
        assert ledger.commit(f"b{batch}", df)
        assert not ledger.commit(f"b{batch}", df)
        for key, (op, s, la, n) in rows.items():
            state.pop(key, None)
            if op != counts.DELETE:
                state[key] = (s, la, key[1], n)
        want = {}
        for s, la, v, n in state.values():
            docs, total = want.get((s, la, v), (0, 0))
            want[s, la, v] = (docs + 1, total + n)
        assert totals(ledger) == sorted([(*k, *x) for k, x in want.items()], key=repr)


def test_interrupted_commit_leaves_no_trace(spark, ledger, monkeypatch):
    df = feed(spark, [(1, counts.INSERT, "a", "en", "v", 7)])
    spark.range(1).selectExpr("1L AS doc_id", "'x' AS source", "'x' AS lang", "'v' AS version", "1L AS docs", "9L AS tokens").write.parquet(
        ledger._path("entries", "b")
    )  # what a lost attempt has left: entries without a marker
    assert totals(ledger) == []
    assert ledger.commit("b", df)
    assert totals(ledger) == [("a", "en", "v", 1, 7)]


def test_empty_batch_and_repeated_rows(spark, ledger):
    assert ledger.commit("none", feed(spark, []))
    assert totals(ledger) == []
    row = (1, counts.INSERT, "a", "en", "v", 3)
    assert ledger.commit("twice", feed(spark, [row, row, (2, counts.DELETE, None, None, "v", None)]))
    assert totals(ledger) == [("a", "en", "v", 1, 3)]


def test_query(spark):
    tokenizer = Tokenizer.from_file(tokens.default_vocabulary())
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    keep = {}
    for r in docs:
        keep[r.text] = min(r.doc_id, keep.get(r.text, r.doc_id))
    want = {}
    for r in docs:
        if keep[r.text] == r.doc_id:
            text = "\n".join(dict.fromkeys(r.text.split("\n")))
            for version, n in (("word_bpe_49k", len(tokenizer.encode(text, add_special_tokens=False).ids)), ("words-1", len(text.encode().split()))):
                d, t = want.get((r.source, r.lang, version), (0, 0))
                want[r.source, r.lang, version] = (d + 1, t + n)
    got = {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in counts.op4_token_counts(spark, SF).collect()}
    assert got == want


def test_odd_texts(docs, tmp_path):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "x\nx\ny"), (None, "q"), (5, "word " * 20_000), (6, "a b")]
    got = {r.version: (r.n_docs, r.n_tokens) for r in counts.maintain(docs(rows), str(tmp_path / "l")).collect()}
    assert got["words-1"] == (5, 0 + 2 + 2 + 1 + 20_000)
    assert counts.maintain(docs([]), str(tmp_path / "e")).collect() == []


def test_documents_without_id_and_unlike_texts_of_one_id_count_each(docs, tmp_path):
    rows = [(None, "a"), (None, "b c"), (7, "d e f"), (7, "g"), (7, "g"), (8, "g")]
    got = {r.version: (r.n_docs, r.n_tokens) for r in counts.maintain(docs(rows), str(tmp_path / "l")).collect()}
    assert got["words-1"] == (4, 1 + 2 + 3 + 1)
