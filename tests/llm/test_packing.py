"""Packing against the tokenizer itself, and the plan against exact bounds."""

import bisect
import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lumenrank.llm import packing, tokens

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.default_vocabulary())


def expected_pieces(tokenizer, rows, capacity=2048):
    out = []
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            out.append((i, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    return sorted(out, key=repr)


def best_fit_decreasing(counts, capacity):
    free, bins = [], 0
    for x in sorted(counts, reverse=True):
        for _ in range(counts[x]):
            k = bisect.bisect_left(free, x)
            bins += k == len(free)
            bisect.insort(free, (free.pop(k) if k < len(free) else capacity) - x)
    return bins


def check_sequences(rows, capacity=2048):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


def test_whole_table(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.op6_best_fit_packing(spark, SF).collect()
    want = expected_pieces(tokenizer, [(r.doc_id, r.text) for r in docs.collect()])
    assert sorted([tuple(r)[:5] for r in rows], key=repr) == want
    total = sum(r["length"] for r in rows)
    assert check_sequences(rows) <= -(-total // 2048) + 1


ODD = [
    (1, None), (2, ""), (3, "a b"), (3, "a b"), (4, " x\x85y　z <|endoftext|> é\n\t'S don't 123ABC!!?"),
    (5, "ΑΣ ΣΑΣ İstanbul ﬁ ½"), (6, "word " * 30_000), (None, "no id"), (7, "x" * 5000), (8, "\x1c \x1f a\x0bb"),
]


def test_odd_texts(docs, tokenizer):
    rows = packing.pack(docs(ODD)).collect()
    assert sorted([tuple(r)[:5] for r in rows], key=repr) == expected_pieces(tokenizer, ODD)
    check_sequences(rows)


def test_empty_table(docs):
    assert packing.pack(docs([])).collect() == []


def test_small_memory_of_pieces(monkeypatch, tokenizer):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 5)
    ids = tokens.PieceIds(tokens.default_vocabulary())
    texts = ["one two three", "four five six seven " + "y" * 80, "one eight nine ten", ""]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoded(ids, texts) == want and [x for t in texts for x in encoded(ids, [t])] == want


def encoded(ids, texts):
    flat, borders = ids.encode(pa.array(texts, pa.string()))
    return [flat[a:b].tolist() for a, b in zip(borders, borders[1:])]


def test_ids_of_every_code_point_and_closing_mark(tokenizer):
    """Each code point alone and after a letter, followed by each mark; normal forms and case may join it to the mark."""
    ids = tokens.PieceIds(tokens.default_vocabulary())
    points = [c for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    odd = [c for c in points if not chr(c).isalnum() or unicodedata.normalize("NFC", chr(c)).lower() != chr(c)]
    for marks, some in ((",", points), (".;:!?", odd)):
        for mark in marks:
            for at in range(0, len(some), 20_000):
                texts = [x for c in some[at : at + 20_000] for x in (f"a{chr(c)}{mark}", f"{chr(c)}{mark}b {mark}{chr(c)}")]
                want = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                assert encoded(ids, texts) == want, mark


def test_ids_of_random_texts(tokenizer):
    rng = random.Random(3)
    parts = [*"abZéßΣσςİK\u09dc\u0958\u0a33ก한\u1100\u1161\u0301\u03311٣½'’-_.,!?;:\u200d\ufe0f \n\xa0\x85\x1c\u3000中😀", "e\u0301", "'s"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(40_000)]
    want = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert encoded(tokens.PieceIds(tokens.default_vocabulary()), texts) == want


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_every_piece_once(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 100): rng.randint(1, 400) for _ in range(30)}
    steps = packing.plan(counts, 100)
    used = {}
    for s in steps:
        assert sum(x * m for x, m in s.parts) <= 100
        for x, m in s.parts:
            used[x] = used.get(x, 0) + m * s.bins
    assert used == counts
    assert sum(s.bins for s in steps) <= 1.02 * best_fit_decreasing(counts, 100) + 2


def test_plan_of_many_lengths_is_nearly_full():
    rng = random.Random(5)
    counts = {}
    for _ in range(60_000):
        x = min(2048, max(2, int(rng.lognormvariate(6.3, 1))))
        counts[x] = counts.get(x, 0) + 1
    least = -(-sum(x * n for x, n in counts.items()) // 2048)
    assert sum(s.bins for s in packing.plan(counts, 2048)) <= least + 2


def test_fullest_bin_is_exact():
    from itertools import combinations

    rng = random.Random(1)
    for _ in range(60):
        items = sorted((rng.randint(1, 40) for _ in range(9)), reverse=True)
        counts = {x: items.count(x) for x in items}
        found = packing.fullest(counts, sorted(counts, reverse=True), 60)
        best = max(items[0] + sum(c) for n in range(9) for c in combinations(items[1:], n) if items[0] + sum(c) <= 60)
        assert sum(x * m for x, m in found.items()) == best
        assert all(m <= counts[x] for x, m in found.items())
