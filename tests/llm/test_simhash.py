"""Fingerprints and components against plain loops over all pairs."""

import random

import pytest
import xxhash

from lumenrank.llm import components, simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    import re

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius=4):
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    distinct = list(parent)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    return {v: root(v) for v in distinct}


def expected(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    roots = plain_components({f for _, f in fps})
    least = {}
    for i, f in fps:
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    return sorted([(i, f"{f:016x}", least.get(roots[f])) for i, f in fps], key=repr)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted([tuple(r) for r in simhash.op10_simhash_near_dedup(spark, SF).collect()], key=repr)
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_texts(docs):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "ONE TWO"), (6, base), (6, base), (7, base + " tail"),
        (None, base), (None, "alone É ß"), (8, "x " * 40_000), (9, "é y"),
    ]
    assert sorted([tuple(r) for r in simhash.near_duplicates(docs(rows)).collect()], key=repr) == expected(rows)


def test_empty_table(docs):
    assert simhash.near_duplicates(docs([])).collect() == []
    assert simhash.keep_one(docs([])).collect() == []


def test_keep_one_keeps_all_columns(docs):
    rows = [(5, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (9, "other words are here now"), (None, "q")]
    table = docs(rows)
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == [
        (3, "a b c d e"), (9, "other words are here now"), (None, "q"),
    ]


@pytest.mark.parametrize("seed", range(3))
def test_dense_groups_lose_no_link(spark, seed):
    """Chains and clouds around few centres: most pairs of a key are close, many are just too far."""
    rng = random.Random(seed)
    values = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(150):
            v = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                v ^= 1 << b
            values.add(v)
            if rng.random() < 0.1:
                centre = v
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = simhash.fingerprint_components(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    want = plain_components(values)
    pairs = {}
    for r in got:
        pairs.setdefault(want[r.fp & (1 << 64) - 1], set()).add(r.component)
    assert len(got) == len(values)
    assert all(len(s) == 1 for s in pairs.values())
    assert len({c for s in pairs.values() for c in s}) == len(pairs)


def test_pairs_made_in_a_dense_group_stay_linear(spark):
    """Near copies by the hundred: chains join them, so hardly a row is left for the pair join."""
    rng = random.Random(3)
    centre = rng.getrandbits(63)
    values = {centre ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)}
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    links = simhash.chain_links(simhash.block_keys(df))
    assert links.count() <= 35 * len(values)
    labels = components.components(links)
    assert labels.select("label").distinct().count() == 1 and labels.count() == len(values) - 1


def test_components_of_paths_and_hubs(spark):
    path = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    found = components.components(spark.createDataFrame(path + hub + [(7, 7)], "a long, b long")).collect()
    assert {(r.node, r.label) for r in found} == {(i, 0) for i in range(1, 201)} | {(i, 1000) for i in range(1001, 1300)}


def test_keep_one_tells_rows_of_one_id_apart(docs):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (1, b), (2, b), (3, a), (None, a), (4, None)]
    got = [(r.doc_id, r.text) for r in simhash.keep_one(docs(rows)).collect()]
    assert sorted(got, key=repr) == sorted([(1, a), (1, b), (None, a), (4, None)], key=repr)


def test_stars_need_no_round(spark, monkeypatch):
    saved, save = [], components.Rounds.save
    monkeypatch.setattr(components.Rounds, "save", lambda self, df: saved.append(1) or save(self, df))
    edges = spark.createDataFrame([(i, i % 3) for i in range(3, 40)] + [(1, 33 + 1), (50, 50)], "a long, b long")
    assert {tuple(r) for r in components.components(edges).collect()} == {(i, i % 3) for i in range(3, 40)}
    assert len(saved) == 1
    assert components.components(edges.filter("a = b")).collect() == [] and len(saved) == 2


def test_rounds_end_only_with_stars(spark):
    shapes = {
        "two parents": [(3, 1), (3, 2)], "a chain of two": [(2, 1), (3, 2)], "both": [(9, 4), (9, 5), (5, 2), (4, 3), (8, 3)],
        "stars apart": [(3, 1), (4, 1), (5, 2)], "twice": [(1, 2), (2, 1), (2, 3)],
    }
    for name, edges in shapes.items():
        found = {tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        nodes = {n for e in edges for n in e}
        least = {n: n for n in nodes}
        for _ in nodes:
            for a, b in edges:
                least[a] = least[b] = min(least[a], least[b])
        assert found == {(n, m) for n, m in least.items() if n != m}, name
