"""Similarity joins, groups and clusters against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrank.operators import aggregates, cosine, fingerprints, grouping, hamming

ITEMS = "item_id bigint, ord bigint, h bigint"


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def near_copies(seed, n, bases=12, flips=3, hot_band=False):
    """Hashes scattered around a few bases; a third of all are one value."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(bases)]
    out = []
    for i in range(n):
        if i % 3 == 0:
            h = centres[0]
        else:
            h = rng.choice(centres)
            for b in rng.sample(range(48 if hot_band else 64), rng.randint(0, flips)):
                h ^= 1 << b
        out.append(signed(h))
    return out


def brute_pairs(hashes, t):
    first = {}
    for i, h in enumerate(hashes):
        first.setdefault(h, i)
    values = sorted((o, h) for h, o in first.items())
    return {
        (a, b, bin((x ^ y) & (2**64 - 1)).count("1"))
        for i, (a, x) in enumerate(values)
        for b, y in values[i + 1 :]
        if bin((x ^ y) & (2**64 - 1)).count("1") <= t
    }


def greedy(hashes, t):
    """The sequential scan the groups are defined by."""
    owner = {}
    for i, h in enumerate(hashes):
        if i in owner:
            continue
        owner[i] = i
        for j in range(i + 1, len(hashes)):
            if j not in owner and bin((h ^ hashes[j]) & (2**64 - 1)).count("1") <= t:
                owner[j] = i
    sizes = {}
    for leader in owner.values():
        sizes[leader] = sizes.get(leader, 0) + 1
    return {i: leader for i, leader in owner.items() if sizes[leader] > 1}


def table(spark, hashes):
    return spark.createDataFrame([(i, i, h) for i, h in enumerate(hashes)], ITEMS)


@pytest.mark.parametrize("t,bands,tile", [(1, None, 4096), (3, None, 4096), (5, None, 4096), (3, 6, 5), (4, 5, 3)])
def test_hamming_pairs_are_all_pairs(spark, t, bands, tile):
    hashes = near_copies(t, 400, hot_band=tile < 10)
    got = [tuple(r) for r in hamming.hamming_pairs(table(spark, hashes), t, bands=bands, tile=tile).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_pairs(hashes, t)


def test_more_bands_are_chosen_for_crowded_keys(spark):
    hashes = near_copies(1, 3000, bases=40, flips=6)
    values = hamming.distinct_values(table(spark, hashes)).cache()
    loose, _ = hamming.choose_bands(values, 3, per_value=10**6)
    tight, _ = hamming.choose_bands(values, 3, per_value=1)
    assert loose == 4 and tight > 4


def test_hamming_plan_has_no_product(spark):
    df = hamming.hamming_pairs(table(spark, near_copies(2, 50)), 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_keyed_sides_are_never_broadcast(spark):
    """The keys multiply the values, which the planner's estimate of their size leaves out."""
    df = hamming.hamming_pairs(table(spark, near_copies(2, 50)), 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_keys_are_not_multiplied_without_gain(spark):
    """Families of 300 leave 150 pairs per value under any bands; more keys can't pay."""
    hashes = [signed((c * 0x9E3779B97F4A7C15 % 2**64 & ~0x1FF) | i) for c in range(1, 5) for i in range(300)]
    values = hamming.distinct_values(table(spark, hashes)).cache()
    assert hamming.choose_bands(values, 3)[0] <= 5


def test_copies_of_a_large_key_are_few(spark):
    """Rows of one key are copied once per block; with a tile of two that was half as often as the key has rows."""
    rows = spark.range(3000).select(F.lit(1).alias("bits"), F.col("id").alias("h"))
    left, right = hamming.tiled(rows, ["bits"], 2)
    assert left.count() + right.count() <= 3000 * (hamming.FEW_BLOCKS + 1)
    a, b = (x.select("_i", "_j", F.col("h").alias(c)) for x, c in ((left, "a"), (right, "b")))
    met = a.join(b, ["_i", "_j"]).filter((F.col("_i") != F.col("_j")) | (F.col("a") < F.col("b")))
    assert met.select("a", "b").distinct().count() == met.count() == 3000 * 2999 // 2


@pytest.mark.parametrize("t", [0, 3, 6])
def test_leader_groups_equal_the_sequential_scan(spark, t):
    hashes = near_copies(10 + t, 300, flips=5)
    got = {r.item_id: r.leader_ord for r in grouping.leader_groups(table(spark, hashes), t).collect()}
    assert got == greedy(hashes, t)


def test_groups_are_not_transitive(spark):
    hashes = [0b0, 0b111, 0b111111]  # neighbours are 3 apart, the ends 6
    groups = grouping.leader_groups(table(spark, hashes), 3).orderBy("ord").collect()
    assert [(r.item_id, r.group_no, r.member_pos) for r in groups] == [(0, 1, 0), (1, 1, 1)]


def test_long_chain_is_settled(spark):
    hashes = [(1 << i) - 1 for i in range(40)]
    got = {r.item_id: r.leader_ord for r in grouping.leader_groups(table(spark, hashes), 1).collect()}
    assert got == greedy(hashes, 1)


def greedy_edges(edges):
    """Owners by the sequential scan over an edge list."""
    later = {}
    for a, b in edges:
        later.setdefault(min(a, b), []).append(max(a, b))
    owner = {}
    for x in sorted({x for e in edges for x in e}):
        if x not in owner:
            for y in later.get(x, []):
                owner.setdefault(y, x)
    return owner


def test_chains_take_few_rounds(spark, monkeypatch):
    """A chain of 1,000 in scan order, one that branches, and one that meets itself again."""
    edges = [(i, i + 1) for i in range(1000)]
    edges += [(2000, 2001), (2001, 2002), (2001, 2003), (2002, 2004), (2003, 2005), (2005, 2006), (2004, 2006), (2006, 2007)]
    saved = []

    class Counted(grouping.Rounds):
        def save(self, df):
            saved.append(self.name)
            return super().save(df)

    monkeypatch.setattr(grouping, "Rounds", Counted)
    got = {r.ord: r.leader for r in grouping.lead_members(spark.createDataFrame(edges, "ord_a bigint, ord_b bigint")).collect()}
    assert got == greedy_edges(edges)
    assert saved.count("open-edges") <= 3 and saved.count("chains") <= 14


@pytest.mark.parametrize("seed", [1, 2])
def test_leaders_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = sorted({tuple(sorted(rng.sample(range(400), 2))) for _ in range(450)})
    got = {r.ord: r.leader for r in grouping.lead_members(spark.createDataFrame(edges, "ord_a bigint, ord_b bigint")).collect()}
    assert got == greedy_edges(edges)


def test_nothing_similar(spark):
    groups = grouping.leader_groups(table(spark, [0, -1]), 5)
    assert groups.count() == 0
    assert aggregates.groups_of_two_or_more(groups, "leader_ord").count() == 0


def test_similar_items_count_their_copies(spark):
    r = grouping.similar_items(table(spark, [7, 7, 6, 7, 6]), 1).collect()
    assert [tuple(x) for x in r] == [(0, 2, 1, 3, 2)]


# ---------------------------------------------------------------- cosine


def vectors(seed, n, dim=8, centres=6, spread=0.25):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(centres, dim))
    v = base[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, dim))
    v[:: 3] = v[0]  # a third of all vectors are copies
    return v


def frame(spark, v):
    rows = [(i, i, [float(x) for x in row]) for i, row in enumerate(v)]
    return spark.createDataFrame(rows, "item_id bigint, ord bigint, features array<double>")


def distances(v):
    norms = np.linalg.norm(v, axis=1, keepdims=True)
    u = v / np.maximum(norms, 1e-12)
    d = 1 - u @ u.T
    np.fill_diagonal(d, 0)
    return d


def loop_dbscan(v, eps, min_samples):
    near = distances(v) <= eps
    core = near.sum(axis=1) >= min_samples
    label, n = np.full(len(v), -1), 0
    for i in range(len(v)):
        if label[i] != -1 or not core[i]:
            continue
        label[i], todo = n, [i]
        while todo:
            for j in np.nonzero(near[todo.pop()])[0]:
                if label[j] == -1:
                    label[j] = n
                    if core[j]:
                        todo.append(j)
        n += 1
    return {i: int(x) for i, x in enumerate(label)}


@pytest.mark.parametrize("cell_size,tile", [(4096, 2048), (20, 7), (60, 500)])
def test_cosine_pairs_are_all_pairs(spark, cell_size, tile):
    v = vectors(3, 240)
    got = [(r.ord_a, r.ord_b) for r in cosine.cosine_pairs(frame(spark, v), 0.08, cell_size=cell_size, tile=tile).collect()]
    first = {}
    for i, row in enumerate(map(tuple, v)):
        first.setdefault(row, i)
    keep = sorted(first.values())
    d = distances(v)
    want = {(a, b) for i, a in enumerate(keep) for b in keep[i + 1 :] if d[a, b] <= 0.08}
    assert len(got) == len(set(got)) and set(got) == want


def clustered(n, clusters=12, dim=48, noise=0.4, seed=1):
    """Vectors around orthogonal directions; the noise is spread over all dimensions."""
    rng = np.random.default_rng(seed)
    base = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:clusters]
    return base[rng.integers(clusters, size=n)] + noise / np.sqrt(dim) * rng.normal(size=(n, dim))


def test_tiles_of_clustered_vectors_are_few(spark):
    """At eps 0.5 heads and tails rule out most pairs of blocks, and no pair is lost."""
    v = clustered(1500)
    eps, cell, tile = 0.5, 50, 50
    values = frame(spark, v).select("ord", "features", F.lit(1).cast("bigint").alias("mark"))
    index = cosine.build_index(values, len(v), cell)
    tiles = cosine.deal_tiles(index, eps, tile).groupBy(*cosine.TILE).agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    sizes = [(r.a, r.b or r.a) for r in tiles.collect() if r.a and (r.b or (r.kind == 0 and r.x == r.y))]
    blocks = sum(max(1, -(-int(s) // tile)) for s in index.sizes)
    assert len(sizes) < 0.3 * blocks * (blocks + 1) / 2
    assert sum(a * b for a, b in sizes) < 0.25 * len(v) ** 2 / 2
    got = {(r.ord_a, r.ord_b) for r in cosine.vector_pairs(values, eps, cell, tile).collect()}
    a, b = np.nonzero(np.triu(distances(v) <= eps, 1))
    assert got == set(zip(a.tolist(), b.tolist()))


@pytest.mark.parametrize("n", [1000, 2000])
def test_copies_of_a_vector_stay_few(spark, n):
    """Where nothing can be ruled out, a vector is dealt once per block, and small tiles grow with the table."""
    v = np.random.default_rng(5).normal(size=(n, 8))
    values = frame(spark, v).select("ord", "features", F.lit(1).cast("bigint").alias("mark"))
    index = cosine.build_index(values, n, 20)
    assert cosine.deal_tiles(index, 0.95, 7).count() <= 1.5 * cosine.MOST_BLOCKS * n


def test_dense_ball_leaves_few_rows(spark):
    """Of the 10^7 near pairs of a ball, tiles pass on one row per vector."""
    rng = np.random.default_rng(4)
    v = np.ones((4000, 6)) + 0.01 * rng.normal(size=(4000, 6))
    values = frame(spark, v).select("ord", "features", F.lit(1).cast("bigint").alias("mark"))
    index = cosine.build_index(values, len(v), 4096)
    counts = cosine.neighbour_counts(index, 0.1, 1024)
    assert counts.filter("near = 3999").count() == 4000
    cores = frame(spark, v).select("ord", F.lit(True).alias("core"))
    links = cosine.core_links(index, cores, 0.1, 1024)
    assert 3999 <= links.count() <= 5 * 4000
    got = grouping.density_clusters(frame(spark, v), 0.1, 5, tile=1024).select("cluster").distinct().collect()
    assert [r.cluster for r in got] == [0]


@pytest.mark.parametrize("cell_size,tile", [(20, 7), (4096, 2048)])
def test_density_clusters_of_small_tiles(spark, cell_size, tile):
    v = clustered(300, clusters=9, dim=20, noise=0.5, seed=3)
    got = {r.item_id: r.cluster for r in grouping.density_clusters(frame(spark, v), 0.22, 4, cell_size=cell_size, tile=tile).collect()}
    want = loop_dbscan(v, 0.22, 4)
    assert got == want and len(set(want.values())) > 3


def test_no_vectors_no_clusters(spark):
    assert grouping.density_clusters(frame(spark, np.zeros((0, 2))), 0.1, 2).collect() == []
    assert [r.cluster for r in grouping.density_clusters(frame(spark, np.zeros((2, 2))), 0.1, 2).collect()] == [-1, -1]


@pytest.mark.parametrize("eps,min_samples", [(0.05, 2), (0.05, 4), (0.03, 3)])
def test_density_clusters_match_a_loop(spark, eps, min_samples):
    v = vectors(7, 150)
    got = {r.item_id: r.cluster for r in grouping.density_clusters(frame(spark, v), eps, min_samples).collect()}
    assert got == loop_dbscan(v, eps, min_samples)


def test_zero_vectors_are_noise(spark):
    v = np.array([[0.0, 0], [1, 0], [1, 0.01], [0, 0]])
    got = {r.item_id: r.cluster for r in grouping.density_clusters(frame(spark, v), 0.1, 2).collect()}
    assert got == {0: -1, 1: 0, 2: 0, 3: -1}


def test_border_point_joins_the_smaller_label(spark):
    angles = np.deg2rad([0, 1, 2, 12, 22, 23, 24])
    v = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    eps = 1 - np.cos(np.deg2rad(10.5))
    got = {r.item_id: r.cluster for r in grouping.density_clusters(frame(spark, v), eps, 4).collect()}
    assert got == loop_dbscan(v, eps, 4)


def test_components_of_a_hub_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(1000, 1060)]
    df = spark.createDataFrame(edges, "ord_a bigint, ord_b bigint")
    got = {r.ord: r.component for r in grouping.connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(200)}, **{i: 1000 for i in range(1000, 1061)}}


def test_text_without_words_has_no_fingerprint(spark):
    rows = [(1, "a b"), (2, "..."), (3, "B a"), (4, "élan vital"), (5, "lan vital"), (6, "вода и лес"), (7, "Лес, И ВОДА!"), (8, "水 火"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.h for r in fingerprints.text_fingerprint(docs).collect()}
    assert set(got) == {1, 3, 4, 5, 6, 7, 8} and got[1] == got[3] and got[4] != got[5] and got[6] == got[7]
