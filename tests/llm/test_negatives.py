"""Scores against matrix products, whole tables and odd rows against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrank.llm import negatives as N

SF = "/root/testdata/sf0.01"
KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, scale=256, positives=5, negatives=3, low=50, high=95, moved=True):
    """Answers of (vec_id, vector, label) rows with whole vectors and ids."""
    ids = np.array([r[0] for r in rows])
    labels = np.array([(r[2] + 1) % 10 if moved and r[0] % 7 == 0 else r[2] for r in rows])
    v = np.floor(scale * np.array([r[1] for r in rows], float)).astype(np.int64)
    out = []
    for k in np.flatnonzero(ids % 50 == 0):
        s = v @ v[k]
        order = np.lexsort((ids, -s))
        for p in [i for i in order if i != k and labels[i] == labels[k]][:positives]:
            fits = [i for i in order if labels[i] != labels[k] and low * s[p] <= 100 * s[i] <= high * s[p]]
            out += [(ids[k], ids[p], r, ids[i], s[p], s[i]) for r, i in enumerate(fits[:negatives], 1)]
    return sorted(tuple(map(int, r)) for r in out)


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = sorted(tuple(r) for r in N.op12_hard_negative_mining(spark, SF).collect())
    assert got == brute([(r.vec_id, r.embedding, r.label) for r in table])


@pytest.mark.parametrize("width,top", [(1, 1), (8, 3), (13, 300), (64, 2000), (40, 2**20)])
def test_scores_are_inner_products(width, top):
    rng = np.random.default_rng(width)
    v = rng.integers(-top, top + 1, (300, width))
    groups, bits = -(-width // 8), int(top).bit_length() + 1
    full = np.zeros((300, 8 * groups), np.int64)
    full[:, :width] = v
    planes = np.stack([np.packbits((full >> p & 1).astype(np.uint8), axis=1, bitorder="little") for p in range(bits)], axis=1)
    assert (N.values_of(planes) == full).all()
    assert (N.scores(planes, N.subset_sums(full[:270], np.int64)) == v @ v[:270].T).all()


@pytest.mark.parametrize("group,slice_", [(4, 16), (4096, 4096)])
def test_cells_ties_and_hot_labels(spark, group, slice_):
    rng = np.random.default_rng(7)
    rows = [(i, rng.integers(-2, 3, 10).tolist(), 0 if i % 3 else i % 10) for i in range(0, 1200, 2)]  # few values: many ties
    table = spark.createDataFrame([(i, [x / 256 for x in v], int(c)) for i, v, c in rows], KIND)
    found = N.hard_negatives(table, F.col("vec_id") % 50 == 0, group=group, slice_=slice_)
    assert sorted(tuple(r) for r in found.collect()) == brute([(i, np.array(v) / 256, c) for i, v, c in rows], moved=False)


def test_odd_rows(spark):
    good = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.6, 0.0], 2), (3, [0.5, 0.5], 3), (7, [0.7, 0.0], 2), (50, [0.0, 1.0], 4), (100, [0.0, 0.0], 1)]
    bad = [(150, None, 1), (4, [None, 1.0], 2), (5, [float("nan"), 1.0], 2), (6, [float("inf"), 1.0], 2), (8, [0.8, 0.0], None)]
    table = spark.createDataFrame(good + bad, KIND)
    for name in ("id", "row", "anchor", "v", "planes", "score", "rank"):
        table = table.withColumn(name, F.lit("clash"))
    anchors = F.col("vec_id") % 50 == 0
    got = sorted(tuple(r) for r in N.hard_negatives(table, anchors).collect())
    assert got == brute(good, moved=False) and len(got) > 0
    again = sorted(tuple(r) for r in N.hard_negatives(table.union(table.filter("vec_id = 0")), anchors).collect())
    assert [r for r in again if r[0] == 0 and r[1] == 0] == sorted([(0, 0, k, i, 65536, s) for k, i, s in ((1, 7, 45824), (2, 2, 39168), (3, 3, 32768))] * 2)
    short = spark.createDataFrame([(0, [1.0], 1), (1, [0.75, 0.5], 1), (None, [0.5], 2), (None, [0.5], 3), (9, [0.5, 9.0], 2)], KIND)
    rows = [tuple(r) for r in N.hard_negatives(short, anchors).collect()]
    assert sorted(rows, key=lambda r: r[2]) == [(0, 1, 1, 9, 49152, 32768), (0, 1, 2, None, 49152, 32768), (0, 1, 3, None, 49152, 32768)]


def test_empty_and_refused(spark):
    anchors = F.col("vec_id") % 50 == 0
    for rows in ([], [(0, None, 1)], [(1, [1.0], 1), (2, [1.0], 2)], [(0, [1.0], 1)], [(0, [], 1), (1, [], 1)]):
        out = N.hard_negatives(spark.createDataFrame(rows, KIND), anchors)
        assert out.collect() == [] and out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    with pytest.raises(ValueError):
        N.hard_negatives(spark.createDataFrame([(0, [1e9], 1), (1, [1e9], 1)], KIND), anchors)
