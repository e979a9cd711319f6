"""Exact polynomials against plain integer arithmetic, roots and components against NumPy, whole tables against brute force."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrank.llm import whitening as W

SF = "/root/testdata/sf0.01"
KIND = "vec_id long, embedding array<float>, label int"


def plain_polynomial(m):
    """Faddeev-LeVerrier in fractions, constant first."""
    d = len(m)
    m = [[Fraction(v) for v in row] for row in m]
    out, aux = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        aux = [[sum(m[i][x] * aux[x][j] for x in range(d)) + (out[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        product = [[sum(m[i][x] * aux[x][j] for x in range(d)) for j in range(d)] for i in range(d)]
        out.append(-sum(product[i][i] for i in range(d)) / k)
    return [int(c) for c in reversed(out)]


def gram(d, rank, seed, size=9):
    rng = random.Random(seed)
    a = [[rng.randint(-size, size) for _ in range(d)] for _ in range(rank)]
    return [[sum(r[i] * r[j] for r in a) for j in range(d)] for i in range(d)]


MATRICES = {
    "full": gram(8, 12, 1), "rank 3 of 7": gram(7, 3, 2), "wide numbers": gram(6, 9, 3, 10**9), "one": [[5]], "two": gram(2, 5, 4),
    "diagonal": [[4 if i == j else 0 for j in range(6)] for i in range(6)],
    "blocks": [[(3, 1, 0, 0), (1, 3, 0, 0), (0, 0, 3, 1), (0, 0, 1, 3)][i][j] for i in range(4) for j in range(4)],
    "swap": [[2, 0, 1], [0, 2, 0], [1, 0, 2]],
}
MATRICES["blocks"] = [MATRICES["blocks"][4 * i : 4 * i + 4] for i in range(4)]


@pytest.mark.parametrize("name", MATRICES)
def test_polynomials(name):
    m = MATRICES[name]
    primes = W.enough_primes(m)
    assert W.chinese_remainder([(p, W.polynomial_modulo(m, p)) for p in primes]) == plain_polynomial(m)


@pytest.mark.parametrize("name", MATRICES)
def test_roots_and_components(name):
    m = MATRICES[name]
    roots = W.largest_roots(plain_polynomial(m), len(m))
    values = np.linalg.eigvalsh(np.array(m, float))[::-1]
    rank = np.linalg.matrix_rank(np.array(m, float))
    assert sum(r.count for r in roots) == rank
    found = [r.value / 2**W._FRACTION_BITS for r in roots for _ in range(r.count)]
    assert np.allclose(found, values[:rank], rtol=1e-9)
    basis = np.array([[float(x) for x in v] for r in roots for v in W.null_space(m, r)])
    assert np.allclose(basis @ basis.T, np.eye(rank), atol=1e-14)
    assert np.allclose(basis @ np.array(m, float), np.array(found)[:, None] * basis, rtol=1e-12, atol=1e-12 * values[0])


def test_primes():
    assert [p for p in range(5, 2000, 2) if W.is_prime(p)] == [p for p in range(5, 2000, 2) if all(p % q for q in range(3, p, 2))]


def brute(vectors, k=16):
    """(n, deviation, whitened, explained) of whole integer vectors."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    cov = centred.T @ centred / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    keep = values > 1e-9 * max(values.max(), 1e-300)
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ basis[:, keep] / np.sqrt(values[keep]), values[keep] / np.trace(cov)


def agrees(rows, ids, vectors, whole=True):
    n, deviation, whitened, explained = brute(vectors)
    k = len(explained)
    rows = sorted(rows, key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component) for r in rows] == sorted((i, c + 1) for i in ids for c in range(k))
    order = np.argsort(ids, kind="stable")
    assert {r.n for r in rows} == {n} and all(r.identity_error < 1e-9 for r in rows)
    assert [r.deviation for r in rows] == np.repeat(deviation[order], k).tolist()
    assert np.allclose([r.explained for r in rows[:k]], explained, rtol=1e-9)
    if whole:
        got = np.array([r.whitened for r in rows]).reshape(-1, k)
        signs = np.sign((got * whitened[order]).sum(axis=0))
        assert np.allclose(got, whitened[order] * signs, atol=1e-8)


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    agrees(W.op11_embedding_whitening(spark, SF).collect(), [r.vec_id for r in table], [r.embedding for r in table])


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(40)]
    good += [(40, good[3][1]), (3, good[3][1]), (41, [0.5, 0.25])]
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [float("nan"), 0.0, 0.0]), (53, [float("inf"), 0.0, 0.0]), (54, [0.0, float("-inf"), 0.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in good + bad], KIND)
    for name in ("id", "y", "component", "n"):
        table = table.withColumn(name, F.lit("clash"))
    rows = [r for r in W.whiten(table, W.fit_whitening(table)).collect() if r.vec_id != 3]
    want = [(i, v + [0.0] * (3 - len(v))) for i, v in good]
    n, deviation, whitened, explained = brute([v for _, v in want])
    assert len(rows) == 3 * 41 and {r.n for r in rows} == {n} == {41}
    by = {(i): d for (i, _), d in zip(want, deviation.tolist())}
    assert all(r.deviation == by[r.vec_id] for r in rows)
    assert np.allclose([r.explained for r in sorted(rows, key=lambda r: r.component)][::41], explained)


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.5])] * 3, [(1, []), (2, [])], [(1, None)], [(None, [1.0]), (None, [1.0])]])
def test_tables_without_variance(spark, rows):
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], KIND)
    out = W.whiten(table, W.fit_whitening(table))
    assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_repeated_variances_and_wide_entries(spark):
    cube = [(8 * a + 4 * b + 2 * c, [float(a), float(b), float(c), 3.0]) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    table = spark.createDataFrame([(i, v, 1) for i, v in cube], KIND)
    model = W.fit_whitening(table)
    assert np.allclose(model.explained, [1 / 3] * 3) and model.identity_error < 1e-12
    wide = spark.createDataFrame([(1, [1e30, 1.0], 1), (2, [-1e30, 2.0], 1), (3, [0.0, 0.0], 1)], KIND)
    rows = W.whiten(wide, W.fit_whitening(wide)).collect()
    assert len(rows) == 6 and all(r.deviation is None for r in rows if r.vec_id < 3) and all(abs(r.whitened) < 2 for r in rows)
