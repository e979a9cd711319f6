"""Operator 11, whitening of embeddings from an exact characteristic polynomial.

1. Entries become integers, ``floor(scale * c)``. The fit list holds each
   distinct integer vector once; its count, sums and sums of products are
   exact whole numbers, added up by tasks and Spark. A common shift of all
   entries (``offset``) cancels in everything that is returned.
2. ``n * sum(x x') - S S'`` is an integer matrix, n squared times the
   covariance. Its characteristic polynomial is found modulo as many primes
   below 2^31 as its coefficients need, each prime a row of a Spark table: the
   matrix is brought to Hessenberg form and the polynomial read off by
   recurrence. Chinese remaindering gives the exact coefficients.
3. All roots are real and none is negative, so the number of roots above a
   point is the number of sign changes of the polynomial shifted there.
   Bisection by exact counts isolates the largest roots, by exact signs it
   refines single ones. A multiple root stays one interval with its count.
4. The component of a root is the null space of the matrix less the root,
   found by inverse iteration in decimals of ``DIGITS`` places, each root a
   row of a Spark table; vectors of one root are made orthogonal.
5. Rows are projected in Arrow batches. Nothing but the sums (d x d), the
   polynomials and the components reaches the driver.

Defined results: a row takes no part if its vector is null or holds a null or
an entry that is not finite. Shorter vectors count as padded with zeros.
Repeated rows and ids give their rows again and count once in the fit list.
Components without variance are left out, so a table of one distinct vector,
of empty vectors or without rows gives an empty result. An entry beyond the
range of a long is cut to it; a ``deviation`` beyond it is null.
"""

from __future__ import annotations

from decimal import Decimal, localcontext
from math import gcd, isqrt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.llm.registry import embeddings, query
from lumenrank.session import materialise

SCALE = 64
COMPONENTS = 16
DIGITS = 70  # decimals of the inverse iteration
ROOT_BITS = 120  # relative precision of a root
_FRACTION_BITS = 160  # roots are searched among multiples of 2^-160
_TOP_PRIME = 2**31
_LIMB_BITS = 100
_LONG = 2**63 - 1


def usable(vector: Column) -> Column:
    """Whether a vector and all its entries are there and finite."""
    finite = F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    )
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def whole_vectors(vectors: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """``id`` and ``y``, the entries as integers, of the rows that take part."""
    return vectors.filter(usable(F.col(vector))).select(
        F.col(id_col).alias("id"), F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("y")
    )


def _matrix(column, width: int):
    """An Arrow list column as an integer matrix, short rows padded with zeros."""
    import numpy as np

    values = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())
    if width and (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _products(y):
    """``y' y`` in exact integers (object array)."""
    import numpy as np

    top = max(int(y.max()), -int(y.min())) if y.size else 0  # Python integers do not overflow
    room = 2**53 // max(1, top * top)
    if not room:
        y = y.astype(object)
        return y.T @ y
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), room):
        part = y[at : at + room].astype(np.float64)  # every sum is below 2^53, hence exact
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def _limbs(value: int) -> list[int]:
    """``value`` as numbers of ``_LIMB_BITS`` bits and its sign, lowest first; Spark adds them up as decimals."""
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value or not out:
        out.append(sign * (value & ((1 << _LIMB_BITS) - 1)))
        value >>= _LIMB_BITS
    return out


def exact_sums(fit_list: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of rows, sums per dimension and sums of products of ``y``, exactly."""
    import pyarrow as pa

    def add(batches):
        import numpy as np

        n, sums, products = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            y = _matrix(batch.column(0), width)
            n += len(y)
            for at in range(0, len(y), 1 << 10):  # sums of halves stay within a long
                part = y[at : at + (1 << 10)]
                high = part >> 32
                sums = sums + high.sum(axis=0).astype(object) * 2**32 + (part - (high << 32)).sum(axis=0).astype(object)
            products = products + _products(y)
        if n:
            i, j = np.triu_indices(width)
            rows = [-2, *[-1] * width, *i.tolist()]
            cols = [0, *range(width), *j.tolist()]
            values = [n, *sums.tolist(), *products[i, j].tolist()]
            limbs = [(i, j, k, v) for i, j, whole in zip(rows, cols, values) for k, v in enumerate(_limbs(int(whole)))]
            i, j, k, v = zip(*limbs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(k, pa.int32()), pa.array(map(Decimal, v), pa.decimal128(38, 0))],
                names=["i", "j", "k", "v"],
            )

    parts = fit_list.mapInArrow(add, "i int, j int, k int, v decimal(38,0)").groupBy("i", "j", "k").agg(F.sum("v").alias("v"))
    found: dict = {}
    for r in parts.collect():  # d (d + 3) / 2 + 1 numbers, some of two limbs
        found[r.i, r.j] = found.get((r.i, r.j), 0) + (int(r.v) << _LIMB_BITS * r.k)
    n = found.get((-2, 0), 0)
    sums = [found.get((-1, j), 0) for j in range(width)]
    return n, sums, [[found.get((min(i, j), max(i, j)), 0) for j in range(width)] for i in range(width)]


def scatter(n: int, sums: list[int], products: list[list[int]]) -> list[list[int]]:
    """n squared times the covariance, an integer matrix."""
    return [[n * p - sums[i] * sums[j] for j, p in enumerate(row)] for i, row in enumerate(products)]


def is_prime(p: int) -> bool:
    """Exact for odd numbers from 5 to 3.2 * 10^9 (Miller-Rabin with bases 2, 3, 5, 7)."""
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, p)
        if x in (1, p - 1) or base == p:
            continue
        for _ in range(twos - 1):
            x = x * x % p
            if x == p - 1:
                break
        else:
            return False
    return True


def enough_primes(matrix: list[list[int]]) -> list[int]:
    """Primes whose product exceeds twice any coefficient of the polynomial.

    With roots r >= 0 the coefficients' sizes add up to the product of
    (1 + r), which is largest when all are equal.
    """
    d = len(matrix)
    bound = 2 * (2 + sum(matrix[i][i] for i in range(d)) // d) ** d
    primes, product, p = [], 1, _TOP_PRIME - 1
    while product <= bound:
        if is_prime(p):
            primes.append(p)
            product *= p
        p -= 2
    return primes


def polynomial_modulo(matrix, p: int) -> list[int]:
    """Coefficients of ``det(x - matrix)`` modulo ``p``, constant first, by Hessenberg form."""
    import numpy as np

    h = np.array([[int(v) % p for v in row] for row in matrix], np.int64)
    d = len(h)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        k = m + int(below[0])
        if k != m:
            h[[m, k]] = h[[k, m]]
            h[:, [m, k]] = h[:, [k, m]]
        factors = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factors[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factors % p).sum(axis=1)) % p
    leading = np.zeros((d + 1, d + 1), np.int64)  # polynomials of the leading blocks
    leading[0, 0] = 1
    for k in range(1, d + 1):
        own = np.zeros(d + 1, np.int64)
        own[1:] = leading[k - 1, :-1]
        weights, below = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            weights[i] = below * int(h[i, k - 1]) % p
            below = below * int(h[i, i - 1]) % p if i else 0
        leading[k] = (own - (weights[:, None] * leading[:k] % p).sum(axis=0)) % p
    return leading[d].tolist()


def chinese_remainder(parts: list[tuple[int, list[int]]]) -> list[int]:
    """Coefficients between minus and plus half the product of the primes."""
    product, whole = 1, [0] * len(parts[0][1])
    for p, rest in parts:
        inverse = pow(product, -1, p)
        whole = [x + product * ((r - x) * inverse % p) for x, r in zip(whole, rest)]
        product *= p
    return [x - product if 2 * x > product else x for x in whole]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients, constant first; a task works on some of the primes."""
    primes = enough_primes(matrix)
    tasks = min(len(primes), 4 * spark.sparkContext.defaultParallelism)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int64()), pa.array([polynomial_modulo(matrix, p) for p in own], pa.list_(pa.int64()))],
                names=["p", "c"],
            )

    table = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
    rows = table.mapInArrow(run, "p long, c array<long>").collect()
    return chinese_remainder([(r.p, list(r.c)) for r in rows])


class Root(NamedTuple):
    """``count`` equal roots at ``value / 2^_FRACTION_BITS``."""

    value: int
    count: int


def _above(coefficients: list[int], point: int) -> int:
    """Number of roots above ``point`` of a polynomial with real roots only (sign changes of the shifted one)."""
    shifted = list(coefficients)
    for i in range(len(shifted) - 1):
        for j in range(len(shifted) - 2, i - 1, -1):
            shifted[j] += point * shifted[j + 1]
    signs = [x > 0 for x in shifted if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(coefficients: list[int], point: int) -> int:
    value = 0
    for c in reversed(coefficients):
        value = value * point + c
    return (value > 0) - (value < 0)


def largest_roots(coefficients: list[int], wanted: int) -> list[Root]:
    """The largest positive roots, at least ``wanted`` with their counts where there are so many."""
    d = len(coefficients) - 1
    zeros = next(k for k, c in enumerate(coefficients) if c)
    wanted = min(wanted, d - zeros)
    fine = [c << (_FRACTION_BITS * (d - k)) for k, c in enumerate(coefficients)][zeros:]
    top = 1 << (-coefficients[d - 1] << _FRACTION_BITS).bit_length()  # above the sum of the roots
    found, todo = [], [(0, top, d - zeros, 0)]  # roots in (low, high]: above low, above high
    while todo and sum(r.count for r in found) < wanted:
        low, high, above_low, above_high = todo.pop()
        count = above_low - above_high
        if not count:
            continue
        if count == 1 and high - low < high >> 8:
            found.append(Root(_refine(fine, low, high), 1))
        elif high - low <= max(1, high >> ROOT_BITS):
            found.append(Root((low + high) // 2, count))
        else:
            middle = (low + high) // 2
            above = _above(fine, middle)
            todo += [(low, middle, above_low, above), (middle, high, above, above_high)]
    return found


def _refine(coefficients: list[int], low: int, high: int) -> int:
    """The single root in (low, high] by exact signs."""
    at_high = _sign(coefficients, high)
    if not at_high:
        return high
    while high - low > max(1, high >> ROOT_BITS):
        middle = (low + high) // 2
        sign = _sign(coefficients, middle)
        if not sign:
            return middle
        low, high = (low, middle) if sign == at_high else (middle, high)
    return (low + high) // 2


def null_space(matrix: list[list[int]], root: Root) -> list[list[Decimal]]:
    """``root.count`` orthonormal vectors that the matrix less the root takes to nothing, by inverse iteration."""
    import numpy as np

    with localcontext() as context:
        context.prec = DIGITS
        d = len(matrix)
        a = np.array([[Decimal(v) for v in row] for row in matrix], object)
        least = max(abs(x) for x in a.ravel().tolist()) * Decimal(10) ** (10 - DIGITS)
        shift = Decimal(root.value) / (1 << _FRACTION_BITS)
        for i in range(d):
            a[i, i] -= shift
        order = list(range(d))
        for k in range(d):  # triangular factors, rows exchanged
            pivot = max(range(k, d), key=lambda i: abs(a[i, k]))
            if pivot != k:
                a[[k, pivot]] = a[[pivot, k]]
                order[k], order[pivot] = order[pivot], order[k]
            if abs(a[k, k]) < least:
                a[k, k] = least
            if k + 1 < d:
                a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
                a[k + 1 :, k + 1 :] -= np.multiply.outer(a[k + 1 :, k], a[k, k + 1 :])
        found: list = []
        for start in range(root.count):
            v = np.array([Decimal(1 + (i * i + 7 * start * i + start) % 11) for i in range(d)], object)
            for _ in range(3):
                w = v[order].copy()
                for k in range(d - 1):
                    w[k + 1 :] -= a[k + 1 :, k] * w[k]
                for k in range(d - 1, -1, -1):
                    w[k] /= a[k, k]
                    w[:k] -= a[:k, k] * w[k]
                for u in found + found:  # twice, against what the first leaves
                    w = w - (u * w).sum() * u
                v = w / (w * w).sum().sqrt()
            found.append(v)
        return [v.tolist() for v in found]


class Whitening(NamedTuple):
    """What a fit leaves: ``weights[k]`` takes ``n * y - sums`` to the whitened value of component k + 1."""

    width: int
    n: int
    sums: list[int]
    weights: list[list[float]]
    explained: list[float]
    identity_error: float


def fit_whitening(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE, components: int = COMPONENTS
) -> Whitening:
    """Components of the distinct integer vectors, largest variance first."""
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, vector, scale)
    width = rows.agg(F.max(F.size("y"))).first()[0] or 0
    nothing = Whitening(width, 0, [], [], [], 0.0)
    if not width:
        return nothing
    short = F.size("y") < width
    padded = F.when(short, F.concat("y", F.array_repeat(F.lit(0).cast("long"), width - F.size("y")))).otherwise(F.col("y"))
    fit_list = materialise(rows.select(padded.alias("y")).distinct(), "fit_list")
    n, sums, products = exact_sums(fit_list, width)
    matrix = scatter(n, sums, products)
    trace = sum(matrix[i][i] for i in range(width))
    if not trace:
        return nothing._replace(n=n)
    common = gcd(*(v for row in matrix for v in row))
    matrix = [[v // common for v in row] for row in matrix]
    roots = largest_roots(characteristic_polynomial(spark, matrix), components)
    weights, explained = _components(spark, matrix, roots, components, common, trace, n)
    model = Whitening(width, n, sums, weights, explained, 0.0)
    return model._replace(identity_error=identity_error(fit_list, model))


def _components(spark, matrix, roots: list[Root], components: int, common: int, trace: int, n: int):
    """Weights and explained shares; a task finds the vectors of one root."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for value, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = null_space(matrix, Root(int(value), count))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([value] * count), pa.array([[str(x) for x in v] for v in found], pa.list_(pa.string()))],
                    names=["value", "v"],
                )

    table = spark.createDataFrame([(str(r.value), r.count) for r in roots], "value string, count int")
    by: dict[int, list] = {}
    for r in table.repartition(len(roots)).mapInArrow(run, "value string, v array<string>").collect():
        by.setdefault(int(r.value), []).append([Decimal(x) for x in r.v])
    weights, explained = [], []
    with localcontext() as context:
        context.prec = DIGITS
        for root in sorted(by, reverse=True):
            variance = Decimal(root) / (1 << _FRACTION_BITS) * common  # of n * y
            for v in by[root]:
                sign = -1 if max(v, key=abs) < 0 else 1
                weights.append([float(sign * x / variance.sqrt()) for x in v])
                explained.append(float(variance / trace))
    return weights[:components], explained[:components]


def _deviations(y, model: Whitening):
    """``n * y - sums``, in longs where its squares add up to one, else in Python integers."""
    import numpy as np

    top = max(int(y.max()), -int(y.min())) if y.size else 0
    most = model.n * top + max(map(abs, model.sums))
    if most <= isqrt(_LONG // model.width):
        return model.n * y - np.array(model.sums, np.int64)
    return model.n * y.astype(object) - np.array(model.sums, object)


def identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance less the identity."""
    import pyarrow as pa

    k = len(model.weights)

    def add(batches):
        import numpy as np

        weights, total = np.array(model.weights).T, np.zeros((k, k))
        for batch in batches:
            w = _deviations(_matrix(batch.column(0), model.width), model).astype(np.float64) @ weights
            total += w.T @ w
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])

    sums = fit_list.mapInArrow(add, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    return max(abs(r.v / model.n - (r.i == r.j)) for r in sums)


def whiten(
    vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """One row per vector and component: ``component, n, deviation, whitened, explained, identity_error``."""
    import pyarrow as pa

    k = len(model.weights)
    rows = whole_vectors(vectors, id_col, vector, scale)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)

    def run(batches):
        import numpy as np

        weights = np.array(model.weights).T
        for batch in batches:
            x = _deviations(_matrix(batch.column(1), model.width), model)
            squares = (x * x).sum(axis=1)
            if squares.dtype == object:
                squares = np.array([v if v <= _LONG else None for v in squares.tolist()], object)
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    pa.array(np.repeat(squares, k), pa.int64(), from_pandas=True),
                    pa.array((x.astype(np.float64) @ weights).ravel()),
                    pa.array(np.tile(model.explained, m)),
                    pa.array(np.full(m * k, model.identity_error)),
                ],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)


@query()
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = embeddings(spark, sf_dir)
    return whiten(vectors, fit_whitening(vectors))
