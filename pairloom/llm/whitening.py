"""Whitening of embeddings by spectral divide and conquer.

Vectors are put on a grid of whole numbers, so sums and products are exact and
don't depend on the partitioning.  The covariance of the distinct vectors (one
d x d matrix; d is the vectors' length, not the table's) is split on the driver:
the polar factor of the shifted matrix, found by QDWH iterations, tells the
eigenvectors above the shift from those below, a projector gives a basis of
either side, and both halves are split in the same way down to single
components.  Means and components are sent to all tasks, which whiten every row
where it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pairloom.llm.common import map_arrow
from pairloom.session import materialise

SCALE = 256
COMPONENTS = 4
EPS = np.finfo(np.float64).eps
# Digits of products that stay exact in a matrix product of doubles, and the rows that are multiplied at once.
DIGIT, ROWS = 20, 4096
# Exact sums travel as four numbers of 48 bits.
PART, PARTS = 48, 4


# --- spectral divide and conquer -------------------------------------------------------------------------------


def polar(a: np.ndarray, rounds: int = 30) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by dynamically weighted Halley iterations in QR form."""
    m = len(a)
    x, low = a / np.abs(a).sum(0).max(), EPS
    for _ in range(rounds):
        square = low * low
        gamma = np.cbrt(4 * (1 - square) / (square * square)) if low < 1 else 0.0
        root = np.sqrt(1 + gamma)
        weight = root + 0.5 * np.sqrt(8 - 4 * gamma + 8 * (2 - square) / (square * root))
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(m)]))
        after = b / c * x + (weight - b / c) / np.sqrt(c) * q[:m] @ q[m:].T
        after = (after + after.T) / 2
        low = min(1.0, low * (weight + b * square) / (1 + c * square))
        moved, x = np.linalg.norm(after - x), after
        if moved <= np.cbrt(EPS) and abs(1 - low) <= 10 * EPS:
            break
    return x


def _halves(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Bases of the invariant subspaces above and below the shift, and what they leave coupled; None if one is empty."""
    m = len(a)
    above = (polar(a - shift * np.eye(m)) + np.eye(m)) / 2
    k = int(round(float(np.trace(above))))
    if not 0 < k < m:
        return None
    basis = np.linalg.qr(above @ np.random.default_rng(m).standard_normal((m, k)))[0]
    for _ in range(2):
        basis = np.linalg.qr(above @ basis)[0]
    whole = np.linalg.qr(basis, mode="complete")[0]
    up, down = whole[:, :k], whole[:, k:]
    return up, down, float(np.linalg.norm(down.T @ a @ up))


def eigen(a: np.ndarray, scale: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) of a symmetric matrix, in no order.

    Where all of a block's eigenvalues are equal to double precision any basis
    is taken.
    """
    m, scale = len(a), scale if scale is not None else float(np.linalg.norm(a))
    diagonal = np.diag(a).copy()
    if m == 1 or np.linalg.norm(a - np.diag(diagonal)) <= EPS * scale:
        return diagonal, np.eye(m)
    centre, spread = float(diagonal.mean()), float(np.linalg.norm(a - diagonal.mean() * np.eye(m)))
    best = None
    # The mean lies between the least and the largest eigenvalue; the others help where an eigenvalue is next to it.
    for shift in (float(np.median(diagonal)), centre, *(centre + spread / m * t for t in (0.1, -0.1, 0.37, -0.37, 0.8, -0.8))):
        halves = _halves(a, shift)
        if halves and (best is None or halves[2] < best[2]):
            best = halves
        if best and best[2] <= 8 * m * EPS * scale:
            break
    if best is None:
        return diagonal, np.eye(m)
    parts = []
    for basis in best[:2]:
        block = basis.T @ a @ basis
        values, vectors = eigen((block + block.T) / 2, scale)
        parts.append((values, basis @ vectors))
    return np.concatenate([parts[0][0], parts[1][0]]), np.concatenate([parts[0][1], parts[1][1]], axis=1)


def principal(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `most` eigenvalues, falling, and their eigenvectors (columns); none that are zero to double precision."""
    values, vectors = eigen(covariance)
    # What rounding left of neighbouring components in each other is taken out to first order.
    inside = vectors.T @ covariance @ vectors
    gaps = np.diag(inside)[None, :] - np.diag(inside)[:, None]
    scale = float(np.linalg.norm(covariance))
    apart = np.abs(gaps) > 1e3 * EPS * scale
    vectors = vectors + vectors @ np.where(apart, inside / np.where(apart, gaps, 1.0), 0.0)
    vectors /= np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,ik,kj->j", vectors, covariance, vectors)
    order = [i for i in np.argsort(-values, kind="stable") if values[i] > len(values) * EPS * scale][:most]
    values, vectors = values[order], vectors[:, order]
    top = np.abs(vectors).argmax(0) if order else np.zeros(0, int)
    return values, vectors * np.where(vectors[top, np.arange(len(order))] < 0, -1.0, 1.0)


# --- exact sums ------------------------------------------------------------------------------------------------


def _pieces(number: int) -> list[int]:
    """The number as PARTS numbers of PART bits; the last has the sign."""
    return [number >> PART * k & (1 << PART) - 1 for k in range(PARTS - 1)] + [number >> PART * (PARTS - 1)]


def _gram(y: np.ndarray) -> np.ndarray:
    """y^T y in whole numbers of any size."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    if y.dtype == object:
        return total + y.T.dot(y)
    for at in range(0, len(y), ROWS):
        rest, digits = y[at : at + ROWS], []
        while len(digits) == 0 or rest.any():
            low = (rest & (1 << DIGIT) - 1) - ((rest & 1 << DIGIT - 1) << 1)
            digits.append(low.astype(np.float64))
            rest = (rest - low) >> DIGIT
        for i, one in enumerate(digits):
            for j, two in enumerate(digits):
                total += (one.T @ two).astype(np.int64).astype(object) << DIGIT * (i + j)
    return total


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, d)


def _centred(x: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """x - middle; in Python's numbers where that leaves 63 bits."""
    if len(x) and max(abs(int(x.max())), abs(int(x.min()))) >= 1 << 61 or max(map(abs, map(int, middle)), default=0) >= 1 << 61:
        return x.astype(object) - np.array([int(m) for m in middle], object)
    return x - middle


def _summed(partials: DataFrame) -> dict[tuple[int, int], int]:
    """Exact totals by (i, j); at most one row per pair of dimensions comes to the driver."""
    long = lambda k: F.sum(F.col(f"v{k}").cast("decimal(38,0)")).alias(f"v{k}")
    rows = partials.groupBy("i", "j").agg(*[long(k) for k in range(PARTS)]).collect()
    return {(r["i"], r["j"]): sum(int(r[f"v{k}"]) << PART * k for k in range(PARTS)) for r in rows}


SUMS = ", ".join(["i int", "j int", *(f"v{k} bigint" for k in range(PARTS))])


def _sum_rows(values: dict[tuple[int, int], int]) -> pa.RecordBatch:
    i, j = zip(*values) if values else ((), ())
    parts = list(zip(*map(_pieces, values.values()))) if values else [()] * PARTS
    columns = [pa.array(list(i), pa.int32()), pa.array(list(j), pa.int32()), *(pa.array(list(p), pa.int64()) for p in parts)]
    return pa.RecordBatch.from_arrays(columns, names=["i", "j", *(f"v{k}" for k in range(PARTS))])


def first_moments(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and the sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n += len(x)
            # Upper and lower halves can't overflow in a batch.
            total = total + ((x >> 32).sum(0).astype(object) << 32) + (x & (1 << 32) - 1).sum(0).astype(object)
        yield _sum_rows({(-1, -1): n} | {(k, k): int(v) for k, v in enumerate(total)})

    sums = _summed(map_arrow(fit.select("x"), run, SUMS))
    return sums.get((-1, -1), 0), [sums.get((k, k), 0) for k in range(d)]


def covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance with divisor n; vectors are centred to the nearest whole numbers first, the rest of the shift is exact."""
    d = len(sums)
    middle = [(2 * s + n) // (2 * n) for s in sums]
    taken = np.array(middle, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for batch in batches:
            total = total + _gram(_centred(_matrix(batch.column(0), d), taken))
        yield _sum_rows({(i, j): int(total[i, j]) for i in range(d) for j in range(i, d)})

    products = _summed(map_arrow(fit.select("x"), run, SUMS))
    rest = [s - n * m for s, m in zip(sums, middle)]
    out = np.empty((d, d))
    for (i, j), value in products.items():
        out[i, j] = out[j, i] = (n * value - rest[i] * rest[j]) / (n * n)
    return out


# --- rows ------------------------------------------------------------------------------------------------------


def on_grid(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * entry) as longs (the largest and least long beyond their range)."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(False))


def _whole(rows: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over dimensions of (n * x - S)^2, exact, as decimals of 38 digits (null beyond)."""
    centre = np.array([s / n for s in sums])
    about = ((rows - centre) ** 2).sum(1) * float(n) ** 2
    # Arithmetic modulo 2^64 is exact where the result fits.
    wrap = np.uint64((1 << 64) - 1)
    turned = np.array([s & int(wrap) for s in sums], np.uint64)
    off = rows.view(np.uint64) * np.uint64(n & int(wrap)) - turned
    out = pa.array((off * off).sum(1, dtype=np.uint64).view(np.int64)).cast(pa.decimal128(38, 0))
    large = np.flatnonzero(~(about < 2.0**62))
    if len(large):
        import decimal

        values = out.to_pylist()
        for r in large.tolist():
            exact = sum((n * int(x) - s) ** 2 for x, s in zip(rows[r], sums))
            values[r] = decimal.Decimal(exact) if exact < 10**38 else None
        out = pa.array(values, pa.decimal128(38, 0))
    return out


def whitened(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """For each usable row and each component: id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null, NaN or infinite entries are left
    out, and those of another length than most rows have (the longer one of
    equally frequent lengths).  The fit list is each distinct vector once, so
    copies count once; every row gets its values.  Components whose eigenvalue
    is zero are left out, so a table with one distinct vector, one of empty
    vectors and an empty table give an empty result.  Of equal eigenvalues the
    components are some basis of their space.  Other columns are ignored.
    `deviation` is null beyond 38 digits.
    """
    kind = vectors.schema[id_column].dataType
    rows = vectors.select(F.col(f"`{id_column}`").alias(id_column), F.col(f"`{vector}`").alias("__v")).where(usable(F.col("__v")))
    rows = rows.select(id_column, on_grid(F.col("__v"), scale).alias("x"))
    schema = T.StructType([
        T.StructField(id_column, kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
    ])
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), F.desc("d")).limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    error = F.lit(None).cast("double").alias("identity_error")
    if not d:
        return vectors.sparkSession.createDataFrame([], schema).select("*", error)
    rows = rows.where(F.size("x") == d)
    fit = materialise(rows.select("x").distinct())
    n, sums = first_moments(fit, d)
    matrix = covariance(fit, n, sums)
    values, basis = principal(matrix, components)
    k = len(values)
    if not k:
        return vectors.sparkSession.createDataFrame([], schema).select("*", error)
    share = values / float(np.trace(matrix))
    mean = np.array([s / n for s in sums])
    known = vectors.sparkSession.sparkContext.broadcast((mean, basis / np.sqrt(values)))

    def scores(x: np.ndarray) -> np.ndarray:
        centre, directions = known.value
        return (x - centre) @ directions

    def of_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = scores(_matrix(batch.column(0), d))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(w[:, i])) for i in range(k)], names=[f"w{i}" for i in range(k)])

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = np.ascontiguousarray(_matrix(part.column(1), d))
                each = np.repeat(np.arange(len(x)), k)
                take = pa.array(each)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(each), n)), _whole(x, n, sums).take(take),
                        pa.array(scores(x).reshape(-1)), pa.array(np.tile(share, len(x))),
                    ],
                    names=schema.names,
                )

    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = map_arrow(fit, of_fit, ", ".join(f"w{i} double" for i in range(k))).agg(
        *[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]
    ).first()
    error = max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    return map_arrow(rows, of_rows, schema).select("*", F.lit(float(error)).alias("identity_error"))
