"""Embedding whitening: centred covariance from tasks, its leading components by bisection and inverse iteration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Dimensions whose covariance the driver takes: 128 MB of doubles.
MOST_DIMENSIONS = 4096
#: Greatest size of an entry; floor(SCALE * c) of others is no whole number that doubles tell apart.
MOST_ENTRY = 2.0**40
#: Eigenvalues below this share of the greatest are rounding, and their components are left out.
RANK = 1e-12


# ---- the leading eigenpairs of a symmetric matrix

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal and off-diagonal of Q'AQ, and the Householder vectors of Q, of a symmetric matrix."""
    a = np.array(a, float)
    n = len(a)
    vectors: list[np.ndarray | None] = []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0 or not np.any(x[1:]):
            vectors.append(None)
            continue
        x[0] += np.copysign(norm, x[0])
        v = x / np.linalg.norm(x)
        vectors.append(v)
        rest = a[k + 1 :, k + 1 :]
        p = 2 * (rest @ v)
        w = p - (p @ v) * v
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy(), vectors


def below(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues are under each x: signs of the Sturm sequence, its quotients kept off zero."""
    tiny = np.finfo(float).tiny ** 0.5 * max(1.0, float(np.max(np.abs(e), initial=0.0)))
    q = d[0] - x
    count = (q < 0).astype(int)
    for i in range(1, len(d)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d[i] - x - e[i - 1] ** 2 / q
        count += q < 0
    return count


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k greatest eigenvalues, falling, each halved in from Gershgorin's bounds until the ends are neighbours."""
    n = len(d)
    radius = np.concatenate((np.abs(e), [0])) + np.concatenate(([0], np.abs(e)))
    spread = max(float(np.max(np.abs(d) + radius)), np.finfo(float).tiny)
    low, high = np.full(k, np.min(d - radius) - 1e-15 * spread), np.full(k, np.max(d + radius) + 1e-15 * spread)
    rank = n - np.arange(1, k + 1)  # of the j-th greatest so many are under it
    while True:
        mid = low + (high - low) / 2
        if np.all((mid <= low) | (mid >= high) | (high - low <= 4e-17 * spread)):
            return mid
        many = below(d, e, mid) > rank
        high, low = np.where(many, mid, high), np.where(many, low, mid)


def solve_shifted(d: np.ndarray, e: np.ndarray, x: float, b: np.ndarray) -> np.ndarray:
    """(T - x) y = b by elimination with row exchanges; pivots under rounding's size are raised to it."""
    n, eps = len(d), np.finfo(float).eps * max(float(np.max(np.abs(d))), float(np.max(np.abs(e), initial=0.0)), np.finfo(float).tiny)
    diag, up, upper2, rhs = (d - x).tolist(), [*e.tolist(), 0.0], [0.0] * n, b.tolist()
    for i in range(n - 1):
        low = float(e[i])
        if abs(diag[i]) >= abs(low):
            pivot = diag[i] = diag[i] if abs(diag[i]) > eps else eps
            f = low / pivot
            diag[i + 1] -= f * up[i]
            rhs[i + 1] -= f * rhs[i]
        else:
            f = diag[i] / low
            diag[i], up[i], diag[i + 1], upper2[i] = low, diag[i + 1], up[i] - f * diag[i + 1], up[i + 1]
            up[i + 1] = -f * upper2[i]
            rhs[i], rhs[i + 1] = rhs[i + 1], rhs[i] - f * rhs[i + 1]
    diag[-1] = diag[-1] if abs(diag[-1]) > eps else eps
    y = [0.0] * (n + 2)
    for i in range(n - 1, -1, -1):
        y[i] = (rhs[i] - up[i] * y[i + 1] - upper2[i] * y[i + 2]) / diag[i]
    return np.array(y[:n])


def leading_pairs(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns.

    The matrix is made tridiagonal; values are bisected by Sturm counts; vectors come by inverse iteration, each made orthogonal
    to those before whose values are near (a cluster) in every turn; then they are turned back, and set upright once more."""
    n = len(a)
    k = min(k, n)
    d, e, reflections = tridiagonal(a)
    values = leading_values(d, e, k)
    width = 1e-3 * max(float(np.max(np.abs(values), initial=0.0)), np.finfo(float).tiny)
    random = np.random.default_rng(11)
    vectors = np.zeros((n, k))
    first = 0
    for j in range(k):
        if j and values[j - 1] - values[j] > width:
            first = j
        shift = values[j] - (j - first) * 4 * np.finfo(float).eps * abs(values[j])  # equal values: not quite the same matrix
        y = random.standard_normal(n)
        for _ in range(6):
            for _ in range(2):
                y -= vectors[:, first:j] @ (vectors[:, first:j].T @ y)
            y /= np.linalg.norm(y)
            y = solve_shifted(d, e, shift, y)
            y /= np.max(np.abs(y))
        for _ in range(2):
            y -= vectors[:, first:j] @ (vectors[:, first:j].T @ y)
        vectors[:, j] = y / np.linalg.norm(y)
    for i in range(len(reflections) - 1, -1, -1):
        if (v := reflections[i]) is not None:
            vectors[i + 1 :] -= 2 * np.outer(v, v @ vectors[i + 1 :])
    for j in range(k):
        vectors[:, j] -= vectors[:, :j] @ (vectors[:, :j].T @ vectors[:, j])
        vectors[:, j] /= np.linalg.norm(vectors[:, j])
    return values, vectors


# ---- the tables

def whole_vectors(rows: DataFrame, vector: str, dimensions: int | None = None) -> DataFrame:
    """Rows whose vector is whole: not null, not empty, every entry a finite number of at most MOST_ENTRY, and with
    dimensions, just so many."""
    v = F.col(vector)
    sound = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) <= MOST_ENTRY, F.lit(False)))
    fits = F.size(v) > 0 if dimensions is None else F.size(v) == dimensions
    return rows.filter(v.isNotNull() & sound & fits)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """Whole numbers floor(SCALE * c) + SHIFT of a batch of vectors, a row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, dimensions) + SHIFT


def _summed(rows: DataFrame, kind: str) -> DataFrame:
    """Rows (i, values) with the values of each i added up, in tasks: what a task holds is a matrix at most."""
    dtype = np.int64 if kind == "long" else np.float64

    def run(batches):
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                have[i] = have.get(i, 0) + v.values.to_numpy(zero_copy_only=False).astype(dtype)
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array([x.tolist() for x in have.values()], pa.list_(pa.int64() if kind == "long" else pa.float64()))], names=["i", "v"])

    return rows.repartition("i").mapInArrow(run, f"i int, v array<{kind}>")


def _gathered(rows: DataFrame, kind: str) -> np.ndarray:
    """The summed rows as an array on the driver, as large as the matrix."""
    got = {r.i: r.v for r in _summed(rows, kind).collect()}
    return np.array([got[i] for i in sorted(got)], dtype=np.int64 if kind == "long" else np.float64)


def sums(rows: DataFrame, vector: str, dimensions: int) -> tuple[int, np.ndarray]:
    """The number of vectors and the exact sum of each dimension's whole numbers."""

    def run(batches):
        n, total = 0, np.zeros(dimensions, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dimensions)
            n, total = n + len(x), total + x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([[n, *total.tolist()]], pa.list_(pa.int64()))], names=["i", "v"])

    both = _gathered(rows.select(vector).mapInArrow(run, "i int, v array<long>"), "long")[0]
    return int(both[0]), both[1:]


def covariance(rows: DataFrame, vector: str, n: int, total: np.ndarray) -> np.ndarray:
    """Covariance with divisor n: each task centres its vectors and adds up their products; the tasks' matrices are dealt out by
    row and added up in tasks again."""
    dimensions, mean = len(total), total / n

    def run(batches):
        products = np.zeros((dimensions, dimensions))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                y = _matrix(batch.column(0).slice(at, 4096), dimensions) - mean
                products += y.T @ y
        for i in range(0, dimensions, 256):
            part = products[i : i + 256]
            yield pa.RecordBatch.from_arrays([pa.array(range(i, i + len(part)), pa.int32()), pa.array(part.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    out = _gathered(rows.select(vector).mapInArrow(run, "i int, v array<double>"), "double") / n
    return (out + out.T) / 2


def _projected(x: np.ndarray, mean: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return (x - mean) @ weights


def identity_error(rows: DataFrame, vector: str, n: int, mean: np.ndarray, weights: np.ndarray) -> float:
    """The greatest entry, by size, of the whitened vectors' covariance less the identity. Means are taken first, then the
    products of what is left."""
    dimensions, k = weights.shape

    def told(centre: np.ndarray | None):
        def run(batches):
            out = np.zeros(k) if centre is None else np.zeros((k, k))
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    w = _projected(_matrix(batch.column(0).slice(at, 4096), dimensions), mean, weights)
                    out = out + (w.sum(axis=0) if centre is None else (w - centre).T @ (w - centre))
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], names=["i", "v"])

        return _gathered(rows.select(vector).mapInArrow(run, "i int, v array<double>"), "double")[0]

    centre = told(None) / n
    return float(np.max(np.abs(told(centre).reshape(k, k) / n - np.eye(k))))


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """All other columns of each row with a whole vector, once for each component, then component, n, deviation, whitened,
    explained and identity_error.

    A vector's entries c count as x = floor(1024 c) + 100000. Left out are rows whose vector is null or empty, holds a null or
    an entry that isn't finite (or beyond MOST_ENTRY), or isn't of the commonest length (of equally common ones the greatest).
    Components whose variance is none but rounding (under RANK of the greatest) are left out, so a table of one distinct vector
    or of none gives no rows. Repeated rows count as often as they are there. deviation is null where no long holds it.
    Columns of the new names are replaced."""
    spark = rows.sparkSession
    new = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    keep = [c for c in rows.columns if c != vector and c not in new]
    rows = whole_vectors(rows.select(*keep, vector), vector)
    lengths = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    picked = T.StructType([*rows.select(*keep).schema, *T.StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double")])
    if lengths is None:
        return spark.createDataFrame([], picked)
    if (dimensions := lengths.d) > MOST_DIMENSIONS:
        raise ValueError(f"{dimensions} dimensions; the driver takes covariances of up to {MOST_DIMENSIONS}")
    rows = whole_vectors(rows, vector, dimensions)
    n, total = sums(rows, vector, dimensions)
    matrix, mean = covariance(rows, vector, n, total), total / n
    values, vectors = leading_pairs(matrix, components)
    real = int(np.sum(values > max(RANK * values[0], 0.0)))
    if not real:
        return spark.createDataFrame([], picked)
    weights, share = vectors[:, :real] / np.sqrt(values[:real]), values[:real] / np.trace(matrix)
    shared = spark.sparkContext.broadcast((mean, weights, total))  # dimensions by components, of a checked size
    error = identity_error(rows, vector, n, mean, weights)

    def run(batches):
        mean, weights, total = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x = _matrix(batch.column(vector), dimensions)
                far, m = deviations(x, n, total), len(x)
                cols = [pa.array(np.tile(np.arange(1, real + 1), m), pa.int32()), pa.array(np.full(m * real, n), pa.int64()), pa.array([v for v in far for _ in range(real)], pa.int64())]
                cols += [pa.array(_projected(x, mean, weights).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * real, error))]
                again = pa.array(np.repeat(np.arange(m), real))
                yield pa.RecordBatch.from_arrays([batch.column(c).take(again) for c in keep] + cols, names=picked.names)

    return rows.mapInArrow(run, picked)


def deviations(x: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """Of each row the sum over dimensions of (n x - total)^2, exact: in 64 bits where all stay within, else in Python's
    integers; None where the sum needs more than a long."""
    span = int(np.max(np.abs(x), initial=0))
    if span * n < 1 << 62:
        off = n * x - total
        top = int(np.max(np.abs(off), initial=0))
        if top * top * x.shape[1] < 1 << 63:
            return (off * off).sum(axis=1).tolist()
    each = [sum((n * v - s) ** 2 for v, s in zip(row, total.tolist(), strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in each]


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
