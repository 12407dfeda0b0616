"""Whitening of embeddings by the principal components of their covariance.

Spark sums the vectors exactly, then the products of their deviations from the
mean. The driver solves one symmetric matrix of the vectors' width: Householder
reflections make it tridiagonal, bisection on Sturm counts finds the leading
eigenvalues, inverse iteration their vectors (made orthogonal again within
clusters of close values). The components go out with a broadcast and every row
is projected where it lies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch, ship_package

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
LARGEST = 2.0 ** 53  # scaled entries beyond it are taken at this bound: no double is exact there
CLUSTER_GAP = 1e-3  # of the matrix' norm
ROUNDING = 2.0 ** -52


# --- the symmetric eigenproblem ---------------------------------------------------------

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and Householder vectors (None where nothing was to reflect)."""
    a = np.array(matrix, np.float64)
    reflectors: list[np.ndarray | None] = []
    for k in range(len(a) - 2):
        column = a[k + 1:, k].copy()
        if not column[1:].any():
            reflectors.append(None)
            continue
        v = column / np.abs(column).max()
        v[0] += math.copysign(math.sqrt(v @ v), v[0])
        v /= math.sqrt(v @ v)
        block = a[k + 1:, k + 1:]
        p = block @ v
        w = p - (v @ p) * v
        block -= 2 * (np.outer(v, w) + np.outer(w, v))
        reflected = column[0] - 2 * (v @ column) * v[0]
        a[k + 1:, k] = a[k, k + 1:] = 0
        a[k + 1, k] = a[k, k + 1] = reflected
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, points: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each point."""
    tiny = max(np.abs(diagonal).max(initial=0), np.abs(off).max(initial=0), 1e-300) * ROUNDING ** 2
    q = diagonal[0] - points
    count = (q < 0).astype(int)
    for i in range(1, len(diagonal)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = diagonal[i] - points - off[i - 1] ** 2 / q
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected down to neighbouring doubles."""
    reach = np.abs(np.concatenate(([0], off))) + np.abs(np.concatenate((off, [0])))
    low = np.full(k, (diagonal - reach).min())
    high = np.full(k, (diagonal + reach).max())
    low, high = low - np.abs(low) * 1e-15, high + np.abs(high) * 1e-15
    at_most = len(diagonal) - 1 - np.arange(k)  # eigenvalues below the j-th largest
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            return middle
        above = sturm_counts(diagonal, off, middle) <= at_most  # the value is not below the middle
        low, high = np.where(above, middle, low), np.where(above, high, middle)


def _solve(diagonal: np.ndarray, off: np.ndarray, value: float, right: np.ndarray, floor: float) -> np.ndarray:
    """(T - value I) x = right by elimination with row exchanges; pivots are ``floor`` at least."""
    n = len(diagonal)
    d, up, up2, x = diagonal - value, np.append(off, 0.0), np.zeros(n), right.copy()
    for i in range(n - 1):
        below = off[i]
        if abs(below) > abs(d[i]):
            factor = d[i] / below
            d[i], up[i], d[i + 1], up2[i], up[i + 1] = (below, d[i + 1], up[i] - factor * d[i + 1],
                                                        up[i + 1], -factor * up[i + 1])
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
        else:
            d[i] = d[i] if abs(d[i]) > floor else math.copysign(floor, d[i])
            factor = below / d[i]
            d[i + 1] -= factor * up[i]
            x[i + 1] -= factor * x[i]
    d[-1] = d[-1] if abs(d[-1]) > floor else math.copysign(floor, d[-1])
    for i in range(n - 1, -1, -1):
        rest = x[i] - (up[i] * x[i + 1] if i + 1 < n else 0) - (up2[i] * x[i + 2] if i + 2 < n else 0)
        x[i] = rest / d[i]
    return x / np.abs(x).max()


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, turns: int = 4) -> np.ndarray:
    """Unit eigenvectors, as columns, of the falling ``values``."""
    n = len(diagonal)
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0)) or 1.0
    starts = np.random.default_rng(12).uniform(0.5, 1, (n, len(values)))
    out = np.zeros((n, len(values)))
    cluster = 0  # first member of the cluster of close values
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER_GAP * norm:
            cluster = j
        x = starts[:, j]
        for _ in range(turns):
            x = _solve(diagonal, off, value, x, norm * ROUNDING)
            for _ in range(2):
                x = x - out[:, cluster:j] @ (out[:, cluster:j].T @ x)
            x = x / math.sqrt(x @ x)
        out[:, j] = x
    return out


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    k = min(k, len(matrix))
    if not k:
        return np.zeros(0), np.zeros((len(matrix), 0))
    diagonal, off, reflectors = tridiagonal(matrix)
    values = leading_values(diagonal, off, k)
    vectors = inverse_iteration(diagonal, off, values)
    for i in range(len(reflectors) - 1, -1, -1):
        if reflectors[i] is not None:
            v = reflectors[i]
            vectors[i + 1:] -= 2 * np.outer(v, v @ vectors[i + 1:])
    return values, vectors / np.sqrt((vectors * vectors).sum(axis=0))


# --- sums over the vectors ----------------------------------------------------------------

class Whitening(NamedTuple):
    """What one fit leaves: counts and exact sums, and the matrix that projects."""
    n: int
    sums: list[int]
    mean: np.ndarray
    projection: np.ndarray  # width x components, scaled by 1 / sqrt(eigenvalue)
    explained: np.ndarray
    identity_error: float


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector`` of the rows whose vector is there and holds finite numbers only."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                         F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return own.where(F.col("vector").isNotNull() & ~bad)


def scaled(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers floor(1024 c) + 100000; shorter vectors count as padded with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width))
    if len(lengths) and (lengths == width).all():
        out[:] = flat.reshape(-1, width)
    else:
        out[np.arange(width)[None, :] < lengths[:, None]] = flat
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * out), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _exact(x: np.ndarray, terms: int) -> np.ndarray:
    """``x`` as Python integers if sums of ``terms`` of its entries could pass 64 bits."""
    largest = int(np.abs(x).max(initial=0))
    return x if largest * max(1, terms) < 2 ** 62 else x.astype(object)


def vector_sums(vectors: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of every dimension."""
    schema = pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("total", pa.decimal128(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, totals = 0, [0] * width
        for batch in batches:
            x = scaled(batch.column(0), width)
            n += len(x)
            totals = [a + int(b) for a, b in zip(totals, _exact(x, len(x)).sum(axis=0), strict=True)]
        if n:
            yield record_batch({"dim": list(range(width)), "n": [n] * width, "total": totals}, schema)

    rows = (vectors.select("vector").mapInArrow(run, "dim int, n long, total decimal(38,0)")
            .groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("dim").collect())
    return (int(rows[0]["n"]), [int(r["total"]) for r in rows]) if rows else (0, [])


def _summed_products(vectors: DataFrame, width: int, size: int, deviations) -> np.ndarray:
    """Sum over all rows of y yT, y = ``deviations(x)`` with ``size`` entries; a task sends ``size`` rows."""
    schema = pa.schema([("i", pa.int32()), ("own", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            y = deviations(scaled(batch.column(0), width))
            total += y.T @ y
        yield record_batch({"i": list(range(size)), "own": list(total)}, schema)

    cells = (vectors.select("vector").mapInArrow(run, "i int, own array<double>")
             .select("i", F.posexplode("own").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")))
    out = np.zeros((size, size))
    for r in cells.collect():  # size x size numbers
        out[r["i"], r["j"]] = r["v"]
    return (out + out.T) / 2


def fit(vectors: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """Leading components of the covariance (divisor n) of all rows; None without rows or without width."""
    n, sums = vector_sums(vectors, width) if width else (0, [])
    if not n:
        return None
    mean = np.array([s / n for s in sums])
    covariance = _summed_products(vectors, width, width, lambda x: x - mean) / n
    trace = float(np.trace(covariance))
    values, axes = leading_components(covariance, components)
    there = values > trace * width * ROUNDING  # directions without any spread cannot be scaled to one
    projection = axes[:, there] / np.sqrt(values[there])
    size = projection.shape[1]
    error = 0.0
    if size:
        white = _summed_products(vectors, width, size, lambda x: (x - mean) @ projection) / n
        error = float(np.abs(white - np.eye(size)).max())
    return Whitening(n, sums, mean, projection, values[there] / trace if size else np.zeros(0), error)


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n x - S)^2 per row; null beyond 38 digits."""
    whole = x.astype(object)
    if int(np.abs(x).max(initial=0)) * n < 2 ** 62 and max(map(abs, sums), default=0) < 2 ** 62:
        y = n * x - np.array(sums, np.int64)
        if int(np.abs(y).max(initial=0)) ** 2 * max(1, x.shape[1]) < 2 ** 62:
            return (y * y).sum(axis=1).tolist()
        whole = y.astype(object)
    else:
        whole = n * whole - np.array(sums, object)
    return [d if d < 10 ** 38 else None for d in ((whole * whole).sum(axis=1)).tolist()]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per vector and component.

    Fitted on, and applied to, all vectors that are there and hold finite
    numbers only; the others are left out. ``deviation`` is a whole number of up to
    38 digits, null beyond. Components without spread (eigenvalue zero up to rounding) give no
    rows, so equal vectors, a single vector and an empty table give an
    empty result. The width is the longest vector's; shorter and empty vectors count as padded with
    zeros. Scaled entries beyond 2^53 are taken at that bound. Null ids and repeated rows
    are kept and count; further columns are ignored. The driver and every task
    hold width x width numbers.
    """
    ship_package(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col)
    schema = ("vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, "
              "identity_error double")
    target = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()),
                        ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64()), ("explained", pa.float64()),
                        ("identity_error", pa.float64())])
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    model = fit(rows, width, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # width x components numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        size = m.projection.shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = scaled(part.column("vector"), width)
                each = np.repeat(np.arange(len(x)), size)
                yield record_batch({
                    "vec_id": part.column("vec_id").take(pa.array(each)),
                    "component": np.tile(np.arange(1, size + 1, dtype=np.int32), len(x)),
                    "n": np.full(len(each), m.n),
                    "deviation": pa.array(_deviation(x, m.n, m.sums), pa.decimal128(38, 0)).take(pa.array(each)),
                    "whitened": ((x - m.mean) @ m.projection).ravel(),
                    "explained": np.tile(m.explained, len(x)),
                    "identity_error": np.full(len(each), m.identity_error)}, target)

    return rows.mapInArrow(run, schema)
