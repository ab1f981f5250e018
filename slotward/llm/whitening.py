"""Embedding whitening by spectral divide-and-conquer.

Entries become integers, x = floor(64 * c) + 1000000, so that counts, sums and centred products are exact sums of
integers, added up inside tasks and then by Spark; what reaches the driver is one number per pair of dimensions.
The covariance is split there: the polar factor of the covariance minus a shift, found by dynamically weighted
Halley steps (QDWH), is the matrix sign, (sign + 1) / 2 projects on the components above the shift, bases of the
two invariant subspaces come from the projector's columns, and both compressed matrices are split again until
single components are left. Two refinement steps in extended precision against the exact covariance bring
eigenvectors to double precision. The components, at most `size` rows of the dimension, are broadcast.

Defined cases: rows whose vector is null or empty or holds null, NaN or infinite entries, or entries beyond 2^55,
are dropped, like rows of another dimension than the most frequent one (the larger of equals); repeated rows and
null ids are kept and count each; directions in which the fitted rows do not differ (under 2^-44 of the largest
eigenvalue) are no components, so a single vector or equal vectors give none; `deviation` is null if it does not fit 64 bits. Only the columns named
are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SIZE = 32  # components
LOT = 4096  # rows multiplied at once; their products stay exact in doubles below NARROW
NARROW = 1 << 20
FINEST = 2.0**-44  # share of the largest eigenvalue under which a direction counts as constant
# Entries to integers.
FACTOR, OFFSET = 64.0, 1_000_000


def _halley(x: np.ndarray, low: float) -> tuple[np.ndarray, float]:
    """One dynamically weighted Halley step by a QR factorisation; `low` bounds the singular values from below."""
    l2 = low * low
    d = (4 * (1 - l2) / (l2 * l2)) ** (1 / 3)
    root = np.sqrt(1 + d)
    a = root + np.sqrt(8 - 4 * d + 8 * (2 - l2) / (l2 * root)) / 2
    b = (a - 1) ** 2 / 4
    c = a + b - 1
    n = len(x)
    q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))
    x = b / c * x + (a - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
    return (x + x.T) / 2, min(low * (a + b * l2) / (1 + c * l2), 1.0)


def polar_sign(matrix: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix, which is its sign."""
    scale = np.linalg.norm(matrix)
    if not scale:
        return np.eye(len(matrix))
    x, low = matrix / scale, 1e-17
    for _ in range(30):
        step, low = _halley(x, low)
        moved = np.linalg.norm(step - x)
        x = step
        if moved < 1e-6 and 1 - low < 1e-12:
            break
    return x


def _bases(above: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of a projector's range and of the rest."""
    lead = np.argsort(-np.einsum("ij,ij->j", above, above), kind="stable")[:rank]
    start = above[:, lead]
    for _ in range(2):
        q, _ = np.linalg.qr(start, mode="complete")
        start = above @ q[:, :rank]
    return q[:, :rank], q[:, rank:]


def divided(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors of a symmetric matrix by spectral divide-and-conquer."""
    n, whole = len(matrix), max(np.linalg.norm(matrix), 1e-300)
    values, vectors = [], []
    waiting = [(matrix, np.eye(n))]
    while waiting:
        part, basis = waiting.pop()
        m = len(part)
        if m == 1 or np.linalg.norm(part - np.diag(np.diag(part))) <= 1e-15 * whole:
            values.extend(np.diag(part))
            vectors.append(basis)
            continue
        for shift in (np.median(np.diag(part)), np.trace(part) / m):
            above = (polar_sign(part - shift * np.eye(m)) + np.eye(m)) / 2
            rank = int(round(np.trace(above)))
            if 0 < rank < m:
                break
        else:  # a multiple of the identity up to rounding
            values.extend(np.diag(part))
            vectors.append(basis)
            continue
        for own in _bases(above, rank):
            small = own.T @ part @ own
            waiting.append(((small + small.T) / 2, basis @ own))
    values, vectors = np.array(values), np.hstack(vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def refined(matrix: np.ndarray, vectors: np.ndarray, steps: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors in extended precision from good ones: first-order corrections of all pairs."""
    a, x = matrix.astype(np.longdouble), vectors.astype(np.longdouble)
    for _ in range(steps):
        lost, turned = np.eye(len(a)) - x.T @ x, x.T @ a @ x
        values = np.diag(turned) / (1 - np.diag(lost))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= 2 * (np.linalg.norm(turned - np.diag(values)) + np.linalg.norm(a) * np.linalg.norm(lost))
        step = np.where(near, lost / 2, (turned + values[None, :] * lost) / np.where(near, 1, gap))
        x = x + x @ step
    x = x / np.sqrt((x * x).sum(axis=0))
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


class Whitening:
    """Count, sums and components of the fitted vectors."""

    def __init__(self, n: int, shift: list[int], sums: list[int], products: np.ndarray, size: int):
        """`sums` and `products` of x minus shift, as Python integers."""
        self.n, self.shift, self.sums = n, shift, sums
        d = len(sums)
        exact = [[n * int(products[i, j]) - sums[i] * sums[j] for j in range(d)] for i in range(d)]  # n * n * covariance
        covariance = np.array([[np.longdouble(str(v)) for v in row] for row in exact], np.longdouble) / np.longdouble(str(n * n))
        values, vectors = refined(covariance, divided(covariance.astype(np.float64))[1])
        trace = np.trace(covariance)
        kept = min(int((values > FINEST * max(values[0], 0)).sum()), size) if trace > 0 else 0
        self.values, self.vectors = values[:kept].astype(np.float64), vectors[:, :kept].astype(np.float64)
        self.explained = (values[:kept] / trace).astype(np.float64) if kept else np.zeros(0)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows of integers to whitened components."""
        centred = (x - np.array(self.shift, np.int64)).astype(np.float64) - np.array([s / self.n for s in self.sums])
        return centred @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S) squared over the dimensions, exact."""
        y = x - np.array(self.shift, np.int64)
        most = max(int(np.abs(y).max(initial=0)) * self.n + max(map(abs, self.sums)), 1)
        if most * most * y.shape[1] < 2**63:
            z = y * self.n - np.array(self.sums, np.int64)
            return (z * z).sum(axis=1).tolist()
        found = [sum((v * self.n - s) ** 2 for v, s in zip(row, self.sums)) for row in y.tolist()]
        return [v if v < 2**63 else None for v in found]


def usable(vector: Column) -> Column:
    return (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) <= 2.0**55))


def remaining(rows: DataFrame, vector: str) -> DataFrame:
    """Rows with a vector of finite entries, of the most frequent dimension."""
    rows = rows.filter(F.col(vector).isNotNull() & usable(F.col(vector)))
    sizes = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size(vector) == (sizes["d"] if sizes else 0))


def _integers(column: pa.Array) -> np.ndarray:
    """Rows of x from a list column of one dimension."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * FACTOR).reshape(len(column), -1).astype(np.int64) + OFFSET


def _lots(batches: Iterator[pa.RecordBatch], vector: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, LOT):
            lot = batch.slice(at, LOT)
            yield lot, _integers(lot.column(vector))


def _exact_products(y: np.ndarray) -> np.ndarray:
    if np.abs(y).max(initial=0) < NARROW:
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64).astype(object)
    z = y.astype(object)
    return z.T @ z


def _summed(rows: DataFrame, sums: Callable[[Iterator[pa.RecordBatch]], dict[tuple[int, int], object]], kind: str) -> dict[tuple[int, int], object]:
    """Sums under pairs of numbers: inside each task first, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sums(batches)
        at = np.array(list(found), np.int32).reshape(-1, 2)
        value = pa.array(list(found.values()), pa.float64() if kind == "double" else pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), value], names=["i", "j", "v"])

    parts = rows.mapInArrow(run, f"i int, j int, v {kind}")
    return {(r["i"], r["j"]): r["v"] for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}


def fit(rows: DataFrame, vector: str = "embedding", size: int = SIZE) -> Whitening | None:
    """The whitening of all rows of `remaining`; None without rows."""

    def first(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, int], object]:
        n, total = 0, 0
        for _, x in _lots(batches, vector):
            n, total = n + len(x), total + x.astype(object).sum(axis=0)
        return {(-1, -1): Decimal(n)} | ({(-1, k): Decimal(v) for k, v in enumerate(total)} if n else {})

    rows = rows.select(vector)
    found = _summed(rows, first, "decimal(38,0)")
    n = int(found.get((-1, -1), 0))
    if not n:
        return None
    total = [int(found[-1, k]) for k in range(len(found) - 1)]
    shift = [s // n for s in total]

    def second(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, int], object]:
        products = np.zeros((len(shift), len(shift)), object)
        for _, x in _lots(batches, vector):
            products += _exact_products(x - np.array(shift, np.int64))
        return {(i, j): Decimal(products[i, j]) for i in range(len(shift)) for j in range(i, len(shift))}

    found = _summed(rows, second, "decimal(38,0)")
    products = np.array([[int(found[min(i, j), max(i, j)]) for j in range(len(shift))] for i in range(len(shift))], object)
    return Whitening(n, shift, [s - n * m for s, m in zip(total, shift)], products, size)


def identity_error(rows: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """Largest absolute entry of the covariance of the whitened fitted rows minus the identity."""
    shared, k = rows.sparkSession.sparkContext.broadcast(model), len(model.values)

    def sums(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, int], float]:
        total, products = np.zeros(k), np.zeros((k, k))
        for _, x in _lots(batches, vector):
            w = shared.value.whiten(x)
            total, products = total + w.sum(axis=0), products + w.T @ w
        return {(-1, i): total[i] for i in range(k)} | {(i, j): products[i, j] for i in range(k) for j in range(k)}

    if not k:
        return 0.0
    found = _summed(rows.select(vector), sums, "double")
    mean = np.array([found[-1, i] for i in range(k)]) / model.n  # zero up to rounding, since rows are centred first
    covariance = np.array([[found[i, j] for j in range(k)] for i in range(k)]) / model.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())


def whitened(rows: DataFrame, model: Whitening, vector: str = "embedding", name: str = "whitened") -> DataFrame:
    """Add the whitened components to rows of `remaining`; all other columns pass through."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        w = shared.value.whiten(_integers(column))
        ends = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(w.ravel()))

    return rows.withColumn(name, run(vector))


def components(rows: DataFrame, size: int = SIZE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per remaining row and component: key, component, n, deviation, whitened, explained, identity_error."""
    rows = remaining(rows, vector).select(key, vector)
    model = fit(rows, vector, size)
    kinds = f"`{key}` {rows.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], kinds)
    shared, error = rows.sparkSession.sparkContext.broadcast(model), identity_error(rows, model, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        k = len(own.values)
        for lot, x in _lots(batches, vector):
            each, size_ = np.repeat(np.arange(len(x)), k), len(x) * k
            yield pa.RecordBatch.from_arrays([
                lot.column(key).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(size_, own.n)),
                pa.array(own.deviations(x), pa.int64()).take(pa.array(each)), pa.array(own.whiten(x).ravel()),
                pa.array(np.tile(own.explained, len(x))), pa.array(np.full(size_, error)),
            ], names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, kinds)
