"""Whitening of embeddings by shifted CholeskyQR.

The centred rows X of the fit list are never decomposed as a whole. A pass solves each row against
the triangular factors found so far and adds up the Gram matrix of the results; its Cholesky factor
is the next factor. The first one is of the shifted Gram matrix, so it exists however badly X is
conditioned; after it the rows are nearly orthogonal, and further passes make them so to rounding.
The product R of the factors then has X = QR with orthonormal Q, and the singular value
decomposition of R, which is as small as one vector squared, gives the components of X without the
squared condition number of its covariance.

A fit list of lower rank has no Cholesky factor in the end; the symmetric root of the last Gram
matrix takes its place, which leaves the covariance exactly what it is.

Scale: the fit list is deduplicated by one shuffle and written once. A pass is a scan with a small
dense matrix per task; the tasks' matrices are added up row by row of the matrix in a shuffle, and
what reaches the driver is dims x dims numbers. Nothing grows with the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import freeze
from .common import map_arrow, sliced

SCALE = 256
COMPONENTS = 4
MOST_PASSES = 8
EPS = np.finfo(float).eps


@dataclass(frozen=True)
class Model:
    """n vectors of the fit list, their sums by dimension, components as columns, and variances.

    `variances` has all of them; those of at most the rounding error of the largest one are zero.
    """
    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray, k: int) -> np.ndarray:
        """Coordinates of the rows in the first k components; zero where there is no variance."""
        e = self.variances[:k]
        return (x - self.mean) @ self.components[:, :k] * np.where(e > 0, 1 / np.sqrt(np.where(e > 0, e, 1)), 0)


def rounded(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): floor(scale * entry) of vectors without null and non-finite entries.

    Products beyond the range of a bigint stay at its ends. Null and empty vectors go.
    """
    entry = F.col(vec_col)
    usable = entry.isNotNull() & (F.size(vec_col) > 0) & F.forall(vec_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(vec_col, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("bigint"))
    return df.filter(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("bigint").alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def solve(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """x times the inverse of the upper triangular r, by substitution over its columns."""
    out = np.empty_like(x)
    for j in range(r.shape[0]):
        out[:, j] = (x[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def _sum_rows(parts: DataFrame, columns: int) -> np.ndarray:
    """(i, v array<double>) of all tasks -> the sums by i as a matrix."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), _matrix(batch.column(1))):
                total[i] = total[i] + row if i in total else row
        for i, row in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([row])], ["i", "v"])

    rows = parts.repartition("i").transform(map_arrow, add, "i int, v array<double>").collect()
    out = np.zeros((len(rows), columns))
    for r in rows:
        out[r.i] = r.v
    return out


def gram(fit: DataFrame, mean: np.ndarray, change) -> np.ndarray:
    """The Gram matrix of change(x - mean) over all rows x of the fit list."""
    k = change(np.zeros((1, len(mean)))).shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in sliced(batches, 4_096):
            q = change(_matrix(batch.column(0)).astype(float) - mean)
            total += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(list(total))], ["i", "v"])

    return _sum_rows(fit.transform(map_arrow, run, "i int, v array<double>"), k)


def _sums(fit: DataFrame, dims: int) -> tuple[int, ...]:
    """Exact sums by dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dims
        for batch in sliced(batches, 4_096):
            x = _matrix(batch.column(0))
            small = int(np.abs(x.astype(float)).max(initial=0)) < (1 << 62) // 4_096
            part = x.sum(0) if small else x.astype(object).sum(0)
            total = [t + int(p) for t, p in zip(total, part)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(map(str, total), pa.string())], ["i", "s"])

    rows = (fit.transform(map_arrow, run, "i int, s string").groupBy("i")
            .agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("decimal(38,0)").alias("s")).collect())
    return tuple(int(s) for _, s in sorted((r.i, r.s) for r in rows))


def _factor(g: np.ndarray, shift: float) -> np.ndarray | None:
    try:
        return np.linalg.cholesky(g + shift * np.eye(len(g))).T
    except np.linalg.LinAlgError:
        return None


def triangular_factor(fit: DataFrame, n: int, mean: np.ndarray) -> np.ndarray:
    """R with the covariance of the fit list = R'R / n."""
    dims = len(mean)
    factors: list[np.ndarray] = []

    def orthogonalised(x: np.ndarray) -> np.ndarray:
        for r in factors:
            x = solve(x, r)
        return x

    composed = np.eye(dims)
    for at in range(MOST_PASSES):
        g = gram(fit, mean, orthogonalised)
        size = float(np.trace(g))
        if not size:
            return np.zeros((dims, dims))
        shift = min(11 * (n * dims + dims * (dims + 1)) * EPS, 1e-3) * size
        near = at > 0 and np.abs(g - np.eye(dims)).max() < 0.1
        r = _factor(g, 0.0 if at else shift)
        if r is None and at >= 2:
            # of lower rank: the symmetric root of the Gram matrix instead of its triangular one
            values, vectors = np.linalg.eigh(g)
            return (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T @ composed
        r = _factor(g, shift) if r is None else r
        factors.append(r)
        composed = r @ composed
        if near:
            break
    return composed


def fit_whitening(x: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of the distinct vectors of (x array<bigint>); None without any.

    Vectors of another length than the longest ones have no place in it.
    """
    distinct = freeze(x.select("x").distinct(), "fit-list")
    dims = distinct.agg(F.max(F.size("x"))).first()[0]
    if not dims:
        return None
    fit = distinct.filter(F.size("x") == dims)
    n = fit.count()
    sums = _sums(fit, dims)
    mean = np.array([s / n for s in sums])
    _, sigma, rows = np.linalg.svd(triangular_factor(fit, n, mean))
    sigma = np.where(sigma > sigma[0] * dims * 10 * EPS, sigma, 0)
    # the sign is free; the largest entry of a component is positive
    largest = rows[np.arange(dims), np.abs(rows).argmax(1)]
    model = Model(n, sums, (rows * np.sign(largest)[:, None]).T, sigma ** 2 / n)
    k = int((model.variances[:components] > 0).sum())
    if not k:
        return model
    measured = gram(fit, mean, lambda c: c @ model.components[:, :k] / np.sqrt(model.variances[:k])) / n
    return Model(model.n, sums, model.components, model.variances, float(np.abs(measured - np.eye(k)).max()))


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """The exact sums over dimensions of (n x - S)^2; None where a bigint can't hold one."""
    most = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, sums))
    if x.shape[1] * most * most < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


WHITENED = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: its coordinate in whitened space and how far it lies
    from the mean.

    Vectors count as integers, floor(scale * entry); the model is fitted to each distinct one once,
    so copies weigh nothing. Rows whose vector is null, empty, holds a null or non-finite entry, or
    is shorter than the longest one are left out; repeated rows stay. Components without variance
    have coordinate and share 0. A deviation too large for a bigint is null. An empty table gives an
    empty one. Other columns aren't read.
    """
    rows = rounded(df, id_col, vec_col, scale)
    model = fit_whitening(rows, components)
    if model is None:
        return df.sparkSession.createDataFrame([], WHITENED)
    dims = len(model.sums)
    k = min(components, dims)
    whole = float(model.variances.sum())
    share = model.variances[:k] / whole if whole else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4_096):
            x, m = _matrix(batch.column(1)), batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n)), pa.array([d for d in deviations(x, model.n, model.sums) for _ in range(k)], pa.int64()),
                pa.array(model.whitened(x.astype(float), k).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, model.identity_error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.filter(F.size("x") == dims).transform(map_arrow, run, WHITENED)
