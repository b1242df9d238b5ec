"""Whitening of embeddings: a distributed covariance, its leading eigenvectors, a broadcast projection.

Vectors become integers. The fit list holds each different vector once. Its sums are exact; the covariance sums
products of vectors less their rounded mean, exactly where entries allow, and takes the rest of the mean out in
integer arithmetic, so the result does not depend on how tasks are cut or repeated. The eigenvectors come from
Householder tridiagonalisation, bisection on Sturm counts and inverse iteration, orthogonalised inside
clusters. Only matrices of one row per dimension reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voidscope.session import stage

SCALE = 256
COMPONENTS = 4
_EXACT = 1 << 53
_LONG = (1 << 63) - 1
_CLUSTER = 1e-3  # of the norm: eigenvalues closer than this share a cluster


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, x``: ``floor(scale * c)`` of each entry, at most 2^62 either way.

    Rows whose vector is NULL or holds NULL or non-finite entries are dropped, repeated rows stay. Shorter vectors
    count as padded with zeros. Further columns are not read.
    """
    c = F.col("embedding").cast("array<double>")
    finite = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select("vec_id", c.alias("c")).filter(F.col("c").isNotNull() & finite)
    width = rows.agg(F.max(F.size("c"))).first()[0] or 0
    most = F.lit(float(1 << 62))
    x = F.transform("c", lambda v: F.floor(F.greatest(F.least(v * float(scale), most), -most)).cast("long"))
    padding = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("c"))
    return rows.select("vec_id", F.when(F.size("c") == width, x).otherwise(F.concat(x, padding)).alias("x"))


def _dense(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _totals(rows: DataFrame, kind: str, add) -> dict[int, float | int]:
    """Sums by number of what ``add(x, totals)`` adds up in each task; one small row per number and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: list = []
        for batch in batches:
            if batch.num_rows:
                add(_dense(batch.column(0)), totals)
        if totals:
            flat = np.concatenate([np.asarray(t).ravel() for t in totals])
            values = pa.array([str(v) for v in flat.tolist()] if kind != "double" else flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), values], ["at", "value"])

    parts = rows.mapInArrow(run, f"at long, value {'double' if kind == 'double' else 'string'}")
    summed = parts.groupBy("at").agg(F.sum(F.col("value").cast(kind)).alias("value")).orderBy("at").collect()
    return [r["value"] if kind == "double" else int(r["value"]) for r in summed]


def _exactly(a: np.ndarray) -> np.ndarray:
    """Integers that sums cannot overflow."""
    return a.astype(object)


def covariance(fit: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """Number of vectors, sums per dimension and covariance (divisor n) of ``fit(x)``."""

    def sums(x, totals):
        small = int(np.abs(x).max(initial=0)) < _EXACT // max(len(x), 1)
        new = [np.array([len(x)], object), _exactly(x.sum(axis=0)) if small else _exactly(x).sum(axis=0)]
        totals[:] = [a + b for a, b in zip(totals, new)] if totals else new

    found = _totals(fit.select("x"), "decimal(38,0)", sums)
    if not found:
        return 0, [], np.zeros((0, 0))
    n, total = found[0], found[1:]
    middle = [(2 * s + n) // (2 * n) for s in total]  # the rounded mean
    widest = max(fit.agg(F.min(F.array_min("x")), F.max(F.array_max("x"))).first(), key=lambda v: abs(v or 0)) or 0
    spread = abs(widest) + max(map(abs, middle), default=0)
    d = len(total)
    if spread * spread < _EXACT // 4:
        centre, rows = np.array(middle, np.int64), max(1, _EXACT // max(spread * spread, 1))

        def products(x, totals):
            for a in range(0, len(x), rows):
                y = (x[a:a + rows] - centre).astype(float)
                new = _exactly((y.T @ y).astype(np.int64))  # below 2^53, so exact
                totals[:] = [totals[0] + new] if totals else [new]

        g = _totals(fit.select("x"), "decimal(38,0)", products)
        rest = [s - n * m for s, m in zip(total, middle)]
        v = [(n * g[i * d + j] - rest[i] * rest[j]) / (n * n) for i in range(d) for j in range(d)]
    else:
        mean = np.array([s / n for s in total])

        def products(x, totals):
            y = x - mean
            totals[:] = [totals[0] + y.T @ y] if totals else [y.T @ y]

        v = [p / n for p in _totals(fit.select("x"), "double", products)]
    return n, total, np.array(v, float).reshape(d, d)


# ---------------------------------------------------------------- eigenvectors of one small matrix


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of the similar tridiagonal matrix, and the Householder vectors that lead to it."""
    a = np.array(a, float)
    d = len(a)
    vectors = []
    for k in range(d - 2):
        x = a[k + 1:, k]
        u = x.copy()
        norm = np.linalg.norm(x)
        u[0] += np.copysign(norm, x[0])
        length = np.linalg.norm(u)
        u = u / length if length > 0 else np.zeros_like(u)
        vectors.append(u)
        if length == 0:
            continue
        b = a[k + 1:, k + 1:]
        p = b @ u
        w = p - (u @ p) * u
        a[k + 1:, k + 1:] = b - 2 * (np.outer(u, w) + np.outer(w, u))
        a[k + 1, k] = a[k, k + 1] = -np.copysign(norm, x[0])
        a[k + 2:, k] = a[k, k + 2:] = 0
    return np.diag(a).copy(), np.diag(a, 1).copy(), vectors


def smaller(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues lie below each of ``at``."""
    least = np.finfo(float).tiny * max(1.0, float((off * off).max(initial=0)))
    q = diagonal[0] - at
    count = (q < 0).astype(np.int64)
    for i in range(1, len(diagonal)):
        q = np.where(np.abs(q) < least, -least, q)
        q = diagonal[i] - at - off[i - 1] ** 2 / q
        count += q < 0
    return count


def largest(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected until its bounds are neighbors."""
    d = len(diagonal)
    radius = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    low = np.full(k, (diagonal - radius).min())
    high = np.full(k, (diagonal + radius).max())
    pad = 4 * np.finfo(float).eps * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0))
    low, high = low - pad, high + pad
    below = d - 1 - np.arange(k)  # eigenvalues smaller than the wanted one
    while True:
        middle = low + (high - low) / 2
        going = (middle > low) & (middle < high)
        if not going.any():
            return middle
        up = smaller(diagonal, off, middle) <= below
        low, high = np.where(going & up, middle, low), np.where(going & ~up, middle, high)


def _solved(diagonal: np.ndarray, off: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Solution of a tridiagonal system by elimination with row exchange; zero pivots count as ``least``."""
    d = len(diagonal)
    rows = [[diagonal[i], off[i] if i < d - 1 else 0.0, 0.0] for i in range(d)]
    b = b.copy()
    for i in range(d - 1):
        below = [off[i], diagonal[i + 1], off[i + 1] if i + 1 < d - 1 else 0.0]
        if abs(below[0]) > abs(rows[i][0]):
            rows[i], below = below, rows[i]
            b[i], b[i + 1] = b[i + 1], b[i]
        if abs(rows[i][0]) < least:
            rows[i][0] = least
        f = below[0] / rows[i][0]
        rows[i + 1] = [below[1] - f * rows[i][1], below[2] - f * rows[i][2], 0.0]
        b[i + 1] -= f * b[i]
    if abs(rows[d - 1][0]) < least:
        rows[d - 1][0] = least
    x = np.zeros(d)
    for i in range(d - 1, -1, -1):
        rest = b[i]
        if i + 1 < d:
            rest -= rows[i][1] * x[i + 1]
        if i + 2 < d:
            rest -= rows[i][2] * x[i + 2]
        x[i] = rest / rows[i][0]
    return x


def leading_eigenvectors(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as columns; the largest entry of each is
    positive (the first of equal ones)."""
    d = len(a)
    k = min(k, d)
    if not k or not np.any(a):
        return np.zeros(k), np.eye(d)[:, :k]
    diagonal, off, reflections = tridiagonal(a)
    values = largest(diagonal, off, k)
    norm = float((np.abs(diagonal) + np.abs(np.append(off, 0)) + np.abs(np.append(0, off))).max())
    least = np.finfo(float).eps * norm
    start = np.random.default_rng(1)
    vectors = np.zeros((d, k))
    cluster, shift = 0, 0.0
    for i in range(k):
        if i and values[i - 1] - values[i] > _CLUSTER * norm:
            cluster = i
        # equal eigenvalues are shifted apart a little, so that their systems differ
        shift = values[i] if i == cluster else min(values[i], shift - 4 * least)
        x = start.uniform(-1, 1, d)
        for _ in range(6):
            for j in range(cluster, i):
                x -= (vectors[:, j] @ x) * vectors[:, j]
            x = _solved(diagonal - shift, off, x / np.linalg.norm(x), least)
        for _ in range(2):
            for j in range(cluster, i):
                x -= (vectors[:, j] @ x) * vectors[:, j]
            x /= np.linalg.norm(x)
        vectors[:, i] = x
    for at in range(len(reflections) - 1, -1, -1):
        u = reflections[at]
        vectors[at + 1:] -= 2 * np.outer(u, u @ vectors[at + 1:])
    vectors /= np.linalg.norm(vectors, axis=0)
    for i in range(k):
        if vectors[np.argmax(np.abs(vectors[:, i])), i] < 0:
            vectors[:, i] *= -1
    return values, vectors


# ---------------------------------------------------------------- model


@dataclass
class Whitening:
    """A fitted map: ``n`` vectors with sums ``total``, eigenvalues and unit vectors, their share of the trace, and
    how far the covariance of the whitened fit list is from the identity."""

    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def whitened(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([s / self.n for s in self.total])
        whole = np.floor(mean)
        part = np.array([s - self.n * int(w) for s, w in zip(self.total, whole)], float) / self.n
        centred = (x.astype(float) - whole) - part if np.abs(x).max(initial=0) >= _EXACT else (
            x - whole.astype(np.int64)).astype(float) - part
        return centred @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Exact sum of ``(n * x - total)^2`` per row."""
        widest = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.total), default=0)
        if widest * widest * max(x.shape[1], 1) <= _LONG:
            t = self.n * x - np.array(self.total, np.int64)
            return (t * t).sum(axis=1).tolist()
        t = x.astype(object) * self.n - np.array(self.total, object)
        return (t * t).sum(axis=1).tolist()


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the different ``x`` of ``vectors(vec_id, x)``; None without any.

    Components whose eigenvalue is zero up to rounding are left out: one vector, or equal ones, have none.
    """
    different = stage(vectors.select("x").distinct(), "fit-list")
    n, total, v = covariance(different)
    if not n:
        return None
    trace = float(np.trace(v))
    values, axes = leading_eigenvectors(v, components)
    real = values > len(v) * np.finfo(float).eps * trace
    model = Whitening(n, total, values[real], axes[:, real], values[real] / trace if trace > 0 else values[real])
    k = int(real.sum())
    if k:
        def moments(x, totals):
            z = model.whitened(x)
            new = [z.sum(axis=0), z.T @ z]
            totals[:] = [a + b for a, b in zip(totals, new)] if totals else new

        found = np.array(_totals(different, "double", moments))
        mean = found[:k] / n
        model.identity_error = float(np.abs(found[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    return model


def transform(vectors: DataFrame, model: Whitening | None) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per row and component (from 1).

    ``deviation`` is exact, or NULL where it leaves 64 bits.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    k = len(model.values) if model else 0
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # a few vectors of one entry per dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _dense(batch.column("x"))
            rows = np.repeat(np.arange(len(x)), k)
            deviation = pa.array([v if v <= _LONG else None for v in own.deviation(x)], pa.int64())
            yield pa.RecordBatch.from_arrays([
                pc.take(batch.column("vec_id"), pa.array(rows)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(rows), own.n, np.int64)), pc.take(deviation, pa.array(rows)),
                pa.array(own.whitened(x).ravel()), pa.array(np.tile(own.explained, len(x))),
                pa.array(np.full(len(rows), own.identity_error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, schema)


def whiten(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Leading whitened components of all valid rows, fitted on their different vectors."""
    vectors = integers(embeddings, scale)
    return transform(vectors, fit(vectors, components))
