"""Whitening of embeddings through a pivoted Cholesky factor and Jacobi rotations.

Entries become integers, so the sums that centre them are exact.  The scatter
of the centred vectors is factored with complete pivoting, V = L L'; one-sided
Jacobi rotates the columns of L until they are orthogonal.  The rotated columns'
squared norms are then V's eigenvalues, and the normalised columns its unit
eigenvectors: L itself is never multiplied out again.

Spark makes the distinct vectors, sums and scatter (a task adds up its rows, and
rows of the scatter are added up across tasks); what reaches the driver is the
d x d matrix of a d-dimensional vector, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.llm import blocks as B
from jobsift.llm.packed_ids import _arrow_type

SCALE = 256
COMPONENTS = 4
#: entries of a larger size have no place in a long after scaling
LARGEST = float(1 << 61)
EPS = float(np.finfo(np.float64).eps)
LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """A fitted model: ``n`` vectors with per-dimension sums ``sums``, V's
    ``trace``, falling eigenvalues ``values`` and unit eigenvectors ``vectors``
    (rows, the largest entry positive), and ``error``, the largest entry of the
    whitened vectors' covariance minus the identity."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    error: float = 0.0

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum of (n * x - S) ** 2 over the dimensions of each row, exactly."""
        most = max(int(np.abs(x).max(initial=0)), 1)
        widest = self.n * most + max(map(abs, self.sums), default=0)
        if widest * widest * max(len(self.sums), 1) <= LONG:
            y = x * self.n - np.array(self.sums, np.int64)
            return (y * y).sum(axis=1).tolist()
        return [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, with the whole part of the mean taken off before rounding."""
        parts = [divmod(s, self.n) for s in self.sums]
        whole = np.array([q for q, _ in parts], np.int64)
        return (x - whole).astype(np.float64) - np.array([r / self.n for _, r in parts])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values)[:, None]).T


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """Lower trapezoidal factor, rows in the matrix's own order: v = L L'.  Stops
    at the rank, where no pivot is left above rounding."""
    a = v.astype(np.float64).copy()
    d = len(a)
    order, cols = np.arange(d), np.zeros((d, d))
    least = d * EPS * max(float(np.diag(a).max(initial=0.0)), 0.0)
    for k in range(d):
        left = np.diag(a)[k:]
        p = k + int(left.argmax())
        if left[p - k] <= least:
            cols = cols[:, :k]
            break
        for m in (a, cols):
            m[[k, p]] = m[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        cols[k, k] = sqrt(a[k, k])
        cols[k + 1:, k] = a[k + 1:, k] / cols[k, k]
        a[k + 1:, k + 1:] -= np.outer(cols[k + 1:, k], cols[k + 1:, k])
    out = np.empty_like(cols)
    out[order] = cols
    return out


def _rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns in rounds of disjoint pairs (a tournament)."""
    ring = list(range(n + n % 2))
    out = []
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(a, b) for a, b in zip(ring[:half], ring[::-1][:half]) if a < n and b < n]
        out.append((np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Rotate pairs of columns until all are orthogonal to working precision."""
    g = factor.copy()
    rounds = _rounds(g.shape[1])
    for _ in range(sweeps):
        largest = 0.0
        for i, j in rounds:
            x, y = g[:, i], g[:, j]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(a * b)
            turn = np.abs(c) > 4 * EPS * size
            if not turn.any():
                continue
            largest = max(largest, float((np.abs(c)[turn] / size[turn]).max()))
            i, j, x, y, a, b, c = i[turn], j[turn], x[:, turn], y[:, turn], a[turn], b[turn], c[turn]
            zeta = (b - a) / (2 * c)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cos = 1 / np.hypot(1.0, t)
            sin = cos * t
            g[:, i], g[:, j] = cos * x - sin * y, sin * x + cos * y
        if largest <= 64 * EPS:
            return g
    return g


def principal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling positive eigenvalues of a positive semidefinite matrix and its
    unit eigenvectors (rows)."""
    g = jacobi(pivoted_cholesky(v))
    norms = np.sqrt((g * g).sum(0))
    rank = np.argsort(-norms, kind="stable")
    rank = rank[norms[rank] > 0]
    vectors = (g[:, rank] / norms[rank]).T
    if len(vectors):
        vectors *= np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])[:, None]
    return norms[rank] ** 2, vectors


def quantised(vec: str, scale: int = SCALE) -> Column:
    """floor(scale * c) of each entry as long; null where the vector is null, is
    empty, or has an entry that is null, not finite or too large for a long."""
    v = F.col(vec).cast("array<double>")
    fine = F.forall(v, lambda c: F.coalesce(F.abs(c * scale) <= LARGEST, F.lit(False)))
    return F.when(F.coalesce(fine, F.lit(False)) & (F.size(v) > 0), F.transform(
        v, lambda c: F.floor(c * scale).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _added(fit: DataFrame, part_rows) -> np.ndarray:
    """Sum over tasks of the matrix that ``part_rows`` makes of each batch of
    vectors; row by row of the matrix, tasks in order."""

    def run(batches):
        from pyspark import TaskContext
        total = None
        for batch in batches:
            for s in B.slices(batch, B.TARGET):
                if s.num_rows:
                    m = part_rows(_matrix(s.column(0)))
                    total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_pydict({
                "row": pa.array(range(len(total)), pa.int64()),
                "task": pa.array([TaskContext.get().partitionId()] * len(total), pa.int64()),
                "payload": pa.array([r.tobytes() for r in total], pa.binary())})

    def add(batches):
        for row, got in B.grouped(B.rows_of(batches), 0):
            total = np.frombuffer(got[0][2], np.float64).copy()
            for _, _, x in got[1:]:
                total += np.frombuffer(x, np.float64)
            yield pa.RecordBatch.from_pydict({"row": [row], "payload": [total.tobytes()]})

    parts = fit.select("x").mapInArrow(run, "row long, task long, payload binary")
    rows = B.by_key(parts, "row", "task").mapInArrow(add, "row long, payload binary").collect()
    return np.array([np.frombuffer(r.payload, np.float64) for r in sorted(rows, key=lambda r: r.row)])


def _sums(fit: DataFrame) -> tuple[int, tuple[int, ...]]:
    """Number of vectors and exact sums of their dimensions."""

    def run(batches):
        n, total = 0, None
        for batch in batches:
            for s in B.slices(batch, B.TARGET):
                x = _matrix(s.column(0))
                if len(x):
                    # halves of 32 bits: a slice's sums of each stay within a long
                    high, low = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
                    part = [(h << 32) + lo for h, lo in zip(high, low)]
                    n, total = n + len(x), part if total is None else [a + b for a, b in zip(total, part)]
        if n:
            yield pa.RecordBatch.from_pydict({
                "at": pa.array(range(len(total)), pa.int32()), "n": pa.array([n] * len(total), pa.int64()),
                "s": pa.array([Decimal(v) for v in total], pa.decimal128(38, 0))})

    parts = fit.select("x").mapInArrow(run, "at int, n long, s decimal(38,0)")
    rows = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("at").collect()
    return (rows[0].n, tuple(int(r.s) for r in rows)) if rows else (0, ())


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct vectors of ``x`` (array<long> of one length); None
    without any.  Components along which nothing varies are left out."""
    return _fit(B.stored(vectors.select("x").distinct(), "vectors"), components)


def _fit(fit: DataFrame, components: int) -> Whitening | None:
    n, sums = _sums(fit)
    if not n:
        return None
    model = Whitening(n, sums, 0.0, np.zeros(0), np.zeros((0, len(sums))))

    def scatter(x):
        y = model.centred(x)
        return y.T @ y

    v = _added(fit, scatter) / n
    values, directions = principal((v + v.T) / 2)
    model = Whitening(n, sums, float(np.trace(v)), values[:components], directions[:components])
    if not len(model.values):
        return model

    def moments(x):
        w = model.whitened(x)
        return np.vstack((w.T @ w, w.sum(0)))

    got = _added(fit, moments) / n
    covariance = got[:-1] - np.outer(got[-1], got[-1])
    error = float(np.abs(covariance - np.eye(len(covariance))).max())
    return Whitening(n, sums, model.trace, model.values, model.vectors, error)


def whiten(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE) -> DataFrame:
    """Per row whose vector is whole: the id, ``n``, ``deviation`` (exact; null
    beyond a long), ``whitened`` (array, one entry a component), ``explained``
    (array: the component's share of the trace) and ``identity_error``.

    Rows are dropped whose vector is null or empty, holds a null or non-finite
    entry or one too large for a long, or has not the length that most distinct
    vectors have (the greater of two as frequent).  Repeated rows and ids each
    have a row; copies are fitted once.  Where vectors vary in fewer directions
    than ``components``, only those are components: equal vectors alone have none.
    Other columns are left out; an empty table gives no rows.
    """
    rows = table.select(F.col(id_col), quantised(vec_col, scale).alias("x")).filter("x IS NOT NULL")
    kind, id_type = table.schema[id_col].dataType.simpleString(), _arrow_type(table, id_col)
    schema = (f"`{id_col}` {kind}, n long, deviation long, whitened array<double>, explained array<double>, "
              "identity_error double")
    fit = B.stored(rows.select("x").distinct(), "vectors")
    usual = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    long_enough = F.size("x") == (usual.d if usual else 0)
    rows, model = rows.filter(long_enough), _fit(fit.filter(long_enough), components)
    if model is None:
        return table.sparkSession.createDataFrame([], schema)
    share = (model.values / model.trace).tolist() if model.trace > 0 else []

    def run(batches):
        for batch in batches:
            for s in B.slices(batch, B.TARGET):
                x, n = _matrix(s.column(1)), s.num_rows
                if n:
                    w = model.whitened(x) if len(model.values) else np.zeros((n, 0))
                    yield pa.RecordBatch.from_arrays([
                        s.column(0).cast(id_type), pa.array([model.n] * n, pa.int64()),
                        pa.array([v if v <= LONG else None for v in model.deviations(x)], pa.int64()),
                        pa.array(w.tolist(), pa.list_(pa.float64())), pa.array([share] * n, pa.list_(pa.float64())),
                        pa.array([model.error] * n, pa.float64())],
                        [id_col, "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op12_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.select("vec_id", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"), "n", "deviation",
                       "identity_error").select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"),
        F.col("c.explained").alias("explained"), "identity_error")
