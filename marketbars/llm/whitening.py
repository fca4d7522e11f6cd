"""Whitening of embeddings: leading components of a distributed covariance, computed by hand, and a broadcast projection.

Vectors are put on a grid (x = floor(scale * c), whole numbers), so that sums are exact and equal vectors are told by
equality; a constant added to all x changes no result, so none is. The fit list is each distinct grid vector once: a hot vector is folded before the shuffle, and vectors
travel packed in the narrowest integers that hold them. Three passes over the fit list follow: sums (exact), products of
rows centred at the exact mean, and, with the components known, the covariance of the whitened rows. A pass runs in at
most TASKS_PER_CORE tasks for each core, each of which adds up d x d numbers batch by batch; what the tasks add up to is
summed by matrix row in Spark, and only the d x d matrix reaches the driver, whose size has nothing to do with the number
of rows. There the matrix is made tridiagonal by Householder reflections, its leading eigenvalues are found by bisection
on Sturm counts, and the eigenvectors by inverse iteration, orthogonalised anew inside clusters of near eigenvalues. The
projection of every row broadcasts d x k numbers.

Cases: a null vector, or one with a null, NaN or infinite entry is dropped, as the contract says. Vectors have the
length that most rows have (the longer one of a tie); others belong to no such space and are left out, as are empty ones.
Entries beyond 2**61 of the grid are held there. Null ids are kept, repeated rows each get their rows. A component
without variance can't be scaled to one, so it is not returned: a single distinct vector gives an empty result, as does
an empty table. deviation is null where it doesn't fit in a long. Other columns of the input are not looked at. More than
MOST_DIMENSIONS dimensions are refused, since the driver holds the matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

SCALE, COMPONENTS = 64, 16
TASKS_PER_CORE = 2
MOST_DIMENSIONS = 8192
#: Eigenvalues nearer than this part of the matrix norm make a cluster.
CLUSTER = 1e-3
EPS = float(np.finfo(np.float64).eps)


# --- the symmetric eigenproblem


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal, off-diagonal and the unit vectors of the Householder reflections that make v tridiagonal."""
    a, mirrors = np.array(v, np.float64), []
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        rest = np.linalg.norm(x[1:])
        if rest == 0:
            mirrors.append(None)
            continue
        alpha = -np.copysign(np.hypot(x[0], rest), x[0])
        x[0] -= alpha
        u = x / np.linalg.norm(x)
        sub = a[k + 1 :, k + 1 :]
        p = sub @ u
        w = p - (u @ p) * u
        sub -= 2 * (np.outer(u, w) + np.outer(w, u))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = alpha
        mirrors.append(u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def count_below(diag: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm counts: for each x, how many eigenvalues of the tridiagonal matrix are below it."""
    tiny = np.finfo(np.float64).tiny / EPS
    squares, n, q = off * off, np.zeros(len(x), np.int64), np.ones(len(x))
    for i in range(len(diag)):
        q = diag[i] - x - (squares[i - 1] / q if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)  # a pivot of nought counts as one below it
        n += q < 0
    return n


def leading_eigenvalues(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection down to neighbouring doubles (or to what the norm allows)."""
    d = len(diag)
    reach = np.concatenate([[0], np.abs(off)]) + np.concatenate([np.abs(off), [0]])
    norm = float(np.max(np.abs(diag) + reach)) or 1.0
    below = d - np.arange(1, k + 1)  # the j-th largest has d - j eigenvalues below it
    low = np.full(k, float(np.min(diag - reach)) - EPS * norm)
    high = np.full(k, float(np.max(diag + reach)) + EPS * norm)
    while True:
        mid = low + (high - low) / 2
        open_ = (mid > low) & (mid < high) & (high - low > EPS * EPS * norm)
        if not open_.any():
            return mid
        more = count_below(diag, off, mid) > below  # the eigenvalue is below mid
        high, low = np.where(open_ & more, mid, high), np.where(open_ & ~more, mid, low)


class _Shifted:
    """T - x I by elimination with row exchanges; a pivot of nought is taken as the smallest that counts."""

    def __init__(self, diag: np.ndarray, off: np.ndarray, x: float, norm: float):
        d = len(diag)
        a, b, c = (diag - x).tolist(), [*off.tolist(), 0.0], [0.0] * d  # main, first and second upper diagonal
        low, self.swap, self.factor = off.tolist(), [False] * d, [0.0] * d
        least = EPS * norm
        for i in range(d - 1):
            if abs(low[i]) > abs(a[i]):
                self.swap[i] = True
                a[i], low_i = low[i], a[i]
                b[i], a[i + 1] = a[i + 1], b[i]
                c[i], b[i + 1] = b[i + 1], 0.0
            else:
                low_i = low[i]
            pivot = a[i] if abs(a[i]) > least else least
            a[i] = pivot
            f = self.factor[i] = low_i / pivot
            a[i + 1] -= f * b[i]
            b[i + 1] -= f * c[i]
        if abs(a[-1]) < least:
            a[-1] = least
        self.a, self.b, self.c = a, b, c

    def solve(self, y: np.ndarray) -> np.ndarray:
        z, d = y.tolist(), len(self.a)
        for i in range(d - 1):
            if self.swap[i]:
                z[i], z[i + 1] = z[i + 1], z[i]
            z[i + 1] -= self.factor[i] * z[i]
        for i in range(d - 1, -1, -1):
            s = z[i]
            if i + 1 < d:
                s -= self.b[i] * z[i + 1]
            if i + 2 < d:
                s -= self.c[i] * z[i + 2]
            z[i] = s / self.a[i]
        return np.array(z)


def inverse_iteration(diag: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Unit eigenvectors (columns) of the tridiagonal matrix for falling eigenvalues."""
    d = len(diag)
    reach = np.concatenate([[0], np.abs(off)]) + np.concatenate([np.abs(off), [0]])
    norm = float(np.max(np.abs(diag) + reach)) or 1.0
    out, rnd, cluster = np.zeros((d, len(values))), np.random.default_rng(7), 0
    for j, x in enumerate(values.tolist()):
        if j and values[j - 1] - x > CLUSTER * norm:
            cluster = j
        near, shifted = out[:, cluster:j], _Shifted(diag, off, x, norm)
        y = rnd.standard_normal(d)
        for _ in range(rounds):
            y = shifted.solve(y / np.linalg.norm(y))
            y /= np.linalg.norm(y)
            for _ in range(2):  # once more, for what the first time leaves
                y = y - near @ (near.T @ y)
                y /= np.linalg.norm(y)
        out[:, j] = y
    return out


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    scale = float(np.abs(v).max()) or 1.0
    diag, off, mirrors = tridiagonal(v / scale)
    values = leading_eigenvalues(diag, off, min(k, len(v)))
    z = inverse_iteration(diag, off, values)
    for i in range(len(mirrors) - 1, -1, -1):
        if mirrors[i] is not None:
            z[i + 1 :] -= 2 * np.outer(mirrors[i], mirrors[i] @ z[i + 1 :])
    return values * scale, z / np.linalg.norm(z, axis=0)


# --- vectors on the grid


def valid_vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id and v (array of double) of the rows whose vector is whole and finite."""
    v = F.col("v")
    rows = df.select(df[id_col].cast("long").alias("id"), df[vector].cast("array<double>").alias("v"))
    return rows.where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))


def dimensions(rows: DataFrame) -> int:
    """The length that most vectors have; 0 if there are none."""
    found = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if found and found[0]["d"] > MOST_DIMENSIONS:
        raise ValueError(f"vectors of more than {MOST_DIMENSIONS} dimensions")
    return found[0]["d"] if found else 0


def _grid(c: pa.Array, d: int, scale: int) -> np.ndarray:
    """floor(scale * c) of an array of lists of d doubles, as a matrix."""
    with np.errstate(over="ignore"):
        x = np.floor(c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d) * scale)
    return np.clip(x, -(2.0**61), 2.0**61).astype(np.int64)


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row in the narrowest of 2, 4 and 8 bytes a number."""
    most, out = np.abs(x).max(axis=1), [b""] * len(x)
    for bytes_, low, high in ((2, -1, 1 << 15), (4, (1 << 15) - 1, 1 << 31), (8, (1 << 31) - 1, 1 << 62)):
        at = np.flatnonzero((most > low) & (most < high))
        rows = x[at].astype(f"<i{bytes_}")
        for i, r in zip(at.tolist(), rows, strict=True):
            out[i] = r.tobytes()
    return out


def _unpacked(col: pa.Array, d: int) -> np.ndarray:
    return np.stack([np.frombuffer(b, f"<i{len(b) // d}").astype(np.int64) for b in col.to_pylist()]) if len(col) else np.zeros((0, d), np.int64)


def fit_list(rows: DataFrame, d: int, scale: int = SCALE) -> DataFrame:
    """Each distinct grid vector once (column x, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([pa.array(_packed(_grid(b.column(0), d, scale)), pa.binary())], ["x"])

    return rows.where(F.size("v") == d).select("v").mapInArrow(run, "x binary").distinct()


@dataclass(frozen=True)
class Whitening:
    """What is sent to the tasks: of a size that depends on the number of dimensions only."""

    scale: int
    n: int
    sums: list[int]  # of the grid vectors
    components: np.ndarray  # d x k
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: whole numbers first, so that nothing is lost, then the fraction."""
        whole = [s // self.n for s in self.sums]
        part = np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole, strict=True)])
        return (x - np.array(whole, np.int64)).astype(np.float64) - part

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum((n x - S)^2) of each row, exactly. None where it doesn't fit in a long."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        if most * most * x.shape[1] < 1 << 63:
            t = self.n * x - np.array(self.sums, np.int64)
            return (t * t).sum(axis=1).tolist()
        out = [sum((self.n * v - s) ** 2 for v, s in zip(r, self.sums, strict=True)) for r in x.tolist()]
        return [v if v < 1 << 63 else None for v in out]


def _passed(fit: DataFrame, run: Callable, schema: str) -> DataFrame:
    """A pass over the fit list in a number of tasks that depends on the cluster, not on the rows."""
    return fit.coalesce(max(1, fit.sparkSession.sparkContext.defaultParallelism * TASKS_PER_CORE)).mapInArrow(run, schema)


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for b in batches:
            x = _unpacked(b.column(0), d)
            if len(x):
                small = int(np.abs(x).max()) * len(x) < 1 << 62
                sums = [s + int(v) for s, v in zip(sums, (x if small else x.astype(object)).sum(axis=0), strict=True)]
                n += len(x)
        if n:
            yield pa.record_batch([pa.array(range(-1, d), pa.int32()), pa.array([Decimal(v) for v in (n, *sums)], pa.decimal128(38, 0))], ["dim", "v"])

    found = {r[0]: int(r[1]) for r in _passed(fit, run, "dim int, v decimal(38,0)").groupBy("dim").agg(F.sum("v")).collect()}  # d + 1 rows
    return found.get(-1, 0), [found.get(i, 0) for i in range(d)]


def covariance(fit: DataFrame, at: Whitening) -> np.ndarray:
    """Mean product of the centred vectors. Tasks add up their own; matrix rows are dealt over tasks, which add up those of all."""
    d = len(at.sums)
    shared = fit.sparkSession.sparkContext.broadcast(at)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            c = shared.value.centred(_unpacked(b.column(0), d))
            total += c.T @ c
        yield from by_row(total)

    def by_row(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in np.flatnonzero(np.abs(total).max(axis=1)).tolist():
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([total[i].tolist()], pa.list_(pa.float64()))], ["i", "row"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, row in zip(b.column(0).to_pylist(), b.column(1).flatten().to_numpy().reshape(-1, d), strict=True):
                total[i] = total[i] + row if i in total else row
        for i, row in total.items():
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([row.tolist()], pa.list_(pa.float64()))], ["i", "row"])

    v = np.zeros((d, d))
    for i, row in _passed(fit, products, "i int, row array<double>").repartition("i").mapInArrow(added, "i int, row array<double>").collect():  # d rows
        v[i] = row
    return (v + v.T) / (2 * at.n)


def identity_error(fit: DataFrame, at: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, measured in a pass of its own."""
    d, k = at.components.shape
    shared = fit.sparkSession.sparkContext.broadcast(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, products = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                y = shared.value.project(_unpacked(b.column(0), d))
                own = y.mean(axis=0)
                c, away, both = y - own, own - mean, n + len(y)
                products += c.T @ c + np.outer(away, away) * n * len(y) / both
                mean, n = mean + away * len(y) / both, both
        if n:
            yield pa.record_batch([pa.array([n], pa.int64()), pa.array([mean.tolist()]), pa.array([products.ravel().tolist()])], ["n", "mean", "products"])

    n, mean, products = 0, np.zeros(k), np.zeros(k * k)
    for m, own, p in _passed(fit, run, "n long, mean array<double>, products array<double>").collect():  # a row for each task
        away, both = np.array(own) - mean, n + m
        products += np.array(p) + np.outer(away, away).ravel() * n * m / both
        mean, n = mean + away * m / both, both
    return float(np.abs(products.reshape(k, k) / n - np.eye(k)).max()) if k else 0.0


def fit_whitening(rows: DataFrame, k: int = COMPONENTS, scale: int = SCALE) -> Whitening | None:
    """The whitening of valid_vectors() by the distinct grid vectors among them; None if there are no rows."""
    d = dimensions(rows)
    if not d:
        return None
    fit = keep(fit_list(rows, d, scale), "fit_list")
    n, sums = exact_sums(fit, d)
    at = Whitening(scale, n, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    v = covariance(fit, at)
    values, vectors = leading_components(v, k)
    good = values > d * EPS * max(float(values[0]), 0.0)
    at = Whitening(scale, n, sums, vectors[:, good], values[good], float(np.trace(v)))
    return Whitening(**(vars(at) | {"identity_error": identity_error(fit, at)}))


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, at: Whitening) -> DataFrame:
    """A row for each row of valid_vectors() and component."""
    d, k = at.components.shape
    shared = rows.sparkSession.sparkContext.broadcast(at)
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    fields = [(f.split()[0], types[f.split()[1]]) for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _grid(b.column(1), d, w.scale)
            m = len(x)
            of = pa.array(np.repeat(np.arange(m), k))
            columns = [b.column(0).take(of), np.tile(np.arange(1, k + 1), m), np.full(m * k, w.n), pa.array(w.deviations(x), pa.int64()).take(of),
                       w.project(x).ravel(), np.tile(w.eigenvalues / w.trace, m), np.full(m * k, w.identity_error)]
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    return rows.where(F.size("v") == d).select("id", "v").mapInArrow(run, SCHEMA)


def op11(embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    rows = valid_vectors(embeddings, id_col, vector)
    at = fit_whitening(rows)
    if at is None or not at.components.shape[1]:
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    return whiten(rows, at)
