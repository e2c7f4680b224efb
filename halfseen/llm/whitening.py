"""Whitening of embeddings: covariance by two exact-sum passes, components by FEAST contour integration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halfseen.llm.common import query, table
from halfseen.llm.vectors import collected, finite, integers, matrix, summed

SCALE, SHIFT = 1024, 100_000
NODES = 8            # quadrature nodes on the upper half of a contour
MOST = 4             # eigenvalues an interval should hold at most
SWEEPS = 40          # contour integrations of one interval before it counts as failed
EPS = float(np.finfo(float).eps)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix (Householder)."""
    a = a.copy()
    for k in range(len(a) - 2):
        v = a[k + 1:, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v[0] += size if v[0] >= 0 else -size
        v /= np.linalg.norm(v)
        a[k + 1:] -= 2 * np.outer(v, v @ a[k + 1:])
        a[:, k + 1:] -= 2 * np.outer(a[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy()


class Inertia:
    """How many eigenvalues of a symmetric matrix exceed a shift: signs of the pivots of the shifted matrix."""

    def __init__(self, a: np.ndarray):
        self.main, off = tridiagonal(a)
        self.square = np.concatenate([[0.0], off ** 2])
        reach = np.concatenate([[0.0], np.abs(off), [0.0]])
        self.low, self.high = float((self.main - reach[:-1] - reach[1:]).min()), float((self.main + reach[:-1] + reach[1:]).max())
        pad = 1e-3 * max(abs(self.low), abs(self.high)) + 1e-300
        self.low, self.high = self.low - pad, self.high + pad

    def above(self, shift: float) -> int:
        pivot, n = 1.0, 0
        least = EPS * (self.high - self.low) * 1e-8
        for d, s in zip(self.main, self.square):
            pivot = d - shift - s / pivot
            if abs(pivot) < least:
                pivot = -least
            n += pivot > 0
        return n


def slices(inertia: Inertia, wanted: int, most: int = MOST) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues inside), from the top, that hold the `wanted` largest eigenvalues.

    An interval is split until it holds at most `most` of them or is too narrow; splits look
    for a place with no eigenvalue close by.
    """
    out, n = [], len(inertia.main)
    open_ = [(inertia.low, inertia.high, 0, n)]           # eigenvalues above its high end, above its low end
    while open_:
        low, high, before, after = open_.pop()
        if before >= wanted or before == after:
            continue
        width = high - low
        if after - before <= most or width <= 1e-9 * max(abs(low), abs(high)):
            out.append((low, high, after - before))
            continue
        places = [low + width * (0.5 + 0.03 * k * s) for k in range(8) for s in ((1,) if k == 0 else (1, -1))]
        free = next((p for p in places if inertia.above(p - width / 99) == inertia.above(p + width / 99)), places[0])
        inside = inertia.above(free)
        open_ += [(low, free, inside, after), (free, high, before, inside)]      # the upper part comes next
    return out


def rayleigh_ritz(a: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of a on the space of y's columns."""
    q = np.linalg.qr(y)[0]
    values, turn = np.linalg.eigh(q.T @ a @ q)
    return values, q @ turn


def feast(a: np.ndarray, low: float, high: float, inside: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The `inside` eigenpairs of a in (low, high): a contour integral of the resolvent filters a random space, again and again.

    Gauss-Legendre nodes z on the half circle over the interval; each asks for one solve with
    z - a. Of the filtered space Rayleigh-Ritz gives the pairs. Ends when as many pairs as the
    inertia says are inside and all are exact to rounding.
    """
    n = len(a)
    x, w = np.polynomial.legendre.leggauss(NODES)
    ray = np.exp(0.5j * np.pi * (1 + x)) * (high - low) / 2
    y = np.random.default_rng(seed).standard_normal((n, min(n, 2 * inside + 4)))
    goal = 64 * n * EPS * max(abs(low), abs(high), np.abs(np.diag(a)).max())
    for _ in range(SWEEPS):
        y = sum(wk * (r * np.linalg.solve(((low + high) / 2 + r) * np.eye(n) - a, y)).real for wk, r in zip(w, ray))
        values, y = rayleigh_ritz(a, y)
        mine = (values > low) & (values <= high)
        if mine.sum() == inside and np.abs(a @ y[:, mine] - y[:, mine] * values[mine]).max() <= goal:
            return values[mine], y[:, mine]
    raise ArithmeticError(f"{int(mine.sum())} of {inside} eigenvalues found between {low} and {high}")


def principal(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues, falling, and unit vectors as columns.

    The vectors of all intervals are made orthogonal once more together. The inertia at the
    lowest end says how many there have to be.
    """
    inertia = Inertia(a)
    parts = slices(inertia, wanted)
    found = [feast(a, low, high, inside)[1] for low, high, inside in parts]
    values, vectors = rayleigh_ritz(a, np.hstack(found))
    if len(values) != inertia.above(parts[-1][0]):
        raise ArithmeticError("an eigenvalue was missed")
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], vectors[:, order]


def deviations(y: np.ndarray) -> pa.Array:
    """Sum of squares of every row, exact."""
    if len(y) and float(np.abs(y).max()) ** 2 * y.shape[1] >= 2.0 ** 62:
        return pa.array([sum(int(v) ** 2 for v in r) for r in y.tolist()], pa.decimal128(38, 0))
    return pa.array((y * y).sum(axis=1)).cast(pa.decimal128(38, 0))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Entries become x = floor(1024 c) + 100000. The tasks add up n and the sums S exactly, then
    the covariance of x (n x - S as integers, divided, then multiplied); the driver gets both,
    d and d (d + 1) / 2 numbers. FEAST finds the largest `components` eigenpairs on the driver;
    a third pass measures the covariance of the whitened rows, a fourth gives the rows.
    Nothing but these sums leaves a task and nothing is shuffled by key.

    Left out: null vectors, vectors with null or non-finite entries (or of a million and more),
    and vectors of another length than most have (of equally frequent lengths the longer).
    Null and repeated ids and repeated vectors are rows as any. A component without variance
    has no whitening: null (with explained 0, or null where nothing varies). With fewer
    dimensions than `components` there are fewer. Equal eigenvalues: any basis of their space.
    deviation is decimal(38,0). Other columns are not read; an empty table gives no rows.
    """
    schema = (f"{id_col} {dict(vectors.dtypes)[id_col]}, component int, n long, deviation decimal(38,0), whitened double, "
              "explained double, identity_error double")
    clean = vectors.where(finite(vector_col)).select(F.col(id_col).alias("id"), vector_col)
    width = clean.groupBy(F.size(vector_col).alias("d")).count().agg(F.max_by("d", F.struct("count", "d")).alias("d")).first()["d"]
    if not width:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = clean.where(F.size(vector_col) == width).select("id", integers(vector_col, SCALE, SHIFT).alias("x"))

    totals = collected(summed(rows.select("x"), lambda b: np.append(matrix(b.column("x"), width).sum(axis=0), b.num_rows), "long"), width + 1, int)
    n, sums = int(totals[-1]), [int(v) for v in totals[:-1]]
    wide = n * max(map(abs, sums)) >= 1 << 62 or n >= 1 << 30
    sums = np.array(sums, object if wide else np.int64)

    def scaled(batch: pa.RecordBatch) -> np.ndarray:
        """n x - S, exact."""
        x = matrix(batch.column("x"), width)
        return (x.astype(object) if wide else x) * n - sums

    upper = np.triu_indices(width)

    def spread(batch: pa.RecordBatch) -> np.ndarray:
        y = scaled(batch).astype(float) / n
        return (y.T @ y)[upper] / n

    cov = np.zeros((width, width))
    cov[upper] = collected(summed(rows.select("x"), spread, "double"), len(upper[0]))
    cov += np.triu(cov, 1).T
    trace, k = float(np.trace(cov)), min(components, width)
    values, turn = principal(cov, k) if trace > 0 else (np.zeros(k), np.eye(width)[:, :k])
    some = values > width * EPS * trace
    to_white = np.where(some, turn / np.sqrt(np.where(some, values, 1.0)), np.nan)
    share = [float(v) / trace if trace > 0 else None for v in np.maximum(values, 0)]

    def white(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        y = scaled(batch)
        return y, (y.astype(float) / n) @ to_white

    error = None
    if some.any():
        def own(batch: pa.RecordBatch) -> np.ndarray:
            z = white(batch)[1][:, some]
            return (z.T @ z).ravel() / n
        m = int(some.sum())
        error = float(np.abs(collected(summed(rows.select("x"), own, "double"), m * m).reshape(m, m) - np.eye(m)).max())

    def emit(batches):
        for batch in batches:
            y, z = white(batch)
            take = pa.array(np.repeat(np.arange(len(y)), k))
            flat = z.ravel()
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
                pa.array(np.full(len(y) * k, n)), deviations(y).take(take), pa.array(flat, mask=np.isnan(flat)),
                pa.array(share * len(y), pa.float64()), pa.array([error] * (len(y) * k), pa.float64())],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(emit, schema)


@query("op11_whiten_embeddings")
def op11_whiten_embeddings(spark, d):
    """deviation is null where it does not fit a long; deviation_exact holds it anyway."""
    out = whiten(table(spark, d, "embeddings"))
    return out.withColumns({"deviation_exact": F.col("deviation"), "deviation": F.expr("try_cast(deviation as bigint)")})
