"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors are read as integers x = floor(64 c) + 1,000,000 of each entry c.  The
covariance V of the distinct integer vectors is never formed: it is applied to a
block of columns by passes over the vectors, each centred before it is multiplied
(X'(XQ), summed in tasks).  A Chebyshev polynomial in V, by its three-term
recurrence, damps the part of the spectrum that is not wanted; QR and
Rayleigh-Ritz follow, until the residuals of the wanted eigenvectors certify them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import drop_folder, new_folder, tidy

SCALE, SHIFT = 64, 1_000_000
_LIMIT = float(1 << 62)          # entries beyond it stay there
_WIDTHS = (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 63))


# ------------------------------------------------------------------- vectors

def _vectors(col: pa.Array):
    """(rows, matrix) by length of the vectors of a list<double> column that are
    not null, not empty and hold numbers only; the matrix has their integers."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return
    off = col.offsets.to_numpy().astype(np.int64)
    flat = col.values
    size = np.diff(off)
    bad = np.zeros(len(flat), bool)
    if flat.null_count:
        bad |= flat.is_null().to_numpy(zero_copy_only=False)
        flat = flat.fill_null(0.0)
    v = flat.to_numpy(zero_copy_only=False)
    bad |= ~np.isfinite(v)
    faults = np.concatenate([[0], np.cumsum(bad)])
    ok = (size > 0) & (faults[off[1:]] == faults[off[:-1]])
    if col.null_count:
        ok &= ~col.is_null().to_numpy(zero_copy_only=False)
    for d in np.unique(size[ok]):
        rows = np.flatnonzero(ok & (size == d))
        whole = len(rows) == n and off[-1] - off[0] == n * d
        c = v[off[0]:off[-1]].reshape(n, d) if whole else v[off[rows][:, None] + np.arange(d)]
        x = np.clip(np.floor(c * SCALE), -_LIMIT, _LIMIT).astype(np.int64) + SHIFT
        yield rows, x


def _keys(x: np.ndarray) -> pa.Array:
    """Integer vectors as bytes: one for the width, then the entries less SHIFT
    in the least width that holds them; equal vectors have equal bytes."""
    y = x - SHIFT
    most = np.maximum(y.max(axis=1), -(y.min(axis=1) + 1))
    width = np.searchsorted([w[1] - 1 for w in _WIDTHS], most)
    out = [b""] * len(x)
    for k in np.unique(width):
        at = np.flatnonzero(width == k)
        rows = np.ascontiguousarray(y[at].astype(_WIDTHS[k][0]))
        size = rows.shape[1] * rows.itemsize
        data, tag = rows.tobytes(), bytes([k])
        for j, i in enumerate(at):
            out[i] = tag + data[j * size:(j + 1) * size]
    return pa.array(out, pa.binary())


def _unpacked(col: pa.Array, d: int) -> np.ndarray:
    """The integers of the keys that hold ``d`` entries."""
    off = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1 + col.offset)[col.offset:].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if len(col) else np.zeros(0, np.uint8)
    size = np.diff(off)
    out = []
    for k, (t, _) in enumerate(_WIDTHS):
        step = 1 + d * np.dtype(t).itemsize
        at = np.flatnonzero(size == step)
        at = at[data[off[at]] == k]
        if len(at):
            raw = data[off[at][:, None] + np.arange(1, step)]
            out.append(np.ascontiguousarray(raw).view(t).astype(np.int64) + SHIFT)
    return np.concatenate(out) if out else np.zeros((0, d), np.int64)


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - S/n, from exact differences where they fit 64 bits."""
    s = np.array([float(v) for v in total])
    if not len(x):
        return np.zeros(x.shape)
    top = max(float(np.abs(x).max()) * n, float(np.abs(s).max()))
    if top < _LIMIT / 2:
        return (x * n - np.array(total, np.int64)).astype(float) / n
    return x.astype(float) - s / n


def deviations(x: np.ndarray, n: int, total: list[int]) -> pa.Array:
    """The exact sums of (n x - S)^2; null where one is 2^63 or more."""
    rough = np.square(x.astype(float) * n - np.array([float(v) for v in total])).sum(axis=1)
    with np.errstate(over="ignore"):
        low = np.array([v & ((1 << 64) - 1) for v in total], np.uint64).view(np.int64)
        exact = np.square(x * np.int64(n) - low).sum(axis=1)
    out: list = exact.tolist()
    for i in np.flatnonzero(rough > _LIMIT):
        v = sum((n * int(a) - s) ** 2 for a, s in zip(x[i], total))
        out[i] = v if v < 1 << 63 else None
    return pa.array(out, pa.int64())


# ------------------------------------------------------------------- fitting

@dataclass(frozen=True)
class Whitening:
    """n, the sums by entry, eigenvalues (falling) and eigenvectors of the
    covariance of the distinct vectors, its trace, and the largest entry of the
    whitened covariance minus the identity, in absolute value."""

    n: int
    total: list
    values: np.ndarray
    vectors: np.ndarray      # d x components
    trace: float
    identity_error: float
    passes: int
    residual: float


class _Fit:
    """The written list of distinct vectors and passes over it."""

    def __init__(self, table: DataFrame, d: int, n: int, total: list[int]):
        self.table, self.d, self.n, self.total, self.passes = table, d, n, total, 0

    def sums(self, f: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum over all vectors of f(centred vectors), an array of ``size``
        numbers, added in the tasks and then by place."""
        d, n, total = self.d, self.n, self.total
        self.passes += 1

        def run(batches):
            acc = np.zeros(size)
            for b in batches:
                for a in range(0, b.num_rows, 8192):
                    acc += f(centred(_unpacked(b.column(0).slice(a, 8192), d), n, total))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(acc)], ["i", "v"])

        got = self.table.mapInArrow(tidy(run), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(size)
        out[got.column("i").to_numpy()] = got.column("v").to_numpy()
        return out

    def apply(self, q: np.ndarray) -> np.ndarray:
        """V q by one pass."""
        return self.sums(lambda c: (c.T @ (c @ q)).ravel(), q.size).reshape(q.shape) / self.n


def _signed(q: np.ndarray) -> np.ndarray:
    """Columns with their largest entry positive."""
    return q * np.sign(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])])


def top_eigenpairs(apply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, guard: int | None = None,
                   degree: int = 9, tol: float = 2e-14, rounds: int = 20, seed: int = 1):
    """(eigenvalues, eigenvectors, largest residual over the first eigenvalue) of
    the ``wanted`` largest of a symmetric matrix without negative eigenvalues, known
    by ``apply``.

    The block has ``guard`` more columns (as many as wanted, if not given).  One more
    column of each product carries a Lanczos run, whose smallest value bounds
    the spectrum from below, so the filter damps [bound, smallest Ritz value] alone.
    Rounds go on until all wanted residuals are at most ``tol``, or stop falling
    within 1e-12 (rounding).  If neither comes in ``rounds``, the block is the whole
    space, where Rayleigh-Ritz is exact."""
    k = min(d, wanted + (wanted if guard is None else guard))
    m = min(wanted, d)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((d, k)))[0]
    basis = [np.linalg.qr(rng.standard_normal((d, 1)))[0][:, 0]]
    alpha, beta = [], []

    def product(y):
        """V y, and one more Lanczos step with it."""
        if len(basis) > min(d, 48) or not basis[-1].any():
            return apply(y)
        z = apply(np.column_stack([y, basis[-1]]))
        w, v = z[:, -1], basis[-1]
        alpha.append(float(v @ w))
        full = np.column_stack(basis)
        w = w - full @ (full.T @ w)
        w = w - full @ (full.T @ w)
        norm = float(np.linalg.norm(w))
        beta.append(norm)
        basis.append(w / norm if norm > 1e-13 * max(abs(alpha[0]), 1e-300) else np.zeros(d))
        return z[:, :-1]

    def lower():
        if len(alpha) < 2:
            return 0.0
        t = np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1)
        e, s = np.linalg.eigh(t)
        return max(0.0, float(e[0] - abs(beta[-1] * s[-1, 0])))

    worst = np.inf
    for turn in range(rounds + 1):
        if turn == rounds and k < d:             # not certified: the whole space
            q, k = np.eye(d), d
        z = product(q)
        h = q.T @ z
        theta, u = np.linalg.eigh((h + h.T) / 2)
        theta, u = theta[::-1], u[:, ::-1]
        q, z = q @ u, z @ u
        if theta[0] <= 0:
            return np.zeros(0), np.zeros((d, 0)), 0.0
        each = np.linalg.norm(z - q * theta, axis=0) / theta[0]
        now = float(each[:m].max())
        if now <= tol or k == d or (now <= 1e-12 and now > worst / 4):
            return theta[:m], _signed(q[:, :m]), now
        worst = now
        a, b = lower(), float(theta[-1])
        if b <= 1e-13 * theta[0]:                # the block holds all of the range
            q = np.linalg.qr(z)[0]
            continue
        a = min(a, 0.98 * b)
        # columns already certified are locked: the filter would amplify what
        # rounding leaves of them in the others, so it is taken out at each step
        open_ = np.flatnonzero(each > tol)
        lock = q[:, :open_[0]]
        e, c = (b - a) / 2, (b + a) / 2
        sigma = first = e / (float(theta[open_[0]]) - c)
        y0 = q[:, open_[0]:]
        y1 = (z[:, open_[0]:] - c * y0) * (sigma / e)
        for _ in range(degree - 1):
            y1 = y1 - lock @ (lock.T @ y1)
            new = 1 / (2 / first - sigma)
            y0, y1 = y1, (product(y1) - c * y1) * (2 * new / e) - (sigma * new) * y0
            sigma = new
        q = np.linalg.qr(np.column_stack([lock, y1 - lock @ (lock.T @ y1)]))[0]
    raise AssertionError("the whole space is certified by construction")


def distinct_vectors(rows: DataFrame, vec_col: str) -> DataFrame:
    """(key, d, copies): each distinct integer vector once, as bytes.  Copies are
    counted in the tasks first, so one vector's many rows are one row a task."""
    schema = "key binary, d int"

    def run(batches):
        for b in batches:
            for _, x in _vectors(b.column(0)):
                yield pa.RecordBatch.from_arrays([_keys(x), pa.array(np.full(len(x), x.shape[1], np.int32))], ["key", "d"])

    src = rows.select(F.col(vec_col).cast("array<double>").alias("v"))
    return src.mapInArrow(tidy(run), schema).groupBy("d", "key").agg(F.count(F.lit(1)).alias("copies"))


def fit_whitening(rows: DataFrame, vec_col: str = "embedding", components: int = 16, **options) -> Whitening | None:
    """The whitening of all vectors of ``rows``; None where none is left."""
    spark = rows.sparkSession
    folder = new_folder(spark, "vectors")
    try:
        distinct_vectors(rows, vec_col).write.parquet(folder)
        table = spark.read.parquet(folder)
        sizes = table.groupBy("d").agg(F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("n")).orderBy(
            F.desc("rows"), F.desc("d")).limit(1).collect()
        if not sizes:
            return None
        d, n = sizes[0].d, sizes[0].n
        table = table.where(F.col("d") == d).select("key")

        def halves(batches):
            high, low = np.zeros(d, np.int64), np.zeros(d, np.int64)
            for b in batches:
                x = _unpacked(b.column(0), d)
                high += (x >> 32).sum(axis=0)
                low += (x & 0xFFFFFFFF).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(high), pa.array(low)], ["i", "high", "low"])

        got = table.mapInArrow(tidy(halves), "i long, high long, low long").groupBy("i").agg(
            F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
        total = [0] * d
        for r in got:
            total[r.i] = (r.high << 32) + r.low
        fit = _Fit(table, d, n, total)
        trace = float(fit.sums(lambda c: np.square(c).sum(axis=0), d).sum()) / n
        if trace <= 0:
            return Whitening(n, total, np.zeros(0), np.zeros((d, 0)), 0.0, 0.0, fit.passes, 0.0)
        values, vectors, residual = top_eigenpairs(fit.apply, d, components, **options)
        kept = values > 1e-12 * trace            # a direction without variance has no whitening
        values, vectors = values[kept], vectors[:, kept]
        w = vectors / np.sqrt(values)
        m = len(values)
        cov = fit.sums(lambda c: ((c @ w).T @ (c @ w)).ravel(), m * m).reshape(m, m) / n
        error = float(np.abs(cov - np.eye(m)).max(initial=0.0))
        return Whitening(n, total, values, vectors, trace, error, fit.passes, residual)
    finally:
        drop_folder(spark, folder)


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16,
           model: Whitening | None = None, **options) -> DataFrame:
    """One row per remaining row of ``rows`` and component: (id_col, component, n,
    deviation, whitened, explained, identity_error), components numbered from 1 by
    falling eigenvalue; ``model`` is fitted on ``rows`` if not given.

    Dropped are rows whose vector is null, empty, or holds null, infinite or NaN
    entries, and rows whose vector has another length than most valid rows have (of
    lengths equally frequent, the greater counts).  Repeated rows are returned once
    each, and count once in the fit; equal eigenvalues leave the choice of their
    directions open.  Directions without variance (eigenvalue at most 1e-12 of the
    trace) have no component, so fewer distinct vectors than components give fewer
    rows, and one distinct vector gives none.  Entries of 2^62 / 64 and more in
    size are held at that bound; a deviation of 2^63 or more is null.  Null ids are
    kept.  Other columns are not read; an empty table gives an empty result."""
    got = model or fit_whitening(rows, vec_col, components, **options)
    schema = T.StructType([T.StructField("id", rows.schema[id_col].dataType), T.StructField("component", T.IntegerType()),
                           T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
                           *[T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]])
    names = schema.names
    if got is None or not len(got.values):
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    n, total, d, m = got.n, got.total, len(got.total), len(got.values)
    w, share, error = got.vectors / np.sqrt(got.values), got.values / got.trace, got.identity_error

    def run(batches):
        for b in batches:
            for at, x in _vectors(b.column(1)):
                if x.shape[1] != d:
                    continue
                for a in range(0, len(x), 1024):
                    y, r = x[a:a + 1024], len(x[a:a + 1024])
                    each = np.repeat(np.arange(r), m)
                    yield pa.RecordBatch.from_arrays([
                        b.column(0).take(pa.array(at[a:a + 1024][each])),
                        pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), r)), pa.array(np.full(r * m, n)),
                        deviations(y, n, total).take(pa.array(each)), pa.array((centred(y, n, total) @ w).ravel()),
                        pa.array(np.tile(share, r)), pa.array(np.full(r * m, error))], names)

    src = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return src.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)
