"""Embedding whitening: float32 eigenvectors of a distributed covariance, refined in higher precision.

The entries of a vector become integers ``x = floor(1024 c) + 100000``.  One pass sums them exactly, a second
sums the products of the centred vectors; tasks send one row per dimension or pair of dimensions, which Spark
adds up, so the driver sees d + d*d numbers however many vectors there are.  The eigenvectors are found in
float32 and then corrected by Ogita and Aishima's iteration: a few matrix products in extended precision give
the residuals of orthogonality and of diagonality, from which a first-order correction of all vectors at once
follows; it converges quadratically.  Where eigenvalues lie too close for that division, the cluster's subspace is
refined as a whole and a small eigenproblem of its own, shifted by the cluster's mean, turns the vectors inside it.
A third pass measures the covariance of the whitened values themselves.

Edge cases: a null vector and one with a null or non-finite entry are dropped.  The dimension is the most frequent
length of the others (ties: the longest); vectors of another length, and empty ones, are dropped as well.  An ``x`` beyond a
long saturates; a ``deviation`` beyond a long is null.  Rows that repeat count as often and come out as often; null ids stay.
A component whose variance is nothing but rounding (below 1e-12 of the trace) has ``whitened`` and ``explained`` 0 and
takes no part in ``identity_error``.  No vectors: no rows.  Other columns are ignored.  d is a few thousand at most,
because d*d doubles are held on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
NOTHING = 1e-12
BLOCK = 4096
WIDE = np.longdouble


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False))


def vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """``(vec_id, vector)`` of the usable rows, and their dimension (0: there are none)."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where(_usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = lengths.agg(F.max(F.struct("n", "d")).alias("top")).first()["top"]
    d = top["d"] if top else 0
    return rows.where(F.size("vector") == d), d


def levels(column: pa.Array, d: int) -> np.ndarray:
    """The integer vectors of an Arrow list column, one row each."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    scaled = np.floor(SCALE * c)
    x = np.clip(scaled, -9.2e18, 9.2e18).astype(np.int64) + OFFSET
    return np.where(scaled >= 9.2e18, high, np.where(scaled <= -9.2e18, low, x))


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            part = batch.slice(at, BLOCK)
            yield part.column(0), levels(part.column(1), d)


def _sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of every dimension."""

    def run(batches):
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for _, x in _blocks(batches, d):
            n += len(x)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n, np.int64)), pa.array(high), pa.array(low)],
                                             names=["at", "n", "high", "low"])

    parts = rows.select("vec_id", "vector").mapInArrow(run, "at int, n long, high long, low long")
    added = parts.groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    found = sorted(added.collect())
    return found[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in found]


def _products(rows: DataFrame, n: int, d: int, centre: np.ndarray, turn: np.ndarray | None = None) -> np.ndarray:
    """Covariance, divisor ``n``, of the vectors less ``centre``, or of what ``turn`` makes of them."""
    k = d if turn is None else turn.shape[1]

    def run(batches):
        total, seen = np.zeros((k, k)), False
        for _, x in _blocks(batches, d):
            y = x - centre if turn is None else (x - centre) @ turn
            total += y.T @ y
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k, dtype=np.int32)), pa.array(total.ravel())], names=["at", "v"])

    parts = rows.select("vec_id", "vector").mapInArrow(run, "at int, v double")
    out = np.zeros(k * k)
    for r in parts.groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    out = out.reshape(k, k) / n
    return (out + out.T) / 2


def _clusters(e: np.ndarray, gap: float) -> list[np.ndarray]:
    """Index groups of eigenvalues in falling order whose neighbours are within ``gap``."""
    cuts = np.flatnonzero(e[:-1] - e[1:] > gap) + 1
    return np.split(np.arange(len(e)), cuts)


def refine(a: np.ndarray, x: np.ndarray, rounds: int = 12, inside: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors of symmetric ``a`` from approximate eigenvectors ``x``, in extended precision.

    Each round: R = I - X'X, S = X'AX, e = diag(S) / (1 - diag(R)).  Pairs of eigenvalues further apart than delta get
    the correction (S_ij + e_j R_ij) / (e_j - e_i), pairs of one cluster R_ij / 2; X + XE is the next X.  With
    ``inside``, clusters are then solved on their own.
    """
    a, x = a.astype(WIDE), x.astype(WIDE)
    d, norm = len(a), max(float(np.abs(a).sum(1).max()), np.finfo(float).tiny)
    eye = np.eye(d, dtype=WIDE)
    before = np.inf
    for _ in range(rounds):
        r, s = eye - x.T @ x, x.T @ (a @ x)
        e = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-e, kind="stable")
        x, e, r, s = x[:, order], e[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        off = s - np.diag(np.diag(s))
        rest = float(np.abs(off).max(initial=0)) + norm * float(np.abs(r).max(initial=0))
        if rest <= 4e-18 * norm or rest >= 0.5 * before and rest < 1e-13 * norm:
            break
        before = rest
        delta = 2 * (float(np.linalg.norm(off.astype(np.float64), 2)) + norm * float(np.linalg.norm(r.astype(np.float64), 2)))
        groups = _clusters(e, delta)
        which = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        far = which[None, :] != which[:, None]
        step = np.where(far, (s + e[None, :] * r) / np.where(far, e[None, :] - e[:, None], 1), r / 2)
        x = x + x @ step
        for group in groups:
            if inside and len(group) > 1:
                x[:, group] = _solve_inside(a, x[:, group])
    return e, _orthonormal(x)


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """Nearly orthonormal columns made so to working precision, each moved as little as can be."""
    for _ in range(2):
        x = x + x @ (np.eye(x.shape[1], dtype=WIDE) - x.T @ x) / 2
    return x


def _solve_inside(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The vectors of one cluster turned within the space they span, so that they diagonalise ``a`` there."""
    x = _orthonormal(x)
    small = x.T @ (a @ x)
    small = (small + small.T) / 2 - np.trace(small) / len(small) * np.eye(len(small), dtype=WIDE)
    size = np.abs(small).max()
    if size == 0:
        return x
    _, turn = np.linalg.eigh((small / size).astype(np.float64))
    return x @ refine(small / size, turn[:, ::-1], 4, inside=False)[1]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of a covariance, float32 first, then refined.

    Signs: the entry of largest size is positive.
    """
    size = float(np.abs(a).max(initial=0)) or 1.0
    _, x = np.linalg.eigh((a / size).astype(np.float32))
    e, x = (part.astype(np.float64) for part in refine(a / size, x[:, ::-1]))
    x = x / np.linalg.norm(x, axis=0)
    sign = np.sign(x[np.abs(x).argmax(0), np.arange(len(a))])
    return e * size, x * sign


@dataclass
class Whitening:
    """A fitted transform: n, sums and mean of the integer vectors, turn (d x components), shares of the variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    trace: float
    turn: np.ndarray
    identity_error: float

    @property
    def centre(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def explained(self) -> np.ndarray:
        return np.where(self.values > 0, self.values / self.trace if self.trace else 0.0, 0.0)


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """The transform of ``rows(vec_id, vector)`` of dimension ``d`` > 0."""
    n, sums = _sums(rows, d)
    centre = np.array([s / n for s in sums])
    v = _products(rows, n, d, centre)
    e, x = eigen(v)
    trace = float(np.trace(v))
    e, x = e[:components], x[:, :components]
    live = e > NOTHING * trace
    e = np.where(live, e, 0.0)
    turn = np.where(live, x / np.sqrt(np.where(live, e, 1.0)), 0.0)
    seen = _products(rows, n, d, centre, turn)
    error = float(np.abs(seen - np.diag(live.astype(float)))[np.ix_(live, live)].max(initial=0))
    return Whitening(n, sums, e, trace, turn, error)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None] | np.ndarray:
    """Sum over dimensions of (n x - S)^2, exactly; None beyond a long."""
    d = x.shape[1]
    far = max(abs(n * int(m) - s) for edge in (x.min(0), x.max(0)) for m, s in zip(edge, sums, strict=True))
    most = (1 << 63) - 1
    if far * far * d <= most and n * max(abs(int(x.max())), abs(int(x.min()))) <= most and max(map(abs, sums)) <= most:
        y = n * x - np.array(sums, np.int64)
        return (y * y).sum(1)
    y = n * x.astype(object) - np.array(sums, object)
    return [v if v <= most else None for v in (y * y).sum(1)]


def apply(rows: DataFrame, d: int, fitted: Whitening) -> DataFrame:
    """One row per vector and component; the transform of d x components numbers travels with the job."""
    n, sums, centre, turn, error = fitted.n, fitted.sums, fitted.centre, fitted.turn, fitted.identity_error
    explained = fitted.explained
    k = turn.shape[1]

    def run(batches):
        for ids, x in _blocks(batches, d):
            take = pa.array(np.repeat(np.arange(len(x)), k))
            m = len(x)
            white = (x - centre) @ turn
            yield pa.RecordBatch.from_arrays([
                ids.take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                pa.array(deviations(x, n, sums), pa.int64()).take(take), pa.array(white.ravel()),
                pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "vector").mapInArrow(
        run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable vector."""
    rows, d = vectors(embeddings, id_col, vector_col)
    if not d:
        schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return embeddings.sparkSession.createDataFrame([], schema)
    return apply(rows, d, fit(rows, d, components))
