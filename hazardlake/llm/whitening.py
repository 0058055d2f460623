"""Whitening of embeddings: components of the covariance by spectral divide and conquer over polar decompositions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardlake.llm.common import bounded_batches, field, stage
from hazardlake.llm.vectors import finite_rows, matrix, whole_numbers

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
EPS = float(np.finfo(float).eps)


# --- polar decomposition and its use (small dense matrices: the covariance is as wide as a vector is long)

def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by dynamically weighted Halley steps (QDWH).

    The weights follow a lower bound of the smallest singular value, which starts at the rounding level, so six steps
    reach every matrix that isn't singular to rounding.  Steps with large weights go through a QR factorisation, which
    needs no inverse; the others through a Cholesky factor.
    """
    n = len(a)
    x, low = a / np.linalg.norm(a), EPS / n
    one = np.eye(n)
    for _ in range(12):
        square = low * low
        root = np.cbrt(4 * (1 - square) / (square * square))
        halley = np.sqrt(1 + root)
        wa = halley + np.sqrt(8 - 4 * root + 8 * (2 - square) / (square * halley)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, one]))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        else:
            factor = np.linalg.cholesky(one + wc * x.T @ x)
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(factor.T, np.linalg.solve(factor, x.T)).T
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        moved = np.linalg.norm(new - x)
        x = (new + new.T) / 2
        if 1 - low < 10 * EPS and moved < 1e-8 * np.sqrt(n):  # the order is three: the error left is the cube of the last move
            break
    return x


def split(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below the shift; None if the shift doesn't part them."""
    n = len(a)
    moved = a - shift * np.eye(n)
    if not np.linalg.norm(moved):
        return None
    projector = (polar_factor(moved) + np.eye(n)) / 2
    rank = int(round(float(np.trace(projector))))
    if not 0 < rank < n or np.linalg.norm(projector @ projector - projector) > 1e-8:
        return None
    basis = projector @ np.random.default_rng(n).standard_normal((n, rank))
    for _ in range(2):  # the second pass removes what an unlucky start leaves
        whole, _ = np.linalg.qr(projector @ basis, mode="complete")
        basis = whole[:, :rank]
    above, below = whole[:, :rank], whole[:, rank:]
    if np.linalg.norm(below.T @ a @ above) > 100 * n * EPS * np.linalg.norm(a):
        return None
    return above, below


def shifts(a: np.ndarray) -> Iterator[float]:
    """Shifts to try: the median of the diagonal and its mean (which lies between the extreme eigenvalues), then points around them."""
    diagonal = np.sort(np.diag(a))
    middle, mean = float(np.median(diagonal)), float(diagonal.mean())
    yield middle
    yield mean
    spread = np.linalg.norm(a - mean * np.eye(len(a))) / np.sqrt(len(a))
    for k in range(1, 40):
        yield mean + spread * (0.618033988749895 * k % 1 - 0.5) / 2 ** (k // 8)


def components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (as columns) of a symmetric matrix, by recursive spectral splits.

    A subspace on which the matrix is a multiple of the identity to rounding is a component of several directions;
    any orthonormal basis of it serves.
    """
    scale = float(np.linalg.norm(a))

    def parts(basis: np.ndarray) -> Iterator[np.ndarray]:
        own = basis.T @ a @ basis
        own = (own + own.T) / 2
        n = len(own)
        if n == 1 or np.linalg.norm(own - np.trace(own) / n * np.eye(n)) <= n * EPS * scale:
            yield basis
            return
        if n == 2:  # one rotation, exact to rounding
            turn = 0.5 * np.arctan2(2 * own[0, 1], own[0, 0] - own[1, 1])
            yield basis @ np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]])
            return
        for shift in shifts(own):
            found = split(own, shift)
            if found:
                yield from parts(basis @ found[0])
                yield from parts(basis @ found[1])
                return
        raise ArithmeticError("no shift parts the spectrum")

    if not len(a):
        return np.zeros(0), np.zeros((0, 0))
    vectors = np.hstack(list(parts(np.eye(len(a)))))
    vectors, _ = np.linalg.qr(vectors)  # the products of bases drift by a few roundings
    values = np.einsum("ij,ik,kj->j", vectors, a, vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# --- over the table

@dataclass(frozen=True)
class Whitener:
    """What a task needs: fixed in size by the length of a vector, whatever the number of rows."""

    n: int
    sums: tuple[int, ...]  # exact, of the whole numbers without the shift
    covariance: np.ndarray
    eigenvalues: np.ndarray
    directions: np.ndarray  # as columns, of unit length
    scale: int = SCALE
    shift: int = SHIFT

    @property
    def rank(self) -> int:
        """How many components have variance beyond rounding."""
        top = max(self.eigenvalues, default=0.0)
        return int((self.eigenvalues > max(1, len(self.eigenvalues)) * EPS * top).sum()) if top > 0 else 0

    def centred(self, values: np.ndarray) -> np.ndarray:
        """Rows minus the mean.  The whole part of the mean goes first, in whole numbers, so nothing cancels in doubles."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (whole_numbers(values, self.scale) - whole) - rest

    def whitened(self, values: np.ndarray, count: int) -> np.ndarray:
        count = min(count, self.rank)
        return self.centred(values) @ (self.directions[:, :count] / np.sqrt(self.eigenvalues[:count]))

    def deviations(self, values: np.ndarray) -> list[int]:
        """Exact sums of (n * x - S) ** 2 over the dimensions; the shift of x cancels."""
        x = whole_numbers(values, self.scale)
        reach = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if reach * reach * max(1, x.shape[1]) < 2 ** 63 else object  # beyond a long: Python's numbers
        d = self.n * x.astype(kind) - np.array(self.sums, kind)
        return [int(v) for v in (d * d).sum(axis=1)]


def _added(parts: DataFrame) -> dict[int, float]:
    """Sums by cell of ``(cells array)`` rows, one row for each task and as many cells as the statistic has."""
    cells = parts.select(F.posexplode("cells").alias("cell", "value")).groupBy("cell").agg(F.sum("value").alias("value"))
    return {r["cell"]: r["value"] for r in cells.collect()}


def _square(parts: DataFrame, size: int) -> np.ndarray:
    found = _added(parts)
    return np.array([found.get(k, 0.0) for k in range(size * size)]).reshape(size, size)


def fit(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> Whitener | None:
    """The whitener of all usable ``vectors(embedding)``; None if there is none.  Two passes: counts and exact sums, then
    the covariance around the mean.  The driver gets one number for each cell of the covariance."""
    column = vectors.select("embedding")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            _, lengths, values = finite_rows(batch.column(0))
            x = whole_numbers(values, scale)
            for size in np.unique(lengths).tolist():
                own = x[np.repeat(lengths == size, lengths)].reshape(-1, size)
                entry = held.setdefault(size, [0, np.zeros(size, np.int64)])
                entry[0] += len(own)
                entry[1] += own.sum(axis=0)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([e[0] for e in held.values()], pa.int64()),
                                              pa.array([e[1] for e in held.values()], pa.list_(pa.int64()))], names=["size", "n", "cells"])

    parts = stage(column.mapInArrow(totals, "size int, n long, cells array<long>"))
    common = parts.groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if common is None:
        return None
    size, n = common["size"], common["n"]
    found = _added(parts.filter(F.col("size") == size))
    start = Whitener(n, tuple(int(found[k]) for k in range(size)), np.zeros((size, size)), np.zeros(size), np.zeros((size, size)), scale, shift)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            _, values = matrix(batch.column(0), size)
            y = start.centred(values)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["cells"])

    covariance = _square(column.mapInArrow(products, "cells array<double>"), size) / n
    covariance = (covariance + covariance.T) / 2
    values, directions = components(covariance)
    return Whitener(n, start.sums, covariance, np.maximum(values, 0.0), directions, scale, shift)


def identity_error(vectors: DataFrame, whitener: Whitener, count: int = COMPONENTS) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over all usable vectors; None without components."""
    size, count = len(whitener.sums), min(count, whitener.rank)
    if not count:
        return None

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count + 1, count + 1))
        for batch in batches:
            _, values = matrix(batch.column(0), size)
            w = np.hstack([whitener.whitened(values, count), np.ones((len(values), 1))])
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["cells"])

    moments = _square(vectors.select("embedding").mapInArrow(products, "cells array<double>"), count + 1) / whitener.n
    mean = moments[-1, :-1]  # zero but for rounding, since the vectors were centred before
    return float(np.abs(moments[:-1, :-1] - np.outer(mean, mean) - np.eye(count)).max())


def whitened(vectors: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, eigenvalue, identity_error)`` for each usable row of
    ``vectors(vec_id, embedding)`` and each component up to ``count`` (or to the length of a vector).

    Rows whose vector is null or empty, or holds a null or non-finite entry, take no part, nor do vectors of another length
    than the most frequent one (the longer of two equally frequent).  ``vec_id`` is passed on as it is, nulls and
    repeats included; every row counts once.  A component without variance (equal vectors, fewer rows than dimensions)
    has null for ``whitened``, and no part in ``identity_error``, which is null without any other component.  ``deviation``
    is an exact decimal.  An empty table gives an empty result; other columns are ignored.

    No row leaves its task but for the output: the passes send sums of fixed size, and the tasks get the fitted
    components (a matrix as wide as a vector).
    """
    bounded_batches(vectors.sparkSession)
    schema = T.StructType([field(vectors, "vec_id")] + [T.StructField(n, t) for n, t in [
        ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.DecimalType(38, 0)), ("whitened", T.DoubleType()), ("explained", T.DoubleType()),
        ("eigenvalue", T.DoubleType()), ("identity_error", T.DoubleType())]])
    whitener = fit(vectors)
    if whitener is None:
        return vectors.sparkSession.createDataFrame([], schema)
    size, shown, rank = len(whitener.sums), min(count, len(whitener.sums)), min(count, whitener.rank)
    error, trace = identity_error(vectors, whitener, count), float(np.trace(whitener.covariance))
    explained = whitener.eigenvalues[:shown] / trace if trace > 0 else np.zeros(shown)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):  # every row becomes as many as there are components
                batch = whole.slice(at, 2048)
                places, values = matrix(batch.column(1), size)
                projected = np.zeros((len(places), shown))
                projected[:, :rank] = whitener.whitened(values, count)
                empty = np.tile(np.arange(shown) >= rank, len(places))
                deviation = pa.array([Decimal(v) for v in whitener.deviations(values)], pa.decimal128(38, 0))
                each, rows = np.repeat(np.arange(len(places)), shown), len(places) * shown
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(places[each])), pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), len(places))), pa.array(np.full(rows, whitener.n)),
                    deviation.take(pa.array(each)), pa.array(projected.ravel(), mask=empty), pa.array(np.tile(explained, len(places))),
                    pa.array(np.tile(whitener.eigenvalues[:shown], len(places))), pa.array([error] * rows, pa.float64())], names=schema.names)

    return vectors.select("vec_id", "embedding").mapInArrow(run, schema)
