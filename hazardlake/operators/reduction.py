"""Principal components of wide sparse features by randomised range finding, and a linear discriminant on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlake.operators.terms import TermSets, add_blocks
from hazardlake.operators.validation import counts_of

# Terms whose sums travel in one row: the thin matrix is never one value.
BLOCK = 256
OVERSAMPLING, PASSES, SEED = 10, 4, 42


def sparse_rows(prepared: DataFrame, *keep: str) -> DataFrame:
    """The vectors in ``features`` as their places and values (all sparse, as text features are)."""
    made = F.unwrap_udt("features")
    return prepared.select(*keep, made["size"].alias("size"), made["indices"].alias("indices"), made["values"].alias("values"))


def _entries(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and values of each row; a row is handled alone, so memory is bounded by the longest."""
    indices, values = batch.column("indices"), batch.column("values")
    ends = indices.offsets.to_numpy(zero_copy_only=False) - indices.offsets[0].as_py()
    places, entries = indices.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False)
    for k in range(batch.num_rows):
        yield places[ends[k]:ends[k + 1]], entries[ends[k]:ends[k + 1]]


def _times(batch: pa.RecordBatch, thin: np.ndarray) -> np.ndarray:
    """The batch's rows times the thin matrix."""
    rows = [entries @ thin[places] for places, entries in _entries(batch)]
    return np.stack(rows) if rows else np.zeros((0, thin.shape[1]))


def _gathered(rows: DataFrame, thin: np.ndarray) -> np.ndarray:
    """``X.T (X thin)`` over all rows, as many numbers as the thin matrix has."""
    terms, width = thin.shape
    blocks = -(-terms // BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((blocks * BLOCK, width))
        for batch in batches:
            for places, entries in _entries(batch):
                total[places] += np.outer(entries, entries @ thin[places])
        for k in range(blocks):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[k * BLOCK:(k + 1) * BLOCK].tobytes()])], names=["block", "cells"])

    found = add_blocks(rows.select("indices", "values").mapInArrow(run, "block int, cells binary"), blocks, BLOCK * width)
    return found.reshape(blocks * BLOCK, width)[:terms]


@dataclass(frozen=True)
class Components:
    """Directions as columns (terms x components), the mean of the features, and the variance along each direction."""

    directions: np.ndarray
    mean: np.ndarray
    variances: np.ndarray
    rows: int


def principal_components(rows: DataFrame, k: int, oversampling: int = OVERSAMPLING, passes: int = PASSES) -> Components:
    """The k leading principal components of ``sparse_rows``.

    A random thin matrix (terms x (k + oversampling)) is multiplied by the covariance a few times, orthonormalised
    between, so it comes to span the leading directions; a last pass gives the covariance inside that span, whose
    eigenvectors are the components.  Each pass reads the rows once; the driver and each task hold the thin matrix, never
    a covariance of terms x terms.  The mean is taken out of the products, so sparse rows stay sparse.
    """
    n, size = rows.agg(F.count(F.lit(1)), F.max("size")).first()
    if not n:
        return Components(np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0)
    sums = rows.select(F.explode(F.arrays_zip("indices", "values")).alias("e")).groupBy("e.indices").agg(F.sum("e.values").alias("s")).collect()  # one row for each term
    mean = np.zeros(size)
    for r in sums:
        mean[r["indices"]] = r["s"] / n
    width = min(k + oversampling, size, n)
    span = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, width)))[0]
    for _ in range(passes):
        span = np.linalg.qr(_gathered(rows, span) / n - np.outer(mean, mean @ span))[0]
    inner = span.T @ (_gathered(rows, span) / n - np.outer(mean, mean @ span))
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-values)[:min(k, width)]
    return Components(span @ vectors[:, order], mean, np.maximum(values[order], 0.0), n)


def _projected(components: Components):
    shift = components.mean @ components.directions
    return lambda batch: _times(batch, components.directions) - shift


@dataclass(frozen=True)
class Discriminant:
    """Two classes told apart by the sign of a weighted sum of the components."""

    components: Components
    weights: np.ndarray
    bias: float

    def predict(self, rows: DataFrame, *keep: str) -> DataFrame:
        """``keep`` columns and ``prediction`` of ``sparse_rows``."""
        project, weights, bias = _projected(self.components), self.weights, self.bias
        plain = rows.select(*keep, "indices", "values")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                said = (project(batch) @ weights + bias > 0).astype(float)
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(said)], names=[*keep, "prediction"])

        return plain.mapInArrow(run, plain.select(*keep).schema.add("prediction", "double"))


def discriminant(rows: DataFrame, k: int = 300, ridge: float = 1e-6) -> Discriminant:
    """Components of ``sparse_rows(..., 'label')``, then a linear discriminant with pooled covariance on them.

    Class means and scatter inside the components are sums of k x k numbers, one row for each task and block; the solve is local.
    """
    found = principal_components(rows, k)
    width = found.directions.shape[1]
    if not width:
        return Discriminant(found, np.zeros(0), 0.0)
    project = _projected(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width + 1, width + 1))
        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            v = np.hstack([project(batch), np.ones((batch.num_rows, 1))])
            for c in (0, 1):
                own = v[labels == c]
                total[c] += own.T @ own
        for c in (0, 1):
            for line in range(width + 1):
                yield pa.RecordBatch.from_arrays([pa.array([c * (width + 1) + line], pa.int32()), pa.array([total[c, line].tobytes()])], names=["block", "cells"])

    moments = add_blocks(rows.select("label", "indices", "values").mapInArrow(run, "block int, cells binary"), 2 * (width + 1), width + 1).reshape(2, width + 1, width + 1)
    counts = moments[:, -1, -1]
    means = moments[:, -1, :-1] / np.maximum(counts, 1)[:, None]
    scatter = sum(moments[c, :-1, :-1] - counts[c] * np.outer(means[c], means[c]) for c in (0, 1))
    pooled = scatter / max(counts.sum() - 2, 1)
    weights = np.linalg.solve(pooled + ridge * max(np.trace(pooled) / width, 1e-300) * np.eye(width), means[1] - means[0])
    share = np.log(max(counts[1], 1) / max(counts[0], 1))
    return Discriminant(found, weights, float(share - weights @ (means[0] + means[1]) / 2))


def discriminant_folds(df: DataFrame, folds: int, write: Callable[[DataFrame], DataFrame], k: int = 300, vocabulary: int = 5_000, fold: str = "fold") -> list[tuple]:
    """``(fold, components, tp, fp, fn, tn)``: each fold's terms, components and discriminant come from the other folds' rows."""
    sets = TermSets(df.select("clean", "label", F.col(fold).alias("outer")), [F.col("outer") != n for n in range(folds)], vocabulary, ["outer"])
    out = []
    for n in range(folds):
        rows = write(sparse_rows(sets.features(n), "label", "outer"))
        made = discriminant(rows.filter(F.col("outer") != n), k)
        out.append((n, made.components.directions.shape[1], *counts_of(made.predict(rows.filter(F.col("outer") == n), "label"))))
    return out
