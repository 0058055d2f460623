"""Validation that needs many fits: leave-one-out over a bounded sample, and nested selection of the regularisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlake.operators.learning import confusions, features, repeated_folds
from hazardlake.operators.metrics import with_scores
from hazardlake.operators.terms import TermSets


# ---- leave-one-out -----------------------------------------------------------

def balanced_weights(y: np.ndarray) -> np.ndarray:
    """n / (classes * class size), as ``learning.balanced`` weighs rows."""
    names, sizes = np.unique(y, return_counts=True)
    return (len(y) / (len(names) * sizes))[np.searchsorted(names, y)]


def kernel_logistic(gram: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float, start: np.ndarray | None = None, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weighted logistic regression with an L2 penalty on the slopes, in the rows' own inner products.

    Slopes are sums of rows, so a fit over n rows is a problem of n numbers and an intercept, whatever the number of terms.
    Each Newton step is one linear system; ``start`` (decision values) saves most of them.
    """
    n = len(y)
    share = weight / weight.sum()
    f = np.zeros(n) if start is None else start.copy()
    system = np.zeros((n + 1, n + 1))
    a, b = np.zeros(n), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-f))
        h = np.maximum(share * p * (1 - p), 1e-14)
        z = f - share * (p - y) / h
        system[:n, :n] = gram
        system[np.arange(n), np.arange(n)] += reg / h
        system[:n, n] = system[n, :n] = 1.0
        solved = np.linalg.solve(system, np.append(z, 0.0))
        a, b = solved[:n], float(solved[n])
        new = gram @ a + b
        # half steps back where a whole one overshoots
        step = np.clip(new - f, -8, 8)
        f = f + step
        if np.abs(step).max() < 1e-9:
            break
    return a, b


def left_out(gram: np.ndarray, y: np.ndarray, reg: float, k: int, start: np.ndarray) -> float:
    """The decision value of row k by the fit of all other rows; one class only gives that class for sure."""
    rest = np.arange(len(y)) != k
    if len(np.unique(y[rest])) < 2:
        return float(np.inf if y[rest][0] == 1 else -np.inf)
    a, b = kernel_logistic(gram[np.ix_(rest, rest)], y[rest], balanced_weights(y[rest]), reg, start[rest])
    return float(gram[k, rest] @ a + b)


def leave_one_out(df: DataFrame, key: str, rows: int = 300, vocabulary: int = 5_000, reg: float = 0.01) -> DataFrame:
    """``(key, label, probability, prediction)``: each row of a sample scored by a model of all the others.

    ``df`` has ``clean`` and ``label``.  The sample is the first ``rows`` rows by a hash of the key, since the number of fits and
    the size of each grow with it; terms and their weights are those of the sample.  The driver holds the sample's inner
    products (rows x rows) and one fit; every left-out row is a small task of its own, which starts from that fit and
    needs two or three Newton steps to reach the solution of a plain refit.
    """
    spark = df.sparkSession
    # read from ``df`` once; every step of the fit reads the held sample
    sample = df.select(key, "clean", "label").orderBy(F.xxhash64(key), key).limit(rows).persist(StorageLevel.MEMORY_AND_DISK)
    kind = df.schema[key].dataType.simpleString()
    schema = f"place int, `{key}` {kind}, label double, decision double"
    if sample.isEmpty():
        return spark.createDataFrame([], f"`{key}` {kind}, label double, probability double, prediction double")
    prepared = Pipeline(stages=features(vocabulary)).fit(sample)
    held = prepared.transform(sample).select(key, "label", "features").collect()  # ``rows`` of them at most
    x = np.stack([r["features"].toArray() for r in held])
    y = np.array([r["label"] for r in held])
    gram = x @ x.T
    start = np.zeros(len(y))
    if len(np.unique(y)) > 1:
        a, b = kernel_logistic(gram, y, balanced_weights(y), reg)
        start = gram @ a + b

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(decision=[left_out(gram, y, reg, k, start) for k in part["place"]])

    places = spark.createDataFrame([(n, r[key], float(r["label"])) for n, r in enumerate(held)], f"place int, `{key}` {kind}, label double")
    scored = places.repartition(min(len(held), spark.sparkContext.defaultParallelism), "place").mapInPandas(run, schema)
    return scored.select(key, "label", (1 / (1 + F.exp(-F.col("decision")))).alias("probability"), (F.col("decision") > 0).cast("double").alias("prediction"))


# ---- nested selection ----------------------------------------------------------

COUNTS = "tp long, fp long, fn long, tn long"


def counts_of(rows: DataFrame) -> tuple[int, int, int, int]:
    """One aggregate: the confusion of scored rows, four numbers."""
    truth, said = F.col("label") == 1, F.col("prediction") == 1
    r = rows.agg(F.count_if(truth & said), F.count_if(~truth & said), F.count_if(truth & ~said), F.count_if(~truth & ~said)).first()
    return tuple(int(v) for v in r)


def f1(counts: tuple[int, int, int, int]) -> float:
    tp, fp, fn, _ = counts
    return 2 * tp / (2 * tp + fp + fn) if tp else 0.0


def nested_selection(df: DataFrame, outer: int, inner: int, key: str, write: Callable[[DataFrame], DataFrame], grid: Sequence[float] = (0.1, 1.0, 10.0), fold: str = "fold",
                     vocabulary: int = 5_000, iterations: int = 100, unit: float = 0.01, parallelism: int = 4) -> DataFrame:
    """``(fold, best_c, inner_f1, tp, fp, fn, tn, scores)`` for each outer fold, with the regularisation that won inside it.

    Texts are cut into terms once for all folds, outer and inner; each fold makes its own vocabulary's features once and scores the
    whole grid on them in one aggregate.  The best value by mean F1 (the smaller of equals) is then one of the models that
    the outer fold fits on all of its training rows, again on its own terms, so no value of the grid costs an action of its own
    and the held-out rows have no part in the choice.
    ``unit / c`` is the penalty for the strength c.  Folds are independent; ``parallelism`` of them run at a time.
    """
    df = write(df.select(key, "clean", "label", F.col(fold).alias("outer")))
    spark, splits = df.sparkSession, [(k, j) for k in range(outer) for j in (*range(inner), None)]
    rows = df
    for k in range(outer):
        rows = repeated_folds(rows, key, inner, k + 1).withColumnRenamed("fold", f"inner{k}")
    trains = [(F.col("outer") != k) & (F.lit(True) if j is None else F.col(f"inner{k}") != j) for k, j in splits]
    sets = TermSets(rows, trains, vocabulary, ["outer", *[f"inner{k}" for k in range(outer)]])

    def counts(k: int, j: int | None, tried: Sequence[float]) -> list[tuple]:
        own = sets.features(splits.index((k, j))).persist(StorageLevel.MEMORY_AND_DISK)
        seen = own.filter("seen")
        held = own.filter(F.col("outer") == k if j is None else (F.col("outer") != k) & (F.col(f"inner{k}") == j))
        models = [LogisticRegression(labelCol="label", weightCol="weight", maxIter=iterations, regParam=unit / c).fit(seen) for c in tried]
        found = confusions(models, held)
        own.unpersist()
        return found

    within = [s for s in splits if s[1] is not None]
    with ThreadPool(parallelism) as pool:
        threads = inheritable_thread_target(spark)
        tried = dict(zip(within, pool.map(threads(lambda s: counts(*s, grid)), within, chunksize=1), strict=True))
        means = [[float(np.mean([f1(tried[k, j][n]) for j in range(inner)])) for n in range(len(grid))] for k in range(outer)]
        best = [min(range(len(grid)), key=lambda n: (-m[n], grid[n])) for m in means]
        last = pool.map(threads(lambda k: counts(k, None, [grid[best[k]]])[0]), range(outer), chunksize=1)
    sets.close()
    made = [(k, float(grid[best[k]]), means[k][best[k]], *last[k]) for k in range(outer)]
    return with_scores(spark.createDataFrame(made, f"fold int, best_c double, inner_f1 double, {COUNTS}"))
