import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from hazardlake.operators import learning as ml
from hazardlake.operators import reduction as rd
from hazardlake.operators import validation as vd


@pytest.fixture(scope="module")
def cases(spark, folder):
    rows = spark.read.parquet(f"{folder}/labels.parquet").join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), "doc_id")
    return ml.labelled(rows, "text", F.col("quality")).select("doc_id", "clean", "label").cache()


@pytest.fixture
def write(spark, tmp_path):
    made = iter(range(10_000))

    def run(frame):
        path = f"file://{tmp_path}/{next(made)}"
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    return run


def test_leave_one_out_equals_plain_refits(spark, cases):
    got = {r["doc_id"]: (r["label"], r["probability"], r["prediction"]) for r in vd.leave_one_out(cases, "doc_id", rows=30, vocabulary=400, reg=0.05).collect()}
    assert len(got) == 30
    sample = cases.filter(F.col("doc_id").isin(list(got)))
    held = Pipeline(stages=ml.features(400)).fit(sample).transform(sample).select("doc_id", "label", "features").coalesce(1).cache()
    x = {r["doc_id"]: np.append(r["features"].toArray(), 1.0) for r in held.collect()}
    for k, (_, probability, prediction) in got.items():  # a plain refit in the terms themselves, from zero
        a, y = np.stack([x[i] for i in x if i != k]), np.array([got[i][0] for i in x if i != k])
        w = vd.balanced_weights(y) / len(y)
        beta, penalty = np.zeros(a.shape[1]), np.append(np.full(a.shape[1] - 1, 0.05), 0.0)
        for _ in range(30):
            p = 1 / (1 + np.exp(-a @ beta))
            beta -= np.linalg.solve((a.T * (w * p * (1 - p))) @ a + np.diag(penalty), a.T @ (w * (p - y)) + penalty * beta)
        assert abs(1 / (1 + np.exp(-x[k] @ beta)) - probability) < 1e-8 and prediction == (probability > 0.5)
    for k in list(got)[:3]:  # and Spark's own fit, as far as it converges
        rest = ml.balanced(held.filter(F.col("doc_id") != k))
        model = LogisticRegression(labelCol="label", weightCol="weight", regParam=0.05, standardization=False, maxIter=100, tol=1e-11).fit(rest)
        assert abs(model.transform(held.filter(F.col("doc_id") == k)).first()["probability"][1] - got[k][1]) < 1e-3


def test_leave_one_out_of_few_rows(spark, cases):
    assert vd.leave_one_out(cases.limit(0), "doc_id").count() == 0
    one_class = cases.filter("label = 1").limit(4)
    assert [r["prediction"] for r in vd.leave_one_out(one_class, "doc_id", vocabulary=50).collect()] == [1.0] * 4
    two = cases.filter("label = 1").limit(1).unionByName(cases.filter("label = 0").limit(2))
    assert sorted((r["label"], r["prediction"]) for r in vd.leave_one_out(two, "doc_id", vocabulary=50).collect())[-1] == (1.0, 0.0)


def test_nested_selection_takes_the_best_inner_value(spark, cases, write):
    folded = cases.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).withColumn("fold", (F.pmod(F.col("doc_id"), F.lit(2))).cast("int"))
    got = {r["fold"]: r for r in vd.nested_selection(folded, 2, 2, "doc_id", write, grid=(0.1, 10.0), vocabulary=150, iterations=10).collect()}
    assert set(got) == {0, 1}
    train = folded.filter("fold = 1")
    inside = ml.repeated_folds(train.select("doc_id", "clean", "label"), "doc_id", 2, 1)
    means = {}
    for c in (0.1, 10.0):
        scores = []
        for j in (0, 1):
            part = ml.balanced(inside.filter(F.col("fold") != j))
            made = Pipeline(stages=[*ml.features(150), LogisticRegression(labelCol="label", weightCol="weight", maxIter=10, regParam=0.01 / c)]).fit(part)
            scores.append(vd.f1(vd.counts_of(made.transform(inside.filter(F.col("fold") == j)))))
        means[c] = np.mean(scores)
    best = min(means, key=lambda c: (-means[c], c))
    assert got[0]["best_c"] == best and abs(got[0]["inner_f1"] - means[best]) < 1e-9
    assert sum(got[0][n] for n in ("tp", "fp", "fn", "tn")) == folded.filter("fold = 0").count()


def test_components_agree_with_exact_ones(spark, cases):
    prepared = Pipeline(stages=ml.features(60)).fit(cases).transform(cases)
    rows = rd.sparse_rows(prepared, "label").repartition(5)
    x = np.stack([r["features"].toArray() for r in prepared.select("features").collect()])
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    found = rd.principal_components(rows, 8, passes=12)
    assert found.rows == len(x) and np.allclose(found.mean, x.mean(axis=0))
    assert np.allclose(found.variances, values[:8], rtol=1e-3) and np.allclose(found.directions.T @ found.directions, np.eye(8), atol=1e-9)
    assert np.linalg.norm(vectors[:, :4].T @ found.directions, axis=1).min() > 0.99
    whole = rd.principal_components(rows, 300)  # more than there are: every direction
    assert np.allclose(whole.variances, values[:len(whole.variances)], atol=1e-10)


def test_discriminant_against_the_formula(spark, cases, write):
    prepared = Pipeline(stages=ml.features(80)).fit(cases).transform(cases)
    rows = write(rd.sparse_rows(prepared, "doc_id", "label"))
    made = rd.discriminant(rows, 300)
    held = prepared.select("doc_id", "label", "features").collect()
    x, y = np.stack([r["features"].toArray() for r in held]), np.array([r["label"] for r in held])
    v = (x - x.mean(axis=0)) @ made.components.directions
    m = [v[y == c].mean(axis=0) for c in (0, 1)]
    pooled = sum((v[y == c] - m[c]).T @ (v[y == c] - m[c]) for c in (0, 1)) / (len(y) - 2)
    w = np.linalg.solve(pooled + 1e-6 * np.trace(pooled) / len(pooled) * np.eye(len(pooled)), m[1] - m[0])
    said = v @ w - w @ (m[0] + m[1]) / 2 + np.log((y == 1).sum() / (y == 0).sum()) > 0
    got = {r["doc_id"]: r["prediction"] for r in made.predict(rows, "doc_id").collect()}
    assert np.mean([got[r["doc_id"]] == s for r, s in zip(held, said, strict=True)]) == 1.0
    assert rd.discriminant(rows.limit(0)).components.rows == 0
