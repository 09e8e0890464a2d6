"""Elastic nets against descent on the rows themselves, and the conditions of a minimum."""

import numpy as np
import pytest

from lociframe.operators import elastic


def plain_descent(x, y, mix, penalty):
    """The coefficients by descent on the rows, scaled by deviations that divide by n; the penalty is in units of y."""
    xs, ys, penalty = (x - x.mean(axis=0)) / x.std(axis=0), (y - y.mean()) / y.std(), penalty / y.std()
    n, p = x.shape
    b = np.zeros(p)
    for _ in range(20_000):
        last = b.copy()
        for j in range(p):
            z = xs[:, j] @ (ys - xs @ b + xs[:, j] * b[j]) / n
            b[j] = np.sign(z) * max(abs(z) - penalty * mix, 0) / (1 + penalty * (1 - mix))
        if np.abs(b - last).max() < 1e-12:
            break
    own = b * y.std() / x.std(axis=0)
    return y.mean() - own @ x.mean(axis=0), own


def table(spark, x, y):
    return spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(len(x))], "id long, x array<double>, y double").repartition(3)


def planted(rng, n, p, noise=0.3):
    x = rng.standard_normal((n, p)) * rng.uniform(0.5, 3, p) + rng.uniform(-2, 2, p)
    x[:, 1] += 0.8 * x[:, 0]
    y = 0.5 + 0.9 * x[:, 2] - 1.2 * x[:, 5] + 0.6 * x[:, 7] + noise * rng.standard_normal(n)
    return x, y


@pytest.mark.parametrize("n,p", [(120, 12), (40, 60)])
def test_models_equal_descent_on_rows(spark, n, p):
    x, y = planted(np.random.default_rng(n), n, p)
    got = elastic.elastic_net(table(spark, x, y), "id", "x", "y", folds=5, repetitions=3, mixes=(0.1, 0.5, 1.0), steps=40).collect()
    assert {r.repetition for r in got} == {0, 1, 2} and all(r.settled for r in got)
    for k in range(3):
        own = sorted((r for r in got if r.repetition == k), key=lambda r: r.feature)
        base, beta = plain_descent(x, y, own[0].mix, own[0].penalty)
        assert len(own) == p + 1 and own[0].coefficient == pytest.approx(base, abs=1e-6)
        assert np.array([r.coefficient for r in own[1:]]) == pytest.approx(beta, abs=1e-6)


def test_errors_come_from_folds_left_out(spark):
    """The chosen penalty and its error, by fitting each training set and predicting its fold."""
    x, y = planted(np.random.default_rng(3), 90, 10)
    df = table(spark, x, y)
    got = elastic.elastic_net(df, "id", "x", "y", folds=4, repetitions=1, mixes=(0.5,), steps=12).first()
    from pyspark.sql import functions as F

    fold = {r.id: r.f for r in df.select("id", F.pmod(F.xxhash64(F.lit(1), F.lit(0), F.col("id")), F.lit(4)).alias("f")).collect()}
    f = np.array([fold[i] for i in range(90)])
    xs, ys = (x - x.mean(axis=0)) / x.std(axis=0), y - y.mean()
    path = np.abs(xs.T @ ys / 90).max() / 0.5 * np.logspace(0, -4, 12)
    errors = np.array([[((y[f == k] - (lambda b: b[0] + x[f == k] @ b[1])(plain_descent(x[f != k], y[f != k], 0.5, t))) ** 2).mean() for k in range(4)] for t in path])
    w = np.bincount(f) / 90
    cvm = errors @ w
    cvsd = np.sqrt(((errors - cvm[:, None]) ** 2) @ w / 3)
    chosen = np.flatnonzero(cvm <= cvm.min() + cvsd[cvm.argmin()])[0]
    assert got.penalty == pytest.approx(path[chosen], rel=1e-9) and got.error == pytest.approx(cvm[chosen], rel=1e-6)


def test_marker_features_and_predictions(spark):
    x, y = planted(np.random.default_rng(1), 300, 20, 0.1)
    df = table(spark, x, y)
    models = elastic.elastic_net(df, "id", "x", "y", folds=5, repetitions=5, mixes=(0.5, 1.0), steps=50)
    marks = {r.feature: r for r in elastic.marker_features(models).collect()}
    assert {3, 6, 8} <= set(marks) and len(marks) <= 6 and marks[6].models == 5 and marks[6].mean < -0.8
    got = elastic.predicted(df.unionByName(spark.createDataFrame([(900, None, 0.0), (901, [None] * 20, 0.0)], df.schema)), "x", models).collect()
    assert {r.id for r in got if r.predicted is None} == {900, 901}
    assert np.corrcoef([r.predicted for r in got if r.id < 900], [r.y for r in got if r.id < 900])[0, 1] > 0.99


def test_odd_tables(spark):
    e = spark.createDataFrame([], "id long, x array<double>, y double")
    assert elastic.elastic_net(e, "id", "x", "y").collect() == [] and elastic.predicted(e, "x", elastic.elastic_net(e, "id", "x", "y")).collect() == []
    x, y = planted(np.random.default_rng(2), 60, 9)
    x[:, 4] = 7.0  # a constant feature has no coefficient
    rows = table(spark, x, y).unionByName(spark.createDataFrame([(1000, x[0].tolist(), None), (1001, None, 1.0), (None, x[0].tolist(), 1.0)], e.schema))
    got = {(r.repetition, r.feature): r.coefficient for r in elastic.elastic_net(rows, "id", "x", "y", folds=3, repetitions=2, mixes=(0.2,), steps=20).collect()}
    same = {(r.repetition, r.feature): r.coefficient for r in elastic.elastic_net(table(spark, x, y), "id", "x", "y", folds=3, repetitions=2, mixes=(0.2,), steps=20).collect()}
    assert got == pytest.approx(same) and got[(0, 5)] == 0
