"""Singular values against numpy's, and independent components of planted sources."""

import numpy as np
import pytest

from lociframe.operators import decompose


def table(spark, x, parts=5):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(parts)


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_triangles_keep_small_singular_values(spark, parts):
    """Values over twelve orders: sums of products would lose those under the root of the rounding."""
    rng = np.random.default_rng(parts)
    u, _ = np.linalg.qr(rng.standard_normal((400, 9)))
    v, _ = np.linalg.qr(rng.standard_normal((9, 9)))
    s = np.array([1e6, 1e4, 300.0, 2.0, 1.0, 1e-2, 1e-3, 1e-5, 1e-6])
    x = (u * s) @ v.T
    got = decompose.singular_values(table(spark, x, parts), "x", 9, centre=False)
    assert got["values"] == pytest.approx(np.linalg.svd(x, compute_uv=False), rel=1e-3) and got["values"][:7] == pytest.approx(s[:7], rel=1e-6)
    assert np.abs(np.abs((got["vectors"] @ v).diagonal())[:7] - 1).max() < 1e-6


def test_centred_and_fewer_rows_than_columns(spark):
    rng = np.random.default_rng(2)
    for n, c in ((300, 20), (7, 20)):
        x = rng.standard_normal((n, c)) + 5
        df = table(spark, x).unionByName(spark.createDataFrame([(-1, None), (-2, [None] * c)], "id long, x array<double>"))
        got = decompose.singular_values(df, "x", 5)
        s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)[:5]
        assert got["n"] == n and got["values"] == pytest.approx(s, rel=1e-9)
        scores = {r.id: r.scores for r in decompose.project(df, "x", got["means"], got["vectors"]).collect()}
        assert scores[-1] is None and scores[-2] is None
        assert np.linalg.norm(np.array([scores[i] for i in range(n)]), axis=0) == pytest.approx(s, rel=1e-9)


def test_range_finder_equals_triangles(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((250, 60)) * np.linspace(3, 1, 60)
    df = table(spark, x)
    a, b = decompose.singular_values(df, "x", 4), decompose.singular_values(df, "x", 4, wide=10)
    assert b["values"] == pytest.approx(a["values"], rel=1e-8) and b["vectors"] == pytest.approx(a["vectors"], abs=1e-4)
    with pytest.raises(RuntimeError):
        decompose.singular_values(df, "x", 4, wide=10, rounds=2)


def test_independent_sources_come_back(spark):
    rng = np.random.default_rng(7)
    n = 3000
    sources = np.stack([rng.uniform(-1, 1, n), rng.laplace(size=n), rng.choice([-1.0, 1.0], n), rng.exponential(size=n)], axis=1)
    x = sources @ rng.standard_normal((4, 6)) + 10
    got = decompose.independent_components(table(spark, x), "x", 4, restarts=4, seed=3)
    assert got["settled"].all() and got["stability"].min() > 0.99
    found = (x - got["means"]) @ got["loadings"].T
    assert found.std(axis=0) == pytest.approx(np.ones(4), abs=1e-6)
    c = np.abs(np.corrcoef(np.concatenate([found, sources], axis=1).T)[:4, 4:])
    assert c.max(axis=0).min() > 0.97 and sorted(c.argmax(axis=0)) == [0, 1, 2, 3]


def test_restarts_that_have_not_settled_say_so(spark):
    x = np.random.default_rng(1).standard_normal((400, 4))
    got = decompose.independent_components(table(spark, x), "x", 4, restarts=5, rounds=1)
    assert not got["settled"].any() and got["stability"].min() < 0.99


def test_empty_and_constant(spark):
    e = spark.createDataFrame([], "id long, x array<double>")
    assert decompose.singular_values(e, "x", 3)["n"] == 0 and decompose.independent_components(e, "x", 3)["loadings"].shape[0] == 0
    flat = table(spark, np.ones((5, 3)))
    assert decompose.singular_values(flat, "x", 2)["values"] == pytest.approx([0, 0], abs=1e-12)
    assert decompose.independent_components(flat, "x", 2)["loadings"].shape[0] == 0


def test_few_rows_of_many_columns_settle(spark):
    """A few rows' directions are used up in a few rounds; rounding must not be taken for more of them."""
    x = np.random.default_rng(5).standard_normal((40, 300)) * 30
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(4)
    svd = decompose.singular_values(df, "v", 6, centre=False, wide=100)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(svd["values"], s[:6], rtol=1e-8) and np.allclose(np.abs((svd["vectors"] * vt[:6]).sum(axis=1)), 1, atol=1e-6)
