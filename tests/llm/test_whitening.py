import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.llm import whitening
from lociframe.llm.whitening import leading_eigenpairs, negative_pivots, whitened

SCHEMA = "vec_id long, embedding array<float>, label int, x string"


def plain(vectors, components=32):
    """The contract by numpy's own decomposition, on Python integers where exactness counts."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    dev = [sum((n * a - b) ** 2 for a, b in zip(row, s)) for row in x]
    c = (n * x - s).astype(float) / n
    cov = c.T @ c / n
    w, v = np.linalg.eigh(cov)
    w, v = w[::-1][:components], v[:, ::-1][:, :components]
    return n, dev, c @ v / np.sqrt(w), w / np.trace(cov)


@pytest.mark.parametrize("dims", [5, 40, 64])
def test_against_numpy(spark, dims):
    rng = np.random.default_rng(dims)
    v = (rng.standard_normal((300, dims)) @ rng.standard_normal((dims, dims)) + 3).astype(np.float32)
    rows = [(i, v[i].tolist(), i % 2, "y") for i in range(300)]
    rows += [(900, None, 0, ""), (901, [None] + v[0].tolist()[1:], 0, ""), (902, [float("nan")] + v[0].tolist()[1:], 0, ""), (903, [float("-inf")] + v[0].tolist()[1:], 0, ""), (904, [], 0, ""), (905, [1.0], 0, "")]
    got = whitened(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    n, dev, white, share = plain(v)
    k = min(32, dims)
    assert len(got) == n * k and {r.component for r in got} == set(range(1, k + 1))
    mine = np.zeros((n, k))
    for r in got:
        mine[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == dev[r.vec_id] and abs(r.identity_error) < 1e-9
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
    sign = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * sign - white).max() < 1e-7


def test_inertia_counts():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 8, 33):
        for _ in range(10):
            a = rng.integers(-3, 4, (n, n)).astype(float)
            a = a + a.T
            w = np.linalg.eigvalsh(a)
            for shift in (w[0] - 1, w[-1] + 1, *((w[1:] + w[:-1]) / 2)):
                if np.abs(w - shift).min() > 1e-9:
                    assert negative_pivots(a, shift) == (w < shift).sum()
    swap = np.array([[0.0, 1.0], [1.0, 0.0]])  # needs a pivot of two rows
    assert negative_pivots(swap, 0.0) == 1


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [1e6, 1, 1e-6, 1e-9], [2, 2, 2, 1, 1], [3, 3 - 1e-9, 3 - 1e-8, 1], [7, 0, 0, 0], [0, 0]])
def test_slices_find_leading_pairs(values):
    rng = np.random.default_rng(3)
    n = len(values)
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    a = (q * np.array(values, float)) @ q.T
    a = (a + a.T) / 2
    for k in range(1, n + 1):
        w, v = leading_eigenpairs(a, k)
        assert w == pytest.approx(sorted(values, reverse=True)[:k], abs=1e-12 * max(max(values), 1))
        assert np.abs(a @ v - v * w).max() < 1e-10 * max(values[0], 1) and np.abs(v.T @ v - np.eye(k)).max() < 1e-6


def test_vectors_of_hidden_order():
    """Each number is certified: as many eigenvalues lie over a component's as come before it."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((500, 48))
    a = np.cov(x.T)
    w, _ = leading_eigenpairs(a, 32)
    gaps = -np.diff(w)
    for i, e in enumerate(w[:-1]):
        assert 48 - negative_pivots(a, e - gaps[i] / 2) == i + 1


def test_odd_tables(spark):
    assert whitened(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitened(spark.createDataFrame([(1, None, 1, "")], SCHEMA)).collect() == []
    one = whitened(spark.createDataFrame([(None, [1.0, 2.0], 1, ""), (3, [1.0, 2.0], 1, "")], SCHEMA)).collect()
    assert len(one) == 4 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.n == 2 for r in one)
    flat = whitened(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0], 1, "") for i in range(4)], SCHEMA)).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in flat) and all(r.identity_error < 1e-9 for r in flat)
    huge = whitened(spark.createDataFrame([(1, [3e38, 0.0], 1, ""), (2, [0.0, 1.0], 1, ""), (2, [0.0, 1.0], 1, "")], SCHEMA)).collect()
    assert len(huge) == 6 and {r.deviation for r in huge} == {None}
    clash = spark.createDataFrame([(i, [float(i), 1.0 - i * i]) for i in range(5)], "vec_id long, embedding array<float>").withColumn("component", F.lit("a")).withColumn("id", F.lit("b"))
    assert len(whitened(clash).collect()) == 10


def test_large_entries_stay_exact(spark):
    v = [[2.0**40, 1.0], [2.0**40 + 2**20, 5.0], [2.0**40, 2.5]]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame([(i, x, 0, "") for i, x in enumerate(v)], SCHEMA.replace("float", "double")), "vec_id", "embedding")[0].withColumnRenamed("id", "vec_id").collect()}
    x = [[math.floor(64 * c) + 1_000_000 for c in r] for r in v]
    s = [sum(c) for c in zip(*x)]
    assert {k: int(d) for k, d in got.items()} == {i: sum((3 * a - b) ** 2 for a, b in zip(r, s)) for i, r in enumerate(x)}
