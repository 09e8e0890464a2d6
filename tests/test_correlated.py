"""Tails of weighted chi-squares, genes by draws, and merged items, against plain computations."""

import math

import numpy as np
import pytest

from lociframe.functions.special import gammaincc
from lociframe.operators import correlated, models


def test_tails_are_exact():
    """Known tails: equal weights are a chi-square; weights in pairs are sums of exponentials. To ten digits, far into the tail, weights of 1e-6 too."""
    for n in (1, 2, 3, 7, 40, 300):
        for q in (1e-6, 0.1, 1.0, 10.0, 50.0, 400.0):
            want = float(gammaincc(np.array([n / 2]), np.array([q / 2]))[0])
            assert correlated.mixture_upper_p(2.5 * q, np.full(n, 2.5)) == pytest.approx(want, rel=1e-9, abs=1e-300)
    for a in ([3.0, 1.0], [1.0, 0.01], [1.0, 1e-6], [5.0, 2.0, 0.3], [1.0, 0.5, 1e-3, 1e-5]):
        for q in (1e-4, 0.5, 3.0, 30.0, 300.0):
            want = sum(math.exp(-q / (2 * x)) * math.prod(x / (x - y) for y in a if y != x) for x in a)
            assert correlated.mixture_upper_p(q, np.repeat(a, 2)) == pytest.approx(want, rel=1e-10)
    assert correlated.mixture_upper_p(1500.0, np.array([1.0])) == pytest.approx(math.erfc(math.sqrt(750)), rel=1e-9)
    assert correlated.mixture_upper_p(0.0, np.ones(3)) == 1 and correlated.mixture_upper_p(1.0, np.zeros(2)) == 0


def test_genes_by_draws(spark):
    """Draws stop at enough exceedances and agree with the tail within their error; rare sums take the tail; no p is under the floor."""
    rng = np.random.default_rng(2)
    z, pairs = [], []
    for g, (n, r, scale) in enumerate([(4, 0.5, 0.5), (10, 0.2, 1.2), (30, 0.7, 0.9), (5, 0.3, 3.5), (6, 0.0, 9.0), (1, 0.0, 1.5)]):
        z += [(f"g{g}", i, float(scale * (1 + 0.1 * rng.standard_normal()))) for i in range(n)]
        pairs += [(f"g{g}", i, j, r) for i in range(n) for j in range(i)]
    zs = spark.createDataFrame(z, "gene string, variant int, z double")
    ps = spark.createDataFrame(pairs, "gene string, a int, b int, r double")
    got = {r.gene: r for r in correlated.gene_p_by_draws(zs, ps, "gene", "variant").collect()}
    exact = {r.gene: r for r in correlated.gene_p(zs, ps, "gene", "variant").collect()}
    assert {g: r.how for g, r in got.items()} == {"g0": "draws", "g1": "draws", "g2": "draws", "g3": "tail", "g4": "tail", "g5": "one"}
    for g in ("g0", "g1", "g2"):
        r = got[g]
        assert r.over >= 20 and r.draws % 10_000 == 0 and r.q == pytest.approx(exact[g].q)
        assert abs(r.p - exact[g].p) < 5 * math.sqrt(exact[g].p / r.draws)
    assert got["g3"].draws == 100_000 and got["g3"].over < 20 and got["g3"].p == pytest.approx(exact["g3"].p, rel=1e-9) and got["g4"].p == 1e-12
    assert got["g5"].p == pytest.approx(math.erfc(math.sqrt(exact["g5"].q / 2)))
    again = {r.gene: r.over for r in correlated.gene_p_by_draws(zs.repartition(7), ps, "gene", "variant").collect()}
    assert again == {g: r.over for g, r in got.items()}  # not dependent on how genes are dealt
    longer = {r.gene: r for r in correlated.gene_p_by_draws(zs, ps, "gene", "variant", most=10_000, rescue=2_000_000).collect()}
    assert longer["g3"].draws > 10_000 and longer["g3"].how in ("draws", "tail")


def blocks(spark, rng, sizes):
    rows, mats = [], []
    item = 0
    for b, n in enumerate(sizes):
        x = rng.standard_normal((200, n))
        if n > 3:
            x[:, 1] = x[:, 0] + 0.05 * rng.standard_normal(200)  # one gene in two names
            x[:, 3] = -x[:, 1] + 0.1 * rng.standard_normal(200)  # over another, and turned
        r = np.corrcoef(x.T) if n > 1 else np.ones((1, 1))
        mats.append(r)
        for i in range(n):
            rows.append((b, item, float(rng.standard_normal()), r[i].tolist()))
            item += 1
    return spark.createDataFrame(rows, "block int, item int, y double, loadings array<double>"), rows, mats


def test_merged_items_count_once(spark):
    rng = np.random.default_rng(5)
    df, rows, mats = blocks(spark, rng, [6, 5, 1, 8])
    sets = {"a": [0, 1, 7], "b": [2, 6, 7, 8, 12, 15], "c": list(range(0, 20, 2)), "one": [0, 1, 3], "few": [4]}
    members = spark.createDataFrame([(i, g) for g, m in sets.items() for i in m] + [(0, "a")], "item int, grp string")
    got = {r.grp: r for r in correlated.set_regression(df, members, "block", "item", "grp", "y", "loadings", 1, 0.9).collect()}
    # plainly: merge by hand, one block-diagonal matrix, one solve a set
    meta, v, mat, at = {}, [], [], 0
    for b, r in enumerate(mats):
        own = [x for x in rows if x[0] == b]
        group = list(range(len(own)))
        changed = True
        while changed:
            changed = False
            for i in range(len(own)):
                for j in range(len(own)):
                    if abs(r[i, j]) >= 0.9 and group[i] != group[j]:
                        group[i] = group[j] = min(group[i], group[j])
                        changed = True
        names = sorted(set(group))
        a = np.array([[1 / group.count(k) if g == k else 0 for g in group] for k in names])
        c = a @ r @ a.T
        mat.append(c / np.sqrt(np.outer(np.diag(c), np.diag(c))))
        v += (a @ [x[2] for x in own]).tolist()
        meta |= {x[1]: at + names.index(g) for x, g in zip(own, group)}
        at += len(names)
    assert at < len(rows) - 5  # some were merged
    whole = np.zeros((at, at))
    k = 0
    for c in mat:
        whole[k : k + len(c), k : k + len(c)] = c
        k += len(c)
    w = np.linalg.inv(whole)
    for g, m in sets.items():
        x = np.zeros(at)
        x[sorted({meta[i] for i in m})] = 1
        d = np.column_stack([np.ones(at), x])
        cov = np.linalg.inv(d.T @ w @ d)
        beta = cov @ d.T @ w @ v
        e = v - d @ beta
        se = math.sqrt(e @ w @ e / (at - 2) * cov[1, 1])
        assert got[g].n == x.sum() and got[g].beta == pytest.approx(beta[1], rel=1e-6) and got[g].se == pytest.approx(se, rel=1e-6)
    assert got["one"].n == 1  # three names of one gene
    listed = {r.item: (r.meta, r["size"]) for r in correlated.meta_items(df, "block", "item", "loadings", 0.9).collect()}
    assert listed[0] == (0, 3) and listed[3] == (0, 3) and listed[2] == (2, 1) and len(listed) == len(rows)


def test_blocks_go_through_python_many_to_a_batch(spark):
    """A call of Python for each of many small blocks costs more than its work."""
    df = spark.createDataFrame([(b, b * 2 + i, float(i), float(b % 5), [1.0, 0.5] if i == 0 else [0.5, 1.0]) for b in range(40) for i in range(2)], "block long, item long, x double, y double, loadings array<double>")
    members = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(80)], "item long, grp string")
    by = {
        "meta": correlated.meta_items(df, "block", "item", "loadings", 0.5),
        "inverse": correlated.inverse_blocks(df, "block", "item", "loadings"),
        "sets": correlated.set_regression(df, members, "block", "item", "grp", "y", "loadings"),
        "merged": correlated.set_regression(df, members, "block", "item", "grp", "y", "loadings", merge=0.5),
        "gls": models.generalised_least_squares(df, "block", "item", "x", "y", "loadings"),
    }
    assert all("InPandas" not in x._jdf.queryExecution().optimizedPlan().toString() for x in by.values())
    assert {(r.item, r.meta, r["size"]) for r in by["meta"].collect()} == {(i, i // 2 * 2, 2) for i in range(80)}
    got = {(r.block, r.a, r.b): r.value for r in by["inverse"].collect()}
    assert len(got) == 160 and abs(got[3, 6, 7] + 0.5 / 0.75) < 1e-12 and abs(got[3, 7, 7] - 1 / 0.75) < 1e-12
    w = np.kron(np.eye(40), np.linalg.inv([[1, 0.5], [0.5, 1]]))
    y = np.repeat(np.arange(40) % 5, 2).astype(float)
    for name, inside in (("a", np.tile([1.0, 0], 40)), ("b", np.tile([0, 1.0], 40))):
        x = np.stack([np.ones(80), inside], axis=1)
        row = {r.grp: r for r in by["sets"].collect()}[name]
        assert row.n == 40 and abs(row.beta - np.linalg.solve(x.T @ w @ x, x.T @ w @ y)[1]) < 1e-9
