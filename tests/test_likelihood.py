"""Allele-count maxima against plain scans, and the likelihood against published values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.functions import special
from lociframe.operators import likelihood


def lb(a, b):
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def plain_ll(q, k, m, sigma=None, het=1.0, error=0.0):
    if sigma is None:
        one = (k * math.log(q) if k else 0) + (m * math.log(1 - q) if m else 0)
    else:
        s = 1 / sigma**2 - 1
        one = lb(k + q * s, m + (1 - q) * s) - lb(q * s, (1 - q) * s)
    if het == 1:
        return one
    wrong = math.exp(k * math.log(error) + m * math.log(1 - error)) + math.exp(m * math.log(error) + k * math.log(1 - error))
    return math.log(het * math.exp(one) + (1 - het) * wrong)


def plain_line(rows, het=1.0, error=0.0):
    """The highest point of a scan over the shares at both ends of the proportions, refined around the best."""
    cs = [r[2] for r in rows]
    lo, hi = min(cs), max(cs)
    width, centre, best = 0.5, (0.5, 0.5), (-math.inf, 0, 0)
    for _ in range(12):
        for i in range(-8, 9):
            for j in range(-8, 9):
                a, b = centre[0] + i * width / 8, centre[1] + j * width / 8
                if 1e-6 <= a <= 1 - 1e-6 and 1e-6 <= b <= 1 - 1e-6:
                    v = sum(plain_ll(a + (b - a) * (c - lo) / (hi - lo), k, m, s, het, error) for k, m, c, s in rows)
                    best = max(best, (v, a, b))
        centre, width = best[1:], width / 3
    return best[0], (best[2] - best[1]) / (hi - lo)


def draw(rng, slope, base, samples=12, sigma=0.2):
    out = []
    for _ in range(samples):
        c = float(rng.uniform(0.1, 0.9))
        s = 1 / sigma**2 - 1
        q = rng.beta((base + slope * c) * s, (1 - base - slope * c) * s)
        n = int(rng.integers(5, 80))
        k = int(rng.binomial(n, q))
        out.append((k, n - k, c, sigma))
    return out


def test_digamma_and_trigamma():
    x = np.array([0.01, 0.3, 1.0, 2.5, 9.9, 50.0, 1e6])
    h = 1e-5 * x
    assert special.digamma(x) == pytest.approx((special.log_gamma(x + h) - special.log_gamma(x - h)) / (2 * h), rel=1e-6)
    assert special.trigamma(x) == pytest.approx((special.digamma(x + h) - special.digamma(x - h)) / (2 * h), rel=1e-6)
    assert special.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-13)
    assert special.trigamma(np.array([1.0]))[0] == pytest.approx(math.pi**2 / 6, abs=1e-13)


def test_likelihood_of_a_mixture(spark):
    """With heterozygotes of 0.980198 and errors of 0.005: sigma, alpha, beta, reads of both, and minus the logarithm."""
    known = [(0.1322021484375, 1.50728797912598, 1.47147178649902, 3, 1, 2.7693565626714465), (0.1429443359375, 2.51745270192623, 0.934578329324722, 0, 0, -0.01960849080585195), (0.149169921875, 3.21029663085938, 2.11465454101563, 23, 15, 25.82528716887173), (0.1446533203125, 4.03051721304655, 1.64812137186527, 5, 2, 4.2781478286599395), (0.131591796875, 3.65502193570137, 3.12404105067253, 2, 5, 5.0913275014018895)]
    df = spark.createDataFrame([(s, a / (a + b), k, m, v) for s, a, b, k, m, v in known], "s double, q double, k int, m int, v double")
    for r in df.withColumn("l", likelihood.log_likelihood(F.col("q"), F.col("k"), F.col("m"), F.col("s"), 0.980198, 0.005)).collect():
        assert -r.l == pytest.approx(r.v, abs=1e-7)
    odd = spark.createDataFrame([(None, 3, 1), (0.5, None, 1)], "q double, k int, m int")
    assert [r.l for r in odd.select(likelihood.log_likelihood(F.col("q"), F.col("k"), F.col("m")).alias("l")).collect()] == [None, None]


@pytest.mark.parametrize("het,error,sigma", [(1.0, 0.0, True), (1.0, 0.0, False), (0.9, 0.01, True), (0.9, 0.01, False)])
def test_cell_type_tests_reach_the_top(spark, het, error, sigma):
    rng = np.random.default_rng(4)
    groups = {i: draw(rng, s, b) for i, (s, b) in enumerate([(0.6, 0.15), (0.0, 0.5), (-0.5, 0.9), (0.0, 0.8), (0.2, 0.3)])}
    groups[5] = [(9, 0, 0.1, 0.2), (8, 0, 0.5, 0.2), (0, 7, 0.9, 0.2)]
    groups[6] = [(3, 4, 0.5, 0.2), (5, 5, 0.5, 0.2)]  # proportions do not vary
    rows = [(g, *r) for g, rs in groups.items() for r in rs] + [(0, 0, 0, 0.5, 0.2), (0, None, 3, 0.5, 0.2), (0, 3, 3, None, 0.2)]
    df = spark.createDataFrame(rows, "g int, k int, m int, c double, s double").repartition(3)
    got = {r.g: r for r in likelihood.allelic_test(df, ["g"], "k", "m", "s" if sigma else None, "c", het, error).collect()}
    assert len(got) == 7 and got[6].slope is None and got[6].chi2 is None and got[6].p is None and got[6].n == 2
    for g, rs in groups.items():
        assert got[g].settled and got[g].reads == sum(r[0] + r[1] for r in rs)
        if g == 6:
            continue
        rs = [(k, m, c, s if sigma else None) for k, m, c, s in rs]
        top, slope = plain_line(rs, het, error)
        assert got[g].alt_ll >= top - 1e-6
        flat = max(sum(plain_ll(q, k, m, s, het, error) for k, m, _, s in rs) for q in np.linspace(0.001, 0.999, 999))
        assert got[g].null_ll >= flat - 1e-9 and got[g].alt_ll >= got[g].null_ll - 1e-9
        assert got[g].chi2 == pytest.approx(max(0, 2 * (got[g].alt_ll - got[g].null_ll)))
        assert got[g].p == pytest.approx(math.erfc(math.sqrt(got[g].chi2 / 2)), abs=1e-9)
        if het == 1 and g < 5:
            assert got[g].slope == pytest.approx(slope, abs=1e-2)
    assert got[0].p < 0.01


def test_joint_share_against_one_half(spark):
    rows = [(1, 30, 10), (1, 30, 10), (1, 5, 9), (2, 10, 10), (2, 7, 7)]
    got = {r.g: r for r in likelihood.allelic_test(spark.createDataFrame(rows, "g int, k int, m int"), ["g"], "k", "m").collect()}
    assert got[1].n == 3 and got[1].ratio == pytest.approx(65 / 94, abs=1e-7) and got[1].slope is None
    assert got[1].chi2 == pytest.approx(2 * (65 * math.log(65 / 94) + 29 * math.log(29 / 94) + 94 * math.log(2)), abs=1e-6)
    assert got[2].chi2 == pytest.approx(0, abs=1e-9) and got[2].p == pytest.approx(1)


def test_dispersion_of_a_sample(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g, sigma in enumerate([0.05, 0.2, 0.5, 0.8]):
        s = 1 / sigma**2 - 1
        for _ in range(400):
            n = int(rng.integers(5, 60))
            k = int(rng.binomial(n, rng.beta(s / 2, s / 2)))
            rows.append((g, k, n - k))
    rows += [(9, 10, 10), (9, 5, 5)]  # less than binomial: no dispersion
    got = {r.g: r for r in likelihood.sample_dispersion(spark.createDataFrame(rows, "g int, k int, m int"), ["g"], "k", "m").collect()}
    for g, sigma in enumerate([0.05, 0.2, 0.5, 0.8]):
        own = [(k, m) for x, k, m in rows if x == g]
        best = max(sum(plain_ll(0.5, k, m, s) for k, m in own) for s in np.linspace(0.01, 0.95, 200))
        assert got[g].settled and got[g].log_likelihood >= best - 1e-7 and got[g].sigma == pytest.approx(sigma, abs=0.06)
    assert got[9].sigma < 0.01


def test_beta_binomial_maximum_is_over_any_grid(spark):
    rng = np.random.default_rng(6)
    rows = []
    for g, (q, t) in enumerate([(0.5, 8.0), (0.3, 2.0), (0.7, 60.0), (0.9, 0.5)]):
        for _ in range(80):
            n = int(rng.integers(1, 60))
            k = int(rng.binomial(n, rng.beta(q * t, (1 - q) * t)))
            rows.append((g, k, n - k))
    got = {r.g: r for r in likelihood.beta_binomial_maximum(spark.createDataFrame(rows, "g int, k int, m int"), ["g"], "k", "m").collect()}
    for g in range(4):
        own = [(k, m) for x, k, m in rows if x == g]
        ways = sum(math.lgamma(k + m + 1) - math.lgamma(k + 1) - math.lgamma(m + 1) for k, m in own)
        ll = lambda q, t: ways + sum(lb(k + q * t, m + (1 - q) * t) - lb(q * t, (1 - q) * t) for k, m in own)
        grid = max(ll(q, t) for q in np.linspace(0.02, 0.98, 49) for t in np.exp(np.linspace(-2, 6, 40)))
        assert got[g].settled and got[g].log_likelihood >= grid - 1e-9
        assert got[g].log_likelihood == pytest.approx(ll(got[g].ratio, got[g].theta), abs=1e-6)
        assert got[g].chi2 == pytest.approx(2 * (got[g].log_likelihood - ll(0.5, got[g].theta)), abs=1e-6)
    assert got[0].p > 0.001 and got[1].p < 1e-4


def test_empty(spark):
    e = spark.createDataFrame([], "g int, k int, m int, c double, s double")
    assert likelihood.allelic_test(e, ["g"], "k", "m", "s", "c").collect() == [] and likelihood.beta_binomial_maximum(e, ["g"], "k", "m").collect() == []
    assert likelihood.sample_dispersion(e, ["g"], "k", "m").collect() == [] and likelihood.negative_binomial(e, ["g"], "k", "m").collect() == []


def test_only_open_keys_climb_on():
    """One key needs many rounds; the others are at their tops after one, and are not worked on with it."""
    seen = []
    top = np.arange(100) / 10.0

    def surface(x, keys=None):
        seen.append(len(x))
        own = np.arange(100) if keys is None else keys
        d = x[:, 0] - top[own]
        far = own == 99  # flat far from its top
        a, b, c = np.where(far, np.log1p(d**2), d**2), np.where(far, 2 * d / (1 + d**2), 2 * d), np.where(far, 2 * (1 - d**2) / (1 + d**2) ** 2, 2.0)
        return -a, -b[:, None], -c[:, None, None]

    x, value, settled = likelihood.maximise(surface, np.full((100, 1), -20.0), -50.0, 50.0)
    assert settled.all() and x[:, 0] == pytest.approx(top, abs=1e-3) and value == pytest.approx(np.zeros(100), abs=1e-6)
    assert len(seen) > 3 and sum(seen) < 100 * 3


def test_counts_are_worked_out_once_a_key():
    rng = np.random.default_rng(2)
    at, counts, add = np.sort(rng.integers(0, 9, 500)), rng.integers(0, 6, 500).astype(float), rng.random(9)
    worked = []

    def square(x):
        worked.append(len(x))
        return [x * x]

    own = likelihood._Counts(at, 9, counts)
    for keys in (np.arange(9), np.array([2, 3, 8]), np.array([], int)):
        to, rows = likelihood._picked(at, 9, keys)
        assert np.array_equal(own.of(square, add[keys], keys, rows)[0], (counts[rows] + add[keys][to]) ** 2)
        assert worked[-1] == len({(k, c) for k, c in zip(at, counts) if k in keys})
