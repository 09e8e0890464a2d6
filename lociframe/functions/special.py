"""Exact tail probabilities as Arrow-vectorised functions.

numpy has no incomplete beta or gamma function, so both are computed here by
continued fractions and series over whole batches. Null or out-of-domain in, null out."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _stirling(x: np.ndarray, order: int) -> list[np.ndarray]:
    """log_gamma and its first derivatives up to order, for positive numbers: asymptotic series, after small ones alone are raised."""
    x = np.array(x, float)
    low = x < 10
    small = x[low]
    sums = [np.ones_like(small), np.zeros_like(small), np.zeros_like(small)][: order + 1]
    for _ in range(10):
        under = small < 10
        if not under.any():
            break
        sums[0] = np.where(under, sums[0] * small, sums[0])
        if order > 0:
            sums[1] = np.where(under, sums[1] - 1 / small, sums[1])
        if order > 1:
            sums[2] = np.where(under, sums[2] + 1 / (small * small), sums[2])
        small = np.where(under, small + 1, small)
    x[low] = small
    log, s = np.log(x), 1 / (x * x)
    out = [np.asarray((x - 0.5) * log - x + 0.9189385332046727 + (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s * (1 / 1680 - s / 1188)))) / x)]
    out[0][low] -= np.log(sums[0])
    if order > 0:
        out.append(np.asarray(log - 0.5 / x - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s / 132))))))
        out[1][low] += sums[1]
    if order > 1:
        out.append(np.asarray((1 + 0.5 / x + s * (1 / 6 - s * (1 / 30 - s * (1 / 42 - s * (1 / 30 - s * 5 / 66))))) / x))
        out[2][low] += sums[2]
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function of positive numbers."""
    return _stirling(x, 0)[0]


_lgamma = log_gamma


def log_gamma_slopes(x: np.ndarray) -> list[np.ndarray]:
    """log_gamma, digamma and trigamma of the same numbers, which share their logarithms and what small ones are raised by."""
    return _stirling(x, 2)


def digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of log_gamma, for positive numbers."""
    return _stirling(x, 1)[1]


def trigamma(x: np.ndarray) -> np.ndarray:
    """The derivative of digamma."""
    return _stirling(x, 2)[2]


def ln_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return _lgamma(n + 1.0) - _lgamma(k + 1.0) - _lgamma(n - k + 1.0)


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 400) -> np.ndarray:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    if not x.size:
        return x.copy()
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    y = np.clip(y, 0, 1)
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        tiny = 1e-300
        c = np.ones_like(y)
        d = 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, steps):
            for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.nanmax(np.abs(d * c - 1), initial=0) < 1e-15:
                break
        out = np.where(y <= 0, 0.0, front * h)
    return np.clip(np.where(swap, 1 - out, out), 0, 1)


def gammaincc(a: np.ndarray, x: np.ndarray, steps: int = 600) -> np.ndarray:
    """Regularised upper incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    if not x.size:
        return x.copy()
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) - x - _lgamma(a))
        term = 1 / a
        total = term.copy()
        for n in range(1, steps):
            term = term * x / (a + n)
            total = total + term
            if np.nanmax(np.abs(term / total), initial=0) < 1e-16:
                break
        low = 1 - front * total
        tiny = 1e-300
        b = x + 1 - a
        c = np.full_like(x, 1 / tiny)
        d = 1 / np.where(np.abs(b) < tiny, tiny, b)
        h = d.copy()
        for i in range(1, steps):
            an = -i * (i - a)
            b = b + 2
            d = 1 / np.where(np.abs(an * d + b) < tiny, tiny, an * d + b)
            c = np.where(np.abs(b + an / c) < tiny, tiny, b + an / c)
            h = h * d * c
            if np.nanmax(np.abs(d * c - 1), initial=0) < 1e-15:
                break
        out = np.where(x < a + 1, low, front * h)
    return np.clip(np.where(x <= 0, 1.0, out), 0, 1)


def _udf(fn, *cols: Column) -> Column:
    @F.pandas_udf("double")
    def run(*series: pd.Series) -> pd.Series:
        values = [s.astype(float).to_numpy() for s in series]
        ok = ~np.any([np.isnan(v) for v in values], axis=0)
        out = np.full(len(ok), np.nan)
        if ok.any():
            out[ok] = fn(*(v[ok] for v in values))
        return pd.Series(out).where(~np.isnan(out), None)

    return run(*(c.cast("double") for c in cols))


def t_two_sided_p(t: Column, df: Column) -> Column:
    return _udf(lambda t, v: betainc(v / 2, 0.5 * np.ones_like(v), v / (v + t * t)), t, df)


def f_upper_p(f: Column, df1: Column, df2: Column) -> Column:
    return _udf(lambda f, a, b: betainc(b / 2, a / 2, b / (b + a * np.maximum(f, 0))), f, df1, df2)


def chi2_upper_p(x: Column, df: Column) -> Column:
    return _udf(lambda x, k: gammaincc(k / 2, np.maximum(x, 0) / 2), x, df)


def beta_cdf(x: Column, a: Column, b: Column) -> Column:
    return _udf(lambda x, a, b: betainc(a, b, np.clip(x, 0, 1)), x, a, b)


def binomial_two_sided_p(k: Column, n: Column) -> Column:
    """Twice the smaller tail of k of n at one half, at most 1."""

    def p(k, n):
        low = np.minimum(k, n - k)
        return np.minimum(1.0, 2 * betainc(n - low, low + 1, np.full_like(n, 0.5)))

    return _udf(lambda k, n: np.where(n > 0, p(k, np.maximum(n, 1)), np.nan), k, n)


def _each(one, columns: tuple[np.ndarray, ...]) -> np.ndarray:
    """one(row) of every row, worked out once for rows alike: counts repeat within a batch."""
    rows = np.stack([np.asarray(c, float) for c in columns], axis=1)
    if not len(rows):
        return np.zeros(0)
    known, inverse = np.unique(rows, axis=0, return_inverse=True)
    return np.array([one(*x) for x in known])[inverse.ravel()]


def fisher_exact_p(a: Column, b: Column, c: Column, d: Column, side: str = "two") -> Column:
    """p of a 2x2 table by its hypergeometric distribution; side is two, left or right."""

    def one(a, b, c, d):
        r, k, n = a + b, a + c, a + b + c + d
        lo, hi = int(max(0, r + k - n)), int(min(r, k))
        x = np.arange(lo, hi + 1, dtype=float)
        lp = ln_choose(np.full_like(x, r), x) + ln_choose(np.full_like(x, n - r), k - x) - math.lgamma(n + 1) + math.lgamma(k + 1) + math.lgamma(n - k + 1)
        p = np.exp(lp)
        own = p[int(a) - lo]
        picked = p[x <= a] if side == "left" else p[x >= a] if side == "right" else p[p <= own * (1 + 1e-7)]
        return min(1.0, float(picked.sum()))

    return _udf(lambda *v: _each(one, v), a, b, c, d)


def hwe_exact_p(hets: Column, hom1: Column, hom2: Column) -> Column:
    """Exact test of Hardy-Weinberg proportions from three genotype counts; null without genotypes."""

    def one(h, a, b):
        n = int(h + a + b)
        if n == 0:
            return math.nan
        rare = int(2 * min(a, b) + h)
        x = np.arange(rare % 2, rare + 1, 2, dtype=float)
        homr, homc = (rare - x) / 2, n - x - (rare - x) / 2
        lp = x * math.log(2) - _lgamma(x + 1) - _lgamma(homr + 1) - _lgamma(homc + 1)
        p = np.exp(lp - lp.max())
        p /= p.sum()
        return min(1.0, float(p[p <= p[int((h - rare % 2) // 2)] * (1 + 1e-9)].sum()))

    return _udf(lambda *v: _each(one, v), hets, hom1, hom2)
