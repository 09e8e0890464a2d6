"""Fits per group that need a solver: deconvolution, beta approximation, generalised least squares.

A group is one feature or gene over its samples or permutations, whose number a study
bounds; groups are spread over tasks by their key."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import betainc
from .correlated import gathered


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Least squares with coefficients of 0 or more, by an active set."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    gradient = a.T @ b
    for _ in range(rounds):
        if free.all() or gradient[~free].max(initial=-1) <= 1e-10:
            break
        free[np.flatnonzero(~free)[np.argmax(gradient[~free])]] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if s[free].min(initial=1) > 0:
                break
            bad = free & (s <= 0)
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + step * (s - x)
            free &= x > 1e-12
        x = s
        gradient = a.T @ (b - a @ x)
    return x


def f_test(rss_small: float, rss_big: float, df_small: int, df_big: int) -> float:
    if rss_big <= 0 or df_small <= df_big or df_big <= 0:
        return math.nan
    f = (rss_small - rss_big) / (df_small - df_big) / (rss_big / df_big)
    return float(betainc(np.array([df_big / 2]), np.array([(df_small - df_big) / 2]), np.array([df_big / (df_big + (df_small - df_big) * max(f, 0.0))]))[0])


def nnls_many(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """nnls of each matrix of a stack (groups, rows, columns) and its row of b, all at once; a group that comes back to where it was is done."""
    m, _, n = a.shape
    x, free, done = np.zeros((m, n)), np.zeros((m, n), bool), np.zeros(m, bool)
    gradient = np.einsum("mrn,mr->mn", a, b)
    for _ in range(rounds):
        steep = np.where(free, -np.inf, gradient)
        at = np.flatnonzero(~done & (steep.max(axis=1) > 1e-10))
        if not len(at):
            break
        was, had = x[at], free[at]
        free[at, steep[at].argmax(axis=1)] = True
        inner = at
        while len(inner):
            own = np.where(free[inner][:, None, :], a[inner], 0.0)
            s = np.where(free[inner], np.einsum("mnr,mr->mn", np.linalg.pinv(own, rcond=np.finfo(float).eps * max(own.shape[1:])), b[inner]), 0.0)
            bad = free[inner] & (s <= 0)
            out = bad.any(axis=1)
            x[inner[~out]] = s[~out]
            inner, s, bad = inner[out], s[out], bad[out]
            step = np.where(bad, x[inner] / np.maximum(x[inner] - s, 1e-300), np.inf).min(axis=1, initial=np.inf)
            x[inner] += np.where(np.isfinite(step), step, 0.0)[:, None] * (s - x[inner])
            free[inner] &= x[inner] > 1e-12
        done[at] = (free[at] == had).all(axis=1) & (x[at] == was).all(axis=1)
        gradient[at] = np.einsum("mrn,mr->mn", a[at], b[at] - np.einsum("mrn,mn->mr", a[at], x[at]))
    return x


def f_tests(rss_small: np.ndarray, rss_big: np.ndarray, df_big: np.ndarray) -> np.ndarray:
    """p of dropping one term, which leaves rss_small of rss_big; NaN without degrees of freedom or residuals."""
    out = np.full(len(rss_big), np.nan)
    ok = (rss_big > 0) & (df_big > 0)
    d = df_big[ok].astype(float)
    f = np.maximum((rss_small[ok] - rss_big[ok]) / (rss_big[ok] / d), 0.0)
    out[ok] = betainc(d / 2, np.full(len(d), 0.5), d / (d + f))
    return out


#: Numbers of a stack of groups that are worked on at once.
STACK = 1 << 20


def _cell_effects(r: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(beta, beta_dosage, p), groups by cells, from the triangles (groups, rows, 2 k + 1) of proportions, their products with dosage, and values."""
    y = r[:, :, 2 * k]
    rss = lambda a, x: ((y - np.einsum("mrn,mn->mr", a, x)) ** 2).sum(axis=1)
    a = r[:, :, : 2 * k]
    turned = np.concatenate([a[:, :, :k], 2 * a[:, :, :k] - a[:, :, k:]], axis=2)
    x, xt = nnls_many(a, y), nnls_many(turned, y)
    big, big_t = rss(a, x), rss(turned, xt)
    turn = big_t < big
    a, x, big = np.where(turn[:, None, None], turned, a), np.where(turn[:, None], xt, x), np.where(turn, big_t, big)
    p = np.empty((len(n), k))
    for i in range(k):
        less = np.delete(a, k + i, axis=2)
        p[:, i] = f_tests(rss(less, nnls_many(less, y)), big, n - 2 * k)
    return x[:, :k], np.where(turn[:, None], -x[:, k:], x[:, k:]), p


def deconvolve(values: DataFrame, by: list[str], expression: str, dosage: str, proportions: list[str]) -> DataFrame:
    """Cell-type effects: expression as a sum over cell types of proportion and proportion times
    dosage, coefficients of 0 or more, for dosage as it is and turned (2 - dosage), each term in whichever
    fits better. (by, cell, beta, beta_dosage, p): p of dropping the cell's dosage term, by an F-test.

    values has one row per sample, without nulls in what is used. Groups of a batch are brought to triangles (QR) and solved as stacks."""
    key, k = list(by), len(proportions)
    used = [*proportions, dosage, expression]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [batch.column(len(key) + i) for i in range(k + 2)]
            flat = [x.flatten().to_numpy(zero_copy_only=False) for x in arrays]
            n = arrays[0].value_lengths().to_numpy(zero_copy_only=False).astype(int)
            start = np.cumsum(n) - n
            beta, slope, p = (np.empty((len(n), k)) for _ in range(3))
            order = np.argsort(n, kind="stable")
            while len(order):
                width = np.maximum(n[order], 2 * k + 1)  # rising
                take = max(1, int((width * np.arange(1, len(order) + 1) * (2 * k + 1) <= STACK).sum()))
                own, order, rows = order[:take], order[take:], int(width[take - 1])
                place = np.arange(rows)[None, :]
                inside = place < n[own][:, None]
                at = np.where(inside, start[own][:, None] + place, 0)
                *c, g, y = (np.where(inside, x[at], 0.0) for x in flat)
                r = np.linalg.qr(np.stack([*c, *(x * g for x in c), y], axis=2), mode="r")
                beta[own], slope[own], p[own] = _cell_effects(r, n[own], k)
            keys = [c.take(pa.array(np.repeat(np.arange(len(n)), k))) for c in batch.columns[: len(key)]]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(proportions * len(n), pa.string()), *(pa.array(x.ravel()) for x in (beta, slope, p))], names=[*key, "cell", "beta", "beta_dosage", "p"])

    types = dict(values.dtypes)
    schema = ", ".join(f"{b} {types[b]}" for b in key) + ", cell string, beta double, beta_dosage double, p double"
    one = values.dropna(subset=[expression, dosage, *proportions]).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(used))))).alias("__v"))
    out = one.select(*key, *(F.col(f"__v.v{i}").alias(f"__v{i}") for i in range(k + 2))).mapInArrow(run, schema)
    return out.withColumn("p", F.when(~F.isnan("p"), F.col("p")))


def fit_beta(p: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Shape parameters of a beta distribution by maximum likelihood, begun at the moments."""
    p = np.clip(p, 1e-12, 1 - 1e-12)
    m, v = p.mean(), max(p.var(ddof=1) if len(p) > 1 else 0.0, 1e-12)
    t = max(m * (1 - m) / v - 1, 1e-3)
    a, b = m * t, (1 - m) * t
    la, lb = np.log(p).mean(), np.log1p(-p).mean()

    def digamma(x):
        s = 0.0
        while x < 6:
            s -= 1 / x
            x += 1
        f = 1 / (x * x)
        return s + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))

    def trigamma(x):
        s = 0.0
        while x < 6:
            s += 1 / (x * x)
            x += 1
        f = 1 / (x * x)
        return s + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f / 42))

    for _ in range(rounds):
        ga, gb = digamma(a) - digamma(a + b) - la, digamma(b) - digamma(a + b) - lb
        haa, hbb, hab = trigamma(a) - trigamma(a + b), trigamma(b) - trigamma(a + b), -trigamma(a + b)
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a2, b2 = max(a - da, a / 4), max(b - db, b / 4)
        done = abs(a2 - a) < 1e-9 * a and abs(b2 - b) < 1e-9 * b
        a, b = a2, b2
        if done:
            break
    return a, b


def beta_adjusted(minimum: DataFrame, by: str, perm: str, p: str) -> DataFrame:
    """(by, p, alpha, beta, adjusted): the least p of each gene (perm 0) under the beta distribution fitted
    to its least p of the permutations. minimum has one row per gene and permutation."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        real = pdf.loc[pdf[perm] == 0, p]
        null = pdf.loc[pdf[perm] != 0, p].to_numpy(float)
        if real.empty or len(null) < 2:
            return pd.DataFrame({by: [pdf[by].iloc[0]], "p": [real.iloc[0] if len(real) else None], "alpha": [None], "beta": [None], "adjusted": [None]}).astype({"p": float, "alpha": float, "beta": float, "adjusted": float})
        a, b = fit_beta(null)
        x = float(real.iloc[0])
        return pd.DataFrame({by: [pdf[by].iloc[0]], "p": [x], "alpha": [a], "beta": [b], "adjusted": [float(betainc(np.array([a]), np.array([b]), np.array([x]))[0])]})

    kind = dict(minimum.dtypes)[by]
    return minimum.where(F.col(p).isNotNull()).groupBy(by).applyInPandas(run, f"{by} {kind}, p double, alpha double, beta double, adjusted double")


def generalised_least_squares(rows: DataFrame, block: str, item: str, x: str, y: str, loadings: str) -> DataFrame:
    """One row (n, beta, alpha, se, t) of y on x where errors of items of a block correlate.

    loadings is each item's row of its block's correlation matrix, as an array in order of item.
    Each block is whitened by its own eigenvectors; the whitened sums
    of all blocks are then added up."""

    @F.pandas_udf("struct<n:int,s1:double,sx:double,sy:double,sxx:double,sxy:double,syy:double>")
    def whiten(matrices: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        out = []
        for m, a, b in zip(matrices, xs, ys):
            r = np.stack(list(m)).astype(float)
            w, v = np.linalg.eigh((r + r.T) / 2)
            ok = w > 1e-8
            t = v[:, ok] / np.sqrt(w[ok])
            one, a, b = t.T @ np.ones(len(r)), t.T @ np.asarray(a, float), t.T @ np.asarray(b, float)
            out.append((int(ok.sum()), one @ one, one @ a, one @ b, a @ a, a @ b, b @ b))
        return pd.DataFrame(out, columns=["n", "s1", "sx", "sy", "sxx", "sxy", "syy"])

    each = gathered(rows, block, item, x=F.col(x), y=F.col(y), loadings=F.col(loadings))
    s = each.select(whiten("loadings", "x", "y").alias("w")).select("w.*").agg(*(F.sum(c).alias(c) for c in ("n", "s1", "sx", "sy", "sxx", "sxy", "syy")))
    det = F.col("s1") * F.col("sxx") - F.col("sx") ** 2
    beta = (F.col("s1") * F.col("sxy") - F.col("sx") * F.col("sy")) / det
    alpha = (F.col("sxx") * F.col("sy") - F.col("sx") * F.col("sxy")) / det
    rss = F.greatest(F.lit(0.0), F.col("syy") - beta * F.col("sxy") - alpha * F.col("sy"))
    se = F.sqrt(rss / (F.col("n") - 2) * F.col("s1") / det)
    return s.select("n", beta.alias("beta"), alpha.alias("alpha"), se.alias("se"), F.when(se > 0, beta / se).alias("t"))
