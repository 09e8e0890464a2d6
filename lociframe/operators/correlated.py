"""Statistics of items whose errors correlate in blocks: generalised least squares, enrichment of sets, inverse
matrices, and tails of sums of weighted chi-squares.

A block (a chromosome arm, a gene's variants) is a group of bounded size, worked on in numpy; what blocks come to is
added up in Spark."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special


def mixture_upper_p(q: float, weights: np.ndarray) -> float:
    """P(sum of weights times chi-squares of one degree of freedom > q), all weights taken; relative errors are some 1e-12.

    The Laplace transform of the tail is inverted along a parabola around its cut, that begins at -1/2 over the largest weight; for few weights
    and a q far under the mean, that of the distribution along one around 0. Either crosses the axis where the integrand is least, so next to nothing
    is cancelled however small the result; steps are a part of the distance to the nearest singularity and of the saddle's
    width, so that the error is near rounding (trapezoid rules on deformed contours, as of Weideman and Trefethen)."""
    w = np.asarray(weights, float)
    w = w[w > 0]
    if not len(w):
        return 1.0 if q < 0 else 0.0
    if q <= 0:
        return 1.0
    q, w = q / w.max(), w / w.max()
    upper = q >= 0.2 * w.sum() or len(w) > 30
    slope = lambda s: q - (w / (1 + 2 * w * s)).sum() - 1 / s
    low, high = (-0.5, 0.0) if upper else (0.0, (1 + w.sum()) / q + 1)
    while not upper and slope(high) < 0:
        high *= 2
    for _ in range(80):
        at = (low + high) / 2
        low, high = (low, at) if at != 0 and slope(at) > 0 else (at, high)
    at = (low + high) / 2
    edge = -0.5 if upper else 0.0
    mu = at - edge
    bend = (2 * w * w / (1 + 2 * w * at) ** 2).sum() + 1 / at**2
    step = min(2 * np.pi * 0.9 * min(1.0, np.sqrt(0.5 / mu) - 1 if upper else 1.0) / 36, 0.3 / (mu * np.sqrt(bend)))
    logs = lambda t: (s := edge + mu * (1 + 1j * t) ** 2, -0.5 * np.log(1 + 2 * s[:, None] * w[None, :]).sum(axis=1) + s * q)
    top = logs(np.zeros(1))[1][0].real
    far = 8 * step
    while logs(np.array([far]))[1][0].real > top - 42:
        far *= 1.3
    total = 0.0
    count = int(far / step) + 2
    for first in range(0, count, part := max(1, (1 << 20) // len(w))):
        t = np.arange(first, min(count, first + part)) * step
        s, m = logs(t)
        f = (np.exp(m - top) * (1 + 1j * t) / s).real
        total += f.sum() - (f[0] / 2 if first == 0 else 0.0)
    with np.errstate(under="ignore"):
        p = abs(2 * mu / np.pi * step * total) * np.exp(top)
    return float(min(1.0, p if upper else 1.0 - p))


def weighted_chi2_p(values: DataFrame, by: list[str], q: Column, weight: str) -> DataFrame:
    """(keys, n, q, p): the upper tail of each key's q under chi-squares of its rows' weights. A key's weights are few, and gathered."""
    s = values.groupBy(*by).agg(F.count(weight).alias("n"), q.alias("q"), F.sort_array(F.collect_list(weight)).alias("__w"))

    @F.pandas_udf("double")
    def tail(q: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([mixture_upper_p(float(a), np.array(b, float)) for a, b in zip(q, w)])

    return s.withColumn("p", tail(F.col("q").cast("double"), F.col("__w").cast("array<double>"))).drop("__w")


def gene_p(z: DataFrame, pairs: DataFrame, gene: str, variant: str) -> DataFrame:
    """(gene, n, q, p): the sum of squared z of a gene's variants, (gene, variant, z), against chi-squares weighted by the
    eigenvalues of their correlations, pairs(gene, a, b, r); pairs not listed are 0. A gene is a group of bounded size."""
    v = z.groupBy(gene).agg(F.sort_array(F.collect_list(F.struct(F.col(variant).alias("v"), F.col("z").cast("double").alias("z")))).alias("items"))
    r = pairs.groupBy(gene).agg(F.collect_list(F.struct("a", "b", F.col("r").cast("double").alias("r"))).alias("r"))

    @F.pandas_udf("struct<n:long,q:double,p:double>")
    def run(items: pd.Series, links: pd.Series) -> pd.DataFrame:
        out = []
        for own, near in zip(items, links):
            m = _correlations(own, near)
            q = sum(x["z"] ** 2 for x in own)
            out.append((len(own), q, mixture_upper_p(q, np.maximum(np.linalg.eigvalsh(m), 0))))
        return pd.DataFrame(out, columns=["n", "q", "p"])

    return v.join(r, gene, "left").select(gene, run("items", "r").alias("x")).select(gene, "x.*")


def gene_p_by_draws(z: DataFrame, pairs: DataFrame, gene: str, variant: str, enough: int = 20, most: int = 100_000, step: int = 10_000, rescue: int = 0, floor: float = 1e-12, seed: int = 1) -> DataFrame:
    """(gene, n, q, p, draws, over, how): gene_p by rounds of draws of the weighted chi-squares, until `enough` of them exceed q or `most` are
    made; then p is (over + 1/2) / (draws + 1), how "draws". A gene with fewer takes the exact tail, how "tail", not under floor;
    with rescue it goes on drawing up to so many, until five exceed, and only then takes the tail. A gene of one variant has its normal p, how "one".

    Draws come from the seed and the gene, not from how genes are dealt to tasks. A round's memory is bounded, whatever the gene's variants."""
    v = z.groupBy(gene).agg(F.sort_array(F.collect_list(F.struct(F.col(variant).alias("v"), F.col("z").cast("double").alias("z")))).alias("items"))
    r = pairs.groupBy(gene).agg(F.collect_list(F.struct("a", "b", F.col("r").cast("double").alias("r"))).alias("r"))

    @F.pandas_udf("struct<n:long,q:double,p:double,draws:long,over:long,how:string>")
    def run(items: pd.Series, links: pd.Series, key: pd.Series) -> pd.DataFrame:
        out = []
        for own, near, k in zip(items, links, key):
            q = sum(x["z"] ** 2 for x in own)
            if len(own) == 1:
                out.append((1, q, max(floor, math.erfc(math.sqrt(q / 2))), 0, 0, "one"))
                continue
            w = np.maximum(np.linalg.eigvalsh(_correlations(own, near)), 0)
            rng, draws, over, need = np.random.default_rng([seed, k & (2**63 - 1)]), 0, 0, enough
            while over < need and draws < max(most, rescue):
                if draws >= most:
                    need = min(enough, 5)
                    if over >= need:
                        break
                for s in range(0, step, part := max(1, min(step, 2_000_000 // len(w)))):
                    over += int((rng.standard_normal((min(part, step - s), len(w))) ** 2 @ w > q).sum())
                draws += step
            if over >= need:
                out.append((len(own), q, (over + 0.5) / (draws + 1), draws, over, "draws"))
            else:
                out.append((len(own), q, max(floor, mixture_upper_p(q, w)), draws, over, "tail"))
        return pd.DataFrame(out, columns=["n", "q", "p", "draws", "over", "how"])

    return v.join(r, gene, "left").select(gene, run("items", "r", F.xxhash64(gene)).alias("x")).select(gene, "x.*")


def _correlations(own, near) -> np.ndarray:
    """The matrix of a gene's variants; pairs not listed are 0."""
    at = {x["v"]: i for i, x in enumerate(own)}
    m = np.eye(len(own))
    for x in near if near is not None else ():
        if x["a"] in at and x["b"] in at:
            m[at[x["a"]], at[x["b"]]] = m[at[x["b"]], at[x["a"]]] = x["r"]
    return m


def gathered(rows: DataFrame, block: str, item: str, **columns: Column) -> DataFrame:
    """(block, items, names...): a row a block, arrays in order of item. Blocks go through Python many to a batch, as a call for each costs more than its work."""
    one = F.sort_array(F.collect_list(F.struct(F.col(item).alias("items"), *(c.alias(n) for n, c in columns.items()))))
    g = rows.groupBy(block).agg(one.alias("__r"))
    return g.select(block, *(F.col(f"__r.{n}").alias(n) for n in ("items", *columns)))


def _square(rows) -> np.ndarray:
    return np.stack(list(rows)).astype(float)


def merged_items(r: np.ndarray, least: float) -> np.ndarray:
    """The group of each item: items that correlate by least or more in absolute value, directly or over others, are one. Groups count from 0 in order of
    their first items."""
    group = np.arange(len(r))
    for i, j in zip(*np.nonzero(np.triu(np.abs(r) >= least, 1))):
        a, b = group[i], group[j]
        group[group == max(a, b)] = min(a, b)
    return np.unique(group, return_inverse=True)[1]


def _merged(r: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(groups by items, the correlations of the means of groups)."""
    a = (group[None, :] == np.arange(group.max() + 1)[:, None]).astype(float)
    a /= a.sum(axis=1, keepdims=True)
    c = a @ r @ a.T
    d = np.sqrt(np.maximum(np.diag(c), 1e-300))
    return a, c / d[:, None] / d[None, :]


def meta_items(rows: DataFrame, block: str, item: str, loadings: str, least: float) -> DataFrame:
    """(block, item, meta, size): the first item of each item's group of merged ones, inside its block, and how many it has."""

    @F.pandas_udf("array<struct<first:int,size:int>>")
    def run(matrices: pd.Series) -> pd.Series:
        out = []
        for r in map(_square, matrices):
            g = merged_items(r, least)
            _, first = np.unique(g, return_index=True)
            out.append([{"first": a, "size": b} for a, b in zip(first[g].tolist(), np.bincount(g)[g].tolist())])
        return pd.Series(out)

    each = gathered(rows, block, item, loadings=F.col(loadings)).withColumn("__g", run("loadings"))
    return each.select(block, "items", F.posexplode("__g").alias("__i", "__g")).select(block, F.get("items", "__i").alias(item), F.get("items", F.col("__g.first")).alias("meta"), F.col("__g.size").alias("size"))


def _inverse(r: np.ndarray) -> np.ndarray:
    w, v = np.linalg.eigh((r + r.T) / 2)
    ok = w > 1e-8
    return (v[:, ok] / w[ok]) @ v[:, ok].T


def inverse_blocks(rows: DataFrame, block: str, item: str, loadings: str) -> DataFrame:
    """(block, a, b, value): the (pseudo-)inverse of each block's correlations. loadings is each item's row of the
    block's matrix, in order of item."""

    @F.pandas_udf("array<double>")
    def run(matrices: pd.Series) -> pd.Series:
        return pd.Series([_inverse(_square(x)).ravel() for x in matrices])

    each = gathered(rows, block, item, loadings=F.col(loadings)).withColumn("__v", run("loadings")).withColumn("__k", F.size("items"))
    each = each.select(block, "items", "__k", F.posexplode("__v").alias("__i", "value"))
    return each.select(block, F.get("items", F.floor(F.col("__i") / F.col("__k")).cast("int")).alias("a"), F.get("items", F.col("__i") % F.col("__k")).alias("b"), "value")


def set_regression(rows: DataFrame, members: DataFrame, block: str, item: str, group: str, y: str, loadings: str, least: int = 2, merge: float | None = None) -> DataFrame:
    """(group, n, beta, se, t, p) of each set: generalised least squares of y on membership and an intercept, where errors
    of a block's items correlate as loadings tell. With merge, items of a block that correlate by so much (merged_items) are one item first, of
    their mean y, which is in a set if one of them is and counts there once. Blocks come to sums by set, which Spark adds up; a set's items
    are never gathered."""
    m = members.select(item, group).distinct().groupBy(item).agg(F.collect_list(group).alias("__sets"))

    @F.pandas_udf("array<struct<at:int,own:int,n:long,s11:double,s1y:double,sq:double,s1x:double,sxy:double>>")
    def run(matrices: pd.Series, ys: pd.Series, places: pd.Series) -> pd.Series:
        """The sums of a block, and those of each set in it, named by where it is first among the sets of the block's items (at item, own of its list)."""
        blocks = []
        for r, v, named in zip(map(_square, matrices), ys, places):
            v = np.asarray(v, float)
            group_of = np.arange(len(v))
            if merge is not None:
                group_of = merged_items(r, merge)
                means, r = _merged(r, group_of)
                v = means @ v
            w = _inverse(r)
            wy, w1 = w @ v, w.sum(axis=1)
            inside: dict = {}
            for i, item_at, codes in zip(group_of.tolist(), range(len(group_of)), named):
                for k, s in enumerate(codes if codes is not None else ()):
                    if i not in (own := inside.setdefault(s, (item_at, k, []))[2]):
                        own.append(i)
            out = [(-1, -1, len(v), w1.sum(), wy.sum(), v @ wy, 0.0, 0.0)]
            out += [(p, k, len(i), 0.0, 0.0, w[np.ix_(i, i)].sum(), w1[i].sum(), wy[i].sum()) for p, k, i in inside.values()]
            blocks.append([dict(zip(("at", "own", "n", "s11", "s1y", "sq", "s1x", "sxy"), x)) for x in out])
        return pd.Series(blocks)

    each = gathered(rows.join(m, item, "left"), block, item, y=F.col(y), loadings=F.col(loadings), sets=F.col("__sets"))
    each = each.withColumn("__codes", F.transform("sets", lambda x: F.transform(x, lambda s: s.cast("string"))))
    sums = each.select("sets", F.explode(run("loadings", "y", "__codes")).alias("__x")).select(F.get(F.get("sets", F.col("__x.at")), F.col("__x.own")).alias(group), *(F.col(f"__x.{c}") for c in ("n", "s11", "s1y", "sq", "s1x", "sxy")))
    sums = sums.groupBy(group).agg(*(F.sum(c).alias(c) for c in ("n", "s11", "s1y", "sq", "s1x", "sxy")))
    every = sums.where(F.col(group).isNull()).select(F.col("n").alias("all"), F.col("s11").alias("t11"), F.col("s1y").alias("t1y"), F.col("sq").alias("tyy"))  # one row
    s = sums.where(F.col(group).isNotNull() & (F.col("n") >= least)).join(F.broadcast(every))
    det = F.col("t11") * F.col("sq") - F.col("s1x") ** 2
    s = s.where(det > 1e-9).withColumn("beta", (F.col("t11") * F.col("sxy") - F.col("s1x") * F.col("t1y")) / det)
    alpha = (F.col("sq") * F.col("t1y") - F.col("s1x") * F.col("sxy")) / det
    rss = F.greatest(F.lit(0.0), F.col("tyy") - F.col("beta") * F.col("sxy") - alpha * F.col("t1y"))
    s = s.withColumn("se", F.sqrt(rss / (F.col("all") - 2) * F.col("t11") / det)).withColumn("t", F.when(F.col("se") > 0, F.col("beta") / F.col("se")))
    return s.select(group, "n", "beta", "se", "t", special.t_two_sided_p(F.col("t"), (F.col("all") - 2).cast("double")).alias("p"))
