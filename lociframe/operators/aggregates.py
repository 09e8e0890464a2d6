"""Grouped statistics in long form: one row per observation, groups by key columns.

Every statistic is a built-in partial aggregate or arithmetic over sums, so what is
shuffled is one row per group and task. Nulls are left out pairwise."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import special, stats
from .ordered import dealt


def describe(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, total, abs_total, variance, sd, skewness and kurtosis (sample estimators), least, most."""
    v = F.col(value)
    n = F.count(v)
    g1 = F.skewness(v)
    g2 = F.kurtosis(v)
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    return values.groupBy(*by).agg(n.alias("n"), F.avg(v).alias("mean"), F.sum(v).alias("total"), F.sum(F.abs(v)).alias("abs_total"), F.var_samp(v).alias("variance"), F.stddev_samp(v).alias("sd"), skew.alias("skewness"), kurt.alias("kurtosis"), F.min(v).alias("least"), F.max(v).alias("most"))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two aggregated columns; null, not an error, without variation."""
    return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def correlate(values: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """n, r and covariance over pairs without nulls; r is null under two pairs or without variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return values.groupBy(*by).agg(F.count_if(both).alias("n"), pearson(a, b).alias("r"), F.covar_samp(a, b).alias("covariance"))


def weighted_correlate(values: DataFrame, by: list[str], x: str, y: str, w: str) -> DataFrame:
    """Correlation with weights, by weighted means; groups are summed once."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(w).isNotNull()
    v = values.where(ok)
    s = v.groupBy(*by).agg(*(F.sum(e).alias(n) for n, e in (("w", F.col(w)), ("wx", F.col(w) * F.col(x)), ("wy", F.col(w) * F.col(y)), ("wxx", F.col(w) * F.col(x) * F.col(x)), ("wyy", F.col(w) * F.col(y) * F.col(y)), ("wxy", F.col(w) * F.col(x) * F.col(y)))))
    sxy, sxx, syy = (F.col("wxy") - F.col("wx") * F.col("wy") / F.col("w")), (F.col("wxx") - F.col("wx") ** 2 / F.col("w")), (F.col("wyy") - F.col("wy") ** 2 / F.col("w"))
    return s.select(*by, F.when((sxx > 0) & (syy > 0), sxy / F.sqrt(sxx * syy)).alias("r"))


def simple_regression(values: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """n, beta, alpha, se and t of y on x."""
    a = values.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("beta"), F.regr_intercept(y, x).alias("alpha"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))
    se = F.when((F.col("n") > 2) & (F.col("sxx") > 0), F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.col("beta") * F.col("sxy")) / (F.col("n") - 2) / F.col("sxx")))
    return a.select(*by, "n", "beta", "alpha", se.alias("se"), F.when(se > 0, F.col("beta") / se).alias("t"))


def two_stage(values: DataFrame, by: list[str], instrument: str, x: str, y: str) -> DataFrame:
    """Two-stage least squares: beta, alpha and se of y on what the instrument explains of x."""
    v = values.where(F.col(instrument).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    a = v.groupBy(*by).agg(F.count("*").alias("n"), F.covar_pop(instrument, y).alias("czy"), F.covar_pop(instrument, x).alias("czx"), F.var_pop(instrument).alias("vz"), F.var_pop(y).alias("vy"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    beta = F.when(F.col("czx") != 0, F.col("czy") / F.col("czx"))
    fitted = F.col("czx") ** 2 / F.when(F.col("vz") > 0, F.col("vz"))  # variance of the fitted x
    rest = F.greatest(F.lit(0.0), F.col("vy") - F.col("czy") ** 2 / F.when(F.col("vz") > 0, F.col("vz")))
    return a.select(*by, "n", beta.alias("beta"), (F.col("my") - beta * F.col("mx")).alias("alpha"), F.when((F.col("n") > 2) & (fitted > 0), F.sqrt(rest / (F.col("n") - 2) / fitted)).alias("se"))


def interaction_regression(values: DataFrame, by: list[str], x: str, c: str, y: str, placed: bool = False) -> DataFrame:
    """b0..b3 of y = b0 + b1 x + b2 c + b3 x c, with the t of b3, from one pass of sums.

    Rows are dealt by key before they are summed: fifteen sums a key are more than the rows of a small key. placed: they are already.
    The normal equations of four unknowns are solved by elimination on columns."""
    v = values.where(F.col(x).isNotNull() & F.col(c).isNotNull() & F.col(y).isNotNull())
    terms = {"1": F.lit(1.0), "x": F.col(x).cast("double"), "c": F.col(c).cast("double"), "i": (F.col(x) * F.col(c)).cast("double"), "y": F.col(y).cast("double")}
    names = list(terms)
    prods = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = (v if placed else dealt(v, by)).groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(terms[a] * terms[b]).alias(f"s{i}") for i, (a, b) in enumerate(prods)))

    @F.pandas_udf("struct<b0:double,b1:double,b2:double,b3:double,t3:double>")
    def solve(*cols: pd.Series) -> pd.DataFrame:
        n = cols[0].to_numpy(float)
        m = np.zeros((len(n), 5, 5))
        for (a, b), s in zip(prods, cols[1:]):
            i, j = names.index(a), names.index(b)
            m[:, i, j] = m[:, j, i] = s.to_numpy(float)
        out = np.full((len(n), 5), np.nan)
        g, r = m[:, :4, :4], m[:, :4, 4]
        scale = np.sqrt(np.maximum(np.einsum("kii->ki", g), 1e-300))
        both = scale[:, :, None] * scale[:, None, :]
        ok = np.flatnonzero((n > 4) & (np.linalg.cond(g / both) < 1e10))
        inv = np.linalg.inv(g[ok] / both[ok]) / both[ok]  # the whole stack at once
        b = np.einsum("kij,kj->ki", inv, r[ok])
        rss = np.maximum(0.0, m[ok, 4, 4] - (b * r[ok]).sum(axis=1))
        se = np.sqrt(np.maximum(0.0, rss / (n[ok] - 4) * inv[:, 3, 3]))
        out[ok, :4] = b
        out[ok, 4] = np.divide(b[:, 3], se, out=np.full(len(ok), np.nan), where=se > 0)
        return pd.DataFrame(out, columns=["b0", "b1", "b2", "b3", "t3"])

    return sums.withColumn("fit", solve("n", *(f"s{i}" for i in range(len(prods))))).select(*by, "n", "fit.*")


def call_rate(genotypes: DataFrame, by: list[str], dosage: str) -> DataFrame:
    return genotypes.groupBy(*by).agg((F.count(dosage) / F.count("*")).alias("call_rate"))


def variant_summary(genotypes: DataFrame, by: list[str], dosage: str) -> DataFrame:
    """n, called, call_rate, the three genotype counts, alternate frequency, maf, MACH r2.

    dosage counts alternate alleles between 0 and 2. maf keeps the reference allele
    on ties by being the same for both. MACH r2 is the variance of dosages over what
    Hardy-Weinberg expects, at most 1, and 1 without variation."""
    d = F.col(dosage)
    p = F.avg(d) / 2
    expected = 2 * p * (1 - p)
    variance = F.avg(d * d) - F.avg(d) * F.avg(d)
    call = lambda lo, hi: F.count_if((d >= lo) & (d < hi))
    return genotypes.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count(d).alias("called"),
        (F.count(d) / F.count("*")).alias("call_rate"),
        call(-1, 0.5).alias("hom_ref"),
        call(0.5, 1.5).alias("het"),
        call(1.5, 3).alias("hom_alt"),
        p.alias("alt_freq"),
        F.least(p, 1 - p).alias("maf"),
        F.when(p.isNotNull(), F.when((p <= 0) | (p >= 1), 1.0).otherwise(F.least(F.lit(1.0), variance / expected))).alias("mach_r2"),
    )


def with_hwe(summary: DataFrame) -> DataFrame:
    """variant_summary with the exact Hardy-Weinberg p of its counts."""
    return summary.withColumn("hwe_p", special.hwe_exact_p(F.col("het"), F.col("hom_ref"), F.col("hom_alt")))


def genotype_counts(genotypes: DataFrame, by: list[str], call: str) -> DataFrame:
    return genotypes.groupBy(*by, call).agg(F.count("*").alias("n"))


def histogram(values: DataFrame, by: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal bins; values under low, and of high or more, are left out."""
    step = (high - low) / bins
    inside = values.where((F.col(value) >= low) & (F.col(value) < high))
    return inside.groupBy(*by, F.floor((F.col(value) - low) / step).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def chi2_2x2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Chi-square of a 2x2 table; null if a margin is 0."""
    n = a + b + c + d
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(margins > 0, n * (a * d - b * c) ** 2 / margins)


def contingency(rows: DataFrame, by: list[str], first: Column, second: Column) -> DataFrame:
    """The counts a, b, c, d of two conditions per group, chi-square, and odds ratio."""
    one, two = F.coalesce(first, F.lit(False)), F.coalesce(second, F.lit(False))
    t = rows.groupBy(*by).agg(F.count_if(one & two).alias("a"), F.count_if(one & ~two).alias("b"), F.count_if(~one & two).alias("c"), F.count_if(~one & ~two).alias("d"))
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    return t.withColumn("chi2", chi2_2x2(a, b, c, d)).withColumn("odds_ratio", F.when(b * c > 0, a * d / (b * c)))


def t_test(values: DataFrame, by: list[str], value: str, group: Column, welch: bool = True) -> DataFrame:
    """t of the mean where group holds less that where not; unequal variances. df is n1 + n2 - 2, or
    Welch's if welch."""
    v = F.col(value)
    one, two = F.when(group, v), F.when(~group, v)
    s = values.groupBy(*by).agg(F.count(one).alias("n1"), F.count(two).alias("n2"), F.avg(one).alias("m1"), F.avg(two).alias("m2"), F.var_samp(one).alias("v1"), F.var_samp(two).alias("v2"))
    q1, q2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    ok = (F.col("n1") > 1) & (F.col("n2") > 1) & (q1 + q2 > 0)
    df = (q1 + q2) ** 2 / (q1 * q1 / (F.col("n1") - 1) + q2 * q2 / (F.col("n2") - 1)) if welch else (F.col("n1") + F.col("n2") - 2).cast("double")
    return s.select(*by, "n1", "n2", "m1", "m2", F.when(ok, (F.col("m1") - F.col("m2")) / F.sqrt(q1 + q2)).alias("t"), F.when(ok, df).alias("df"))


def theil_sen(values: DataFrame, by: list[str], x: str, y: str, row: str) -> DataFrame:
    """Median slope of all pairs with different x, 2.5 and 97.5 percentiles, intercept, and pairs.

    A group's rows are gathered and its pairs made in numpy, so that no pair is shuffled or spilled. A group should be
    small (it is quadratic by definition); equal rows make no pair."""
    a = values.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.forall(F.array(*(F.col(k).isNotNull() for k in by)), lambda k: k))
    one = F.struct(F.col(row).alias("i"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    g = dealt(a, by).groupBy(*by).agg(F.sort_array(F.collect_list(one)).alias("__r"))
    # rows without a number have a part in the medians of x and y, and in no pair
    place = F.transform("__r", lambda r: F.when(r["i"].isNotNull(), F.array_position(F.col("__r.i"), r["i"])))

    @F.pandas_udf("struct<slope:double,low:double,high:double,pairs:long,mx:double,my:double>")
    def fit(xs: pd.Series, ys: pd.Series, places: pd.Series) -> pd.DataFrame:
        out = []
        for u, v, at in zip(xs, ys, places):
            u, v, at = np.asarray(u, float), np.asarray(v, float), np.asarray(at, float)
            slopes = _slopes(u, v, at)
            out.append((*(_percentile(slopes, q) for q in (0.5, 0.025, 0.975)), len(slopes), _percentile(np.sort(u), 0.5), _percentile(np.sort(v), 0.5)))
        return pd.DataFrame(out, columns=["slope", "low", "high", "pairs", "mx", "my"])

    f = g.select(*by, fit("__r.x", "__r.y", place).alias("f")).where("f.pairs > 0")
    return f.select(*by, "f.slope", (F.col("f.my") - F.col("f.slope") * F.col("f.mx")).alias("intercept"), "f.low", "f.high", "f.pairs")


@functools.lru_cache(128)
def _triangle(k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(k, 1)


def _slopes(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The slopes of all pairs of another number and another x, sorted."""
    i, j = _triangle(len(x)) if len(x) <= 256 else np.triu_indices(len(x), 1)
    ok = (at[j] > at[i]) & (x[j] != x[i]) & ~(np.isnan(x[j]) & np.isnan(x[i]))
    i, j = i[ok], j[ok]
    return np.sort((y[j] - y[i]) / (x[j] - x[i]))


def _percentile(x: np.ndarray, q: float) -> float | None:
    """The percentile of sorted values, between two by their distances; None of none."""
    if not len(x):
        return None
    at = q * (len(x) - 1)
    low = int(at)
    high = min(low + 1, len(x) - 1)
    return float(x[low] if x[low] == x[high] else (high - at) * x[low] + (at - low) * x[high])


def ks_test(values: DataFrame, by: list[str], value: str, group: Column) -> DataFrame:
    """Largest gap d of the two distribution functions, and z = d sqrt(n1 n2 / (n1 + n2))."""
    v = values.where(F.col(value).isNotNull()).withColumn("__g", group.cast("int"))
    counts = v.groupBy(*by, value).agg(F.sum("__g").alias("k1"), F.sum(1 - F.col("__g")).alias("k2"))
    w = Window.partitionBy(*by)
    run = w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    gaps = counts.select(*by, F.sum("k1").over(w).alias("n1"), F.sum("k2").over(w).alias("n2"), F.sum("k1").over(run).alias("c1"), F.sum("k2").over(run).alias("c2")).where("n1 > 0 and n2 > 0")
    d = gaps.groupBy(*by, "n1", "n2").agg(F.max(F.abs(F.col("c1") / F.col("n1") - F.col("c2") / F.col("n2"))).alias("d"))
    return d.withColumn("z", F.col("d") * F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2"))))


def distances(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with city_block and bray_curtis of two array columns."""
    diff = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return pairs.withColumn("city_block", diff).withColumn("bray_curtis", F.when(total != 0, diff / total))


def fold_change(values: DataFrame, by: list[str], dosage: str, value: str) -> DataFrame:
    """log2 of the mean of alternate over that of reference homozygotes, halved for one allele."""
    m0, m2 = F.avg(F.when(F.col(dosage) == 0, F.col(value))), F.avg(F.when(F.col(dosage) == 2, F.col(value)))
    fc = F.when((m0 > 0) & (m2 > 0), F.log2(m2 / m0))
    return values.groupBy(*by).agg(m0.alias("mean_ref"), m2.alias("mean_alt"), fc.alias("log2_fold"), (fc / 2).alias("log2_allelic"))


def allelic_imbalance(reads: DataFrame, by: list[str], ref: str, alt: str, grid: int = 1000) -> DataFrame:
    """Maximum likelihood reference share on the grid 1/grid .. 1 - 1/grid and the ratio statistic
    2 (max - at one half) with its p.

    The binomial log-likelihood is concave in the share, so its best grid point is one of the
    two around the exact maximum, total ref reads over all reads: only sums are needed."""
    s = reads.groupBy(*by).agg(F.sum(ref).cast("double").alias("r"), F.sum(alt).cast("double").alias("a")).where("r + a > 0")
    exact = F.col("r") / (F.col("r") + F.col("a"))
    inside = lambda p: F.least(F.greatest(p, F.lit(1.0)), F.lit(grid - 1.0)) / grid
    ll = lambda p: F.col("r") * F.log(p) + F.col("a") * F.log(1 - p)
    s = s.withColumn("lo", inside(F.floor(exact * grid).cast("double"))).withColumn("hi", inside(F.ceil(exact * grid).cast("double")))
    best = F.when(ll(F.col("lo")) >= ll(F.col("hi")), F.col("lo")).otherwise(F.col("hi"))
    s = s.withColumn("share", best)
    d = F.greatest(F.lit(0.0), 2 * (ll(F.col("share")) - (F.col("r") + F.col("a")) * F.log(F.lit(0.5))))
    return s.select(*by, "r", "a", "share", d.alias("d")).withColumn("p", stats.chi2_p_1df(F.col("d")))


def degree_stats(z: DataFrame, by: list[str], value: str, cutoffs: dict[str, float]) -> DataFrame:
    """Mean and sum of z and z squared, and how many reach each cut-off in size."""
    v = F.col(value)
    return z.groupBy(*by).agg(F.avg(v).alias("mean_z"), F.sum(v).alias("sum_z"), F.avg(v * v).alias("mean_z2"), F.sum(v * v).alias("sum_z2"), *(F.count_if(F.abs(v) >= c).alias(f"n_{name}") for name, c in cutoffs.items()))
