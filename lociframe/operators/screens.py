"""Interaction results, imputation and read-count checks, merges and summaries of results.

Results of an interaction screen are rows (variant, gene, covariate, z, n): a cube that is
stored partitioned, sliced by filters and summed by grouping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import alleles
from ..functions.special import log_gamma
from .aggregates import correlate, interaction_regression
from .ordered import dealt, running_sums, settled


def cube_slice(cube: DataFrame, **bound: object) -> DataFrame:
    """Rows of the cube whose bound columns have the given value, or one of the given values; what is
    None is not bound. Partitioned columns prune files, others are pushed to the scan."""
    for column, value in bound.items():
        if value is not None:
            cube = cube.where(F.col(column).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    return cube


def write_cube(cube: DataFrame, path: str, by: str = "gene") -> None:
    """The cube as Parquet, partitioned by one column and sorted by the rest within files."""
    rest = [c for c in ("variant", "covariate") if c in cube.columns]
    cube.repartition(by).sortWithinPartitions(by, *rest).write.partitionBy(by).parquet(path)


def covariate_chi2(cube: DataFrame, covariate: str, z: str) -> DataFrame:
    """(covariate, n, chi2): the sum of squared z of each covariate, over all pairs."""
    return cube.groupBy(covariate).agg(F.count(z).alias("n"), F.sum(F.col(z) * F.col(z)).alias("chi2"))


def covariate_extremes(values: DataFrame, by: list[str], x: str, covariate: str, y: str, parts: int = 3) -> DataFrame:
    """(keys, low, high, direction): the slope of y on x among the rows of each key with the lowest and the
    highest of `parts` equal parts by covariate (ties by x and y), and whether the effect is stronger ("up") at the
    high end, weaker ("down"), or turns ("flip"); null without variation at an end."""
    v = values.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(covariate).isNotNull())
    v = v.withColumn("__part", F.ntile(parts).over(Window.partitionBy(*by).orderBy(covariate, x, y)))
    s = v.groupBy(*by).agg(*(F.regr_slope(F.when(F.col("__part") == p, F.col(y)), F.when(F.col("__part") == p, F.col(x))).alias(name) for p, name in ((1, "low"), (parts, "high"))))
    s = s.select(*by, *(F.when(F.abs(c) > 1e-9, F.col(c)).when(F.col(c).isNotNull(), 0.0).alias(c) for c in ("low", "high")))
    way = F.when(F.signum("low") != F.signum("high"), "flip").when(F.abs("high") >= F.abs("low"), "up").otherwise("down")
    return s.withColumn("direction", F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), way))


def summary_of_results(results: DataFrame, by: list[str], variant: str, gene: str, p: str, cutoffs: tuple[float, ...]) -> DataFrame:
    """(keys, n, variants, genes, n_1, n_2, ...): the size of each result and how many p are up to each cutoff."""
    hits = [F.count_if(F.col(p) <= c).alias(f"n_{i + 1}") for i, c in enumerate(cutoffs)]
    return results.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(variant).alias("variants"), F.count_distinct(gene).alias("genes"), *hits)


def filter_reads(reads: DataFrame, ref: str, alt: str, total: int, each: int, share: float) -> DataFrame:
    """Allele counts with so many reads in all, so many of each allele, and each allele's share at least share."""
    n = F.col(ref) + F.col(alt)
    least = F.least(ref, alt)
    return reads.where((n >= total) & (least >= each) & (least >= share * n))


def merge_panels(first: DataFrame, second: DataFrame) -> DataFrame:
    """(chrom, pos, variant, other, ref, alt, recode): variants that both panels have at a position with
    fitting alleles; recode tells how the second's dosages (counts of alt) become the first's:
    "same", "swap" (2 - dosage), or on the other strand "strand" or "strand swap". Of several that fit the
    first of these counts, then the smallest id; A/T and C/G fit only as they are. Panels have (variant, chrom, pos, ref, alt)."""
    a = first.select("chrom", "pos", "variant", "ref", "alt")
    b = second.select("chrom", "pos", F.col("variant").alias("other"), F.col("ref").alias("r2"), F.col("alt").alias("a2"))
    turned = lambda c: alleles.complement(F.col(c))
    safe = ~alleles.is_ambiguous(F.array("ref", "alt"))
    same = lambda r, x: (F.col("ref") == r) & (F.col("alt") == x)
    way = F.when(same(F.col("r2"), F.col("a2")), 1).when(same(F.col("a2"), F.col("r2")) & safe, 2)
    way = way.when(same(turned("r2"), turned("a2")) & safe, 3).when(same(turned("a2"), turned("r2")) & safe, 4)
    j = a.join(b, ["chrom", "pos"]).withColumn("way", way).where("way is not null")
    w = Window.partitionBy("variant").orderBy("way", "other")
    names = F.element_at(F.array(*map(F.lit, ("same", "swap", "strand", "strand swap"))), F.col("way"))
    return j.withColumn("k", F.row_number().over(w)).where("k = 1").select("chrom", "pos", "variant", "other", "ref", "alt", names.alias("recode"))


def merged_dosages(merged: DataFrame, first: DataFrame, second: DataFrame, sample: str, dosage: str) -> DataFrame:
    """(variant, sample, dosage) of both panels' samples at the merged variants, the second's recoded."""
    a = first.join(merged.select("variant"), "variant", "left_semi").select("variant", sample, dosage)
    b = second.withColumnRenamed("variant", "other").join(merged.select("variant", "other", "recode"), "other")
    return a.unionByName(b.select("variant", sample, F.when(F.col("recode").endswith("swap"), 2 - F.col(dosage)).otherwise(F.col(dosage)).alias(dosage)))


def presence(expected: DataFrame, found: DataFrame, key: str, by: list[str]) -> DataFrame:
    """(keys, expected, present): how many of the expected variants a data set has."""
    have = found.select(key).distinct().withColumn("__have", F.lit(1))
    return expected.join(have, key, "left").groupBy(*by).agg(F.count("*").alias("expected"), F.count("__have").alias("present"))


def dosage_agreement(first: DataFrame, second: DataFrame, variant: str, sample: str, dosage: str) -> DataFrame:
    """(variant, n, r2, same): squared correlation of two data sets' dosages over common samples, and
    the share of equal rounded calls."""
    a = first.select(variant, sample, F.col(dosage).cast("double").alias("x"))
    b = second.select(variant, sample, F.col(dosage).cast("double").alias("y"))
    j = a.join(b, [variant, sample]).where("x is not null and y is not null")
    n, sx, sy = F.count("*"), F.sum("x"), F.sum("y")
    vx, vy, cov = n * F.sum(F.col("x") * F.col("x")) - sx * sx, n * F.sum(F.col("y") * F.col("y")) - sy * sy, n * F.sum(F.col("x") * F.col("y")) - sx * sy
    r2 = F.when((vx > 0) & (vy > 0), cov * cov / (vx * vy))  # one quotient of sums: exact sums where dosages are whole
    return j.groupBy(variant).agg(n.alias("n"), r2.alias("r2"), F.avg((F.round("x") == F.round("y")).cast("double")).alias("same"))


def z_ld(pairs: DataFrame, results: DataFrame, variant: str, feature: str, z: str, least: int = 3) -> DataFrame:
    """(a, b, n, r): the correlation of the z of two variants over features, which is near their LD where
    z are mostly chance. pairs has (a, b)."""
    x = results.select(F.col(variant).alias("a"), feature, F.col(z).alias("x"))
    y = results.select(F.col(variant).alias("b"), feature, F.col(z).alias("y"))
    j = pairs.join(x, "a").join(y, ["b", feature])
    return correlate(j, ["a", "b"], "x", "y").select("a", "b", "n", "r").where((F.col("n") >= least) & F.col("r").isNotNull())


def linked_artefacts(hits: DataFrame, under: DataFrame, links: DataFrame, variant: str, gene: str, linked: bool = True) -> DataFrame:
    """Hits (variant, gene) whose variant lies under the gene's probe or is in LD, links(a, b), with one that does;
    with linked False the others. under has (variant, gene)."""
    both = links.select("a", "b").union(links.select("b", "a")).toDF(variant, "__u")
    near = both.join(under.select(F.col(variant).alias("__u"), gene), "__u").select(variant, gene).union(under.select(variant, gene)).distinct()
    return hits.join(near, [variant, gene], "left_semi" if linked else "left_anti")


def joint_against_meta(joint: DataFrame, meta_z: DataFrame, on: list[str], z: str) -> DataFrame:
    """(keys, joint_z, meta_z, gap): a pooled analysis beside the meta-analysis of its parts."""
    j = joint.select(*on, F.col(z).alias("joint_z")).join(meta_z.select(*on, F.col(z).alias("meta_z")), on)
    return j.withColumn("gap", F.col("joint_z") - F.col("meta_z"))


def improve_by_children(scores: DataFrame, edges: DataFrame, term: str, gene: str, z: str) -> DataFrame:
    """(term, gene, z, children): z of each term and gene joined with those of the term's children for the
    gene: their sum over the root of their number."""
    kids = edges.select(F.col(term).alias("__child"), F.col("parent").alias(term)).distinct()
    c = scores.withColumnRenamed(term, "__child").join(kids, "__child").groupBy(term, gene).agg(F.sum(z).alias("__s"), F.count(z).alias("__k"))
    j = scores.join(c, [term, gene], "left").withColumn("children", F.coalesce("__k", F.lit(0)))
    return j.select(term, gene, ((F.col(z) + F.coalesce("__s", F.lit(0.0))) / F.sqrt(1.0 + F.col("children"))).alias(z), "children")


def project(results: DataFrame, loadings: DataFrame, row: str, feature: str, component: str, z: str, weight: str) -> DataFrame:
    """(row, component, z): rows of z over features taken to components: the sum of z times loading."""
    return results.join(loadings.select(feature, component, weight), feature).groupBy(row, component).agg(F.sum(F.col(z) * F.col(weight)).alias(z), F.count("*").alias("n"))


def keep_components(values: DataFrame, by: list[str], component: str, variance: str, share: float) -> DataFrame:
    """Components of each key, largest variance first, up to the first that reaches this share of the sum."""
    w = Window.partitionBy(*by)
    order = w.orderBy(F.desc(variance), component)
    before = F.coalesce(F.sum(variance).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    part = (before / F.sum(variance).over(w)).alias("before")
    return values.withColumn("__before", part).where(F.col("__before") < share).drop("__before")


def rename(values: DataFrame, names: DataFrame, column: str, old: str, new: str, prefix: str = "") -> DataFrame:
    """values with the names of a column replaced where the map has one, and a prefix before all. The map has one
    row an old name; of several the least new name counts."""
    m = names.groupBy(F.col(old).alias("__old")).agg(F.min(new).alias("__new"))
    j = values.join(m, values[column] == m["__old"], "left")
    return j.withColumn(column, F.concat(F.lit(prefix), F.coalesce(F.col("__new").cast("string"), F.col(column).cast("string")))).drop("__old", "__new")


def dosage_matrix(genotypes: DataFrame, variant: str, sample: str, dosage: str) -> DataFrame:
    """(variant, samples, dosages): one row a variant, arrays in order of sample."""
    g = genotypes.groupBy(variant).agg(F.array_sort(F.collect_list(F.struct(sample, dosage))).alias("x"))
    return g.select(variant, F.col(f"x.{sample}").alias("samples"), F.col(f"x.{dosage}").alias("dosages"))


def null_distribution(values: DataFrame, by: list[str], value: str, width: float) -> DataFrame:
    """(keys, bin, n): counts of permuted values in bins of a width, summed in parts before the shuffle."""
    return values.where(F.col(value).isNotNull()).groupBy(*by, F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"))


def empirical_p(values: DataFrame, null: DataFrame, by: list[str], value: str, width: float) -> DataFrame:
    """values with p: (1 + null values in its bin or above) / (1 + all) of its keys' null_distribution."""
    w = Window.partitionBy(*by).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    above = null.select(*by, "bin", F.sum("n").over(w).alias("above"), F.sum("n").over(Window.partitionBy(*by)).alias("all"))
    # the nearest bin at or over the value's own; bins are few, so they meet by key
    v = values.withColumn("__bin", F.floor(F.col(value) / width))
    bins = above.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bin", "above"))).alias("bins"), F.max("all").alias("all"))
    j = v.join(bins, by, "left")
    over = F.get(F.filter("bins", lambda x: x["bin"] >= F.col("__bin")), F.lit(0))["above"]
    return j.withColumn("p", (1 + F.coalesce(over, F.lit(0))) / (1 + F.coalesce("all", F.lit(0)))).drop("__bin", "bins", "all")


def naive_bh(tests: DataFrame, p: str, tie: str, out: str = "q") -> DataFrame:
    """p times the whole part of n / rank, without a running minimum, as some older tools report."""
    t = settled(tests.where(F.col(p).isNotNull()))
    n = t.count()
    return running_sums(t, p, [p, tie], {"__rank": F.lit(1)}).withColumn(out, F.col(p) * F.floor(F.lit(n) / F.col("__rank"))).drop("__rank")


def rank_with_second(values: DataFrame, by: list[str], first: str, second: str, out: str = "rank") -> DataFrame:
    """1-based ranks in each group by first, ties by second; equal pairs share their mean rank."""
    w = Window.partitionBy(*by)
    low = F.rank().over(w.orderBy(first, second))
    return values.withColumn(out, low + (F.count("*").over(Window.partitionBy(*by, first, second)) - 1) / 2)


def anderson_darling(values: DataFrame, by: list[str], value: str, cdf) -> DataFrame:
    """(keys, n, a2) of the values of each key, scaled to mean 0 and deviation 1, against the normal."""
    v = values.where(F.col(value).isNotNull())
    m = v.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"), F.count("*").alias("__n")).where("__n >= 3 and __s > 0")
    w = Window.partitionBy(*by)
    u = cdf((F.col(value) - F.col("__m")) / F.col("__s"))
    x = v.join(m, by).withColumn("__u", F.least(F.greatest(u, F.lit(1e-12)), F.lit(1 - 1e-12)))
    up, down = F.row_number().over(w.orderBy("__u", value)), F.row_number().over(w.orderBy(F.desc("__u"), value))
    x = x.select(*by, F.col("__n").alias("n"), ((2 * up - 1) * F.log("__u") + (2 * down - 1) * F.log(1 - F.col("__u"))).alias("__x"))
    return x.groupBy(*by, "n").agg((-F.col("n") - F.sum("__x") / F.col("n")).alias("a2"))


def largest_p_at(fdr: DataFrame, p: str, level: float) -> DataFrame:
    """(p, fdr) of the largest p up to which every false discovery rate is within the level: p in rising
    order until one exceeds it. One row, or none."""
    over = fdr.where(F.col("fdr") > level).agg(F.min(p).alias("__first")).select("__first")
    inside = fdr.join(F.broadcast(over), (F.col(p) < F.col("__first")) | F.col("__first").isNull())  # one row on the right
    return inside.agg(F.max(F.struct(p, "fdr")).alias("x")).where("x is not null").select("x.*")


def logistic(cells: DataFrame, by: list[str], x: str, cases: str, controls: str, rounds: int = 25) -> DataFrame:
    """(keys, beta, se, intercept) of a logistic regression of being a case on x, from one row a key and value of
    x with its numbers of cases and controls; null where it does not settle or x does not vary.

    A key's values of x are few, so they are gathered; Newton steps run on a batch of keys at a time."""
    one = cells.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(cases).cast("double").alias("y"), F.col(controls).cast("double").alias("n")))).alias("c"))

    @F.pandas_udf("struct<beta:double,se:double,intercept:double>")
    def fit(col: pd.Series) -> pd.DataFrame:
        width = max((len(c) for c in col), default=0)
        t = np.zeros((len(col), max(width, 1), 3))
        for i, c in enumerate(col):
            t[i, : len(c)] = [(r["x"], r["y"], r["n"]) for r in c]
        x_, y, n = t[:, :, 0], t[:, :, 1], t[:, :, 1] + t[:, :, 2]
        b = np.zeros((len(col), 2))
        h = np.zeros((len(col), 2, 2))
        ok = np.ones(len(col), bool)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(b[:, :1] + b[:, 1:] * x_, -30, 30)))
            w = n * p * (1 - p)
            g = np.stack([(y - n * p).sum(axis=1), ((y - n * p) * x_).sum(axis=1)], axis=1)
            h = np.stack([np.stack([w.sum(axis=1), (w * x_).sum(axis=1)], axis=1), np.stack([(w * x_).sum(axis=1), (w * x_ * x_).sum(axis=1)], axis=1)], axis=1)
            det = h[:, 0, 0] * h[:, 1, 1] - h[:, 0, 1] ** 2
            ok = det > 1e-9
            safe = np.where(ok, det, 1)
            step = np.stack([(h[:, 1, 1] * g[:, 0] - h[:, 0, 1] * g[:, 1]) / safe, (h[:, 0, 0] * g[:, 1] - h[:, 0, 1] * g[:, 0]) / safe], axis=1)
            b = np.where(ok[:, None], b + step, b)
        det = h[:, 0, 0] * h[:, 1, 1] - h[:, 0, 1] ** 2
        good = ok & (np.abs(b) < 20).all(axis=1) & (det > 1e-9)
        se = np.sqrt(np.where(good, h[:, 0, 0] / np.where(good, det, 1), 0))
        none = lambda v: pd.Series(np.where(good, v, np.nan)).astype(object).where(good, None)
        return pd.DataFrame({"beta": none(b[:, 1]), "se": none(se), "intercept": none(b[:, 0])})

    return one.select(*by, fit("c").alias("f")).select(*by, "f.*")


def beta_binomial(reads: DataFrame, by: list[str], ref: str, alt: str, grid: tuple[float, ...] = (0.001, 0.003, 0.01, 0.03, 0.1, 0.2, 0.3, 0.5)) -> DataFrame:
    """(keys, n, p, rho, log_likelihood, chi2): over-dispersion rho, of a grid, with the largest beta-binomial
    likelihood of the allele counts of a key around their joint share p, and twice its gain over p one half.

    Likelihoods are summed by key and grid point, partly before the shuffle."""
    v = reads.where((F.col(ref) + F.col(alt) > 0))
    share = v.groupBy(*by).agg((F.sum(ref) / (F.sum(ref) + F.sum(alt))).alias("p"), F.count("*").alias("n")).where("p > 0 and p < 1")

    @F.pandas_udf("array<double>")
    def terms(k: pd.Series, m: pd.Series, p: pd.Series) -> pd.Series:
        k, m, p = (s.to_numpy(float)[:, None] for s in (k, m, p))
        scale = 1 / np.array(grid)[None, :] - 1
        a, b = p * scale, (1 - p) * scale
        lg = log_gamma
        out = lg(k + m + 1) - lg(k + 1) - lg(m + 1) + lg(k + a) + lg(m + b) - lg(k + m + a + b) + lg(a + b) - lg(a) - lg(b)
        return pd.Series(list(out))

    x = v.join(share, by).select(*by, "n", "p", F.posexplode(terms(ref, alt, "p")).alias("i", "l"), F.col(ref).alias("__k"), F.col(alt).alias("__m"))
    half = v.join(share.select(*by), by).select(*by, F.posexplode(terms(ref, alt, F.lit(0.5))).alias("i", "l")).groupBy(*by, "i").agg(F.sum("l").alias("l0"))
    sums = x.groupBy(*by, "n", "p", "i").agg(F.sum("l").alias("l"))
    best = sums.groupBy(*by, "n", "p").agg(F.max(F.struct("l", (-F.col("i")).alias("i"))).alias("x"))
    none = half.groupBy(*by).agg(F.max("l0").alias("l0"))
    rho: Column = F.element_at(F.array(*map(F.lit, grid)), (1 - F.col("x.i")).cast("int"))
    return best.join(none, by).select(*by, "n", "p", rho.alias("rho"), F.col("x.l").alias("log_likelihood"), F.greatest(F.lit(0.0), 2 * (F.col("x.l") - F.col("l0"))).alias("chi2"))


def covariate_screen(values: DataFrame, by: list[str], x: str, covariates: list[str], y: str) -> DataFrame:
    """(keys, covariate, n, b0..b3, t3): the interaction regression of y on x with each covariate in turn, in one pass:
    rows are dealt by key, and repeated once a covariate where they are summed."""
    entries = F.array(*(F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("__c")) for c in covariates))
    long = dealt(values.select(*by, x, y, *covariates), by).select(*by, x, y, F.explode(entries).alias("__e")).select(*by, x, y, "__e.*")
    return interaction_regression(long, [*by, "covariate"], x, "__c", y, placed=True)


def matched_background(items: DataFrame, item: str, hit: str, bin_: str, per: int, seed: int = 1) -> DataFrame:
    """Hits, and for each bin per times as many others of the same bin, or all there are, by the order of a digest of the
    seed and the item: a background like the hits in what the bin stands for."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(item)).cast("binary"))
    w = Window.partitionBy(bin_, hit).orderBy(order, item)
    hits = items.where(F.col(hit)).groupBy(bin_).agg(F.count("*").alias("__hits"))
    placed = items.withColumn("__place", F.row_number().over(w)).join(hits, bin_)
    return placed.where(F.col(hit) | (F.col("__place") <= per * F.col("__hits"))).select(*items.columns)
