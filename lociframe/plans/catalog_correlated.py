"""Registered queries of correlated items, mixtures and permutations; see catalog.py.

Blocks of ten items have correlations that halve with each step between items, whose inverse is known, so that
SQL can say what generalised least squares gives."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import correlated, intervals, ld, models, testing
from . import workflows as flow
from .catalog import CALLS_SQL, MEMBERS_SQL, _calls, _sets, _traits, query, r, rounded


def _blocks(v):
    """(block, item, x, y, loadings): variants in blocks of ten."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("block")
    x = v.variants.selectExpr("cast(floor(variant / 10) as bigint) as block", "variant as item", "score / 1000 as x", "variant * 7919 % 101 / 10 as y")
    x = x.withColumn("i", F.row_number().over(w.orderBy("item"))).withColumn("k", F.count("*").over(w))
    return x.withColumn("loadings", F.transform(F.sequence(F.lit(1), F.col("k").cast("int")), lambda j: F.pow(F.lit(0.5), F.abs(j - F.col("i"))))).drop("i", "k")


_WHITE = ", b as (select variant // 10 as block, variant as item, score / 1000e0 as x, variant * 7919 % 101 / 10e0 as y from variants), s as (select *, lag(item) over w is null as first, lag(x) over w as xb, lag(y) over w as yb from b window w as (partition by block order by item)), t as (select item, case when first then 1e0 else 0.5 / sqrt(0.75) end as o, case when first then x else (x - 0.5 * xb) / sqrt(0.75) end as x, case when first then y else (y - 0.5 * yb) / sqrt(0.75) end as y from s)"


@query("gls_regression", ("variants",), _WHITE + ", q as (select count(*) as n, sum(o * o) as oo, sum(o * x) as ox, sum(o * y) as oy, sum(x * x) as xx, sum(x * y) as xy, sum(y * y) as yy from t), c as (select *, (oo * xy - ox * oy) / (oo * xx - ox * ox) as beta, (xx * oy - ox * xy) / (oo * xx - ox * ox) as alpha from q) select n, round(beta, 6) as beta, round(alpha, 6) as alpha, round(sqrt((yy - beta * xy - alpha * oy) / (n - 2) * oo / (oo * xx - ox * ox)), 6) as se from c")
def gls_regression(v):
    return rounded(models.generalised_least_squares(_blocks(v), "block", "item", "x", "y", "loadings").withColumn("n", F.col("n").cast("long")).select("n", "beta", "alpha", "se"))


@query("inverse_correlations", ("variants",), ", b as (select variant // 10 as block, variant as item, row_number() over w as i, count(*) over (partition by variant // 10) as k from variants window w as (partition by variant // 10 order by variant)) select x.block, x.item as a, y.item as b, round(case when x.k = 1 then 1 when x.i = y.i then case when x.i in (1, x.k) then 1 else 1.25 end / 0.75 when abs(x.i - y.i) = 1 then -0.5 / 0.75 else 0e0 end, 6) as value from b x join b y on x.block = y.block")
def inverse_correlations(v):
    m = correlated.inverse_blocks(_blocks(v), "block", "item", "loadings")
    return m.select("block", "a", "b", (F.round("value", 6) + 0.0).alias("value"))


@query("set_regression", ("variants",), _WHITE.replace("x as x", "x") + f", {MEMBERS_SQL}, g as (select distinct grp from members), e as (select g.grp, t0.block, t0.item, t0.first, t0.y as ry, (m.item is not null)::int * 1e0 as x from g cross join s t0 left join members m on m.item = t0.item and m.grp = g.grp), f as (select grp, item, first, ry, x, lag(x) over (partition by grp, block order by item) as xb, lag(ry) over (partition by grp, block order by item) as yb from e), h as (select grp, x as raw, case when first then 1e0 else 0.5 / sqrt(0.75) end as o, case when first then x else (x - 0.5 * xb) / sqrt(0.75) end as x, case when first then ry else (ry - 0.5 * yb) / sqrt(0.75) end as y from f), q as (select grp, count(*) as total, cast(sum(raw) as bigint) as n, sum(o * o) as oo, sum(o * x) as ox, sum(o * y) as oy, sum(x * x) as xx, sum(x * y) as xy, sum(y * y) as yy from h group by grp having sum(raw) >= 2), c as (select *, (oo * xy - ox * oy) / (oo * xx - ox * ox) as beta, (xx * oy - ox * xy) / (oo * xx - ox * ox) as alpha from q) select grp, n, round(beta, 5) as beta, round(beta / sqrt((yy - beta * xy - alpha * oy) / (total - 2) * oo / (oo * xx - ox * ox)), 5) as t from c")
def set_regression(v):
    members, _ = _sets(v)
    s = correlated.set_regression(_blocks(v), members, "block", "item", "grp", "y", "loadings")
    return s.select("grp", "n", r("beta", 5), r("t", 5))


@query("weighted_chi2_tails", ("effects", "variants", "genes"), """, b as (select snp as variant, max(z) as z from effects group by snp), j as (select g.gene, v.score / 1000e0 as w, b.z from b join variants v on b.variant = v.variant join genes g on v.chrom = g.chrom and v.pos between g.start - 2000 and g.stop + 2000),
 k as (select gene, count(*) as n, sum(z * z) as q from j group by gene having count(*) >= 4), g as (select unnest(range(0, 12001)) as i), u as (select i, i * 0.005 as u, case when i in (0, 12000) then 1 when i % 2 = 1 then 4 else 2 end * 0.005 / 3 as h from g),
 t as (select k.gene, k.n, k.q, u.u, u.h, sum(atan(w * u.u)) / 2 - k.q * u.u / 2 as theta, exp(sum(ln(1 + w * w * u.u * u.u)) / 4) as rho, sum(w) as sw from k join j on k.gene = j.gene, u group by 1, 2, 3, 4, 5)
 select gene, n, round(q, 5) as q, round(least(1, greatest(0, 0.5 + sum(h * case when u = 0 then (sw - q) / 2 else sin(theta) / (u * rho) end) / pi())), 3) as p from t group by gene, n, q""")
def weighted_chi2_tails(v):
    best = v.effects.groupBy(F.col("snp").alias("variant")).agg(F.max("z").alias("z"))
    g = v.genes.selectExpr("gene", "chrom", "start - 2000 as lo", "stop + 2000 as hi")
    j = intervals.point_join(v.variants.join(best, "variant"), g, ["chrom"], "pos", "lo", "hi", 5000).withColumn("w", F.col("score") / 1000)
    return correlated.weighted_chi2_p(j, ["gene"], F.sum(F.col("z") ** 2), "w").where("n >= 4").select("gene", "n", r("q", 5), r("p", 3))


@query("ld_greedy_clumps", ("genotypes", "variants", "effects"), f", {CALLS_SQL}, r as (select a, b, pow(case when min(x) < max(x) and min(y) < max(y) then corr(x, y) end, 2) as r2 from j group by a, b), e as (select a, b from r where r2 >= 0.20001 union all select b, a from r where r2 >= 0.20001), nb as (select a as variant, list(b) as nb from e group by a), best as (select snp as variant, min(p) as p from effects group by snp), h as (select v.variant, v.chrom, p, coalesce(nb, []) as nb from variants v join best b on v.variant = b.variant left join nb on v.variant = nb.variant), f as (select chrom, list_reduce(list([{{'k': variant, 'nb': nb}}] order by p, variant), lambda a, x: case when list_has_any(list_transform(a, lambda y: y.k), x[1].nb) then a else list_concat(a, x) end) as f from h group by chrom) select h.variant, coalesce(list_filter(f.f, lambda y: y.k = h.variant)[1].k, list_filter(f.f, lambda y: list_contains(h.nb, y.k))[1].k) as locus from h join f on h.chrom = f.chrom")
def ld_greedy_clumps(v):
    links = ld.proxies(v.variants, _calls(v), "variant", "chrom", "pos", "sample", "dosage", 3000, 0.20001)
    best = testing.strongest(v.effects, ["snp"], ["p", "id"]).select(F.col("snp").alias("variant"), "p")
    hits = v.variants.select("variant").join(best, "variant")
    inside = hits.select("variant")
    links = links.join(inside.toDF("a"), "a", "left_semi").join(inside.toDF("b"), "b", "left_semi")
    return ld.greedy_clumps(hits, links, "variant", "p").select("variant", "locus")


@query("sample_permutations", ("genotypes",), ", s as (select distinct sample from genotypes), p as (select sample, unnest([1, 2, 3]) as perm from s), o as (select perm, sample, row_number() over (partition by perm order by sample) as k from p), m as (select perm, sample, row_number() over (partition by perm order by md5('7:' || perm || ':' || sample), sample) as k from p) select o.perm, o.sample, m.sample as shuffled from o join m on o.perm = m.perm and o.k = m.k union all select 0, sample, sample from s")
def sample_permutations(v):
    return flow.shuffled_samples(v.genotypes.select("sample"), "sample", 3, 7).select("perm", "sample", "shuffled")


def _gene_links(v):
    """(gene, variant, z) of the variants around each gene, and (gene, a, b, r) of their pairs in linkage."""
    best = v.effects.groupBy(F.col("snp").alias("variant")).agg(F.max("z").alias("z"))
    g = v.genes.selectExpr("gene", "chrom", "start - 2000 as lo", "stop + 2000 as hi")
    j = intervals.point_join(v.variants.join(best, "variant"), g, ["chrom"], "pos", "lo", "hi", 5000).select("gene", "variant", "z")
    near = ld.genotype_r2(ld.pair_counts(_calls(v), ld.nearby_pairs(v.variants, "variant", "chrom", "pos", 3000), "variant", "sample", "dosage")).where("r2 is not null and n >= 8")
    return j, near.join(j.select("gene", F.col("variant").alias("a")), "a").join(j.select("gene", F.col("variant").alias("b")), ["gene", "b"]).select("gene", "a", "b", F.sqrt("r2").alias("r"))


@query("gene_scores_ld", ("effects", "genotypes", "variants", "genes"))
def gene_scores_ld(v):
    """Summed squared z of the variants around each gene against what their LD makes of it."""
    return rounded(correlated.gene_p(*_gene_links(v), "gene", "variant"), 5)


@query("gene_scores_by_draws", ("effects", "genotypes", "variants", "genes"))
def gene_scores_by_draws(v):
    return correlated.gene_p_by_draws(*_gene_links(v), "gene", "variant")


@query("meta_items", ("variants",), ", b as (select variant // 10 as block, variant as item from variants), k as (select *, row_number() over (partition by block order by item) as i from b) select block, item, min(item) over (partition by block) as meta, cast(count(*) over (partition by block) as int) as size from k")
def meta_items(v):
    """Neighbours correlate by one half, so a block is one chain of links and one item."""
    return correlated.meta_items(_blocks(v), "block", "item", "loadings", 0.5).select("block", "item", "meta", "size")


@query("set_regression_merged", ("variants",))
def set_regression_merged(v):
    """Items 0 and 1, 2 and 3, ... of a block are nearly one: they count once in a set."""
    members, _ = _sets(v)
    pair = lambda j: F.floor((j - 1) / 2)
    from pyspark.sql.window import Window

    w = Window.partitionBy("block")
    b = _blocks(v).withColumn("i", F.row_number().over(w.orderBy("item"))).withColumn("k", F.count("*").over(w))
    b = b.withColumn("loadings", F.transform(F.sequence(F.lit(1), F.col("k").cast("int")), lambda j: F.when(j == F.col("i"), 1.0).when(pair(j) == pair(F.col("i")), 0.97).otherwise(F.pow(F.lit(0.5), 1 + F.abs(pair(j) - pair(F.col("i")))))))
    return correlated.set_regression(b, members, "block", "item", "grp", "y", "loadings", merge=0.9)


@query("harmonise_with_ld", ("genotypes", "variants"))
def harmonise_with_ld(v):
    """A second panel of the largest calls, whose alleles stand the other way round for every third variant."""
    study = v.variants.selectExpr("variant", "chrom", "pos", "ref", "alt", "0.05 + variant % 9 * 0.05 as maf").where("ref != alt")
    turn = "variant % 3 = 0"
    ref = study.selectExpr("concat('r', variant) as ref_id", "chrom", "pos", f"if({turn}, alt, ref) as ref", f"if({turn}, ref, alt) as alt", "maf")
    there = v.genotypes.where("dosage is not null").groupBy("variant", "sample").agg(F.max("dosage").alias("d")).selectExpr("concat('r', variant) as ref_id", "sample", f"if({turn}, 2 - d, d) as dosage")
    return flow.harmonise_by_ld(study, ref, _calls(v), there, 3000, 0.01)


@query("component_search", ("genotypes", "variants", "genes"))
def component_search(v):
    cells = _traits(v).groupBy("gene", "sample").agg(F.avg("value").alias("value"))
    samples = [x["sample"] for x in cells.select("sample").distinct().orderBy("sample").collect()]  # a study's samples
    places = F.broadcast(v.spark.createDataFrame([(s, i) for i, s in enumerate(samples)], "sample long, i int"))
    row = cells.join(places, "sample").groupBy("gene").agg(F.collect_list(F.struct("i", "value")).alias("m"), F.avg("value").alias("mean"))

    @F.pandas_udf("array<double>")
    def filled(i: pd.Series, value: pd.Series, mean: pd.Series) -> pd.Series:
        """Values in order of samples; samples without one have the gene's mean."""
        out = []
        for at, own, m in zip(i, value, mean):
            at, own = np.asarray(at, int), np.asarray(own, float)
            x = np.full(len(samples), m)
            x[at[~np.isnan(own)]] = own[~np.isnan(own)]
            out.append(None if np.isnan(m) else x)
        return pd.Series(out)

    values = row.select("gene", filled("m.i", "m.value", "mean").alias("values"))
    pairs = intervals.band_join(v.variants, v.genes, ["chrom"], "pos", "mid", 20000)
    return flow.component_search(values, samples, pairs, _calls(v), 0.05, step=2, most=6)
