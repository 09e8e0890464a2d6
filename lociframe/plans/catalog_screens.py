"""Registered queries of interaction results, merges, checks and further statistics; see catalog.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..functions.stats import normal_p_sql
from ..operators import aggregates as agg
from ..operators import filters, intervals, ld, meta, screens, testing
from .catalog import CALLS_SQL, SQL, _calls, query, r, rounded

# --- joint results ---------------------------------------------------------------------------


@query("interaction_meta", ("effects",), "select snp, gene, count(*) as datasets, round(sum(n * z) / sqrt(sum(n * n)), 5) as z from effects group by snp, gene")
def interaction_meta(v):
    return meta.weighted_z(v.effects, ["snp", "gene"], "z", "n", weight="n").select("snp", "gene", "datasets", r("z", 5))


@query("trans_correlation_meta", ("effects", "variants"), ", f as (select e.snp, e.gene, e.n, case when v.ref = 'A' then e.z when v.alt = 'A' then -e.z end as z from effects e join variants v on e.snp = v.variant) select snp, gene, count(*) as datasets, round(sum(n * z) / sqrt(sum(n * n)), 5) as z from f where z is not null group by snp, gene")
def trans_correlation_meta(v):
    flip = F.when(F.col("ref") == "A", 1).when(F.col("alt") == "A", -1)
    e = v.effects.join(v.variants.selectExpr("variant as snp", "ref", "alt"), "snp").withColumn("flip", flip)
    return meta.weighted_z(e, ["snp", "gene"], "z", "n", weight="n", flip="flip").select("snp", "gene", "datasets", r("z", 5))


@query("text_meta", ("effects",), ", u as (select snp, gene, z, n from effects where dataset = '1-URGENT' union all select snp, gene, z, n from effects where dataset = '5-LOW') select snp, gene, count(*) as datasets, cast(sum(n) as bigint) as n, round(sum(sqrt(n) * z) / sqrt(sum(n)), 5) as z from u group by snp, gene")
def text_meta(v):
    cohorts = [v.effects.where(F.col("dataset") == d).select("snp", "gene", "z", "n") for d in ("1-URGENT", "5-LOW")]
    return meta.weighted_z(cohorts[0].unionByName(cohorts[1]), ["snp", "gene"], "z", "n").select("snp", "gene", "datasets", "n", r("z", 5))


@query("covariate_chi2", ("effects",), "select gene as covariate, count(z) as n, round(sum(z * z), 4) as chi2 from effects group by gene")
def covariate_chi2(v):
    return rounded(screens.covariate_chi2(v.effects.withColumnRenamed("gene", "covariate"), "covariate", "z"), 4)


@query("interaction_slice", ("effects",), "select id, snp, gene, perm, round(z, 6) as z from effects where gene = 3 and perm in (1, 2)")
def interaction_slice(v):
    return screens.cube_slice(v.effects, gene=3, perm=[1, 2], snp=None).select("id", "snp", "gene", "perm", r("z"))


@query("covariate_direction", ("genotypes",), """, t as (select variant, dosage as x, expression as y, ntile(3) over (partition by variant order by quantity, dosage, expression) as part from genotypes where dosage is not null),
 s0 as (select variant, regr_slope(y, x) filter (where part = 1) as low, regr_slope(y, x) filter (where part = 3) as high from t group by variant), s as (select variant, case when not isnan(low) then low end as low, case when not isnan(high) then high end as high from s0)
 select variant, round(low, 4) as low, round(high, 4) as high, case when low is null or high is null then null when sign(low) <> sign(high) then 'flip' when abs(high) >= abs(low) then 'up' else 'down' end as direction from s""")
def covariate_direction(v):
    return rounded(screens.covariate_extremes(v.genotypes, ["variant"], "dosage", "quantity", "expression"), 4)


@query("results_summary", ("effects",), "select dataset, count(*) as n, count(distinct snp) as variants, count(distinct gene) as genes, count(*) filter (where p <= 0.05) as n_1, count(*) filter (where p <= 0.01) as n_2, count(*) filter (where p <= 0.001) as n_3 from effects group by dataset")
def results_summary(v):
    return screens.summary_of_results(v.effects, ["dataset"], "snp", "gene", "p", (0.05, 0.01, 0.001))


@query("joint_against_meta", ("genotypes",), """, c as (select variant, dataset, count(dosage) as n, case when min(dosage) < max(dosage) then corr(dosage, expression) end as r from genotypes where dosage is not null group by 1, 2),
 z as (select variant, n, sign(r) * (8 * (n - 2) + 1e0) / (8 * (n - 2) + 3) * sqrt((n - 2) * ln(1 + r * r * (n - 2) / (1 - r * r) / (n - 2))) as z from c where n >= 4 and abs(r) < 0.9999),
 m as (select variant, sum(sqrt(n) * z) / sqrt(sum(n)) as z from z group by variant), d as (select variant, count(dosage) as n, case when min(dosage) < max(dosage) then corr(dosage, expression) end as r from genotypes where dosage is not null group by 1),
 j as (select variant, sign(r) * (8 * (n - 2) + 1e0) / (8 * (n - 2) + 3) * sqrt((n - 2) * ln(1 + r * r * (n - 2) / (1 - r * r) / (n - 2))) as z from d where n >= 4 and abs(r) < 0.9999) select j.variant, round(j.z, 4) as joint_z, round(m.z, 4) as meta_z from j join m on j.variant = m.variant""")
def joint_against_meta(v):
    z = lambda by: agg.correlate(v.genotypes, by, "dosage", "expression").where("n >= 4 and abs(r) < 0.9999").withColumn("z", stats.correlation_z(F.col("r"), F.col("n").cast("double")))
    m = meta.weighted_z(z(["variant", "dataset"]), ["variant"], "z", "n")
    return rounded(screens.joint_against_meta(z(["variant"]), m, ["variant"], "z").drop("gap"), 4)


@query("allelic_meta_counts", ("reads",), ", s as (select variant, sample, sum(ref_reads) as a, sum(alt_reads) as b from reads group by 1, 2) select variant, count(*) as n, cast(sum(a) as bigint) as a, cast(sum(b) as bigint) as b from s where a + b >= 20 and least(a, b) >= 3 and least(a, b) >= 0.1 * (a + b) group by variant")
def allelic_meta_counts(v):
    s = v.reads.groupBy("variant", "sample").agg(F.sum("ref_reads").alias("a"), F.sum("alt_reads").alias("b"))
    return screens.filter_reads(s, "a", "b", 20, 3, 0.1).groupBy("variant").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))


@query("annotated_read_counts", ("reads", "variants", "genes"), ", s as (select variant, sum(ref_reads) as a, sum(alt_reads) as b from reads group by variant having sum(ref_reads) + sum(alt_reads) > 0), j as (select v.variant, g.gene, s.a * 1e0 / (s.a + s.b) as share from s join variants v on s.variant = v.variant left join genes g on v.chrom = g.chrom and v.pos between g.start and g.stop) select variant, gene, round(share, 6) as share from j")
def annotated_read_counts(v):
    s = v.reads.groupBy("variant").agg(F.sum("ref_reads").alias("a"), F.sum("alt_reads").alias("b")).where("a + b > 0")
    j = intervals.point_join(v.variants.join(s, "variant"), v.genes.select("gene", "chrom", "start", "stop"), ["chrom"], "pos", "start", "stop", 2000, "left")
    return j.select("variant", "gene", F.round(F.col("a") / (F.col("a") + F.col("b")), 6).alias("share"))


# --- genotype merges and imputation checks ---------------------------------------------------

_PANEL_SQL = ", one as (select variant, chrom, pos - pos % 130 as pos, ref, alt from variants where ref <> alt), two as (select peak as variant, chrom, start as pos, substr('ACGT', cast(peak % 4 as int) + 1, 1) as ref, substr('CGTA', cast(peak % 4 as int) + 1, 1) as alt from peaks)"


def _panels(v):
    one = v.variants.where("ref != alt").selectExpr("variant", "chrom", "pos - pos % 130 as pos", "ref", "alt")
    return one, v.peaks.selectExpr("peak as variant", "chrom", "start as pos", "substr('ACGT', cast(peak % 4 as int) + 1, 1) as ref", "substr('CGTA', cast(peak % 4 as int) + 1, 1) as alt")


@query("merge_panels", ("variants", "peaks"), _PANEL_SQL + """, j as (select one.*, two.variant as other, two.ref as r2, two.alt as a2, translate(two.ref, 'ACGT', 'TGCA') as rt, translate(two.alt, 'ACGT', 'TGCA') as tt, one.ref || one.alt not in ('AT', 'TA', 'CG', 'GC') as safe from one join two on one.chrom = two.chrom and one.pos = two.pos),
 w as (select *, case when ref = r2 and alt = a2 then 1 when safe and ref = a2 and alt = r2 then 2 when safe and ref = rt and alt = tt then 3 when safe and ref = tt and alt = rt then 4 end as way from j), k as (select *, row_number() over (partition by variant order by way, other) as k from w where way is not null)
 select variant, other, ['same', 'swap', 'strand', 'strand swap'][way] as recode from k where k = 1""")
def merge_panels(v):
    return screens.merge_panels(*_panels(v)).select("variant", "other", "recode")


@query("imputation_presence", ("variants", "peaks"), _PANEL_SQL + " select one.chrom, count(*) as expected, count(t.pos) as present from one left join (select distinct pos from two) t on one.pos = t.pos group by one.chrom")
def imputation_presence(v):
    one, two = _panels(v)
    return screens.presence(one, two, "pos", ["chrom"])


@query("imputation_agreement", ("genotypes",), """, a as (select variant, sample, min(dosage) as x from genotypes where dosage is not null and line <= 3 group by 1, 2), b as (select variant, sample, max(dosage) as y from genotypes where dosage is not null group by 1, 2)
 select a.variant, count(*) as n, round(case when min(x) < max(x) and min(y) < max(y) then pow(1e0 * count(*) * sum(x * y) - 1e0 * sum(x) * sum(y), 2) / ((1e0 * count(*) * sum(x * x) - 1e0 * sum(x) * sum(x)) * (1e0 * count(*) * sum(y * y) - 1e0 * sum(y) * sum(y))) end, 6) as r2, round(avg(case when x = y then 1e0 else 0 end), 6) as same from a join b on a.variant = b.variant and a.sample = b.sample group by a.variant""")
def imputation_agreement(v):
    g = v.genotypes.where("dosage is not null")
    a, b = g.where("line <= 3").groupBy("variant", "sample").agg(F.min("dosage").alias("d")), g.groupBy("variant", "sample").agg(F.max("dosage").alias("d"))
    return screens.dosage_agreement(a, b, "variant", "sample", "d").select("variant", "n", r("r2"), r("same"))


@query("dosage_matrix", ("genotypes",), ", c as (select variant, sample, min(dosage) as dosage from genotypes where dosage is not null group by 1, 2) select variant, list(sample order by sample) as samples, list(dosage order by sample) as dosages from c group by variant")
def dosage_matrix(v):
    return screens.dosage_matrix(_calls(v), "variant", "sample", "dosage")


@query("renamed_rows", ("genes", "effects"), "select e.id, 'g_' || coalesce(g.symbol, cast(e.gene as varchar)) as gene from effects e left join genes g on e.gene = g.gene and g.chrom < 3")
def renamed_rows(v):
    return screens.rename(v.effects.select("id", F.col("gene")), v.genes.where("chrom < 3").selectExpr("gene as old", "symbol as new"), "gene", "old", "new", "g_").select("id", "gene")


# --- linkage and artefacts -------------------------------------------------------------------


@query("z_ld", ("effects", "variants"), ", near as (select a.variant as a, b.variant as b from variants a join variants b on a.chrom = b.chrom and a.variant < b.variant and abs(a.pos - b.pos) < 3000), m as (select snp, gene, avg(z) as z from effects group by 1, 2), c as (select a, b, count(*) as n, case when min(x.z) < max(x.z) and min(y.z) < max(y.z) then corr(x.z, y.z) end as r from near join m x on x.snp = near.a join m y on y.snp = near.b and x.gene = y.gene group by a, b) select a, b, n, round(r, 4) as r from c where n >= 3 and r is not null")
def z_ld(v):
    m = v.effects.groupBy("snp", "gene").agg(F.avg("z").alias("z"))
    return rounded(screens.z_ld(ld.nearby_pairs(v.variants, "variant", "chrom", "pos", 3000), m, "snp", "gene", "z"), 4)


_ARTEFACT_SQL = f", {CALLS_SQL}, r as (select a, b, pow(case when min(x) < max(x) and min(y) < max(y) then corr(x, y) end, 2) as r2 from j group by a, b), l as (select a, b from r where r2 >= 0.30001 union select b, a from r where r2 >= 0.30001), h as (select distinct e.snp as variant, e.gene from effects e where e.p < 0.1), u as (select v.variant, g.gene from variants v join genes g on v.chrom = g.chrom and v.pos between g.start and g.stop), n as (select l.a as variant, u.gene from l join u on l.b = u.variant union select variant, gene from u)"


def _artefacts(v, linked):
    links = ld.proxies(v.variants, _calls(v), "variant", "chrom", "pos", "sample", "dosage", 3000, 0.30001)
    hits = v.effects.where("p < 0.1").selectExpr("snp as variant", "gene").distinct()
    under = intervals.point_join(v.variants, v.genes.select("gene", "chrom", "start", "stop"), ["chrom"], "pos", "start", "stop", 2000).select("variant", "gene")
    return screens.linked_artefacts(hits, under, links, "variant", "gene", linked)


@query("probe_artefacts", ("genotypes", "variants", "genes", "effects"), _ARTEFACT_SQL + " select variant, gene from h where exists (select 1 from n where n.variant = h.variant and n.gene = h.gene)")
def probe_artefacts(v):
    return _artefacts(v, True)


@query("unlinked_pairs", ("genotypes", "variants", "genes", "effects"), _ARTEFACT_SQL + " select variant, gene from h where not exists (select 1 from n where n.variant = h.variant and n.gene = h.gene)")
def unlinked_pairs(v):
    return _artefacts(v, False)


@query("region_enrichment_with_proxies", ("genotypes", "variants", "peaks", "effects"), f", {CALLS_SQL}, r as (select a, b, pow(case when min(x) < max(x) and min(y) < max(y) then corr(x, y) end, 2) as r2 from j group by a, b), l as (select a, b from r where r2 >= 0.30001 union select b, a from r where r2 >= 0.30001 union select variant, variant from variants), i as (select distinct v.variant from variants v join peaks p on v.chrom = p.chrom and v.pos between p.start and p.stop), t as (select distinct l.a as variant from l join i on l.b = i.variant) select e.perm, count(*) as n, count(t.variant) as inside from effects e join variants v on e.snp = v.variant left join t on e.snp = t.variant group by e.perm")
def region_enrichment_with_proxies(v):
    p = ld.proxies(v.variants, _calls(v), "variant", "chrom", "pos", "sample", "dosage", 3000, 0.30001)
    links = p.select("a", "b").union(p.select("b", "a")).union(v.variants.select("variant", "variant")).toDF("a", "b")
    inside = intervals.point_join(v.variants, v.peaks.select("chrom", "start", "stop"), ["chrom"], "pos", "start", "stop", 500, "left_semi").select(F.col("variant").alias("b"))
    touched = links.join(inside, "b", "left_semi").select(F.col("a").alias("snp")).distinct().withColumn("hit", F.lit(1))
    e = v.effects.join(v.variants.selectExpr("variant as snp"), "snp", "left_semi").join(touched, "snp", "left")
    return e.groupBy("perm").agg(F.count("*").alias("n"), F.count("hit").alias("inside"))


# --- ranks, tests and tails ------------------------------------------------------------------


@query("naive_bh", ("effects",), ", x as (select id, p, row_number() over (order by p, id) as k, count(*) over () as n from effects) select id, round(p * (n // k), 6) as q from x")
def naive_bh(v):
    return screens.naive_bh(v.effects, "p", "id").select("id", r("q"))


@query("rank_with_second", ("effects",), "select id, rank() over (partition by gene order by n, perm) + (count(*) over (partition by gene, n, perm) - 1) / 2e0 as rank from effects")
def rank_with_second(v):
    return screens.rank_with_second(v.effects, ["gene"], "n", "perm").select("id", "rank")


@query("storey_q", ("effects",), ", x as (select id, p, p * count(*) over () / row_number() over (order by p, id) as s from effects), q as (select id, least(1, min(s) over (order by p, id rows between current row and unbounded following)) as q from x) select id, round(q * (select least(1, count(*) filter (where p > 0.5) / (count(*) * 0.5)) from effects), 5) as q from q")
def storey_q(v):
    return testing.storey_q(v.effects, "p", "id").select("id", r("q", 5))


@query("fdr_threshold", ("effects",), ", c as (select p, sum(case when perm = 0 then 1 else 0 end) as nr, sum(case when perm > 0 then 1 else 0 end) as np from effects where p > 0.2 or perm = 0 group by p), x as (select p, nr, sum(nr) over (order by p) as n_real, sum(np) over (order by p) as n_permuted from c), f as (select p, least(1, n_permuted / 4e0 / n_real) as fdr from x where nr > 0), o as (select min(p) as first from f where fdr > 0.1) select round(max(p), 9) as p, round(max_by(fdr, p), 6) as fdr from f, o where p < first or first is null having max(p) is not null")
def fdr_threshold(v):
    f = testing.permutation_fdr(v.effects.where("perm = 0"), v.effects.where("perm > 0 and p > 0.2"), "p", 4)
    return screens.largest_p_at(f, "p", 0.1).select(r("p", 9), r("fdr"))


@query("anderson_darling", ("effects",), """, m as (select gene, avg(z) as m, stddev_samp(z) as s, count(*) as n from effects group by gene), u as (select e.gene, m.n, e.z, (e.z - m.m) / m.s as x from effects e join m on e.gene = m.gene where m.n >= 3 and m.s > 0),
 c as (select gene, n, z, least(greatest(case when x >= 0 then 1 - {p} / 2 else {p} / 2 end, 1e-12), 1 - 1e-12) as u from u), k as (select *, row_number() over (partition by gene order by u, z) as up, row_number() over (partition by gene order by u desc, z) as down from c)
 select gene, n, round(-n - sum((2 * up - 1) * ln(u) + (2 * down - 1) * ln(1 - u)) / n, 4) as a2 from k group by gene, n""".replace("{p}", normal_p_sql("x")))
def anderson_darling(v):
    return rounded(screens.anderson_darling(v.effects, ["gene"], "z", stats.normal_cdf), 4)


@query("null_distribution", ("effects",), "select gene, cast(floor(abs(z) / 0.25) as bigint) as bin, count(*) as n from effects where perm > 0 group by 1, 2")
def null_distribution(v):
    return screens.null_distribution(v.effects.where("perm > 0").withColumn("a", F.abs("z")), ["gene"], "a", 0.25)


@query("empirical_p", ("effects",), ", b as (select gene, floor(abs(z) / 0.25) as bin from effects where perm > 0), e as (select id, gene, floor(abs(z) / 0.25) as bin from effects where perm = 0) select id, round((1e0 + (select count(*) from b where b.gene = e.gene and b.bin >= e.bin)) / (1 + (select count(*) from b where b.gene = e.gene)), 6) as p from e")
def empirical_p(v):
    e = v.effects.withColumn("a", F.abs("z"))
    null = screens.null_distribution(e.where("perm > 0"), ["gene"], "a", 0.25)
    return screens.empirical_p(e.where("perm = 0").drop("p"), null, ["gene"], "a", 0.25).select("id", r("p"))


@query("looked_up_p", ("effects",), "with base as (select id, greatest(-37.65, least(37.65, z * 20)) as z from effects), g as (select id, floor((z + 37.65) * 5000) / 5000e0 - 37.65 as z from base) select id, round({p}, 9) as p from g".replace("with base", ", base").replace("{p}", normal_p_sql("z")))
def looked_up_p(v):
    return v.effects.select("id", F.round(stats.looked_up_p(F.col("z") * 20), 9).alias("p"))


@query("rounded_correlation_z", ("genotypes",), """, c as (select variant, count(dosage) as n, case when min(dosage) < max(dosage) then corr(dosage, expression) end as r0 from genotypes where dosage is not null group by 1), d as (select variant, n, round(r0, 6) as r1 from c where n >= 4 and abs(r0) < 0.999),
 e as (select variant, n, floor(abs(r1) * 1000 + 0.5) / 1000 * sign(r1) as r, (floor((r1 + 1) / 2 * 200) + 0.5) / 200 * 2 - 1 as b from d) select variant, round(sign(r) * (8 * (n - 2) + 1e0) / (8 * (n - 2) + 3) * sqrt((n - 2) * ln(1 + r * r / (1 - r * r))), 5) as z_rounded, round(sign(b) * (8 * (n - 2) + 1e0) / (8 * (n - 2) + 3) * sqrt((n - 2) * ln(1 + b * b / (1 - b * b))), 5) as z_binned from e""")
def rounded_correlation_z(v):
    c = agg.correlate(v.genotypes, ["variant"], "dosage", "expression").where("n >= 4 and abs(r) < 0.999").withColumn("r", F.round("r", 6))
    n = F.col("n").cast("double")
    return c.select("variant", F.round(stats.correlation_z(stats.rounded_r(F.col("r")), n), 5).alias("z_rounded"), F.round(stats.correlation_z(stats.binned_r(F.col("r"), 200), n), 5).alias("z_binned"))


@query("hic_contacts_sorted", ("effects",), "select snp % 50 as bin_a, gene as bin_b, id, row_number() over (partition by snp % 50 order by gene, id) as place from effects")
def hic_contacts_sorted(v):
    from pyspark.sql.window import Window

    e = v.effects.selectExpr("snp % 50 as bin_a", "gene as bin_b", "id")
    return e.withColumn("place", F.row_number().over(Window.partitionBy("bin_a").orderBy("bin_b", "id")).cast("long"))


# --- projections, ontologies, sets -----------------------------------------------------------


@query("project_results", ("effects",), ", l as (select gene, k as component, ((gene * k) % 7 - 3) / 3e0 as w from (select distinct gene from effects), (values (1), (2), (3)) t(k)) select e.snp, l.component, count(*) as n, round(sum(z * w), 5) as z from effects e join l on e.gene = l.gene group by e.snp, l.component")
def project_results(v):
    loadings = v.effects.select("gene").distinct().withColumn("component", F.explode(F.array(*map(F.lit, (1, 2, 3))))).withColumn("w", ((F.col("gene") * F.col("component")) % 7 - 3) / 3)
    return screens.project(v.effects, loadings, "snp", "gene", "component", "z", "w").select("snp", "component", "n", r("z", 5))


@query("kept_components", ("variants",), ", x as (select chrom, variant, coalesce(sum(score) over (partition by chrom order by score desc, variant rows between unbounded preceding and 1 preceding), 0) / sum(score) over (partition by chrom) as before from variants) select chrom, variant from x where before < 0.3")
def kept_components(v):
    return screens.keep_components(v.variants, ["chrom"], "variant", "score", 0.3).select("chrom", "variant")


@query("improved_by_children", ("effects",), ", s as (select snp % 40 as term, gene, avg(z) as z from effects group by 1, 2), e as (select k as term, k // 3 as parent from (select distinct term as k from s) where k > 0), c as (select e.parent as term, s.gene, sum(s.z) as sz, count(*) as k from s join e on s.term = e.term group by 1, 2) select s.term, s.gene, round((s.z + coalesce(sz, 0)) / sqrt(1 + coalesce(k, 0)), 5) as z, coalesce(k, 0) as children from s left join c on s.term = c.term and s.gene = c.gene")
def improved_by_children(v):
    s = v.effects.groupBy(F.expr("snp % 40").alias("term"), "gene").agg(F.avg("z").alias("z"))
    edges = s.select("term").distinct().where("term > 0").selectExpr("term", "cast(floor(term / 3) as bigint) as parent")
    return rounded(screens.improve_by_children(s, edges, "term", "gene", "z"), 5)


@query("mutated_genes_only", ("effects", "reads"), ", m as (select distinct variant % 7 as gene from reads where ref_reads < alt_reads and sample % 4 = 1) select id, gene, row_number() over (order by z desc, id) as rank from effects where perm = 0 and gene in (select gene from m)")
def mutated_genes_only(v):
    from ..operators import ordered

    m = v.reads.where("ref_reads < alt_reads and sample % 4 = 1").selectExpr("variant % 7 as gene").distinct()
    kept = filters.listed(v.effects.where("perm = 0"), m, ["gene"])
    return ordered.running_sums(kept, "z", [F.desc("z"), "id"], {"rank": F.lit(1)}, descending=True).select("id", "gene", F.col("rank").cast("long").alias("rank"))


@query("annotation_association", ("genotypes",), "select dataset, count(*) as n, round(corr(quality, expression), 6) as r from genotypes group by dataset")
def annotation_association(v):
    return agg.correlate(v.genotypes, ["dataset"], "quality", "expression").select("dataset", "n", r("r"))


# --- models ----------------------------------------------------------------------------------

_LOGISTIC_SQL = """, cells as (select variant, dosage * 1e0 as x, count(*) filter (where expression > 40) * 1e0 as y, count(*) filter (where expression <= 40) * 1e0 as n0 from genotypes where dosage is not null group by 1, 2),
 it as (select variant, 0 as i, 0e0 as b0, 0e0 as b1, 1e0 as det, 0e0 as h00 from cells group by variant
  union all select variant, i + 1, case when d > 1e-9 then b0 + (h11 * g0 - h01 * g1) / d else b0 end, case when d > 1e-9 then b1 + (h00 * g1 - h01 * g0) / d else b1 end, d, h00
  from (select variant, i, b0, b1, sum(y - n * p) as g0, sum((y - n * p) * x) as g1, sum(n * p * (1 - p)) as h00, sum(n * p * (1 - p) * x) as h01, sum(n * p * (1 - p) * x * x) as h11, sum(n * p * (1 - p)) * sum(n * p * (1 - p) * x * x) - sum(n * p * (1 - p) * x) * sum(n * p * (1 - p) * x) as d
   from (select it.variant, i, b0, b1, x, y, y + n0 as n, 1 / (1 + exp(-greatest(-30e0, least(30e0, b0 + b1 * x)))) as p from it join cells c on it.variant = c.variant where i < 25) t group by variant, i, b0, b1) s)
 select variant, round(case when good then b1 end, 4) as beta, round(case when good then b0 end, 4) as intercept from (select *, det > 1e-9 and abs(b0) < 20 and abs(b1) < 20 as good from it where i = 25) f"""


@query("logistic_regression", ("genotypes",), _LOGISTIC_SQL)
def logistic_regression(v):
    cells = v.genotypes.where("dosage is not null").groupBy("variant", "dosage").agg(F.count_if(F.col("expression") > 40).alias("y"), F.count_if(F.col("expression") <= 40).alias("n"))
    return rounded(screens.logistic(cells, ["variant"], "dosage", "y", "n").select("variant", "beta", "intercept"), 4)


SQL["logistic_regression"] = SQL["logistic_regression"].replace("with ", "with recursive ", 1)

_GRID = (0.001, 0.003, 0.01, 0.03, 0.1, 0.2, 0.3, 0.5)
_BB = "lgamma(k + m + 1) - lgamma(k + 1) - lgamma(m + 1) + lgamma(k + {a}) + lgamma(m + {b}) - lgamma(k + m + {a} + {b}) + lgamma({a} + {b}) - lgamma({a}) - lgamma({b})"


@query("beta_binomial", ("reads",), f", s as (select variant, sample, sum(ref_reads) * 1e0 as k, sum(alt_reads) * 1e0 as m from reads group by 1, 2), t as (select variant, sum(k) / (sum(k) + sum(m)) as p, count(*) as n from s where k + m > 0 group by variant having sum(k) > 0 and sum(m) > 0), g as (select unnest([{', '.join(map(str, _GRID))}]) as rho), l as (select s.variant, t.n, t.p, rho, sum({_BB.format(a='(p * (1 / rho - 1))', b='((1 - p) * (1 / rho - 1))')}) as l, sum({_BB.format(a='(0.5 * (1 / rho - 1))', b='(0.5 * (1 / rho - 1))')}) as l0 from s join t on s.variant = t.variant, g where k + m > 0 group by 1, 2, 3, 4) select variant, n, round(p, 6) as p, round(max(l), 4) as log_likelihood, round(greatest(0, 2 * (max(l) - max(l0))), 3) as chi2 from l group by variant, n, p")
def beta_binomial(v):
    s = v.reads.groupBy("variant", "sample").agg(F.sum("ref_reads").alias("k"), F.sum("alt_reads").alias("m"))
    return screens.beta_binomial(s, ["variant"], "k", "m", _GRID).select("variant", "n", r("p"), r("log_likelihood", 4), r("chi2", 3))


@query("trans_correlation_qtl", ("genotypes",))
def trans_correlation_qtl(v):
    """Whether a variant changes how one measure follows another: the interaction of dosage and the other measure."""
    return rounded(agg.interaction_regression(v.genotypes, ["variant"], "dosage", "quantity", "expression"), 5)


@query("covariate_interaction_screen", ("genotypes",))
def covariate_interaction_screen(v):
    return rounded(screens.covariate_screen(v.genotypes, ["variant"], "dosage", ["depth", "quantity"], "expression"), 5)


@query("prepared_permutations", ("effects",), "select snp, gene, round(sum(z) filter (where perm = 0), 5) as p0, round(sum(z) filter (where perm = 1), 5) as p1, round(sum(z) filter (where perm = 2), 5) as p2, round(sum(z) filter (where perm = 3), 5) as p3, round(sum(z) filter (where perm = 4), 5) as p4 from effects group by snp, gene")
def prepared_permutations(v):
    wide = v.effects.groupBy("snp", "gene").pivot("perm", [0, 1, 2, 3, 4]).agg(F.sum("z"))
    return wide.select("snp", "gene", *(F.round(F.col(str(i)), 5).alias(f"p{i}") for i in range(5)))


@query("matched_background", ("variants",), ", i as (select variant, score > 1000 as hit, pos % 7 as bin from variants), h as (select bin, count(*) as hits from i where hit group by bin), p as (select *, row_number() over (partition by bin, hit order by md5('1:' || variant), variant) as place from i) select variant, hit from p join h on p.bin = h.bin where hit or place <= 2 * hits")
def matched_background(v):
    i = v.variants.selectExpr("variant", "score > 1200 as hit", "pos % 7 as bin")
    return screens.matched_background(i, "variant", "hit", "bin", 2).select("variant", "hit")
