"""Registered queries: one per operator, over whole tables, with SQL to check against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alleles, special, stats
from ..functions.stats import normal_p_sql
from ..operators import aggregates as agg
from ..operators import enrichment as enr
from ..operators import filters, intervals, ld, matrix, meta, models, ordered, ranks, testing
from .views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, views: tuple[str, ...] = (), sql: str | None = None):
    def add(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            SQL[name] = (with_views(*views) + " " if views else "") + sql
        return fn

    return add


def r(column: str, digits: int = 6):
    return F.round(column, digits).alias(column)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


# --- the flagship --------------------------------------------------------------------------

_FLAGSHIP = """, good as (select variant from genotypes group by variant having count(dosage) * 1e0 / count(*) >= 0.8 and least(avg(dosage) / 2, 1 - avg(dosage) / 2) >= 0.1),
 c as (select g.variant, dataset, count(dosage) as n, case when min(dosage) < max(dosage) then corr(dosage, expression) end as r from genotypes g join good on g.variant = good.variant group by 1, 2),
 t as (select variant, n, r * sqrt((n - 2) / (1 - r * r)) as t from c where n >= 4 and abs(r) < 0.9999), z as (select variant, n, sign(t) * (8 * (n - 2) + 1e0) / (8 * (n - 2) + 3) * sqrt((n - 2) * ln(1 + t * t / (n - 2))) as z from t),
 m as (select variant, count(*) as datasets, sum(sqrt(n) * z) / sqrt(sum(n)) as z from z group by variant), p as (select variant, datasets, z, {p} as p from m), x as (select *, p * count(*) over () / row_number() over (order by p, variant) as s from p)
 select variant, datasets, round(z, 5) as z, round(p, 6) as p, round(least(1, min(s) over (order by p, variant rows between current row and unbounded following)), 5) as q from x""".replace("{p}", normal_p_sql("z"))


@query("association_screen", ("genotypes",), _FLAGSHIP)
def association_screen(v):
    """QC, correlation by dataset, joint z over datasets, and false discovery rates."""
    g = v.genotypes
    s = agg.variant_summary(g, ["variant"], "dosage").where(filters.at_least(F.col("call_rate"), 0.8) & filters.at_least(F.col("maf"), 0.1))
    c = agg.correlate(g.join(s.select("variant"), "variant", "left_semi"), ["variant", "dataset"], "dosage", "expression").where("n >= 4 and abs(r) < 0.9999")
    one = c.withColumn("z", stats.correlation_z(F.col("r"), F.col("n").cast("double")))
    joint = meta.weighted_z(one, ["variant"], "z", "n")
    return testing.benjamini_hochberg(joint, "p", "variant").select("variant", "datasets", r("z", 5), r("p"), r("q", 5))


# --- variant summaries and filters -------------------------------------------------------

SUMMARY_SQL = """summary as (select variant, count(*) as n, count(dosage) as called, count(dosage) * 1e0 / count(*) as call_rate,
 count(*) filter (where dosage = 0) as hom_ref, count(*) filter (where dosage = 1) as het, count(*) filter (where dosage = 2) as hom_alt,
 avg(dosage) / 2 as alt_freq, least(avg(dosage) / 2, 1 - avg(dosage) / 2) as maf,
 case when avg(dosage) is null then null when avg(dosage) <= 0 or avg(dosage) >= 2 then 1e0 else least(1e0, (avg(dosage * dosage) - avg(dosage) * avg(dosage)) / (avg(dosage) * (1 - avg(dosage) / 2))) end as mach_r2
 from genotypes group by variant)"""


@query("variant_summary", ("genotypes",), f", {SUMMARY_SQL} select variant, n, called, round(call_rate, 6) as call_rate, hom_ref, het, hom_alt, round(alt_freq, 6) as alt_freq, round(maf, 6) as maf, round(mach_r2, 6) as mach_r2 from summary")
def variant_summary(v):
    return rounded(agg.variant_summary(v.genotypes, ["variant"], "dosage"))


@query("filter_maf", ("genotypes",), f", {SUMMARY_SQL} select variant, round(maf, 6) as maf from summary where maf >= 0.4")
def filter_maf(v):
    s = agg.variant_summary(v.genotypes, ["variant"], "dosage")
    return s.where(filters.at_least(F.col("maf"), 0.4)).select("variant", r("maf"))


HWE_SQL = """hwe as (select variant, call_rate, maf, het, hom_ref, hom_alt, 2 * least(hom_ref, hom_alt) + het as rare, hom_ref + het + hom_alt as people from summary),
 grid as (select variant, rare, people, het, unnest(range(cast(rare % 2 as bigint), cast(rare + 1 as bigint), 2)) as x from hwe where people > 0),
 logp as (select variant, het, x, x * ln(2) - lgamma(x + 1) - lgamma((rare - x) / 2 + 1) - lgamma(people - x - (rare - x) / 2 + 1) as lp from grid),
 probs as (select variant, het, x, exp(lp - max(lp) over (partition by variant)) as w from logp),
 normed as (select variant, het, x, w / sum(w) over (partition by variant) as pr from probs),
 own as (select variant, max(pr) filter (where x = het) as po from normed group by variant),
 exact as (select n.variant, least(1, sum(n.pr) filter (where n.pr <= o.po * (1 + 1e-9))) as hwe_p from normed n join own o on n.variant = o.variant group by n.variant)"""


@query("hardy_weinberg", ("genotypes",), f", {SUMMARY_SQL}, {HWE_SQL} select variant, round(hwe_p, 6) as hwe_p from exact")
def hardy_weinberg(v):
    s = agg.variant_summary(v.genotypes, ["variant"], "dosage").where("called > 0")
    return agg.with_hwe(s).select("variant", r("hwe_p"))


@query("filter_quality", ("genotypes",), f", {SUMMARY_SQL}, {HWE_SQL} select h.variant, round(h.maf, 6) as maf from hwe h join exact e on h.variant = e.variant where h.call_rate >= 0.8 and h.maf >= 0.3 and e.hwe_p >= 0.01")
def filter_quality(v):
    s = agg.with_hwe(agg.variant_summary(v.genotypes, ["variant"], "dosage"))
    return filters.quality(s, 0.8, 0.3, 0.01).select("variant", r("maf"))


@query("filter_mach_r2", ("genotypes",), f", {SUMMARY_SQL} select variant, n from summary where mach_r2 >= 0.9")
def filter_mach_r2(v):
    return agg.variant_summary(v.genotypes, ["variant"], "dosage").where(filters.at_least(F.col("mach_r2"), 0.9)).select("variant", "n")


@query("filter_strict_call_rate", ("genotypes",), f", {SUMMARY_SQL} select variant, called from summary where call_rate > 0.9")
def filter_strict_call_rate(v):
    return agg.variant_summary(v.genotypes, ["variant"], "dosage").where(filters.at_least(F.col("call_rate"), 0.9, inclusive=False)).select("variant", "called")


@query("filter_alleles", ("variants",), "select variant, ref, alt, (ref <> alt and ref || alt not in ('AT', 'TA', 'CG', 'GC')) as strand_safe from variants where ref <> alt")
def filter_alleles(v):
    a = v.variants.withColumn("alleles", F.array("ref", "alt"))
    return a.where(alleles.is_biallelic(F.col("alleles")) & alleles.is_snp(F.col("alleles"))).select("variant", "ref", "alt", (~alleles.is_ambiguous(F.col("alleles"))).alias("strand_safe"))


@query("filter_listed", ("variants", "peaks"), "select variant, pos from variants where variant in (select peak from peaks where track = 'BUILDING')")
def filter_listed(v):
    return filters.listed(v.variants, v.peaks.where("track = 'BUILDING'").select(F.col("peak").alias("variant")), ["variant"]).select("variant", "pos")


@query("filter_excluded", ("variants", "peaks"), "select variant, pos from variants where variant not in (select peak from peaks where track = 'BUILDING')")
def filter_excluded(v):
    return filters.listed(v.variants, v.peaks.where("track = 'BUILDING'").select(F.col("peak").alias("variant")), ["variant"], exclude=True).select("variant", "pos")


@query("filter_genotype_calls", ("genotypes",), "select variant, count(*) as n, count(case when depth >= 3 and quality >= 4 then dosage end) as kept from genotypes group by variant")
def filter_genotype_calls(v):
    g = filters.mask_genotypes(v.genotypes, "dosage", depth="depth", quality="quality", least_depth=3, least_quality=4)
    return g.groupBy("variant").agg(F.count("*").alias("n"), F.count("dosage").alias("kept"))


@query("filter_summary_statistics", ("effects",), "select id, snp, round(p, 6) as p from effects where p < 0.01")
def filter_summary_statistics(v):
    return v.effects.where(filters.under(F.col("p"), 0.01)).select("id", "snp", r("p"))


@query("drop_sparse", ("genotypes",), "select g.variant, count(*) as n from genotypes g where g.variant in (select variant from genotypes group by variant having count(*) filter (where dosage is null) <= 2) group by g.variant")
def drop_sparse(v):
    return filters.drop_sparse(v.genotypes, "variant", "dosage", 2).groupBy("variant").agg(F.count("*").alias("n"))


@query("impute_mean", ("genotypes",), "select variant, round(sum(coalesce(dosage, m)), 6) as total from (select variant, dosage, avg(dosage) over (partition by variant) as m from genotypes) t group by variant")
def impute_mean(v):
    g = filters.impute(v.genotypes.withColumn("dosage", F.col("dosage").cast("double")), "variant", "dosage")
    return g.groupBy("variant").agg(F.round(F.sum("dosage"), 6).alias("total"))


@query("impute_median", ("genotypes",), "select g.variant, round(sum(coalesce(dosage, m)), 6) as total from genotypes g join (select variant, median(dosage) as m from genotypes group by variant) t on g.variant = t.variant group by g.variant")
def impute_median(v):
    g = filters.impute(v.genotypes.withColumn("dosage", F.col("dosage").cast("double")), "variant", "dosage", "median")
    return g.groupBy("variant").agg(F.round(F.sum("dosage"), 6).alias("total"))


@query("zero_to_null", ("genotypes",), "select sample, count(nullif(dosage, 0)) as n from genotypes group by sample")
def zero_to_null(v):
    return filters.zero_to_null(v.genotypes, "dosage").groupBy("sample").agg(F.count("dosage").alias("n"))


@query("drop_constant", ("genotypes",), "select variant from genotypes group by variant having min(dosage) < max(dosage)")
def drop_constant(v):
    return filters.drop_constant(v.genotypes, "variant", "dosage").select("variant").distinct()


@query("overlay_edits", ("variants", "peaks"), "select v.variant, coalesce(e.ref, v.ref) as ref from variants v left join (select peak as variant, case when peak % 2 = 0 then 'N' end as ref, peak % 10 = 0 as excluded from peaks) e on v.variant = e.variant where not coalesce(e.excluded, false)")
def overlay_edits(v):
    e = v.peaks.selectExpr("peak as variant", "case when peak % 2 = 0 then 'N' end as ref", "peak % 10 = 0 as excluded")
    return filters.overlay(v.variants, e, "variant", ["ref"]).select("variant", "ref")


# --- joins ---------------------------------------------------------------------------------


@query("cis_pairs", ("variants", "genes"), "select variant, gene, abs(pos - mid) as distance from variants v join genes g on v.chrom = g.chrom and abs(pos - mid) < 5000")
def cis_pairs(v):
    j = intervals.band_join(v.variants, v.genes, ["chrom"], "pos", "mid", 5000)
    return j.select("variant", "gene", F.abs(F.col("pos") - F.col("mid")).alias("distance"))


@query("cis_windows", ("variants", "genes"), "select gene, count(*) as n, min(variant) as first_variant from variants v join genes g on v.chrom = g.chrom and pos >= greatest(0, start - 3000) and pos <= start + 3000 group by gene")
def cis_windows(v):
    g = v.genes.withColumn("lo", F.greatest(F.lit(0), F.col("start") - 3000)).withColumn("hi", F.col("start") + 3000).drop("start", "stop", "mid")
    return intervals.point_join(v.variants, g, ["chrom"], "pos", "lo", "hi", 6000).groupBy("gene").agg(F.count("*").alias("n"), F.min("variant").alias("first_variant"))


@query("trans_pairs", ("variants", "genes", "effects"), "select distinct e.snp as variant, e.id % 100 + 1 as gene from effects e where exists (select 1 from variants v where v.variant = e.snp) and not exists (select 1 from variants v join genes g on v.chrom = g.chrom and abs(v.pos - g.mid) < 50000 where v.variant = e.snp and g.gene = e.id % 100 + 1)")
def trans_pairs(v):
    pairs = v.effects.selectExpr("snp as variant", "id % 100 + 1 as gene").distinct().join(v.variants.select("variant"), "variant", "left_semi")
    return intervals.anti_band_pairs(v.variants, v.genes, ["chrom"], "pos", "mid", 50000, "variant", "gene", pairs)


@query("confined_pairs", ("variants", "genes", "effects"), "select e.id, v.chrom as snp_chrom, g.chrom as gene_chrom, v.pos, g.start from effects e join variants v on e.snp = v.variant join genes g on e.id % 100 + 1 = g.gene")
def confined_pairs(v):
    e = v.effects.selectExpr("id", "snp as variant", "id % 100 + 1 as gene")
    a, b = v.variants.selectExpr("variant", "chrom as snp_chrom", "pos"), v.genes.selectExpr("gene", "chrom as gene_chrom", "start")
    return e.join(a, "variant").join(b, "gene").select("id", "snp_chrom", "gene_chrom", "pos", "start")


@query("points_in_intervals", ("variants", "peaks"), "select variant, peak from variants v join peaks p on v.chrom = p.chrom and pos between start and stop")
def points_in_intervals(v):
    return intervals.point_join(v.variants, v.peaks, ["chrom"], "pos", "start", "stop", 500).select("variant", "peak")


@query("points_outside_intervals", ("variants", "peaks"), "select variant from variants v where not exists (select 1 from peaks p where v.chrom = p.chrom and v.pos between start and stop)")
def points_outside_intervals(v):
    return intervals.point_join(v.variants, v.peaks, ["chrom"], "pos", "start", "stop", 500, "left_anti").select("variant")


@query("interval_overlaps", ("genes", "peaks"), "select gene, peak from genes g join peaks p on g.chrom = p.chrom and g.start < p.stop and p.start < g.stop")
def interval_overlaps(v):
    p = v.peaks.withColumnRenamed("start", "p_start").withColumnRenamed("stop", "p_stop")
    return intervals.overlap_join(v.genes, p, ["chrom"], ("start", "stop"), ("p_start", "p_stop"), 1500, touching=False).select("gene", "peak")


@query("interval_overlaps_windowed", ("genes", "peaks"), "select gene, count(*) as n from genes g join peaks p on g.chrom = p.chrom and g.start - 1000 <= p.stop and p.start <= g.stop + 1000 group by gene")
def interval_overlaps_windowed(v):
    g = v.genes.withColumn("lo", F.col("start") - 1000).withColumn("hi", F.col("stop") + 1000)
    p = v.peaks.withColumnRenamed("start", "p_start").withColumnRenamed("stop", "p_stop")
    return intervals.overlap_join(g, p, ["chrom"], ("lo", "hi"), ("p_start", "p_stop"), 3000).groupBy("gene").agg(F.count("*").alias("n"))


@query("boundary_as_of", ("variants", "genes"), "select variant, gene, (pos <= stop + 100) as inside from (select v.variant, v.pos, g.gene, g.stop, row_number() over (partition by v.variant order by g.start desc nulls last, g.gene desc) as k from variants v left join genes g on v.chrom = g.chrom and g.start <= v.pos) t where k = 1")
def boundary_as_of(v):
    j = intervals.as_of_join(v.variants.select("variant", "chrom", "pos"), v.genes, ["chrom"], "pos", "start", ["gene", "stop"])
    return j.select("variant", "gene", (F.col("pos") <= F.col("stop") + 100).alias("inside"))


@query("first_overlapping_peak", ("variants", "peaks"), "select variant, peak from (select variant, peak, row_number() over (partition by variant order by start, peak) as k from variants v join peaks p on v.chrom = p.chrom and pos between start and stop) t where k = 1")
def first_overlapping_peak(v):
    j = intervals.point_join(v.variants, v.peaks, ["chrom"], "pos", "start", "stop", 500)
    return intervals.first_match(j, ["variant"], ["start", "peak"]).select("variant", "peak")


@query("peaks_around_variants", ("variants", "peaks"), "select variant, string_agg(cast(peak as string), ',' order by peak) as peaks from variants v join peaks p on v.chrom = p.chrom and pos >= start - 2000 and pos <= stop + 2000 group by variant")
def peaks_around_variants(v):
    p = v.peaks.withColumn("lo", F.col("start") - 2000).withColumn("hi", F.col("stop") + 2000)
    j = intervals.point_join(v.variants, p, ["chrom"], "pos", "lo", "hi", 4500)
    return j.groupBy("variant").agg(F.array_join(F.transform(F.sort_array(F.collect_list("peak")), lambda x: x.cast("string")), ",").alias("peaks"))


TRACKS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("state_indicators", ("variants", "peaks"), "select v.variant, " + ", ".join(f"coalesce(max(case when p.track = '{t}' then 1 else 0 end), 0) as {t.lower()}" for t in TRACKS) + " from variants v left join peaks p on v.chrom = p.chrom and pos between start and stop group by v.variant")
def state_indicators(v):
    j = intervals.point_join(v.variants, v.peaks, ["chrom"], "pos", "start", "stop", 500, "left")
    return j.groupBy("variant").agg(*(F.max(F.when(F.col("track") == t, 1).otherwise(0)).alias(t.lower()) for t in TRACKS))


@query("track_summary", ("variants", "peaks"), "select track, count(distinct variant) as n_variants, count(*) as n from variants v join peaks p on v.chrom = p.chrom and pos between start and stop group by track")
def track_summary(v):
    j = intervals.point_join(v.variants, v.peaks, ["chrom"], "pos", "start", "stop", 500)
    return j.groupBy("track").agg(F.count_distinct("variant").alias("n_variants"), F.count("*").alias("n"))


@query("contact_map", ("variants", "genes", "effects", "peaks"), """, pairs as (select e.id, v.chrom, least(v.pos, g.mid) // 10000 * 10000 as bin_a, greatest(v.pos, g.mid) // 10000 * 10000 as bin_b from effects e join variants v on e.snp = v.variant join genes g on e.id % 100 + 1 = g.gene and v.chrom = g.chrom),
 contacts as (select chrom, start // 10000 * 10000 as bin_a, (start * 2) // 10000 * 10000 as bin_b, count(*) as contacts from peaks group by 1, 2, 3) select p.id, p.bin_a, p.bin_b, c.contacts from pairs p left join contacts c on p.chrom = c.chrom and p.bin_a = c.bin_a and p.bin_b = c.bin_b""")
def contact_map(v):
    contacts = v.peaks.selectExpr("chrom", "floor(start / 10000) * 10000 as bin_a", "floor(start * 2 / 10000) * 10000 as bin_b").groupBy("chrom", "bin_a", "bin_b").agg(F.count("*").alias("contacts"))
    e = v.effects.selectExpr("id", "snp as variant", "id % 100 + 1 as gene").join(v.variants.select("variant", "chrom", "pos"), "variant").join(v.genes.select("gene", "chrom", "mid"), ["gene", "chrom"])
    return intervals.contact_join(e, contacts, "chrom", "pos", "mid", 10000).select("id", "bin_a", "bin_b", "contacts")


@query("match_positions", ("variants", "peaks"), """, ref as (select peak as ref_id, chrom, start as ref_pos, substr('ACGT', cast(peak % 4 as int) + 1, 1) as ref_allele from peaks)
 select variant, ref_id from (select v.variant, x.ref_id, row_number() over (partition by v.variant order by (v.ref = x.ref_allele) desc, abs(v.pos - x.ref_pos), x.ref_id) as k from variants v join ref x on v.chrom = x.chrom and abs(v.pos - x.ref_pos) < 100) t where k = 1""")
def match_positions(v):
    ref = v.peaks.selectExpr("peak as ref_id", "chrom", "start as ref_pos", "substr('ACGT', cast(peak % 4 as int) + 1, 1) as ref_allele")
    j = intervals.band_join(v.variants, ref, ["chrom"], "pos", "ref_pos", 100)
    return intervals.first_match(j, ["variant"], [F.desc(F.col("ref") == F.col("ref_allele")), F.abs(F.col("pos") - F.col("ref_pos")), "ref_id"]).select("variant", "ref_id")


@query("neighbouring_variants", ("variants",), "select variant, array_to_string(list_concat(coalesce(list(variant) over (partition by chrom order by pos rows between 2 preceding and 1 preceding), []), coalesce(list(variant) over (partition by chrom order by pos rows between 1 following and 2 following), [])), ',') as flanks from variants")
def neighbouring_variants(v):
    n = intervals.neighbours(v.variants, ["chrom"], "pos", "variant", 2, "near")
    return n.select("variant", F.array_join(F.transform("near", lambda x: x.cast("string")), ",").alias("flanks"))


@query("harmonise_alleles", ("variants", "peaks"), """, other as (select peak as variant, substr('ACGTTGCA', cast(peak % 8 as int) + 1, 1) as ref, substr('CAGATGTC', cast(peak % 8 as int) + 1, 1) as alt from peaks), j as (select v.variant, v.ref, v.alt, o.ref as ref2, o.alt as alt2, translate(o.ref, 'ACGT', 'TGCA') as c_ref, translate(o.alt, 'ACGT', 'TGCA') as c_alt from variants v join other o on v.variant = o.variant)
 select variant, case when (ref = ref2 and alt = alt2) or (ref = alt2 and alt = ref2) then case when alt = alt2 then 1 else -1 end when (ref = c_ref and alt = c_alt) or (ref = c_alt and alt = c_ref) then case when alt = c_alt then 1 else -1 end end as flip from j""")
def harmonise_alleles(v):
    o = v.peaks.selectExpr("peak as variant", "substr('ACGTTGCA', cast(peak % 8 as int) + 1, 1) as ref2", "substr('CAGATGTC', cast(peak % 8 as int) + 1, 1) as alt2")
    j = v.variants.join(o, "variant")
    return j.select("variant", alleles.flip(F.array("ref", "alt"), F.col("alt"), F.array("ref2", "alt2"), F.col("alt2")).alias("flip"))


TWO = ", one as (select snp, gene, max(z) as z, min(p) as p from effects where perm = 0 group by snp, gene), two as (select snp, gene, max(z) as z, min(p) as p from effects where perm = 1 group by snp, gene)"


def _two(v):
    side = lambda k: v.effects.where(f"perm = {k}").groupBy("snp", "gene").agg(F.max("z").alias("z"), F.min("p").alias("p"))
    return side(0), side(1)


@query("compare_results", ("effects",), TWO + " select coalesce(a.snp, b.snp) as snp, coalesce(a.gene, b.gene) as gene, round(a.z, 6) as z1, round(b.z, 6) as z2, case when a.snp is not null and b.snp is not null then 'both' when a.snp is not null then 'first' else 'second' end as found, case when a.snp is not null and b.snp is not null then sign(a.z) = sign(b.z) end as same_direction from one a full join two b on a.snp = b.snp and a.gene = b.gene")
def compare_results(v):
    return rounded(meta.compare(*_two(v), ["snp", "gene"], "z"))


@query("replicate_results", ("effects",), TWO + ", j as (select a.snp, a.gene, a.z, b.z as other_z, b.p as other_p from one a left join two b on a.snp = b.snp and a.gene = b.gene) select snp, gene, round(z, 6) as z, coalesce(sign(z) = sign(other_z) and other_p <= 0.5 / greatest(1, (select count(other_p) from j)), false) as replicated from j")
def replicate_results(v):
    return rounded(meta.replication(*_two(v), ["snp", "gene"], "z", "p", 0.5).select("snp", "gene", "z", "replicated"))


@query("shared_pairs", ("effects",), TWO + " select snp, gene from one intersect select snp, gene from two")
def shared_pairs(v):
    a, b = _two(v)
    return a.select("snp", "gene").intersect(b.select("snp", "gene"))


@query("pairs_in_one_only", ("effects",), TWO + " select snp, gene from one except select snp, gene from two")
def pairs_in_one_only(v):
    a, b = _two(v)
    return a.select("snp", "gene").subtract(b.select("snp", "gene"))


@query("annotate_results", ("effects", "genes"), "select e.id, g.symbol, g.chrom from effects e left join genes g on e.id % 250 = g.gene")
def annotate_results(v):
    return v.effects.selectExpr("id", "id % 250 as gene").join(v.genes.select("gene", "symbol", "chrom"), "gene", "left").select("id", "symbol", "chrom")


@query("sample_linkage", ("genotypes",), "select c.c_mktsegment as cohort, count(*) as n, round(avg(g.expression), 4) as mean from genotypes g join customer c on g.sample = c.c_custkey group by 1")
def sample_linkage(v):
    links = v.customer.selectExpr("c_custkey as sample", "c_mktsegment as cohort")
    return v.genotypes.join(links, "sample").groupBy("cohort").agg(F.count("*").alias("n"), F.round(F.avg("expression"), 4).alias("mean"))


@query("merge_matrices", ("effects",), TWO + " select coalesce(a.snp, b.snp) as snp, coalesce(a.gene, b.gene) as gene, round(a.z, 6) as z_1, round(b.z, 6) as z_2 from one a full join two b on a.snp = b.snp and a.gene = b.gene")
def merge_matrices(v):
    a, b = _two(v)
    return rounded(matrix.merge(a, b, ["snp", "gene"], "z", "full"))


@query("common_matrix_rows", ("effects",), TWO + " select snp, count(*) as n from one where snp in (select snp from two) group by snp")
def common_matrix_rows(v):
    a, b = _two(v)
    return matrix.common_rows(a, b, row="snp").groupBy("snp").agg(F.count("*").alias("n"))


# --- grouped statistics ----------------------------------------------------------------------


@query("describe", ("genotypes",), """, m as (select variant, count(expression) as n, avg(expression) as mean, sum(expression) as total, sum(abs(expression)) as abs_total, var_samp(expression) as variance, stddev_samp(expression) as sd, min(expression) as least, max(expression) as most, var_pop(expression) as vp from genotypes group by variant),
 c as (select g.variant, avg(pow(g.expression - m.mean, 3)) as m3, avg(pow(g.expression - m.mean, 4)) as m4 from genotypes g join m on g.variant = m.variant group by g.variant)
 select m.variant, n, round(mean, 4) as mean, round(total, 4) as total, round(abs_total, 4) as abs_total, round(variance, 4) as variance, round(sd, 4) as sd, round(case when n > 2 then m3 / pow(vp, 1.5) * sqrt(n * (n - 1)) / (n - 2) end, 4) as skewness, round(case when n > 3 then (n - 1) * 1e0 / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (vp * vp) - 3) + 6) end, 4) as kurtosis, round(least, 4) as least, round(most, 4) as most from m join c on m.variant = c.variant""")
def describe(v):
    return rounded(agg.describe(v.genotypes, ["variant"], "expression"), 4)


CORR_SQL = "corrs as (select variant, dataset, count(*) filter (where dosage is not null and expression is not null) as n, case when min(dosage) < max(dosage) then corr(dosage, expression) end as r, covar_samp(dosage, expression) as covariance from genotypes group by variant, dataset)"


@query("correlate", ("genotypes",), f", {CORR_SQL} select variant, dataset, n, round(r, 6) as r, round(covariance, 6) as covariance from corrs")
def correlate(v):
    return rounded(agg.correlate(v.genotypes, ["variant", "dataset"], "dosage", "expression"))


SPEARMAN_SQL = "rk as (select variant, rank() over (partition by variant order by dosage) + (count(*) over (partition by variant, dosage) - 1) / 2e0 as rx, rank() over (partition by variant order by expression) + (count(*) over (partition by variant, expression) - 1) / 2e0 as ry from genotypes where dosage is not null)"


@query("spearman", ("genotypes",), f", {SPEARMAN_SQL} select variant, count(*) as n, round(case when min(rx) < max(rx) then corr(rx, ry) end, 6) as rho from rk group by variant")
def spearman(v):
    return rounded(ranks.spearman(v.genotypes, ["variant"], "dosage", "expression"))


@query("spearman_p", ("genotypes",), f", {SPEARMAN_SQL}, s as (select variant, count(*) as n, case when min(rx) < max(rx) then corr(rx, ry) end as rho from rk group by variant), f as (select variant, n, case when n > 3 and abs(rho) < 0.9999 then sqrt((n - 3) / 1.06e0) * 0.5e0 * ln((1 + rho) / (1 - rho)) end as z from s) select variant, round(z, 5) as z, round({normal_p_sql('z')}, 5) as p from f where z is not null")
def spearman_p(v):
    s = ranks.spearman(v.genotypes, ["variant"], "dosage", "expression").where("abs(rho) < 0.9999 and n > 3")
    s = s.withColumn("z", stats.spearman_fieller_z(F.col("rho"), F.col("n").cast("double"))).where("z is not null")
    return rounded(s.select("variant", "z", stats.two_sided_normal_p(F.col("z")).alias("p")), 5)


@query("weighted_correlation", ("genotypes",), """, s as (select variant, sum(depth) as w, sum(depth * dosage) * 1e0 as wx, sum(depth * expression) as wy, sum(depth * dosage * dosage) * 1e0 as wxx, sum(depth * expression * expression) as wyy, sum(depth * dosage * expression) as wxy from genotypes where dosage is not null group by variant)
 select variant, round(case when wxx - wx * wx / w > 0 and wyy - wy * wy / w > 0 then (wxy - wx * wy / w) / sqrt((wxx - wx * wx / w) * (wyy - wy * wy / w)) end, 5) as r from s""")
def weighted_correlation(v):
    return rounded(agg.weighted_correlate(v.genotypes, ["variant"], "dosage", "expression", "depth"), 5)


@query("simple_regression", ("genotypes",), """, s as (select variant, count(*) as n, regr_slope(expression, dosage) as beta, regr_intercept(expression, dosage) as alpha, regr_sxx(expression, dosage) as sxx, regr_syy(expression, dosage) as syy, regr_sxy(expression, dosage) as sxy from genotypes where dosage is not null group by variant)
 select variant, n, round(beta, 4) as beta, round(alpha, 4) as alpha, round(sqrt(greatest(0, syy - beta * sxy) / (n - 2) / sxx), 4) as se from s where n > 2 and sxx > 0.5""")
def simple_regression(v):
    f = agg.simple_regression(v.genotypes, ["variant"], "dosage", "expression").where("n > 2 and se is not null")
    return rounded(f.select("variant", "n", "beta", "alpha", "se"), 4)


@query("two_stage_least_squares", ("genotypes",), """, s as (select variant, count(*) as n, covar_pop(dosage, expression) as czy, covar_pop(dosage, quantity) as czx, var_pop(dosage) as vz, var_pop(expression) as vy, avg(quantity) as mx, avg(expression) as my from genotypes where dosage is not null group by variant)
 select variant, n, round(czy / czx, 3) as beta, round(my - czy / czx * mx, 3) as alpha from s where abs(czx) > 0.01""")
def two_stage_least_squares(v):
    g = v.genotypes.where("dosage is not null").withColumn("cents", F.round(F.col("expression") * 99900))
    # dosages, quantities and cents are whole numbers, so sums are exact: neither a covariance of just 0.01 nor a half hangs on the order of rows
    exact = (F.col("cents") / 100 / 999.0 == F.col("expression")) & (F.col("quantity") == F.floor("quantity"))
    whole = {"z": F.col("dosage"), "x": F.col("quantity"), "c": F.col("cents"), "zx": F.col("dosage") * F.col("quantity"), "zc": F.col("dosage") * F.col("cents")}
    sums = g.groupBy("variant").agg(F.count("*").alias("n"), F.min(F.coalesce(exact, F.lit(False))).alias("exact"), *(F.sum(e.try_cast("long")).alias(k) for k, e in whole.items()), F.sum("quantity").alias("xs"), F.sum(F.col("dosage") * F.col("quantity")).alias("zxs"))
    ok = sums.where("abs(n * zxs - z * xs) * 100 > n * n").select("variant", "exact", *(F.expr(f"cast(n as decimal(19, 0)) * {k} - cast(z as decimal(19, 0)) * {a}").alias(k) for k, a in (("zx", "x"), ("zc", "c"))), "x", "c")
    f = agg.two_stage(g.join(ok.select("variant"), "variant", "left_semi"), ["variant"], "dosage", "quantity", "expression").join(ok, "variant")
    beta, alpha = stats.nearest("zc", "zx * 99900", 3), stats.nearest("c * zx - zc * x", "zx * n * 99900", 3)
    return f.select("variant", "n", *(F.when(F.col("exact"), e).otherwise(F.round(k, 3)).alias(k) for k, e in (("beta", beta), ("alpha", alpha))))


@query("interaction_regression", ("genotypes",))
def interaction_regression(v):
    return rounded(agg.interaction_regression(v.genotypes, ["variant"], "dosage", "depth", "expression"), 5)


@query("genotype_counts", ("genotypes",), "select variant, dosage, count(*) as n from genotypes group by variant, dosage")
def genotype_counts(v):
    return agg.genotype_counts(v.genotypes, ["variant"], "dosage")


@query("call_rates_by_sample", ("genotypes",), "select sample, round(count(dosage) * 1e0 / count(*), 6) as call_rate from genotypes group by sample")
def call_rates_by_sample(v):
    return rounded(agg.call_rate(v.genotypes, ["sample"], "dosage"))


@query("histogram", ("genotypes",), "select dataset, cast(floor((expression - 0e0) / 5e0) as int) as bin, count(*) as n from genotypes where expression >= 0 and expression < 50 group by 1, 2")
def histogram(v):
    return agg.histogram(v.genotypes, ["dataset"], "expression", 0.0, 50.0, 10)


@query("contingency", ("genotypes",), """, t as (select variant, count(*) filter (where coalesce(dosage = 1, false) and expression > 30) * 1e0 as a, count(*) filter (where coalesce(dosage = 1, false) and not expression > 30) * 1e0 as b, count(*) filter (where not coalesce(dosage = 1, false) and expression > 30) * 1e0 as c, count(*) filter (where not coalesce(dosage = 1, false) and not expression > 30) * 1e0 as d from genotypes group by variant)
 select variant, cast(a as bigint) as a, cast(b as bigint) as b, cast(c as bigint) as c, cast(d as bigint) as d, round(case when (a + b) * (c + d) * (a + c) * (b + d) > 0 then (a + b + c + d) * (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d) * (a + c) * (b + d)) end, 6) as chi2, round(case when b * c > 0 then a * d / (b * c) end, 6) as odds_ratio from t""")
def contingency(v):
    return rounded(agg.contingency(v.genotypes, ["variant"], F.col("dosage") == 1, F.col("expression") > 30))


FISHER_SQL = """, t as (select variant, count(*) filter (where coalesce(dosage = 1, false) and expression > 30) as a, count(*) filter (where coalesce(dosage = 1, false) and not expression > 30) as b, count(*) filter (where not coalesce(dosage = 1, false) and expression > 30) as c, count(*) filter (where not coalesce(dosage = 1, false) and not expression > 30) as d from genotypes group by variant),
 g as (select variant, a, a + b as r, a + c as k, a + b + c + d as n, unnest(range(greatest(0, (a + b) + (a + c) - (a + b + c + d)), least(a + b, a + c) + 1)) as x from t),
 h as (select variant, a, x, exp(lgamma(r + 1) - lgamma(x + 1) - lgamma(r - x + 1) + lgamma(n - r + 1) - lgamma(k - x + 1) - lgamma(n - r - k + x + 1) - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1)) as pr from g),
 o as (select variant, max(pr) filter (where x = a) as po from h group by variant)
 select h.variant, round(least(1, sum(pr) filter (where pr <= po * (1 + 1e-7))), 6) as p, round(least(1, sum(pr) filter (where x <= a)), 6) as p_left from h join o on h.variant = o.variant group by h.variant"""


@query("fisher_exact", ("genotypes",), FISHER_SQL)
def fisher_exact(v):
    t = agg.contingency(v.genotypes, ["variant"], F.col("dosage") == 1, F.col("expression") > 30)
    cells = [F.col(c) for c in "abcd"]
    return rounded(t.select("variant", special.fisher_exact_p(*cells).alias("p"), special.fisher_exact_p(*cells, side="left").alias("p_left")))


@query("t_test", ("genotypes",), """, s as (select variant, count(expression) filter (where dosage > 0) as n1, count(expression) filter (where dosage = 0) as n2, avg(expression) filter (where dosage > 0) as m1, avg(expression) filter (where dosage = 0) as m2, var_samp(expression) filter (where dosage > 0) as v1, var_samp(expression) filter (where dosage = 0) as v2 from genotypes group by variant)
 select variant, n1, n2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 4) as t, n1 + n2 - 2e0 as df from s where n1 > 1 and n2 > 1 and v1 / n1 + v2 / n2 > 0""")
def t_test(v):
    t = agg.t_test(v.genotypes, ["variant"], "expression", F.col("dosage") > 0, welch=False).where("t is not null")
    return rounded(t.select("variant", "n1", "n2", "t", "df"), 4)


@query("mann_whitney", ("genotypes",), f""", x as (select variant, dosage > 0 as g, rank() over (partition by variant order by expression) + (count(*) over (partition by variant, expression) - 1) / 2e0 as rk from genotypes where dosage is not null),
 s as (select variant, count(*) filter (where g) * 1e0 as n1, count(*) filter (where not g) * 1e0 as n2, sum(rk) filter (where g) as r1 from x group by variant), u as (select variant, n1, n2, r1 - n1 * (n1 + 1) / 2 as u1 from s where n1 > 0 and n2 > 0), z as (select *, (u1 - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) as z from u)
 select variant, cast(n1 as bigint) as n1, cast(n2 as bigint) as n2, round(u1, 6) as u1, round(z, 6) as z, round({normal_p_sql('z')}, 6) as p, round(u1 / (n1 * n2), 6) as auc from z""")
def mann_whitney(v):
    return rounded(ranks.mann_whitney(v.genotypes, ["variant"], "expression", F.col("dosage") > 0))


@query("kolmogorov_smirnov", ("genotypes",), """, x as (select variant, expression, sum(cast(dosage > 0 as int)) as k1, sum(cast(dosage = 0 as int)) as k2 from genotypes where dosage is not null group by 1, 2),
 y as (select variant, sum(k1) over (partition by variant) as n1, sum(k2) over (partition by variant) as n2, sum(k1) over (partition by variant order by expression) as c1, sum(k2) over (partition by variant order by expression) as c2 from x)
 select variant, cast(n1 as bigint) as n1, cast(n2 as bigint) as n2, round(max(abs(c1 * 1e0 / n1 - c2 * 1e0 / n2)), 6) as d from y where n1 > 0 and n2 > 0 group by variant, n1, n2""")
def kolmogorov_smirnov(v):
    return rounded(agg.ks_test(v.genotypes.where("dosage is not null"), ["variant"], "expression", F.col("dosage") > 0).drop("z"))


@query("theil_sen", ("genotypes",), """, x as (select variant, obs * 10 + line as i, dosage, expression from genotypes where dosage is not null), s as (select a.variant, (a.expression - b.expression) / (a.dosage - b.dosage) as s from x a join x b on a.variant = b.variant and a.i < b.i and a.dosage <> b.dosage)
 select s.variant, round(median(s.s), 4) as slope, count(*) as pairs from s group by s.variant""")
def theil_sen(v):
    g = v.genotypes.withColumn("i", F.col("obs") * 10 + F.col("line"))
    return rounded(agg.theil_sen(g, ["variant"], "dosage", "expression", "i").select("variant", "slope", "pairs"), 4)


@query("fold_change", ("genotypes",), "select variant, round(avg(expression) filter (where dosage = 0), 4) as mean_ref, round(avg(expression) filter (where dosage = 2), 4) as mean_alt, round(log2(avg(expression) filter (where dosage = 2) / avg(expression) filter (where dosage = 0)), 4) as log2_fold from genotypes group by variant")
def fold_change(v):
    return rounded(agg.fold_change(v.genotypes, ["variant"], "dosage", "expression").drop("log2_allelic"), 4)


@query("allelic_imbalance", ("reads",), """, s as (select variant, sum(ref_reads) * 1e0 as r, sum(alt_reads) * 1e0 as a from reads group by variant having sum(ref_reads) + sum(alt_reads) > 0), g as (select variant, r, a, unnest(range(1, 1000)) / 1000e0 as q from s), l as (select variant, r, a, q, r * ln(q) + a * ln(1 - q) as ll from g), b as (select variant, r, a, arg_max(q, ll) as share, max(ll) as best from l group by variant, r, a)
 select variant, round(share, 3) as share, round(greatest(0, 2 * (best - (r + a) * ln(0.5))), 5) as d from b""")
def allelic_imbalance(v):
    a = agg.allelic_imbalance(v.reads, ["variant"], "ref_reads", "alt_reads")
    return a.select("variant", F.round("share", 3).alias("share"), F.round("d", 5).alias("d"))


@query("allelic_meta", ("reads",))
def allelic_meta(v):
    one = v.reads.groupBy("variant", "sample").agg(F.sum("ref_reads").alias("k"), (F.sum("ref_reads") + F.sum("alt_reads")).alias("n")).where("n > 0")
    z = one.withColumn("z", meta.signed_binomial_z(special.binomial_two_sided_p(F.col("k"), F.col("n")), F.col("k") / F.col("n")))
    return rounded(z.groupBy("variant").agg((F.sum("z") / F.sqrt(F.count("z").cast("double"))).alias("z")), 5)


@query("degree_stats", ("effects",), "select gene, round(avg(z), 6) as mean_z, round(sum(z), 4) as sum_z, round(avg(z * z), 6) as mean_z2, round(sum(z * z), 4) as sum_z2, count(*) filter (where abs(z) >= 1.96) as n_nominal, count(*) filter (where abs(z) >= 3) as n_strict from effects group by gene")
def degree_stats(v):
    d = agg.degree_stats(v.effects, ["gene"], "z", {"nominal": 1.96, "strict": 3.0})
    return d.select("gene", r("mean_z"), r("sum_z", 4), r("mean_z2"), r("sum_z2", 4), "n_nominal", "n_strict")


@query("profile_distances", (), "select a.vec_id as a, b.vec_id as b, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: abs(cast(x[1] as double) - cast(x[2] as double)))), 4) as city_block from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def profile_distances(v):
    a = v.embeddings.selectExpr("vec_id as a", "embedding as x")
    b = v.embeddings.selectExpr("vec_id as b", "vec_id - 1 as a", "embedding as y")
    return agg.distances(a.join(b, "a"), "x", "y").select("a", "b", r("city_block", 4))


@query("chi2_sums", ("effects",), "select dataset, gene, perm, round(sum(z * z), 4) as chi2, count(*) as n from effects group by dataset, gene, perm")
def chi2_sums(v):
    return v.effects.groupBy("dataset", "gene", "perm").agg(F.round(F.sum(F.col("z") * F.col("z")), 4).alias("chi2"), F.count("*").alias("n"))


@query("genomic_inflation", ("effects",), "select dataset, round(median(z * z) / 0.4549364, 6) as lambda from effects group by dataset")
def genomic_inflation(v):
    return rounded(testing.lambda_gc(v.effects, ["dataset"], "z"))


@query("reads_per_million", ("reads",), "select variant, sample, round(1e6 * sum(ref_reads) / max(total), 4) as per_million from (select variant, sample, ref_reads, sum(ref_reads) over (partition by sample) as total from reads) t group by variant, sample")
def reads_per_million(v):
    c = v.reads.groupBy("variant", "sample").agg(F.sum("ref_reads").alias("n"))
    return matrix.per_million(c, "sample", "n").select("variant", "sample", r("per_million", 4))


@query("collapse_items", ("genotypes", "variants"), "select coalesce(cast(v.chrom as string), '-') as chrom, g.dataset, round(avg(g.expression), 4) as mean, count(distinct g.variant) as items from genotypes g left join (select * from variants where variant % 3 > 0) v on g.variant = v.variant group by 1, 2")
def collapse_items(v):
    return rounded(matrix.collapse(v.genotypes, v.variants.where("variant % 3 > 0"), "variant", "chrom", ["dataset"], "expression"), 4)


# --- meta-analysis ---------------------------------------------------------------------------


@query("weighted_z", ("effects",), f", m as (select snp, count(z) as datasets, sum(n) as n, sum(sqrt(n) * z) / sqrt(sum(n)) as z from effects group by snp having count(z) >= 2) select snp, datasets, cast(n as bigint) as n, round(z, 6) as z, round({normal_p_sql('z')}, 6) as p from m")
def weighted_z(v):
    return rounded(meta.weighted_z(v.effects, ["snp"], "z", "n", least=2))


@query("weighted_z_by_size", ("effects",), "select snp, round(sum(n * z) / sqrt(sum(n * n)), 6) as z from effects group by snp")
def weighted_z_by_size(v):
    return rounded(meta.weighted_z(v.effects, ["snp"], "z", "n", weight="n").select("snp", "z"))


@query("weighted_z_flipped", ("effects",), "select snp, count(*) as datasets, round(sum(sqrt(n) * z * case when id % 2 = 0 then 1 else -1 end) / sqrt(sum(n)), 6) as z from effects where id % 6 > 0 group by snp")
def weighted_z_flipped(v):
    e = v.effects.withColumn("flip", F.expr("case when id % 6 = 0 then null when id % 2 = 0 then 1 else -1 end"))
    return rounded(meta.weighted_z(e, ["snp"], "z", "n", flip="flip").select("snp", "datasets", "z"))


@query("heterogeneity", ("effects",), ", s as (select snp, count(*) as k, greatest(0, sum(z * z) - pow(sum(sqrt(n) * z), 2) / sum(n)) as q from effects group by snp) select snp, k, round(q, 5) as q, round(case when k > 1 and q > 1e-9 then greatest(0, (q - (k - 1)) / q) else 0 end, 5) as i2 from s")
def heterogeneity(v):
    return rounded(meta.heterogeneity(v.effects, ["snp"], "z", "n"), 5)


@query("fixed_effect_correlation", ("genotypes",), f", {CORR_SQL}, e as (select variant, n - 3e0 as w, 0.5 * ln((1 + r) / (1 - r)) as z from corrs where abs(r) < 0.99999 and n > 3), s as (select variant, count(*) as k, sum(w) as w, sum(w * z) as wz, sum(w * z * z) as wzz from e group by variant) select variant, k, round(wz / w, 5) as fisher_z, round(greatest(0, wzz - wz * wz / w), 5) as q from s")
def fixed_effect_correlation(v):
    c = agg.correlate(v.genotypes, ["variant", "dataset"], "dosage", "expression").where("abs(r) < 0.99999")
    return rounded(meta.fixed_effect_correlation(c, ["variant"], "r", "n").select("variant", "k", "fisher_z", "q"), 5)


@query("leave_one_out", ("effects",), "select snp, id, round((sum(sqrt(n) * z) over w - sqrt(n) * z) / sqrt(sum(n) over w - n), 5) as z_without from effects window w as (partition by snp) qualify sum(n) over w - n > 0")
def leave_one_out(v):
    return rounded(meta.leave_one_out(v.effects, ["snp"], "id", "z", "n").where("z_without is not null"), 5)


@query("z_matrix", ("effects",), "select snp, " + ", ".join(f"round(min(z) filter (where gene = {g}), 6) as g{g}" for g in range(7)) + " from effects group by snp")
def z_matrix(v):
    e = v.effects.groupBy("snp", "gene").agg(F.min("z").alias("z"))
    m = meta.z_matrix(e, ["snp"], "gene", "z", list(range(7)))
    return m.select("snp", *(F.round(str(g), 6).alias(f"g{g}") for g in range(7)))


# --- ranks, order and multiple testing ----------------------------------------------------


@query("average_rank", ("genotypes",), "select variant, obs, line, rank() over (partition by variant order by dosage) + (count(*) over (partition by variant, dosage) - 1) / 2e0 as rank from genotypes where dosage is not null")
def average_rank(v):
    return ranks.ranked(v.genotypes, ["variant"], "dosage").select("variant", "obs", "line", "rank")


@query("sequential_rank", ("genotypes",), "select variant, obs, line, row_number() over (partition by variant order by dosage, obs * 10 + line) as rank from genotypes where dosage is not null")
def sequential_rank(v):
    g = v.genotypes.withColumn("i", F.col("obs") * 10 + F.col("line"))
    return ranks.ranked(g, ["variant"], "dosage", ties="sequential", tie_breaker="i").select("variant", "obs", "line", F.col("rank").cast("long").alias("rank"))


@query("inverse_normal", ("genotypes",))
def inverse_normal(v):
    return ranks.inverse_normal(v.genotypes, ["variant"], "expression").select("variant", "obs", "line", r("normal"))


@query("centre_scale", ("genotypes",), "select variant, obs, line, round((expression - avg(expression) over w) / stddev_samp(expression) over w, 5) as scaled from genotypes window w as (partition by variant) qualify stddev_samp(expression) over w > 1e-9")
def centre_scale(v):
    g = ranks.centre_scale(v.genotypes, ["variant"], "expression")
    return g.where("scaled is not null").select("variant", "obs", "line", r("scaled", 5))


QN_SQL = """, d as (select sample, i, avg(x) as x from (select l_suppkey % 20 as sample, l_partkey % 50 as i, l_extendedprice as x from lineitem) t group by 1, 2),
 o as (select *, row_number() over (partition by sample order by x) as place, rank() over (partition by sample order by x) + (count(*) over (partition by sample, x) - 1) / 2e0 as rk from d), m as (select place, avg(x) as mean from o group by place)
 select sample, i, round((a.mean + b.mean) / 2, 3) as normalised from o join m a on a.place = floor(rk) join m b on b.place = ceil(rk)"""


@query("quantile_normalise", (), "with" + QN_SQL[1:])
def quantile_normalise(v):
    d = v.lineitem.selectExpr("l_suppkey % 20 as sample", "l_partkey % 50 as i", "l_extendedprice as x").groupBy("sample", "i").agg(F.avg("x").alias("x"))
    return ranks.quantile_normalise(d, "sample", "x").select("sample", "i", r("normalised", 3))


@query("log2_shifted", ("peaks",), ", s as (select min(height) as lo from peaks) select peak, round(log2(height + case when lo <= 0 then -lo else 0 end + 1), 6) as log2 from peaks, s")
def log2_shifted(v):
    return ranks.log2_shifted(v.peaks, "height").select("peak", r("log2"))


@query("benjamini_hochberg", ("effects",), ", x as (select id, p, p * count(*) over () / row_number() over (order by p, id) as s from effects) select id, round(least(1, min(s) over (order by p, id rows between current row and unbounded following)), 6) as q from x")
def benjamini_hochberg(v):
    return testing.benjamini_hochberg(v.effects.select("id", "p"), "p", "id").select("id", r("q"))


@query("benjamini_hochberg_by_gene", ("effects",), ", x as (select id, gene, snp, p, p * count(*) over (partition by snp) / row_number() over (partition by snp order by p, id) as s from effects) select id, round(least(1, min(s) over (partition by snp order by p, id rows between current row and unbounded following)), 6) as q from x")
def benjamini_hochberg_by_gene(v):
    return testing.benjamini_hochberg_by(v.effects, ["snp"], "p", "id").select("id", r("q"))


@query("bonferroni", ("effects",), "select id, round(least(1, p * count(*) over ()), 6) as adjusted from effects")
def bonferroni(v):
    return testing.bonferroni(v.effects.select("id", "p"), "p").select("id", r("adjusted"))


@query("holm", ("effects",), ", x as (select id, p, row_number() over (order by p, id) as k, count(*) over () as n from effects), f as (select id, p, cast(p > 0.9 / (n - k + 1) as int) as fail from x) select id, (sum(fail) over (order by p, id rows unbounded preceding)) = 0 as rejected from f")
def holm(v):
    return testing.holm(v.effects.select("id", "p"), "p", "id", 0.9).select("id", "rejected")


@query("storey_pi0", ("effects",), "select dataset, count(*) as n, round(least(1, count(*) filter (where p > 0.5) / (count(*) * 0.5)), 6) as pi0 from effects group by dataset")
def storey_pi0(v):
    e = v.effects
    return e.groupBy("dataset").agg(F.count("*").alias("n"), F.round(F.least(F.lit(1.0), F.count_if(F.col("p") > 0.5) / (F.count("*") * 0.5)), 6).alias("pi0"))


FDR_SQL = ", c as (select p, sum(case when perm = 0 then 1 else 0 end) as nr, sum(case when perm > 0 then 1 else 0 end) as np from {src} group by p), x as (select p, nr, sum(nr) over (order by p) as n_real, sum(np) over (order by p) as n_permuted from c) select round(p, 9) as p, cast(n_real as bigint) as n_real, cast(n_permuted as bigint) as n_permuted, round(least(1, n_permuted / 4e0 / n_real), 6) as fdr from x where nr > 0"


@query("permutation_fdr", ("effects",), FDR_SQL.format(src="effects"))
def permutation_fdr(v):
    f = testing.permutation_fdr(v.effects.where("perm = 0"), v.effects.where("perm > 0"), "p", 4)
    return f.select(r("p", 9), "n_real", "n_permuted", r("fdr"))


@query("permutation_fdr_by_snp", ("effects",), ", s as (select p, perm from (select p, perm, row_number() over (partition by snp, perm order by p, id) as k from effects) t where k = 1)" + FDR_SQL.format(src="s"))
def permutation_fdr_by_snp(v):
    f = testing.fdr_at_level(v.effects.where("perm = 0"), v.effects.where("perm > 0"), ["snp"], "perm", "p", "id", 4)
    return f.select(r("p", 9), "n_real", "n_permuted", r("fdr"))


@query("apply_thresholds", ("effects",), ", t as (select p, max(gene / 10e0) as fdr from effects where perm = 1 group by p), j as (select e.id, e.p, t.p as tp, t.fdr from effects e left join t on false where perm = 0 union all select null, p, p, fdr from t) select e.id, (select arg_max(t.fdr, t.p) from t where t.p <= e.p) as fdr from effects e where perm = 0")
def apply_thresholds(v):
    t = v.effects.where("perm = 1").groupBy("p").agg((F.max("gene") / 10).alias("fdr"))
    return testing.apply_thresholds(v.effects.where("perm = 0").select("id", "p"), t, "p").select("id", "fdr")


@query("qq_points", ("effects",), "select id, round(-log10(row_number() over (order by p, id) * 1e0 / (count(*) over () + 1)), 6) as expected, round(-log10(p), 6) as observed from effects")
def qq_points(v):
    return rounded(testing.qq(v.effects.select("id", "p"), "p", "id"))


@query("top_association", ("effects",), "select snp, id, round(p, 6) as p from (select *, row_number() over (partition by snp order by p, abs(z) desc, id) as k from effects) t where k = 1")
def top_association(v):
    return testing.strongest(v.effects, ["snp"], ["p", F.desc(F.abs("z")), "id"]).select("snp", "id", r("p"))


@query("top_n", ("effects",), "select id, round(p, 6) as p from effects order by p, abs(z) desc, id limit 500")
def top_n(v):
    return v.effects.orderBy("p", F.desc(F.abs("z")), "id").limit(500).select("id", r("p"))


@query("cumulative_share", ("genotypes",), "select variant, obs, line, round(100 * sum(expression) over (partition by variant order by obs, line, expression, depth) / sum(expression) over (partition by variant), 5) as percent from genotypes")
def cumulative_share(v):
    c = ranks.cumulative_share(v.genotypes, ["variant"], ["obs", "line", "expression", "depth"], "expression")
    return c.select("variant", "obs", "line", r("percent", 5))


@query("global_running_total", ("effects",), "select id, cast(sum(n) over (order by p, id rows unbounded preceding) as bigint) as running from effects")
def global_running_total(v):
    return ordered.running_sums(v.effects.select("id", "p", "n"), "p", ["p", "id"], {"running": F.col("n")}).select("id", "running")


# --- intervals and reshaping -----------------------------------------------------------------


@query("merge_intervals", ("peaks",), ", x as (select chrom, start, stop, case when start > max(stop) over (partition by chrom order by start, stop rows between unbounded preceding and 1 preceding) then 1 else 0 end as fresh from peaks), y as (select *, sum(fresh) over (partition by chrom order by start, stop rows unbounded preceding) as island from x) select chrom, min(start) as start, max(stop) as stop, count(*) as n from y group by chrom, island")
def merge_intervals(v):
    return intervals.merge_spans(v.peaks, ["chrom"], "start", "stop")


@query("drop_contained_intervals", ("peaks",), ", d as (select distinct chrom, start, stop from peaks), x as (select *, max(stop) over (partition by chrom order by start, stop desc rows between unbounded preceding and 1 preceding) as reach from d) select chrom, start, stop from x where reach is null or stop > reach")
def drop_contained_intervals(v):
    return intervals.drop_contained(v.peaks, ["chrom"], "start", "stop").select("chrom", "start", "stop")


@query("union_results", ("effects",), TWO + " select snp, gene, round(z, 6) as z from one union all select snp, gene, round(z, 6) from two")
def union_results(v):
    a, b = _two(v)
    return a.unionByName(b).select("snp", "gene", r("z"))


@query("first_per_key", ("effects",), "select snp, min(id) as id from effects group by snp")
def first_per_key(v):
    return testing.strongest(v.effects, ["snp"], ["id"]).select("snp", "id")


@query("split_in_batches", ("variants",), "select chrom, cast(variant % 8 as int) as batch, count(*) as n from variants group by 1, 2")
def split_in_batches(v):
    return v.variants.groupBy("chrom", F.expr("cast(variant % 8 as int) as batch")).agg(F.count("*").alias("n"))


@query("transpose", ("effects",), "select gene, snp, round(min(z), 6) as z from effects group by gene, snp")
def transpose(v):
    cells = v.effects.groupBy("snp", "gene").agg(F.min("z").alias("z"))
    return matrix.transpose(cells, "snp", "gene", "z").select(F.col("snp").alias("gene"), F.col("gene").alias("snp"), r("z"))


@query("wide_and_long", ("effects",), "select snp, 'g' || cast(gene as string) as column, round(min(z), 6) as value from effects group by snp, gene")
def wide_and_long(v):
    cells = v.effects.select("snp", F.concat(F.lit("g"), F.col("gene").cast("string")).alias("g"), "z").groupBy("snp", "g").agg(F.min("z").alias("z"))
    wide = matrix.to_wide(cells, "snp", "g", "z", [f"g{i}" for i in range(7)])
    return rounded(matrix.to_long(wide, "snp", [f"g{i}" for i in range(7)]).where("value is not null"))


@query("symmetric_matrix", ("variants",), ", p as (select variant as a, variant + 1 as b, chrom * 1e0 as w from variants) select a, b, w from p union all select b, a, w from p")
def symmetric_matrix(v):
    return matrix.symmetric(v.variants.selectExpr("variant as a", "variant + 1 as b", "chrom * 1e0 as w"), "a", "b", "w")


@query("matrix_to_edges", ("effects",), ", c as (select snp % 50 as a, id % 50 as b, max(z) as w from effects group by 1, 2) select a, b, round(w, 6) as w from c where a < b and w > 0.5")
def matrix_to_edges(v):
    c = v.effects.selectExpr("snp % 50 as a", "id % 50 as b", "z").groupBy("a", "b").agg(F.max("z").alias("w"))
    return matrix.upper_pairs(c, "a", "b", "w", 0.5).select("a", "b", r("w"))


@query("set_indicators", (), "select p_partkey as item, p_brand as grp, 1 as value from part group by p_partkey, p_brand")
def set_indicators(v):
    return matrix.indicator(v.part.selectExpr("p_partkey as item", "p_brand as grp"), "item", "grp").select("item", "grp", "value")


@query("sorted_by_chromosome", ("variants",), ", c as (select variant, pos, case chrom when 0 then '1' when 1 then '10' when 2 then 'X' when 3 then 'MT' else '2' end as name from variants) select name, row_number() over (order by case when name = 'MT' then 3 when name in ('X', 'Y') then 2 when length(name) = 1 then 0 else 1 end, name) as place, n from (select name, count(*) as n from c group by name) t")
def sorted_by_chromosome(v):
    named = v.variants.withColumn("name", F.expr("case chrom when 0 then '1' when 1 then '10' when 2 then 'X' when 3 then 'MT' else '2' end"))
    from pyspark.sql.window import Window

    n = named.groupBy("name").agg(F.count("*").alias("n"))  # one row per chromosome
    return n.select("name", F.row_number().over(Window.orderBy(alleles.chromosome_order(F.col("name")))).cast("long").alias("place"), "n")


# --- scalar functions ------------------------------------------------------------------------


@query("normal_tail", ("effects",), f"select id, round({normal_p_sql('z * 2')}, 7) as p from effects")
def normal_tail(v):
    return v.effects.select("id", F.round(stats.two_sided_normal_p(F.col("z") * 2), 7).alias("p"))


@query("effect_sizes", ("effects",), "select id, round(z / sqrt(2 * m * (1 - m) * (n + z * z)), 6) as beta, round(1 / sqrt(2 * m * (1 - m) * (n + z * z)), 6) as se, round(z / sqrt(n - 2 + z * z), 6) as r from (select id, z, n, 0.05 + id % 9 * 0.05e0 as m from effects) t")
def effect_sizes(v):
    z, n, m = F.col("z"), F.col("n"), F.expr("0.05e0 + id % 9 * 0.05e0")
    return rounded(v.effects.select("id", stats.z_to_beta(z, m, n).alias("beta"), stats.z_to_se(z, m, n).alias("se"), stats.z_to_r(z, n).alias("r")))


@query("correlation_scores", ("genotypes",), f", {CORR_SQL} select variant, dataset, round(0.5 * ln((1 + r) / (1 - r)), 5) as fisher_z, round(r * sqrt((n - 2) / (1 - r * r)), 4) as t from corrs where n > 4 and abs(r) < 0.999")
def correlation_scores(v):
    c = agg.correlate(v.genotypes, ["variant", "dataset"], "dosage", "expression").where("n > 4 and abs(r) < 0.999")
    return c.select("variant", "dataset", F.round(stats.fisher_z(F.col("r")), 5).alias("fisher_z"), F.round(stats.correlation_t(F.col("r"), F.col("n")), 4).alias("t"))


@query("correlation_p", ("genotypes",))
def correlation_p(v):
    c = agg.correlate(v.genotypes, ["variant", "dataset"], "dosage", "expression").where("n > 4")
    return c.select("variant", "dataset", "n", F.round(special.t_two_sided_p(stats.correlation_t(F.col("r"), F.col("n")), F.col("n") - 2), 8).alias("p"))


@query("methylation_values", ("effects",), "select id, round(log2(p / (1 - p)), 6) as m, round(pow(2, z) / (pow(2, z) + 1), 6) as beta from effects where p > 0 and p < 1")
def methylation_values(v):
    return rounded(v.effects.where("p > 0 and p < 1").select("id", stats.m_value(F.col("p")).alias("m"), stats.beta_value(F.col("z")).alias("beta")))


@query("sequence_functions", (), "select p_partkey as id, translate(upper(p_name), 'ACGT', 'TGCA') as comp, round(case when length(p_name) > 0 then (length(p_name) - length(translate(upper(p_name), 'GC', ''))) * 1e0 / length(p_name) end, 6) as gc from part")
def sequence_functions(v):
    return v.part.select(F.col("p_partkey").alias("id"), alleles.complement(F.upper("p_name")).alias("comp"), F.round(alleles.gc_content(F.col("p_name")), 6).alias("gc"))


@query("parse_regions", ("peaks",), "select peak, cast(chrom as string) as chrom, start, stop from peaks")
def parse_regions(v):
    t = v.peaks.select("peak", alleles.region(F.expr("concat(chrom, ':', start, '-', stop)")).alias("x"))
    return t.select("peak", "x.chrom", "x.start", "x.stop")


@query("dosage_conversions", ("genotypes",), ", d as (select obs, line, case when dosage is not null then dosage * 0.9e0 + 0.1 end as d from genotypes) select obs, line, case when d is null then null when d < 0.5 then 'AA' when d < 1.5 then 'AG' else 'GG' end as call, case when d is null then null when d < 0.5 then 0 when d < 1.5 then 1 else 2 end as n_alt from d")
def dosage_conversions(v):
    d = v.genotypes.select("obs", "line", F.expr("case when dosage is not null then dosage * 0.9e0 + 0.1e0 end").alias("d"))
    c = d.withColumn("alleles", alleles.dosage_to_call(F.col("d"), F.lit("A"), F.lit("G")))
    return c.select("obs", "line", F.array_join("alleles", "").alias("call"), alleles.alternate_count(F.col("alleles"), F.lit("A")).alias("n_alt"))


@query("probability_conversions", ("genotypes",), ", q as (select obs, line, (depth % 4) * 1e0 as a, (quality * 1e0) as b, dosage * 1e0 as c from genotypes where dosage is not null) select obs, line, round(case when a + b + c > 0 then (b + 2 * c) / (a + b + c) end, 6) as dosage from q")
def probability_conversions(v):
    g = v.genotypes.where("dosage is not null").select("obs", "line", F.array(F.expr("(depth % 4) * 1e0"), F.col("quality").cast("double"), F.col("dosage").cast("double")).alias("p"))
    return g.select("obs", "line", F.round(alleles.probabilities_to_dosage(F.col("p")), 6).alias("dosage"))


# --- linkage disequilibrium, clumping, scores ----------------------------------------------


def _calls(v):
    return v.genotypes.where("dosage is not null").groupBy("variant", "sample").agg(F.min("dosage").alias("dosage"))


CALLS_SQL = "calls as (select variant, sample, min(dosage) as dosage from genotypes where dosage is not null group by variant, sample), near as (select a.variant as a, b.variant as b from variants a join variants b on a.chrom = b.chrom and a.variant < b.variant and abs(a.pos - b.pos) < 3000), j as (select a, b, x.dosage as x, y.dosage as y from near join calls x on x.variant = a join calls y on y.variant = b and y.sample = x.sample)"


@query("ld_counts", ("genotypes", "variants"), f", {CALLS_SQL} select a, b, " + ", ".join(f"count(*) filter (where x = {i} and y = {k}) as n{i}{k}" for i in range(3) for k in range(3)) + " from j group by a, b")
def ld_counts(v):
    return ld.pair_counts(_calls(v), ld.nearby_pairs(v.variants, "variant", "chrom", "pos", 3000), "variant", "sample", "dosage")


@query("ld_r2", ("genotypes", "variants"), f", {CALLS_SQL} select a, b, count(*) as n, round(pow(case when min(x) < max(x) and min(y) < max(y) then corr(x, y) end, 2), 9) as r2 from j group by a, b")
def ld_r2(v):
    c = ld.pair_counts(_calls(v), ld.nearby_pairs(v.variants, "variant", "chrom", "pos", 3000), "variant", "sample", "dosage")
    return rounded(ld.genotype_r2(c), 9)


@query("ld_haplotypes", ("genotypes", "variants"))
def ld_haplotypes(v):
    c = ld.pair_counts(_calls(v), ld.nearby_pairs(v.variants, "variant", "chrom", "pos", 3000), "variant", "sample", "dosage")
    return rounded(ld.em_ld(c))


@query("ld_proxies", ("genotypes", "variants"), f", {CALLS_SQL}, r as (select a, b, pow(case when min(x) < max(x) and min(y) < max(y) then corr(x, y) end, 2) as r2 from j group by a, b) select a, b, round(r2, 9) as r2 from r where r2 >= 0.30001")
def ld_proxies(v):
    return rounded(ld.proxies(v.variants, _calls(v), "variant", "chrom", "pos", "sample", "dosage", 3000, 0.30001), 9)


@query("clump_loci", ("effects", "variants"))
def clump_loci(v):
    best = testing.strongest(v.effects, ["snp"], ["p", "id"]).select(F.col("snp").alias("variant"), "p")
    hits = v.variants.select("variant", "chrom", "pos").join(best, "variant").where("p < 0.02")
    return ld.clump(hits, "chrom", "pos", "p", "variant", 5000).select("variant", "chrom", "locus")


@query("risk_scores", ("genotypes", "variants"), ", c as (select variant from genotypes where variant in (select variant from variants) group by variant having count(dosage) * 1e0 / count(*) >= 0.9) select sample, round(sum(dosage * (score - 1000) / 1000), 4) as score, count(*) as n from genotypes g join variants v on g.variant = v.variant where g.variant in (select variant from c) and dosage is not null group by sample")
def risk_scores(v):
    w = v.variants.selectExpr("variant", "(score - 1000) / 1000 as weight")
    return rounded(ld.risk_scores(v.genotypes, w, "variant", "sample", "dosage", "weight", 0.9), 4)


# --- gene sets and prioritisation ----------------------------------------------------------


MEMBERS_SQL = "members as (select p_partkey as item, p_brand as grp from part), hits as (select p_partkey as item, p_retailprice > 1200 as hit, p_retailprice as score from part)"


def _sets(v):
    return v.part.selectExpr("p_partkey as item", "p_brand as grp"), v.part.selectExpr("p_partkey as item", "p_retailprice > 1200 as hit", "p_retailprice as score")


@query("set_tables", (), f"with {MEMBERS_SQL} select grp, count(*) filter (where hit) as a, (select count(*) from hits where hit) - count(*) filter (where hit) as b, count(*) filter (where not hit) as c, (select count(*) from hits where not hit) - count(*) filter (where not hit) as d from members m join hits h on m.item = h.item group by grp")
def set_tables(v):
    m, h = _sets(v)
    return enr.set_tables(h, m, "item", "grp", "hit")


@query("set_fisher", ())
def set_fisher(v):
    m, h = _sets(v)
    return rounded(enr.fisher_enrichment(h, m, "item", "grp", "hit", 5), 8)


@query("set_rank_enrichment", (), f"with {MEMBERS_SQL}, r as (select item, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2e0 as rk, count(*) over () as total from hits), s as (select grp, count(*) * 1e0 as n1, max(total) - count(*) * 1e0 as n2, sum(rk) as r1 from members m join r on m.item = r.item group by grp) select grp, cast(n1 as bigint) as n, round((r1 - n1 * (n1 + 1) / 2) / (n1 * n2), 6) as auc, round((r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 5) as z from s")
def set_rank_enrichment(v):
    m, h = _sets(v)
    e = enr.rank_enrichment(h, m, "item", "grp", "score")
    return e.select("grp", "n", r("auc"), r("z", 5))


@query("prioritise_genes", ("effects",), ", t as (select snp, sum(z) / sqrt(count(z)) as score from effects where gene in (1, 3, 5) group by snp) select snp, round(score, 6) as score, row_number() over (order by score desc, snp) as rank from t")
def prioritise_genes(v):
    terms = v.spark.createDataFrame([(1,), (3,), (5,)], "gene long")
    p = enr.prioritise(v.effects, terms, "snp", "gene", "z", "id")
    return p.select("snp", r("score"), F.col("rank").cast("long").alias("rank"))


@query("ontology_roll_up", (), """with recursive edges as (select 'c' || c_custkey as term, 'n' || c_nationkey as parent from customer union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all select 'r' || r_regionkey, 'root' from region),
 usable as (select 'n' || n_nationkey as term from nation where n_nationkey % 2 = 0 union all select 'r' || r_regionkey from region), terms as (select distinct term from edges where term like 'c%'),
 up as (select term, term as used, term in (select term from usable) as done from terms union all select u.term, e.parent, e.parent in (select term from usable) from up u join edges e on u.used = e.term where not u.done) select distinct term, used from up where done""")
def ontology_roll_up(v):
    c = v.customer.selectExpr("concat('c', c_custkey) as term", "concat('n', c_nationkey) as parent")
    n = v.nation.selectExpr("concat('n', n_nationkey) as term", "concat('r', n_regionkey) as parent")
    top = v.region.selectExpr("concat('r', r_regionkey) as term", "'root' as parent")
    usable = v.nation.where("n_nationkey % 2 = 0").selectExpr("concat('n', n_nationkey) as term").union(v.region.selectExpr("concat('r', r_regionkey) as term"))
    return enr.roll_up(c.select("term"), c.union(n).union(top), usable, "term", "parent")


@query("ontology_descendants", (), "with edges as (select 'n' || n_nationkey as term, 'r' || n_regionkey as parent from nation union all select 's' || s_suppkey, 'n' || s_nationkey from supplier) select parent as ancestor, term from edges union select e.parent, f.term from edges e join edges f on e.term = f.parent")
def ontology_descendants(v):
    n = v.nation.selectExpr("concat('n', n_nationkey) as term", "concat('r', n_regionkey) as parent")
    s = v.supplier.selectExpr("concat('s', s_suppkey) as term", "concat('n', s_nationkey) as parent")
    return enr.descendants(n.union(s), "term", "parent")


@query("expand_annotations", ("effects",), ", m as (select distinct snp as item, gene as grp from effects where perm = 0), big as (select grp from m group by grp having count(*) >= 10), k as (select item, grp from m where grp in (select grp from big)) select item, grp, false as predicted from k union all select item, grp, true from (select distinct snp as item, gene as grp from effects where z >= 1.5 and gene in (select grp from big) except select item, grp from k) t")
def expand_annotations(v):
    m = v.effects.where("perm = 0").selectExpr("snp as item", "gene as grp")
    s = v.effects.selectExpr("snp as item", "gene as grp", "z")
    return enr.expand_annotations(s, m, "item", "grp", "z", 1.5, 10)


@query("real_against_permuted", ("effects", "variants", "peaks"), ", h as (select e.id, e.perm = 0 as is_real, exists (select 1 from peaks p where p.chrom = v.chrom and v.pos between p.start and p.stop) as hit, e.dataset from effects e join variants v on e.snp = v.variant) select dataset, count(*) filter (where is_real and hit) as a, count(*) filter (where is_real and not hit) as b, count(*) filter (where not is_real and hit) as c, count(*) filter (where not is_real and not hit) as d from h group by dataset")
def real_against_permuted(v):
    hit = intervals.point_join(v.variants, v.peaks, ["chrom"], "pos", "start", "stop", 500, "left_semi").selectExpr("variant as snp", "true as hit")
    e = v.effects.join(v.variants.selectExpr("variant as snp"), "snp").join(hit, "snp", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return enr.real_against_permuted(e, ["dataset"], F.col("perm") == 0, F.col("hit")).select("dataset", "a", "b", "c", "d")


@query("distinct_sets", (), "select count(*) as n, min(grp) as grp from (select p_brand as grp, list_sort(list(distinct p_size)) as m from part group by p_brand) t group by m")
def distinct_sets(v):
    s = enr.distinct_sets(v.part.selectExpr("p_size as item", "p_brand as grp"), "item", "grp")
    full = v.part.groupBy(F.col("p_brand").alias("grp")).agg(F.array_sort(F.collect_set("p_size")).alias("m")).groupBy("m").agg(F.count("*").alias("n"), F.min("grp").alias("grp"))
    return full.select("n", "grp").join(s.select("grp"), "grp", "left_semi").select("n", "grp")


# --- fits that need a solver ---------------------------------------------------------------


@query("principal_components", ())
def principal_components(v):
    means, scales, _, vectors = matrix.principal_components(v.embeddings, "embedding", 5)
    p = matrix.project(v.embeddings.select("vec_id", "embedding"), "embedding", means, scales, vectors)
    return p.select("vec_id", F.transform("scores", lambda x: F.round(x, 4)).alias("scores"))


@query("remove_components", ())
def remove_components(v):
    means, _, _, vectors = matrix.principal_components(v.embeddings, "embedding", 3)
    x = matrix.remove_components(v.embeddings.select("vec_id", "embedding"), "embedding", means, vectors)
    return x.select("vec_id", F.round(F.aggregate("residual", F.lit(0.0), lambda s, y: s + y * y), 4).alias("power"))


@query("regress_out_covariates", ())
def regress_out_covariates(v):
    import numpy as np

    i = np.arange(64.0)
    x = matrix.regress_out(v.embeddings.select("vec_id", "embedding"), "embedding", np.column_stack([i, i * i, 2 * i]))
    return x.select("vec_id", F.round(F.aggregate("residual", F.lit(0.0), lambda s, y: s + y * y), 4).alias("power"))


@query("column_covariance", (), "select i, j, round(covar_samp(a, b), 6) as covariance from (select x.i, y.i as j, x.v as a, y.v as b from (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding) as v from embeddings) x join (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding) as v from embeddings) y on x.vec_id = y.vec_id) t group by i, j")
def column_covariance(v):
    return rounded(matrix.covariances(v.embeddings, "embedding"))


@query("deconvolve_cells", ("genotypes",))
def deconvolve_cells(v):
    g = v.genotypes.where("dosage is not null").withColumn("c1", F.expr("0.2 + (sample % 5) * 0.1")).withColumn("c2", F.expr("0.8 - (sample % 5) * 0.1"))
    return rounded(models.deconvolve(g, ["variant"], "expression", "dosage", ["c1", "c2"]), 5)


@query("beta_adjusted_p", ("effects",))
def beta_adjusted_p(v):
    least = v.effects.groupBy("gene", F.expr("cast(floor(id / 7) as bigint) % 21").alias("perm")).agg(F.min("p").alias("p"))
    return rounded(models.beta_adjusted(least, "gene", "perm", "p"), 8)


@query("dataset_report", ("genotypes", "variants"), f", {SUMMARY_SQL} select v.chrom, count(*) as variants, sum(s.called) as called, round(avg(s.maf), 5) as mean_maf, round(avg(s.mach_r2), 5) as mean_mach_r2 from summary s join variants v on s.variant = v.variant group by v.chrom")
def dataset_report(v):
    s = agg.variant_summary(v.genotypes, ["variant"], "dosage").join(v.variants.select("variant", "chrom"), "variant")
    return s.groupBy("chrom").agg(F.count("*").alias("variants"), F.sum("called").alias("called"), F.round(F.avg("maf"), 5).alias("mean_maf"), F.round(F.avg("mach_r2"), 5).alias("mean_mach_r2"))


# --- workflows -------------------------------------------------------------------------------


from . import workflows as flow  # noqa: E402


def _traits(v):
    return v.genotypes.selectExpr("variant % 100 + 1 as gene", "sample", "dataset", "expression as value").groupBy("gene", "sample", "dataset").agg(F.avg("value").alias("value"))


TRAITS_SQL = "traits as (select variant % 100 + 1 as gene, sample, dataset, avg(expression) as value from genotypes group by 1, 2, 3), calls0 as (select variant, sample, min(dosage) as dosage from genotypes where dosage is not null group by 1, 2), pairs as (select v.variant, g.gene from variants v join genes g on v.chrom = g.chrom and abs(v.pos - g.mid) < 20000), ind as (select p.variant, p.gene, t.dataset, count(*) as n, case when min(c.dosage) < max(c.dosage) and min(t.value) < max(t.value) then corr(c.dosage, t.value) end as r from pairs p join calls0 c on c.variant = p.variant join traits t on t.gene = p.gene and t.sample = c.sample group by 1, 2, 3)"


@query("association", ("genotypes", "variants", "genes"), f", {TRAITS_SQL} select variant, gene, dataset, n, round(r, 5) as r from ind where n >= 5 and abs(r) < 0.999")
def association(v):
    pairs = intervals.band_join(v.variants, v.genes, ["chrom"], "pos", "mid", 20000)
    a = flow.associate(pairs, _calls(v), _traits(v), ["dataset"], "variant", "gene", "sample", "dosage", "value", least=5)
    return a.where("abs(r) < 0.999").select("variant", "gene", "dataset", "n", r("r", 5))


@query("cis_mapping", ("genotypes", "variants", "genes"), f", {TRAITS_SQL}, t as (select *, r * sqrt((n - 2) / (1 - r * r)) as t from ind where n >= 5 and abs(r) < 0.999), z as (select *, sign(t) * (8 * (n - 2) + 1e0) / (8 * (n - 2) + 3) * sqrt((n - 2) * ln(1 + t * t / (n - 2))) as z from t) select variant, gene, count(*) as datasets, round(sum(sqrt(n) * z) / sqrt(sum(n)), 5) as z from z group by variant, gene having count(*) >= 2")
def cis_mapping(v):
    pairs = intervals.band_join(v.variants, v.genes, ["chrom"], "pos", "mid", 20000)
    a = flow.associate(pairs, _calls(v), _traits(v), ["dataset"], "variant", "gene", "sample", "dosage", "value", least=5).where("abs(r) < 0.999")
    return meta.weighted_z(a, ["variant", "gene"], "z", "n", least=2).select("variant", "gene", "datasets", r("z", 5))


@query("cis_mapping_with_fdr", ())
def cis_mapping_with_fdr(v):
    m = flow.cis_mapping(v.variants, v.genes, _calls(v), _traits(v), 5000, maf=0.05, call_rate=0.5, permutations=3, seed=7)
    return rounded(m.select("variant", "gene", "datasets", "z", "p", "fdr"), 5)


@query("top_with_beta", ("effects",))
def top_with_beta(v):
    e = v.effects.selectExpr("gene", "snp as variant", "cast(floor(id / 7) as bigint) % 21 as perm", "p", "z")
    return rounded(flow.top_with_beta(e, "gene", "variant", "perm", "p", "z").select("gene", "variant", "p", "adjusted"), 8)


@query("conditional_mapping", ())
def conditional_mapping(v):
    pairs = intervals.band_join(v.variants, v.genes, ["chrom"], "pos", "mid", 5000)
    t = _traits(v).groupBy("gene", "sample").agg(F.avg("value").alias("value"))
    return rounded(flow.conditional_mapping(pairs, _calls(v), t, 0.01).select("round", "variant", "gene", "n", "z"), 5)


@query("mediation", ("genotypes",), """, v as (select variant, dosage * 1e0 as x, quantity as m, expression as y from genotypes where dosage is not null), a as (select variant, count(*) as n, regr_slope(y, x) as total, regr_slope(y, m) as b, regr_intercept(y, m) as a from v group by variant), d as (select v.variant, regr_slope(y - a.a - a.b * m, x) as direct from v join a on v.variant = a.variant group by v.variant)
 select a.variant, n, round(total, 4) as total, round(direct, 4) as direct from a join d on a.variant = d.variant where total is not null and direct is not null""")
def mediation(v):
    g = v.genotypes.withColumn("x", F.col("dosage").cast("double"))
    return rounded(flow.mediation(g, ["variant"], "x", "quantity", "expression").where("total is not null and direct is not null").select("variant", "n", "total", "direct"), 4)


@query("sample_mixups", ())
def sample_mixups(v):
    calls = _calls(v)
    eff = v.variants.selectExpr("variant", "variant % 100 + 1 as gene")
    t = _traits(v).groupBy("gene", "sample").agg(F.avg("value").alias("value"))
    return rounded(flow.mixups(eff, calls, t), 4)


@query("harmonise_panels", ("variants", "peaks"))
def harmonise_panels(v):
    study = v.variants.selectExpr("variant", "chrom", "pos - pos % 130 as pos", "ref", "alt", "0.05 + variant % 9 * 0.05 as maf").where("ref != alt")
    ref = v.peaks.selectExpr("peak as ref_id", "chrom", "start as pos", "substr('ACGT', cast(peak % 4 as int) + 1, 1) as ref", "substr('CGTA', cast(peak % 4 as int) + 1, 1) as alt", "0.05 + peak % 9 * 0.05 as maf")
    return flow.harmonise(study, ref)


@query("gene_scores", ("effects", "variants", "genes"), ", b as (select snp as variant, max(z) as z from effects group by snp) select g.gene, count(b.z) as n, round(sum(b.z * b.z), 5) as chi2 from b join variants v on b.variant = v.variant join genes g on v.chrom = g.chrom and v.pos between g.start - 2000 and g.stop + 2000 group by g.gene")
def gene_scores(v):
    best = v.effects.groupBy(F.col("snp").alias("variant")).agg(F.max("z").alias("z"))
    return flow.gene_scores(best, v.variants, v.genes, 2000).select("gene", "n", r("chi2", 5), r("p"))


@query("clumped_risk_scores", ())
def clumped_risk_scores(v):
    best = testing.strongest(v.effects, ["snp"], ["p", "id"]).selectExpr("snp as variant", "p", "z as weight")
    return rounded(flow.clumped_risk_score(best, v.genotypes, v.variants, 0.1, 2000), 4)


@query("ld_pruned", ("genotypes", "variants"))
def ld_pruned(v):
    links = ld.proxies(v.variants, _calls(v), "variant", "chrom", "pos", "sample", "dosage", 3000, 0.30001)
    return ld.prune(v.variants, links, "variant", "pos").select("variant", "chrom", "pos")


@query("ld_clusters", ("genotypes", "variants"), f"")
def ld_clusters(v):
    links = ld.proxies(v.variants, _calls(v), "variant", "chrom", "pos", "sample", "dosage", 3000, 0.30001)
    return ld.components(links)


SQL["ld_clusters"] = with_views("genotypes", "variants").replace("with ", "with recursive ", 1) + f", {CALLS_SQL}, r as (select a, b, pow(case when min(x) < max(x) and min(y) < max(y) then corr(x, y) end, 2) as r2 from j group by a, b), e as (select a, b from r where r2 >= 0.30001 union select b, a from r where r2 >= 0.30001), c as (select a as node, a as reach from e union select c.node, e.b from c join e on c.reach = e.a) select node, min(reach) as component from c group by node"


@query("allelic_concordance", ("reads", "effects", "variants"), ", a as (select variant, sum(ref_reads) * 1e0 / (sum(ref_reads) + sum(alt_reads)) as share from reads group by variant having sum(ref_reads) + sum(alt_reads) > 0), m as (select snp as variant, max(z) as z from effects group by snp), j as (select a.variant, a.share, case when m.variant % 2 = 0 then m.z else -m.z end as za from a join m on a.variant = m.variant join variants v on v.variant = a.variant) select variant, round(za, 6) as z_aligned, (share > 0.5 and za > 0) or (share < 0.5 and za < 0) as agree from j")
def allelic_concordance(v):
    a = v.reads.groupBy("variant").agg(F.sum("ref_reads").alias("x"), F.sum("alt_reads").alias("y")).where("x + y > 0").selectExpr("variant", "x / (x + y) as share")
    m = v.effects.groupBy(F.col("snp").alias("variant")).agg(F.max("z").alias("z")).join(v.variants.select("variant", "alt"), "variant").selectExpr("variant", "z", "alt", "case when variant % 2 = 0 then alt else '-' end as assessed")
    return flow.concordance(a, m, ["variant"]).select("variant", r("z_aligned"), "agree")
