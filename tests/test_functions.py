import math

import numpy as np
from pyspark.sql import functions as F

from lociframe.functions import alleles, special, stats


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_normal_tail_and_quantile(spark):
    r = one(spark, p=stats.two_sided_normal_p(F.lit(2.0)), z=stats.probit(F.lit(0.975)), low=stats.probit(F.lit(1e-10)), out=stats.probit(F.lit(0.0)), null=stats.probit(F.lit(None).cast("double")))
    assert abs(r.p - 0.04550026) < 1e-6
    assert abs(r.z - 1.959963985) < 1e-7
    assert abs(r.low + 6.361340902) < 1e-6
    assert r.out is None and r.null is None


def test_exact_tails(spark):
    r = one(spark, t=special.t_two_sided_p(F.lit(2.0), F.lit(10)), f=special.f_upper_p(F.lit(4.0), F.lit(2), F.lit(20)), c=special.chi2_upper_p(F.lit(3.841458821), F.lit(1)), b=special.binomial_two_sided_p(F.lit(2), F.lit(10)), null=special.t_two_sided_p(F.lit(None), F.lit(3)))
    assert abs(r.t - 0.07338803) < 1e-7
    assert abs(r.f - 0.03459) < 1e-4
    assert abs(r.c - 0.05) < 1e-8
    assert abs(r.b - 2 * (1 + 10 + 45) / 1024) < 1e-12
    assert r.null is None


def test_fisher_tails(spark):
    a = [F.lit(x) for x in (3, 1, 1, 3)]
    r = one(spark, two=special.fisher_exact_p(*a), left=special.fisher_exact_p(*a, side="left"), right=special.fisher_exact_p(*a, side="right"))
    assert abs(r.two - 34 / 70) < 1e-9
    assert abs(r.left - 69 / 70) < 1e-9
    assert abs(r.right - 17 / 70) < 1e-9


def test_hwe(spark):
    r = one(spark, p=special.hwe_exact_p(F.lit(57), F.lit(14), F.lit(50)), none=special.hwe_exact_p(F.lit(0), F.lit(0), F.lit(0)))
    assert abs(r.p - 0.842279756) < 1e-6  # a published example
    assert r.none is None


def test_alleles(spark):
    ag, tc, at = (F.array(*(F.lit(x) for x in s)) for s in ("AG", "TC", "AT"))
    r = one(spark, comp=alleles.complement(F.lit("ACGTN")), rc=alleles.reverse_complement(F.lit("AAC")), amb=alleles.is_ambiguous(at), not_amb=alleles.is_ambiguous(ag), flip=alleles.flip(ag, F.lit("A"), tc, F.lit("T")), opposite=alleles.flip(ag, F.lit("A"), tc, F.lit("C")), none=alleles.flip(ag, F.lit("A"), at, F.lit("A")), gc=alleles.gc_content(F.lit("GGCA")), chrom=alleles.chromosome(F.lit("chrM")), region=alleles.region(F.lit("3:10-20")), bad=alleles.region(F.lit("x")), v=alleles.strip_version(F.lit("ENSG1.5")))
    assert (r.comp, r.rc, r.amb, r.not_amb) == ("TGCAN", "GTT", True, False)
    assert (r.flip, r.opposite, r.none) == (1, -1, None)
    assert r.gc == 0.75 and r.chrom == "MT" and r.v == "ENSG1"
    assert tuple(r.region) == ("3", 10, 20) and r.bad is None


def test_dosage_conversions(spark):
    p = F.array(F.lit(0.0), F.lit(0.25), F.lit(0.75))
    zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    r = one(spark, d=alleles.probabilities_to_dosage(p), none=alleles.probabilities_to_dosage(zero), call=alleles.probabilities_to_call(p), c=alleles.dosage_to_call(F.lit(1.5), F.lit("A"), F.lit("G")), n=alleles.alternate_count(F.array(F.lit("A"), F.lit("G")), F.lit("A")), miss=alleles.alternate_count(F.array(F.lit("A"), F.lit(None).cast("string")), F.lit("A")))
    assert r.d == 1.75 and r.none is None and r.call == 2 and r.c == ["G", "G"] and r.n == 1 and r.miss is None


def test_correlation_z_matches_t(spark):
    r = one(spark, z=stats.correlation_z(F.lit(0.5), F.lit(30.0)), t=special.t_two_sided_p(stats.correlation_t(F.lit(0.5), F.lit(30.0)), F.lit(28)))
    p = math.erfc(r.z / math.sqrt(2))
    assert abs(p - r.t) / r.t < 0.05


def test_special_against_sums():
    x = special.betainc(np.array([2.0]), np.array([3.0]), np.array([0.4]))[0]
    grid = np.linspace(0, 0.4, 200001)
    assert abs(x - np.trapezoid(12 * grid * (1 - grid) ** 2, grid)) < 1e-8
