"""Registered queries of fits and decompositions; see catalog.py.

Each sample's proportion of a cell type is its supplier's account balance, brought to 0 to 1."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decompose, elastic, likelihood
from .catalog import query, r


def _typed_reads(v):
    """reads with `proportion` of their sample."""
    return v.reads.join(v.supplier.select(F.col("s_suppkey").alias("sample"), ((F.col("s_acctbal") + 1000) / 11000).alias("proportion")), "sample")


_TYPED = ", typed as (select r.*, (s_acctbal + 1000e0) / 11000e0 as proportion from reads r join supplier on sample = s_suppkey)"
_PART = "lgamma(k + q * s) + lgamma(m + (1 - q) * s) - lgamma(k + m + s) - lgamma(q * s) - lgamma((1 - q) * s) + lgamma(s)"


@query("allelic_likelihood", ("reads",), _TYPED + f", x as (select variant, ref_reads * 1e0 as k, alt_reads * 1e0 as m, 0.2 + 0.5 * proportion as q, 1 / 0.09e0 - 1 as s from typed), l as (select variant, ln(0.98e0 * exp({_PART}) + 0.02e0 * (exp(k * ln(0.005e0) + m * ln(0.995e0)) + exp(m * ln(0.005e0) + k * ln(0.995e0)))) as l from x) select variant, count(*) as n, round(sum(l), 5) as log_likelihood from l group by variant")
def allelic_likelihood(v):
    ll = likelihood.log_likelihood(0.2 + 0.5 * F.col("proportion"), F.col("ref_reads"), F.col("alt_reads"), F.lit(0.3), 0.98, 0.005)
    return _typed_reads(v).withColumn("l", ll).groupBy("variant").agg(F.count("l").alias("n"), F.round(F.sum("l"), 5).alias("log_likelihood"))


@query("sample_dispersion", ("reads",))
def sample_dispersion(v):
    return likelihood.sample_dispersion(v.reads, ["sample"], "ref_reads", "alt_reads")


@query("cell_type_allelic", ("reads",))
def cell_type_allelic(v):
    """Whether a variant's allelic share follows a cell type's proportion, with each sample's own dispersion."""
    own = likelihood.sample_dispersion(v.reads, ["sample"], "ref_reads", "alt_reads").select("sample", "sigma")
    return likelihood.allelic_test(_typed_reads(v).join(own, "sample"), ["variant"], "ref_reads", "alt_reads", "sigma", "proportion")


@query("cell_type_binomial", ("reads",))
def cell_type_binomial(v):
    return likelihood.allelic_test(_typed_reads(v), ["variant"], "ref_reads", "alt_reads", None, "proportion")


@query("beta_binomial_maximum", ("reads",))
def beta_binomial_maximum(v):
    return likelihood.beta_binomial_maximum(v.reads, ["variant"], "ref_reads", "alt_reads")


@query("negative_binomial", ("reads",), ", s as (select variant, count(*) as n, sum(ref_reads) * 1e0 as k, sum(alt_reads) * 1e0 as m, sum(lgamma(ref_reads + alt_reads) - lgamma(ref_reads + 1) - lgamma(alt_reads)) as w from reads where alt_reads > 0 group by variant), g as (select *, k * ln(k / (k + m)) + m * ln(m / (k + m)) as gain from s) select variant, n, round(k / (k + m), 6) as ratio, round(w + gain, 4) as log_likelihood, round(greatest(0, 2 * (gain + (k + m) * ln(2e0))), 4) as chi2 from g")
def negative_binomial(v):
    return likelihood.negative_binomial(v.reads, ["variant"], "ref_reads", "alt_reads").select("variant", "n", r("ratio"), r("log_likelihood", 4), r("chi2", 4))


# --- models of many features and decompositions ----------------------------------------------


def _shares(v):
    """Embeddings with the share of one label in each: all or nothing."""
    return v.embeddings.select("vec_id", "embedding", (F.col("label") == 3).cast("double").alias("share"))


@query("elastic_net_models", ("embeddings",))
def elastic_net_models(v):
    return elastic.elastic_net(_shares(v), "vec_id", "embedding", "share", folds=5, repetitions=3, steps=40)


@query("marker_features", ("embeddings",))
def marker_features(v):
    return elastic.marker_features(elastic.elastic_net(_shares(v), "vec_id", "embedding", "share", folds=5, repetitions=3, steps=40))


@query("singular_scores", ("embeddings",))
def singular_scores(v):
    svd = decompose.singular_values(v.embeddings, "embedding", 6)
    return decompose.project(v.embeddings, "embedding", svd["means"], svd["vectors"]).select("vec_id", "scores")


@query("independent_sources", ("embeddings",))
def independent_sources(v):
    ica = decompose.independent_components(v.embeddings, "embedding", 3, restarts=3, within=1e-6)
    out = decompose.project(v.embeddings, "embedding", ica["means"], ica["loadings"], "sources")
    return out.select("vec_id", "sources", F.lit(bool(ica["settled"].all())).alias("settled"), F.lit(float(ica["stability"].min())).alias("stability"))
