"""End-to-end analyses composed of the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import alleles, special, stats
from ..operators import aggregates as agg
from ..operators import decompose, filters, intervals, ld, matrix, meta, models, ranks, testing
from ..operators.ordered import settled
from ..sources.ranges import open_file


def shuffled_samples(samples: DataFrame, sample: str, rounds: int, seed: int) -> DataFrame:
    """(perm, sample, shuffled) for perm 0 (unchanged) to rounds: a permutation of the samples in
    each round, by the order of a hash of seed, round and sample."""
    s = samples.select(sample).distinct()
    each = s.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    place = F.row_number().over(Window.partitionBy("perm").orderBy(sample))
    mixed = F.row_number().over(Window.partitionBy("perm").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "perm", sample).cast("binary")), sample))
    a, b = each.select("perm", sample, place.alias("__k")), each.select("perm", F.col(sample).alias("shuffled"), mixed.alias("__k"))
    real = s.select(F.lit(0).alias("perm"), sample, F.col(sample).alias("shuffled"))
    return real.unionByName(a.join(b, ["perm", "__k"]).drop("__k"))


def associate(pairs: DataFrame, genotypes: DataFrame, traits: DataFrame, by: list[str], variant: str, feature: str, sample: str, dosage: str, value: str, rank: bool = False, least: int = 3) -> DataFrame:
    """(variant, feature, by..., n, r, z, p) of each pair, by correlation over their common samples.

    traits carry `by` (dataset, permutation). Genotypes meet pairs first, then values by
    feature and sample; partial sums of each task are all that the last shuffle moves."""
    t = traits.where(F.col(value).isNotNull())
    if rank:
        t = t.withColumn(value, ranks.average_rank([feature, *by], value))
    g = genotypes.where(F.col(dosage).isNotNull()).select(variant, sample, dosage)
    j = pairs.select(variant, feature).join(g, variant).join(t.select(feature, sample, *by, value), [feature, sample])
    c = agg.correlate(j, [variant, feature, *by], dosage, value).where((F.col("n") >= least) & F.col("r").isNotNull() & (F.abs("r") < 1))
    z = stats.correlation_z(F.col("r"), F.col("n").cast("double"))
    return c.withColumn("z", z).withColumn("p", stats.two_sided_normal_p(F.col("z"))).select(variant, feature, *by, "n", "r", "z", "p")


def cis_mapping(variants: DataFrame, genes: DataFrame, genotypes: DataFrame, traits: DataFrame, window: int, maf: float = 0.05, call_rate: float = 0.95, hwe: float | None = 1e-4, rank: bool = False, permutations: int = 0, seed: int = 1, least_datasets: int = 1) -> DataFrame:
    """Multi-dataset cis mapping: QC, band join, correlation by dataset, weighted-Z over datasets, and,
    with permutations, the permutation FDR of each result.

    Columns: variants (variant, chrom, pos), genes (gene, chrom, mid), genotypes (variant, sample,
    dosage), traits (gene, sample, dataset, value)."""
    s = agg.variant_summary(genotypes, ["variant"], "dosage")
    s = s.where(filters.at_least(F.col("maf"), maf) & filters.at_least(F.col("call_rate"), call_rate))
    if hwe is not None:
        s = agg.with_hwe(s).where(filters.at_least(F.col("hwe_p"), hwe))
    good = variants.join(s.select("variant"), "variant", "left_semi")
    pairs = intervals.band_join(good, genes, ["chrom"], "pos", "mid", window).select("variant", "gene")
    if permutations:
        links = shuffled_samples(traits.select("sample"), "sample", permutations, seed)
        traits = traits.join(links.select("perm", F.col("shuffled").alias("sample"), F.col("sample").alias("__to")), "sample").select("gene", F.col("__to").alias("sample"), "dataset", "value", "perm")
    else:
        traits = traits.withColumn("perm", F.lit(0))
    one = associate(pairs, genotypes, traits, ["dataset", "perm"], "variant", "gene", "sample", "dosage", "value", rank)
    joint = meta.weighted_z(one, ["variant", "gene", "perm"], "z", "n", least=least_datasets)
    if not permutations:
        return joint.drop("perm")
    joint = settled(joint)
    real, null = joint.where("perm = 0").drop("perm"), joint.where("perm > 0")
    fdr = testing.permutation_fdr(real, null, "p", permutations).select("p", "fdr")
    return real.join(fdr, "p").select("variant", "gene", "datasets", "n", "z", "p", "fdr")


def top_with_beta(results: DataFrame, gene: str, variant: str, perm: str, p: str, z: str) -> DataFrame:
    """Top association of each gene with its p adjusted by a beta distribution fitted to the least p
    of the permutations. results has all permutations, 0 the real one."""
    top = testing.strongest(results.where(F.col(perm) == 0), [gene], [p, F.desc(F.abs(z)), variant])
    least = results.groupBy(gene, perm).agg(F.min(p).alias(p))
    return top.join(models.beta_adjusted(least, gene, perm, p).select(gene, "alpha", "beta", "adjusted"), gene)


def residual_values(values: DataFrame, hits: DataFrame, genotypes: DataFrame, feature: str, variant: str, sample: str, dosage: str, value: str) -> DataFrame:
    """values with the linear effect of each feature's hit variant taken out; features without a hit,
    and samples without its genotype, stay as they are."""
    j = values.join(hits.select(feature, variant), feature).join(genotypes.select(variant, sample, F.col(dosage).alias("__g")), [variant, sample]).where(F.col("__g").isNotNull() & F.col(value).isNotNull())
    fit = agg.simple_regression(j, [feature], "__g", value).where("beta is not null").select(feature, "beta", "alpha")
    out = j.join(fit, feature).select(feature, sample, (F.col(value) - F.col("alpha") - F.col("beta") * F.col("__g")).alias("__res"))
    return values.join(out, [feature, sample], "left").withColumn(value, F.coalesce("__res", value)).drop("__res")


def conditional_mapping(pairs: DataFrame, genotypes: DataFrame, values: DataFrame, cutoff: float, rounds: int | None = None) -> DataFrame:
    """(round, variant, gene, n, r, z, p): the top hit of each gene, then again without its effect, while
    any gene has one up to cutoff that is new (or for so many rounds). A variant is a gene's hit once, so rounds
    end. Columns as for cis_mapping, without datasets.

    The driver loops over rounds only; what a round leaves, values and pairs of the genes with a hit, is written before the next."""
    found = None
    left = settled(values.select("gene", "sample", "value"))
    # pairs of genes that have values, and genotypes of their variants, once for all rounds
    pairs = settled(pairs.select("variant", "gene").join(left.select("gene").distinct(), "gene", "left_semi"))
    genotypes = settled(genotypes.where("dosage is not null").select("variant", "sample", "dosage").join(pairs.select("variant").distinct(), "variant", "left_semi"))
    i = 0
    while rounds is None or i < rounds:
        i += 1
        res = associate(pairs, genotypes, left, [], "variant", "gene", "sample", "dosage", "value").where(F.col("p") <= cutoff)
        if found is not None:
            res = res.join(found.select("variant", "gene"), ["variant", "gene"], "left_anti")
        top = settled(testing.strongest(res, ["gene"], ["p", F.desc(F.abs("z")), "variant"]))
        if top.isEmpty():
            break
        step = top.withColumn("round", F.lit(i))
        found = step if found is None else found.unionByName(step)
        pairs = settled(pairs.join(top.select("gene"), "gene", "left_semi"))
        left = settled(residual_values(left.join(top.select("gene"), "gene", "left_semi"), top, genotypes, "gene", "variant", "sample", "dosage", "value"))
    if found is None:
        return associate(pairs, genotypes, values.limit(0), [], "variant", "gene", "sample", "dosage", "value").withColumn("round", F.lit(0))
    return found


def instrument_analysis(values: DataFrame, by: list[str], instrument: str, exposure: str, outcome: str) -> DataFrame:
    """Two-stage least squares with the t of the effect."""
    f = agg.two_stage(values, by, instrument, exposure, outcome)
    return f.withColumn("t", F.when(F.col("se") > 0, F.col("beta") / F.col("se")))


def mediation(values: DataFrame, by: list[str], x: str, mediator: str, y: str) -> DataFrame:
    """Slope of y on x before and after the mediator is taken out of y, and their ratio."""
    v = values.where(F.col(x).isNotNull() & F.col(mediator).isNotNull() & F.col(y).isNotNull())
    total = agg.simple_regression(v, by, x, y).select(*by, "n", F.col("beta").alias("total"))
    m = agg.simple_regression(v, by, mediator, y).where("beta is not null").select(*by, F.col("beta").alias("__b"), F.col("alpha").alias("__a"))
    rest = v.join(m, by).withColumn("__y", F.col(y) - F.col("__a") - F.col("__b") * F.col(mediator))
    direct = agg.simple_regression(rest, by, x, "__y").select(*by, F.col("beta").alias("direct"))
    return total.join(direct, by).withColumn("ratio", F.when(F.col("total") != 0, F.col("direct") / F.col("total")))


def mixups(effects: DataFrame, genotypes: DataFrame, values: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(genotyped, measured, score, n): for each pair of a genotyped and a measured sample that share an effect, or
    each listed pair, how far
    the values are, on average in standard deviations, from those of its genotype's group.

    effects has (variant, gene); links has the pairs to score (genotyped, measured); linked
    samples themselves define the groups. Groups of under three are left out."""
    g = genotypes.where("dosage is not null").select("variant", F.col("sample").alias("genotyped"), "dosage")
    x = values.where("value is not null").select("gene", F.col("sample").alias("measured"), "value")
    if links is None:
        x = settled(x)
        return _all_pairs(_grouped_calls(effects, g, x), x)
    own = effects.join(g, "variant").join(x.withColumn("genotyped", F.col("measured")), ["gene", "genotyped"])
    groups = own.groupBy("variant", "gene", "dosage").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count("*").alias("k")).where("k >= 3 and s > 0")
    scored = links.join(g, "genotyped").join(groups, ["variant", "dosage"]).join(x, ["gene", "measured"])
    return scored.groupBy("genotyped", "measured").agg(F.avg(F.abs((F.col("value") - F.col("m")) / F.col("s"))).alias("score"), F.count("*").alias("n"))


def _grouped_calls(effects: DataFrame, calls: DataFrame, values: DataFrame) -> DataFrame:
    """(gene, genotyped, m, s) of each call (variant, genotyped, dosage): mean and deviation of its group by its own samples' values. Groups are
    windows over the calls, so that these move once for them; what repeats in effects or values counts in groups, but makes no call twice."""
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)) == 1
    e = effects.where("gene is not null").select("variant", "gene", first("variant", "gene").alias("__e"))
    x = values.select("gene", F.col("measured").alias("genotyped"), "value", first("gene", "measured").alias("__x"))
    w = Window.partitionBy("variant", "gene", "dosage")
    own = e.join(calls, "variant").join(x, ["gene", "genotyped"], "left")
    own = own.select("gene", "genotyped", F.col("__e") & F.coalesce("__x", F.lit(True)), F.avg("value").over(w).alias("m"), F.stddev_samp("value").over(w).alias("s"), F.count("value").over(w).alias("k"))
    return own.toDF("gene", "genotyped", "once", "m", "s", "k").where("once and k >= 3 and s > 0").select("gene", "genotyped", "m", "s")


#: Genotyped samples of a task and measured samples of a block, about, and the most rows of either.
GENOTYPED, MEASURED, TILE_ROWS = 500, 8000, 1_000_000
#: Values that are worked on at once, about, and scored pairs of a batch.
CELLS, BATCH = 1 << 17, 1 << 16


def _all_pairs(calls: DataFrame, values: DataFrame) -> DataFrame:
    """The scores of all pairs of samples that share a gene. calls: (gene, genotyped, m, s), values: (gene, measured, value), written already.

    Genotyped samples are dealt to tasks; measured samples are written to the shared folder in blocks, which each task reads one after the
    other. So neither side is copied for the other, and disk grows as the rows do, though pairs are samples squared by nature. A pair's terms
    are never rows; a task holds its own samples, one block, and one sample's sums over it."""
    a, b = settled(calls), values.where("gene is not null")
    kinds = dict(a.dtypes)["genotyped"], dict(b.dtypes)["measured"]

    def blocks(rows: DataFrame, sample: str, each: int) -> tuple[int, int]:
        """How many, and rows of one."""
        c = rows.agg(F.approx_count_distinct(sample).alias("samples"), F.count("*").alias("rows")).first()
        n = max(1, -(-c["samples"] // each), -(-c["rows"] // TILE_ROWS))
        return n, c["rows"] // n

    (na, _), (nb, each) = blocks(a, "genotyped", GENOTYPED), blocks(b, "measured", MEASURED)
    a = a.select("gene", "genotyped", F.col("m").cast("double").alias("m"), F.col("s").cast("double").alias("s")).repartition(na, "genotyped")
    b = settled(b.select("gene", "measured", F.col("value").cast("double").alias("value")).repartition(nb, "measured"))
    files = b.inputFiles()  # a file a block, or several smaller ones

    def numbered(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
        """The distinct values of a column, null one of them, and the number of each row's."""
        coded = column.combine_chunks().dictionary_encode("encode")
        return coded.dictionary, coded.indices.to_numpy()

    def starts(numbers: np.ndarray, n: int) -> np.ndarray:
        """Where each of n numbers begins among sorted ones."""
        return np.searchsorted(numbers, np.arange(n + 1))

    def scored(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        (who, i), (whom, j) = numbered(left["genotyped"]), numbered(right["measured"])
        genes, g = numbered(pa.concat_tables([left.select(["gene"]), right.select(["gene"])], promote_options="permissive")["gene"])
        g, h = g[: len(i)], g[len(i) :]
        by, of = np.lexsort((g, i)), np.lexsort((j, h))
        at, to = starts(i[by], len(who)), starts(h[of], len(genes))
        g, m, w, j, v = g[by], left["m"].to_numpy()[by], 1 / left["s"].to_numpy()[by], j[of], right["value"].to_numpy()[of]
        held = {}

        def row(k: int) -> tuple:
            """A gene's values, the places of their samples (None: all samples have a place), the places without a value, and whether places repeat."""
            places, x = j[to[k] : to[k + 1]], v[to[k] : to[k + 1]]
            repeat = bool((np.diff(places) == 0).any())  # they are in order
            if repeat or 2 * len(places) < len(whom):
                return x, places, None, repeat
            every, holes = np.zeros(len(whom)), np.ones(len(whom), bool)
            every[places], holes[places] = x, False
            return every, None, np.flatnonzero(holes), False

        rows, many, room = [], 0, np.empty(max(CELLS, len(v)))
        for p in range(len(who)):
            total, count, full = np.zeros(len(whom)), np.zeros(len(whom), np.int64), 0
            cuts = at[p] + np.flatnonzero(np.diff(g[at[p] : at[p + 1]], prepend=-1, append=-1))
            for first, last in zip(cuts, cuts[1:]):
                k = g[first]
                if k not in held:
                    held[k] = row(k)
                x, places, holes, repeat = held[k]
                if not len(x):
                    continue
                sums, step = 0.0, max(1, CELLS // len(x))
                for q in range(first, last, step):
                    r = min(q + step, last)
                    gaps = room[: (r - q) * len(x)].reshape(r - q, len(x))
                    np.subtract(x, m[q:r, None], out=gaps)
                    sums += w[q:r] @ np.abs(gaps, out=gaps)
                if repeat:  # a sample measured twice in a gene counts twice
                    np.add.at(total, places, sums)
                    np.add.at(count, places, last - first)
                elif places is not None:
                    total[places] += sums
                    count[places] += last - first
                else:
                    sums[holes] = 0
                    total += sums
                    count[holes] -= last - first
                    full += last - first
            count += full
            c = np.flatnonzero(count)
            rows.append((np.full(len(c), p), c, total[c] / count[c], count[c]))
            many += len(c)
            if many >= BATCH or p == len(who) - 1:
                r, c, score, n = (np.concatenate(x) for x in zip(*rows))
                yield pa.record_batch([who.take(pa.array(r)), whom.take(pa.array(c)), pa.array(score), pa.array(n)], names=["genotyped", "measured", "score", "n"])
                rows, many = [], 0

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, block, rows = [x for x in batches if x.num_rows], [], 0
        for name in files if mine else ():
            with open_file(name) as f:
                block.append(pq.read_table(f))
            rows += block[-1].num_rows
            if rows and (4 * rows > 3 * each or name == files[-1]):
                yield from scored(pa.Table.from_batches(mine), pa.concat_tables(block))
                block, rows = [], 0

    return a.mapInArrow(scores, f"genotyped {kinds[0]}, measured {kinds[1]}, score double, n long")


def harmonise(study: DataFrame, reference: DataFrame, flank_r: DataFrame | None = None, most_maf_gap: float = 0.1) -> DataFrame:
    """(variant, ref_id, action): how each study variant aligns with a reference panel.

    Both have (variant or ref_id, chrom, pos, ref, alt, maf). At a position the same id is
    preferred, else alleles that fit as they are, then on the other strand; two that fit equally
    exclude the variant. A/T and C/G are kept if the sign of flank_r(variant, r), the
    correlation of LD with flanking variants in both panels, is positive, swapped if negative;
    without it, by minor allele frequencies that are close and not near one half; else excluded."""
    s = study.select("variant", "chrom", "pos", F.array("ref", "alt").alias("a"), F.col("maf").alias("m"))
    x = reference.select("ref_id", "chrom", "pos", F.array("ref", "alt").alias("b"), F.col("maf").alias("mr"))
    j = s.join(x, ["chrom", "pos"])
    same = alleles.same_alleles(F.col("a"), F.col("b"))
    turned = alleles.same_alleles(F.col("a"), F.transform("b", alleles.complement))
    rank = F.when(F.col("variant").cast("string") == F.col("ref_id").cast("string"), 0).when(same, 1).when(turned, 2)
    j = j.withColumn("rank", rank).withColumn("fits", same | turned).where("rank is not null")
    w = Window.partitionBy("variant")
    j = j.withColumn("best", F.min("rank").over(w)).where("rank = best").withColumn("k", F.count("*").over(w))
    if flank_r is not None:
        j = j.join(flank_r.select("variant", "r"), "variant", "left")
    else:
        j = j.withColumn("r", F.lit(None).cast("double"))
    by_maf = F.when((F.abs(F.col("m") - F.col("mr")) <= most_maf_gap) & (F.col("m") < 0.4), "keep").otherwise("exclude")
    unclear = F.when(F.col("r") > 0, "keep").when(F.col("r") < 0, "swap").otherwise(by_maf)
    action = F.when((F.col("k") > 1) | ~F.col("fits"), "exclude").when(alleles.is_ambiguous(F.col("a")), unclear).when(same, "keep").otherwise("swap")
    return j.select("variant", "ref_id", action.alias("action")).groupBy("variant", "action").agg(F.min("ref_id").alias("ref_id")).select("variant", "ref_id", "action")


def harmonise_by_ld(study: DataFrame, reference: DataFrame, study_genotypes: DataFrame, reference_genotypes: DataFrame, window: int, least_r2: float = 0.3, least_votes: int = 3, most_maf_gap: float = 0.1) -> DataFrame:
    """(variant, ref_id, action, agree, against): harmonise, with A/T and C/G decided by linkage in both panels.

    study (variant, chrom, pos, ref, alt, maf) and reference (ref_id, ...) have genotypes (variant or ref_id, sample, dosage), dosages of alt. An unclear
    variant and each settled one less than window away, whose genotypes correlate with it in both panels (squared,
    by least_r2), give a vote: whether the correlations have one sign once alleles are named alike. Majorities of at least least_votes
    settle a variant, which then votes for others in the next pass; passes go on until none settles another. What stays unclear is decided by
    allele frequencies, as harmonise does, or excluded."""
    every = settled(harmonise(study, reference, study.select("variant", F.lit(1.0).alias("r"))).where("action != 'exclude'"))
    m = every.join(study.select("variant", "chrom", "pos", "ref", "alt"), "variant").join(reference.select("ref_id", F.col("ref").alias("rr"), F.col("alt").alias("ra")), "ref_id")
    unclear = alleles.is_ambiguous(F.array("ref", "alt"))
    like = (F.col("alt") == F.col("ra")) | (~unclear & (alleles.complement(F.col("alt")) == F.col("ra")))
    m = settled(m.select("variant", "ref_id", "chrom", "pos", unclear.alias("unclear"), F.when(like, 1).otherwise(-1).alias("way")))
    known, open_, votes = m.where("not unclear").drop("unclear"), m.where("unclear").drop("unclear"), None
    while True:
        near = intervals.band_join(open_.select("chrom", F.col("variant").alias("a"), F.col("ref_id").alias("xa"), F.col("way").alias("wa"), F.col("pos").alias("pa")), known.select("chrom", F.col("variant").alias("b"), F.col("ref_id").alias("xb"), F.col("way").alias("wb"), F.col("pos").alias("pb")), ["chrom"], "pa", "pb", window)
        near = settled(near.select("a", "b", "xa", "xb", (F.col("wa") * F.col("wb")).alias("way")))
        here = ld.genotype_r(ld.pair_counts(study_genotypes, near.select("a", "b"), "variant", "sample", "dosage")).select("a", "b", F.col("r").alias("r1"))
        there = ld.genotype_r(ld.pair_counts(reference_genotypes, near.select(F.col("xa").alias("a"), F.col("xb").alias("b")).distinct(), "ref_id", "sample", "dosage")).select(F.col("a").alias("xa"), F.col("b").alias("xb"), F.col("r").alias("r2"))
        both = near.join(here, ["a", "b"]).join(there, ["xa", "xb"]).where((F.col("r1") ** 2 >= least_r2) & (F.col("r2") ** 2 >= least_r2))
        sign = F.signum("r1") * F.signum("r2") * F.col("way")
        got = both.groupBy(F.col("a").alias("variant")).agg(F.count_if(sign > 0).alias("agree"), F.count_if(sign < 0).alias("against"))
        got = settled(got.where((F.col("agree") + F.col("against") >= least_votes) & (F.col("agree") != F.col("against"))))
        if got.isEmpty():
            break
        votes = got if votes is None else votes.unionByName(got)
        turned = F.when(F.col("agree") > F.col("against"), F.col("way")).otherwise(-F.col("way"))
        known = settled(known.unionByName(open_.join(got, "variant").withColumn("way", turned).select(*open_.columns)))
        open_ = settled(open_.join(got, "variant", "left_anti"))
    if votes is None:
        votes = study.select("variant", F.lit(0).cast("long").alias("agree"), F.lit(0).cast("long").alias("against")).limit(0)
    flank = votes.select("variant", F.when(F.col("agree") > F.col("against"), 1.0).otherwise(-1.0).alias("r"))
    return harmonise(study, reference, flank, most_maf_gap).join(votes, "variant", "left").select("variant", "ref_id", "action", F.coalesce("agree", F.lit(0)).alias("agree"), F.coalesce("against", F.lit(0)).alias("against"))


def component_search(values: DataFrame, samples: list, pairs: DataFrame, genotypes: DataFrame, cutoff: float, step: int = 5, most: int = 50, patience: int = 2) -> DataFrame:
    """(components, hits, genes, best): how many pairs (and genes with one) have p up to cutoff after 0, step, 2 step, ... components are taken out
    of the values, and which number gives the most hits (of equal ones the least).

    values has (gene, values), an array in order of samples. The components are those of samples over all genes, decomposed once; the mapping is
    repeated on residuals until hits have not risen for so many steps. The driver loops over steps only."""

    @F.pandas_udf("array<double>")
    def centred(v: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(x, float) - np.mean(x) if len(x) else x for x in v])

    whole = values.where(F.forall("values", lambda x: x.isNotNull())).select("gene", F.col("values").cast("array<double>").alias("values"))
    rows = settled(whole.select("gene", centred("values").alias("values")))
    svd = decompose.singular_values(rows, "values", min(most, len(samples)), centre=False)
    # pairs of genes that have values, and genotypes of their variants, once for all steps
    pairs = settled(pairs.select("variant", "gene").join(rows.select("gene"), "gene", "left_semi"))
    genotypes = settled(genotypes.where("dosage is not null").select("variant", "sample", "dosage").join(pairs.select("variant"), "variant", "left_semi"))
    places = values.sparkSession.createDataFrame(list(enumerate(samples)), StructType([StructField("i", IntegerType()), StructField("sample", genotypes.schema["sample"].dataType)]))
    found, best, since, k = [], -1, 0, 0
    while k <= min(most, len(svd["values"])):
        left = matrix.remove_components(rows, "values", svd["means"], svd["vectors"][:k].T) if k else rows.withColumn("residual", F.col("values"))
        long = left.select("gene", F.posexplode("residual").alias("i", "value")).join(F.broadcast(places), "i").select("gene", "sample", "value")  # the samples of a study
        hits = associate(pairs, genotypes, long, [], "variant", "gene", "sample", "dosage", "value").where(F.col("p") <= cutoff)
        one = hits.agg(F.count("*").alias("hits"), F.count_distinct("gene").alias("genes")).first()
        found.append((k, one["hits"], one["genes"]))
        since = 0 if one["hits"] > best else since + 1
        best = max(best, one["hits"])
        if since >= patience:
            break
        k += step
    top = min(k for k, hits, _ in found if hits == best)
    return values.sparkSession.createDataFrame([(k, h, g, k == top) for k, h, g in found], "components int, hits long, genes long, best boolean")


def gene_scores(results: DataFrame, variants: DataFrame, genes: DataFrame, flank: int) -> DataFrame:
    """(gene, n, chi2, p): the sum of squared z of the variants in and around each gene, and its p with
    one degree of freedom a variant (independent variants: prune first)."""
    g = genes.withColumn("lo", F.col("start") - flank).withColumn("hi", F.col("stop") + flank).select("gene", "chrom", "lo", "hi")
    j = intervals.point_join(variants.join(results.select("variant", "z"), "variant"), g, ["chrom"], "pos", "lo", "hi", max(1, 2 * flank + 1000))
    s = j.groupBy("gene").agg(F.count("z").alias("n"), F.sum(F.col("z") ** 2).alias("chi2"))
    return s.withColumn("p", special.chi2_upper_p(F.col("chi2"), F.col("n")))


def clumped_risk_score(summary: DataFrame, genotypes: DataFrame, variants: DataFrame, most_p: float, window: int) -> DataFrame:
    """Risk scores over the founders of clumps of variants with p up to most_p; summary has (variant, p, weight)."""
    hits = variants.join(summary.where(F.col("p") <= most_p), "variant")
    founders = ld.clump(hits.select("variant", "chrom", "pos", "p", "weight"), "chrom", "pos", "p", "variant", window).where("locus = variant")
    return ld.risk_scores(genotypes, founders, "variant", "sample", "dosage", "weight")


def concordance(allelic: DataFrame, mapped: DataFrame, on: list[str]) -> DataFrame:
    """Allele-specific shares next to mapped z, flipped to the same allele, and whether they agree."""
    j = allelic.join(mapped, on)
    z = F.when(F.col("assessed") == F.col("alt"), F.col("z")).otherwise(-F.col("z"))
    agree: Column = ((F.col("share") > 0.5) & (z > 0)) | ((F.col("share") < 0.5) & (z < 0))
    return j.withColumn("z_aligned", z).withColumn("agree", agree)
