"""Linkage disequilibrium, clumping and pruning.

Pairs come from band joins; the nine genotype counts of a pair are conditional sums, and
haplotype frequencies an EM on those counts, a batch of pairs at a time."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .intervals import band_join
from .ordered import settled

#: Variants that one task decides in order.
TILE = 4096


def pair_counts(genotypes: DataFrame, pairs: DataFrame, variant: str, sample: str, call: str) -> DataFrame:
    """pairs (a, b) of variants with n00 .. n22, the samples that have i copies at a and j at b."""
    g = genotypes.where(F.col(call).isNotNull())
    a = g.select(F.col(variant).alias("a"), F.col(sample).alias("__s"), F.col(call).cast("int").alias("__x"))
    b = g.select(F.col(variant).alias("b"), F.col(sample).alias("__s"), F.col(call).cast("int").alias("__y"))
    j = pairs.select("a", "b").join(a, "a").join(b, ["b", "__s"])
    cells = [F.count_if((F.col("__x") == i) & (F.col("__y") == k)).alias(f"n{i}{k}") for i in range(3) for k in range(3)]
    return j.groupBy("a", "b").agg(*cells)


def genotype_r(counts: DataFrame) -> DataFrame:
    """(a, b, n, r): the correlation of the genotypes themselves, from the nine counts; null without variation."""
    n, sx, sy, sxy, vx, vy = _moments()
    return counts.select("a", "b", n.cast("long").alias("n"), F.when((vx > 0) & (vy > 0), (n * sxy - sx * sy) / F.sqrt(vx * vy)).alias("r"))


def genotype_r2(counts: DataFrame) -> DataFrame:
    """Squared correlation of the genotypes themselves, from the nine counts; null without variation."""
    n, sx, sy, sxy, vx, vy = _moments()
    return counts.select("a", "b", n.cast("long").alias("n"), F.when((vx > 0) & (vy > 0), (n * sxy - sx * sy) ** 2 / (vx * vy)).alias("r2"))


def _moments() -> tuple[Column, ...]:
    """n, sums of both sides and of their products, and n squared times the variances, of the nine counts."""
    n = sum((F.col(f"n{i}{k}") for i in range(3) for k in range(3)), F.lit(0)).cast("double")
    sx = sum((i * F.col(f"n{i}{k}") for i in (1, 2) for k in range(3)), F.lit(0))
    sy = sum((k * F.col(f"n{i}{k}") for i in range(3) for k in (1, 2)), F.lit(0))
    sxx = sum((i * i * F.col(f"n{i}{k}") for i in (1, 2) for k in range(3)), F.lit(0))
    syy = sum((k * k * F.col(f"n{i}{k}") for i in range(3) for k in (1, 2)), F.lit(0))
    sxy = sum((i * k * F.col(f"n{i}{k}") for i in (1, 2) for k in (1, 2)), F.lit(0))
    return n, sx, sy, sxy, n * sxx - sx * sx, n * syy - sy * sy


def haplotypes(tables: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Frequencies of 00, 01, 10, 11 haplotypes of (pairs, 3, 3) genotype counts, by EM."""
    t = tables.astype(float)
    n = np.maximum(2 * t.sum(axis=(1, 2)), 1)
    base = np.stack([2 * t[:, 0, 0] + t[:, 0, 1] + t[:, 1, 0], 2 * t[:, 0, 2] + t[:, 0, 1] + t[:, 1, 2], 2 * t[:, 2, 0] + t[:, 1, 0] + t[:, 2, 1], 2 * t[:, 2, 2] + t[:, 1, 2] + t[:, 2, 1]], axis=1)
    het = t[:, 1, 1]
    p = (base + het[:, None] / 2) / n[:, None]
    for _ in range(rounds):
        same, cross = p[:, 0] * p[:, 3], p[:, 1] * p[:, 2]
        total = same + cross
        share = np.divide(same, total, out=np.full_like(total, 0.5), where=total > 0)
        p = (base + het[:, None] * np.stack([share, 1 - share, 1 - share, share], axis=1)) / n[:, None]
    return p


def em_ld(counts: DataFrame) -> DataFrame:
    """(a, b, n, r2, d_prime) from haplotype frequencies; null without variation, d_prime at most 1."""
    cols = [f"n{i}{k}" for i in range(3) for k in range(3)]

    @F.pandas_udf("struct<r2:double,d_prime:double>")
    def run(*series: pd.Series) -> pd.DataFrame:
        t = np.stack([s.to_numpy() for s in series], axis=1).reshape(-1, 3, 3)
        p = haplotypes(t)
        pa, pb = p[:, 0] + p[:, 1], p[:, 0] + p[:, 2]
        d = p[:, 0] - pa * pb
        var = pa * (1 - pa) * pb * (1 - pb)
        top = np.where(d < 0, np.minimum(pa * pb, (1 - pa) * (1 - pb)), np.minimum(pa * (1 - pb), (1 - pa) * pb))
        ok = var > 1e-12
        r2 = np.divide(d * d, var, out=np.full_like(d, np.nan), where=ok)
        dp = np.minimum(1, np.divide(np.abs(d), top, out=np.full_like(d, np.nan), where=ok & (top > 1e-12)))
        return pd.DataFrame({"r2": r2, "d_prime": dp})

    total = sum((F.col(c) for c in cols), F.lit(0))
    out = counts.select("a", "b", total.alias("n"), run(*cols).alias("x"))
    null = lambda c: F.when(~F.isnan(f"x.{c}"), F.col(f"x.{c}")).alias(c)
    return out.select("a", "b", "n", null("r2"), null("d_prime"))


def nearby_pairs(variants: DataFrame, variant: str, chrom: str, pos: str, window: int) -> DataFrame:
    """Pairs (a < b) of one chromosome less than window apart."""
    left = variants.select(chrom, F.col(variant).alias("a"), F.col(pos).alias("__pa"))
    right = variants.select(chrom, F.col(variant).alias("b"), F.col(pos).alias("__pb"))
    return band_join(left, right, [chrom], "__pa", "__pb", window).where("a < b").select("a", "b")


def proxies(variants: DataFrame, genotypes: DataFrame, variant: str, chrom: str, pos: str, sample: str, call: str, window: int, least_r2: float) -> DataFrame:
    """(a, b, r2): pairs near each other with r2 of least_r2 or more."""
    pairs = nearby_pairs(variants, variant, chrom, pos, window)
    return genotype_r2(pair_counts(genotypes, pairs, variant, sample, call)).where(F.col("r2") >= least_r2).select("a", "b", "r2")


def clump(hits: DataFrame, chrom: str, pos: str, p: str, key: str, window: int) -> DataFrame:
    """hits with `locus`, the key of the hit each belongs to: in order of p, a hit founds a locus or
    joins the first founded one within window of it. Hits without p are left out.

    Decided in rounds of joins over near pairs, so no chromosome and no region is one task."""
    h = hits.where(F.col(p).isNotNull())
    side = lambda x: h.select(chrom, F.col(key).alias(x), F.col(pos).alias(f"__{x}"))
    near = band_join(side("a"), side("b"), [chrom], "__a", "__b", window + 1).where("a < b").select("a", "b")
    return greedy_clumps(h, near, key, p, [chrom, pos])


def greedy_clumps(hits: DataFrame, links: DataFrame, key: str, p: str, near: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """hits with `locus`: in order of p, a hit founds a locus unless it is linked to one that does; the others join
    the linked founder of the least p. links has (a, b) of pairs in LD, or near each other; near and tile are as for prune."""
    links = settled(links.select("a", "b"))
    founders = settled(prune(hits.select(*{key, p, *(near or [])}), links, key, p, near, tile))
    both = links.union(links.select("b", "a")).toDF(key, "__f")
    joined = both.join(founders.select(F.col(key).alias("__f"), F.col(p).alias("__p")), "__f").groupBy(key).agg(F.min(F.struct("__p", "__f"))["__f"].alias("__f"))
    own = founders.select(key, F.col(key).alias("__f"))
    locus = joined.join(own, key, "left_anti").select(key, "__f").unionByName(own)
    return hits.join(locus, key).withColumnRenamed("__f", "locus").select(*hits.columns, "locus")


def prune(variants: DataFrame, links: DataFrame, key: str, order: str, near: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """Variants kept when, in order, each is dropped that is linked to a kept earlier one.

    links has (a, b) of pairs in LD. near names columns by which linked variants stand together (chromosome and position;
    else the key). Variants are cut into tiles of up to tile rows along near, and a task decides a tile's variants in order, as far as
    the earlier neighbours in other tiles are decided; what a round decides is carried to the tiles that wait for it. Rounds thus
    grow with the tiles that a chain of links runs through, not with its variants, and each writes open variants only. Each round decides at
    least the earliest open variant, so rounds go on until none is open."""
    spark = variants.sparkSession
    near = near or [key]
    v = variants.select(F.col(key).alias("k"), F.struct(order, key).alias("r"), F.struct(*near, key).alias("__near"))
    v = v.repartitionByRange("__near").sortWithinPartitions("__near").select("k", "r", F.floor(F.monotonically_increasing_id() / tile).alias("tile"))
    v = settled(v)
    e = links.select("a", "b").union(links.select("b", "a")).toDF("k", "other").distinct()
    e = e.join(v, "k").join(v.select(F.col("k").alias("other"), F.col("r").alias("ro"), F.col("tile").alias("to")), "other").where("ro < r")
    e = settled(e.select("k", "other", (F.col("tile") == F.col("to")).alias("inside")))
    waiting = e.where("not inside").select("k", "other")
    place = F.row_number().over(Window.partitionBy("tile").orderBy("r"))  # a tile's rows
    inside = e.where("inside").groupBy("k").agg(F.collect_list("other").alias("inside"))
    open_ = settled(v.join(inside, "k", "left").select("tile", "k", place.alias("i"), "inside", F.lit(False).alias("hit")))
    kind = open_.schema["k"].dataType.simpleString()
    parts = []
    while True:
        blocked = waiting.groupBy("k").agg(F.count("*").alias("blocked"))
        state = settled(open_.join(blocked, "k", "left").groupBy("tile").applyInPandas(_decide_tile, f"tile long, k {kind}, i int, inside array<{kind}>, kept boolean"))
        decided = state.where("kept is not null").select("k", "kept")
        parts.append(decided)
        left = state.where("kept is null").drop("kept")
        if left.isEmpty():
            break
        known = waiting.join(left.select("k"), "k", "left_semi").join(decided.select(F.col("k").alias("other"), "kept"), "other", "left").select("k", "other", "kept")
        known = settled(known)
        hit = known.where("kept").select("k").distinct().withColumn("hit", F.lit(True))
        open_ = left.join(hit, "k", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
        waiting = known.where("kept is null").select("k", "other")
    kept = reduce(DataFrame.unionByName, parts).where("kept").select(F.col("k").alias(key)) if parts else spark.createDataFrame([], variants.select(key).schema)
    return variants.join(kept, key, "left_semi")


def _decide_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """One pass in order over a tile's open variants. hit: a kept earlier neighbour in another tile; blocked: neighbours there that are still
    open. A neighbour in the tile that is no more open was dropped, else this variant would not be open."""
    pdf = pdf.sort_values("i")
    state: dict = {}
    for k, near, hit, blocked in zip(pdf["k"], pdf["inside"], pdf["hit"], pdf["blocked"]):
        own = [state[o] for o in near if o in state] if near is not None else []
        if hit or True in own:
            state[k] = False
        elif blocked > 0 or None in own:
            state[k] = None
        else:
            state[k] = True
    return pd.DataFrame({"tile": pdf["tile"], "k": pdf["k"], "i": pdf["i"], "inside": pdf["inside"], "kept": pd.Series([state[k] for k in pdf["k"]], dtype=object, index=pdf.index)})


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links (a, b) reach. Labels spread along links and
    through the labels themselves, so rounds grow with the logarithm of the longest path; they go on until
    nothing changes, and each is written out."""
    e = settled(links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").distinct())
    label = settled(e.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")))
    while True:
        near = e.join(label.select(F.col("node").alias("other"), F.col("component").alias("c")), "other").groupBy("node").agg(F.min("c").alias("c"))
        new = label.join(near, "node").select("node", F.least("component", "c").alias("new"), F.col("component").alias("old"))
        jump = new.select(F.col("node").alias("new"), F.col("new").alias("c2"))
        new = settled(new.join(jump, "new").select("node", F.least("new", "c2").alias("component"), "old"))
        label = new.drop("old")
        if new.where("component != old").isEmpty():
            return label


def risk_scores(genotypes: DataFrame, weights: DataFrame, variant: str, sample: str, dosage: str, weight: str, least_call_rate: float = 0.75) -> DataFrame:
    """(sample, score, n): the sum of dosage times weight over variants called often enough."""
    j = genotypes.join(weights.select(variant, weight), variant)
    rate = j.groupBy(variant).agg((F.count(dosage) / F.count("*")).alias("__rate")).where(F.col("__rate") >= least_call_rate).select(variant)
    j = j.join(rate, variant, "left_semi").where(F.col(dosage).isNotNull())
    return j.groupBy(sample).agg(F.sum(F.col(dosage) * F.col(weight)).alias("score"), F.count("*").alias("n"))
