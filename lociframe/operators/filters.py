"""Filters of variants, samples, genotypes, summary statistics and matrices.

Comparisons take `inclusive`, as both conventions are in use. A null statistic fails
every filter. All are plain predicates or semi joins, so they are pushed into scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def at_least(value: Column, least: float, inclusive: bool = True) -> Column:
    return F.coalesce(value >= least if inclusive else value > least, F.lit(False))


def under(value: Column, most: float) -> Column:
    return F.coalesce(value < most, F.lit(False))


def all_of(*predicates: Column) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def quality(variants: DataFrame, call_rate: float = 0.95, maf: float = 0.05, hwe_p: float = 1e-4, inclusive: bool = True) -> DataFrame:
    """Variants whose call_rate, maf and hwe_p are large enough."""
    return variants.where(all_of(at_least(F.col("call_rate"), call_rate, inclusive), at_least(F.col("maf"), maf, inclusive), at_least(F.col("hwe_p"), hwe_p, inclusive)))


def listed(rows: DataFrame, keys: DataFrame, on: list[str], exclude: bool = False) -> DataFrame:
    """Rows whose keys are listed, or are not. Nulls are never listed."""
    return rows.join(keys.select(*on).distinct(), on, "left_anti" if exclude else "left_semi")


def mask_genotypes(genotypes: DataFrame, call: str, depth: str | None = None, quality: str | None = None, least_depth: float = 0, least_quality: float = 0, allele_depths: tuple[str, str] | None = None, balance: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """The genotypes, calls set to null where depth or quality are too low (or unknown), or where
    the second allele's share of reads of a heterozygote (call 1) is outside balance."""
    ok = F.lit(True)
    if depth:
        ok = ok & at_least(F.col(depth), least_depth)
    if quality:
        ok = ok & at_least(F.col(quality), least_quality)
    if allele_depths:
        a, b = (F.col(c) for c in allele_depths)
        share = F.when(a + b > 0, b / (a + b))
        ok = ok & ((F.col(call) != 1) | F.coalesce(share.between(*balance), F.lit(False)))
    return genotypes.withColumn(call, F.when(ok, F.col(call)))


def drop_sparse(values: DataFrame, by: str, value: str, most_missing: int) -> DataFrame:
    """Rows of those groups that have at most so many nulls."""
    keep = values.groupBy(by).agg(F.count_if(F.col(value).isNull()).alias("__missing")).where(F.col("__missing") <= most_missing)
    return values.join(keep.select(by), by, "left_semi")


def impute(values: DataFrame, by: str, value: str, how: str = "mean") -> DataFrame:
    """Nulls replaced by the mean or median of their group; groups of nulls stay null."""
    w = Window.partitionBy(by)
    fill = F.avg(value).over(w) if how == "mean" else F.median(value).over(w)
    return values.withColumn(value, F.coalesce(F.col(value), fill))


def zero_to_null(values: DataFrame, value: str) -> DataFrame:
    return values.withColumn(value, F.nullif(F.col(value), F.lit(0)))


def drop_constant(values: DataFrame, by: str, value: str) -> DataFrame:
    """Rows of groups whose values vary."""
    keep = values.groupBy(by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")).where("__lo < __hi").select(by)
    return values.join(keep, by, "left_semi")


def overlay(rows: DataFrame, edits: DataFrame, key: str, columns: list[str], excluded: str = "excluded") -> DataFrame:
    """rows with the edits' non-null columns in place of their own; rows marked excluded go."""
    e = edits.select(key, *(F.col(c).alias(f"__{c}") for c in columns), F.coalesce(F.col(excluded), F.lit(False)).alias("__out"))
    both = rows.join(e, key, "left").where(~F.coalesce("__out", F.lit(False)))
    for c in columns:
        both = both.withColumn(c, F.coalesce(f"__{c}", c))
    return both.select(*rows.columns)


def min_cohorts(effects: DataFrame, z_list: str, least: int) -> DataFrame:
    """Effects with so many cohorts that have a z."""
    return effects.where(F.size(F.filter(z_list, lambda z: z.isNotNull())) >= least)
