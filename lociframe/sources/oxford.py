"""Oxford GEN and SAMPLE, and phased HAPS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _head(parts: Column) -> list[Column]:
    return [parts[0].alias("chrom"), parts[2].cast("long").alias("pos"), F.nullif(parts[1], F.lit(".")).alias("id"), parts[3].alias("ref"), parts[4].alias("alt")]


def read_gen(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, id, ref, alt, probabilities, dosages); triplets of zeros are missing."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("x"))
    x = F.col("x")
    n = ((F.size(x) - 5) / 3).cast("int")
    triplet = lambda i: F.transform(F.slice(x, 6 + 3 * i, 3), lambda p: p.cast("double"))
    v = lines.select(*_head(x), F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), triplet)).otherwise(F.array().cast("array<array<double>>")).alias("probabilities"))
    return v.withColumn("dosages", F.transform("probabilities", lambda p: F.when(p[0] + p[1] + p[2] > 0, (p[1] + 2 * p[2]) / (p[0] + p[1] + p[2]))))


def write_gen(variants: DataFrame, path: str) -> None:
    """From probabilities if there are, else from dosages as certain or two-way calls; null is three zeros."""
    if "probabilities" in variants.columns:
        cells = F.transform("probabilities", lambda p: F.array_join(F.transform(p, lambda x: x.cast("string")), " "))
    else:
        one = lambda d: F.when(d.isNull(), "0 0 0").when(d <= 1, F.concat_ws(" ", (1 - d).cast("string"), d.cast("string"), F.lit("0"))).otherwise(F.concat_ws(" ", F.lit("0"), (2 - d).cast("string"), (d - 1).cast("string")))
        cells = F.transform("dosages", one)
    variants.select(F.concat_ws(" ", "chrom", F.coalesce(F.col("id").cast("string"), F.lit(".")), F.col("pos").cast("string"), "ref", "alt", F.array_join(cells, " ")).alias("value")).write.text(path)


def read_sample(spark: SparkSession, path: str) -> DataFrame:
    """(index, sample, family, missing, sex): the second line, of type codes, is left out."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("i", "line"))
    x = F.split(F.trim("line"), r"\s+")
    return lines.where("i >= 2").select((F.col("i") - 2).alias("index"), x[1].alias("sample"), x[0].alias("family"), x[2].try_cast("double").alias("missing"), F.nullif(F.try_element_at(x, F.lit(4)).try_cast("int"), F.lit(0)).alias("sex"))


def read_haps(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, id, ref, alt, haplotypes, dosages), two phased alleles a sample."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("x"))
    x = F.col("x")
    haps = F.transform(F.slice(x, 6, F.greatest(F.size(x) - 5, F.lit(0))), lambda a: a.try_cast("int"))
    v = lines.select(*_head(x), haps.alias("haplotypes"))
    n = (F.size("haplotypes") / 2).cast("int")
    return v.withColumn("dosages", F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: (F.get("haplotypes", 2 * i) + F.get("haplotypes", 2 * i + 1)).cast("double"))).otherwise(F.array().cast("array<double>")))


def write_haps(variants: DataFrame, path: str) -> None:
    cells = F.transform("haplotypes", lambda a: F.coalesce(a.cast("string"), F.lit("?")))
    variants.select(F.concat_ws(" ", "chrom", F.coalesce(F.col("id").cast("string"), F.lit(".")), F.col("pos").cast("string"), "ref", "alt", F.array_join(cells, " ")).alias("value")).write.text(path)
