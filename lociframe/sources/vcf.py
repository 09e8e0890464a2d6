"""VCF as text lines and expressions: no per-row Python, splittable when not gzipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alleles import chromosome_order

COLUMNS = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")


def samples(spark: SparkSession, path: str) -> list[str]:
    head = spark.read.text(path).where(F.col("value").startswith("#CHROM")).first()
    return head[0].split("\t")[9:] if head else []


def info_map(info: Column) -> Column:
    """INFO as a map; flags have the value "true"."""
    pairs = F.filter(F.split(info, ";"), lambda x: (x != "") & (x != "."))
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)), F.when(F.contains(x, F.lit("=")), F.split_part(x, F.lit("="), F.lit(2))).otherwise("true"))))


def field(entry: Column, format_: Column, name: str) -> Column:
    """A named field of a sample's entry; null if it is absent or "."."""
    at = F.array_position(F.split(format_, ":"), name)
    return F.nullif(F.try_element_at(F.split(entry, ":"), F.nullif(at, F.lit(0)).cast("int")), F.lit("."))


def dosage_of_call(gt: Column) -> Column:
    """Alternate alleles of a call such as 0/1 or 1|1; null if any allele is missing."""
    parts = F.split(gt, "[/|]")
    return F.when(gt.isNotNull() & ~F.contains(gt, F.lit(".")), F.aggregate(parts, F.lit(0), lambda n, a: n + F.when(a == "0", 0).otherwise(1)).cast("double"))


def read(spark: SparkSession, path: str, least_probability: float = 0.4) -> DataFrame:
    """(chrom, pos, id, ref, alt array, qual, filter, info map, calls, phased, dosages, depths, qualities).

    Calls are GT, or, without it, the genotype of the largest GP that is least_probability or more. Dosages count
    alternate alleles: DS if given, else GP's mean if one GP is least_probability or more, else the call. Depths and
    qualities are DP and GQ. Haploid calls (one allele) count as they stand."""
    return parse(spark.read.text(path), least_probability)


def parse(lines: DataFrame, least_probability: float = 0.4) -> DataFrame:
    """The same of lines in a column value."""
    lines = lines.where(~F.col("value").startswith("#"))
    parts = F.split("value", "\t")
    v = lines.select(*(F.try_element_at(parts, F.lit(i + 1)).alias(c) for i, c in enumerate(COLUMNS)), F.slice(parts, 10, F.greatest(F.size(parts) - 9, F.lit(0))).alias("entries"))
    fmt = F.col("format")

    def dosage(e: Column) -> Column:
        ds = field(e, fmt, "DS").try_cast("double")
        gp = F.transform(F.split(field(e, fmt, "GP"), ","), lambda x: x.try_cast("double"))
        total = F.get(gp, F.lit(0)) + F.get(gp, F.lit(1)) + F.get(gp, F.lit(2))
        sure = (total > 0) & (F.array_max(gp) >= least_probability)
        return F.coalesce(ds, F.when(sure, (F.get(gp, F.lit(1)) + 2 * F.get(gp, F.lit(2))) / total), dosage_of_call(field(e, fmt, "GT")))

    def call(e: Column) -> Column:
        gp = F.transform(F.split(field(e, fmt, "GP"), ","), lambda x: x.try_cast("double"))
        best = F.array_position(gp, F.array_max(gp)).cast("int")
        return F.coalesce(field(e, fmt, "GT"), F.when(F.array_max(gp) >= least_probability, F.get(F.array(*map(F.lit, ("0/0", "0/1", "1/1"))), best - 1)))

    return v.select(
        "chrom",
        F.col("pos").cast("long").alias("pos"),
        F.nullif("id", F.lit(".")).alias("id"),
        "ref",
        F.split("alt", ",").alias("alt"),
        F.col("qual").try_cast("double").alias("qual"),
        F.col("filter"),
        info_map(F.col("info")).alias("info"),
        F.transform("entries", call).alias("calls"),
        F.transform("entries", lambda e: F.contains(field(e, fmt, "GT"), F.lit("|"))).alias("phased"),
        F.transform("entries", dosage).alias("dosages"),
        F.transform("entries", lambda e: field(e, fmt, "DP").try_cast("int")).alias("depths"),
        F.transform("entries", lambda e: field(e, fmt, "GQ").try_cast("double")).alias("qualities"),
    )


def write(variants: DataFrame, path: str, names: list[str] | None = None) -> None:
    """A folder of VCF parts of (chrom, pos, id, ref, alt, dosages), ordered by chromosome and position; joined in
    the order of their names they are one VCF. With names the first row of the first part is the header."""
    alt = F.array_join("alt", ",") if variants.schema["alt"].dataType.typeName() == "array" else F.col("alt")
    call = lambda d: F.when(d.isNull(), "./.:.").otherwise(F.concat(F.when(d < 0.5, "0/0").when(d < 1.5, "0/1").otherwise("1/1"), F.lit(":"), F.round(d, 4).cast("string")))
    entries = F.array_join(F.transform("dosages", call), "\t")
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(".")), "ref", alt, F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT:DS"), entries)
    rows = variants.select(chromosome_order(F.col("chrom").cast("string")).alias("o"), "chrom", F.col("pos").cast("long").alias("pos"), line.alias("value"))
    if names is not None:
        head = ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', '##FORMAT=<ID=DS,Number=1,Type=Float,Description="Dosage">', "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])]
        first = variants.sparkSession.range(1).select(F.lit(None).cast(rows.schema["o"].dataType).alias("o"), F.lit(None).cast(rows.schema["chrom"].dataType).alias("chrom"), F.lit(-1).cast("long").alias("pos"), F.lit("\n".join(head)).alias("value"))
        rows = first.unionByName(rows)
    # nulls come first, so the header leads the first range; ranges become files in their order
    rows.orderBy(F.asc_nulls_first("o"), F.asc_nulls_first("chrom"), "pos").select("value").write.text(path)


def effects(info_ann: Column) -> Column:
    """An ANN annotation as an array of (allele, effect, impact, gene)."""
    return F.transform(F.split(info_ann, ","), lambda x: F.struct(F.split_part(x, F.lit("|"), F.lit(1)).alias("allele"), F.split_part(x, F.lit("|"), F.lit(2)).alias("effect"), F.split_part(x, F.lit("|"), F.lit(3)).alias("impact"), F.split_part(x, F.lit("|"), F.lit(4)).alias("gene")))
