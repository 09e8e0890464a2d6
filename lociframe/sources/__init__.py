"""Readers and writers of genotype, annotation, matrix and result files.

`read_genotypes` and `write_genotypes` choose by format; `sniff` tells the format of a path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import annotation, bgen, dosage_folder, matrices, oxford, plink, ranges, tabix, vcf

#: Suffixes in the order they are tried.
_SUFFIXES = ((".vcf", "vcf"), (".vcf.gz", "vcf"), (".vcf.bgz", "vcf"), (".ped", "ped_map"), (".map", "ped_map"), (".bed", "plink_bed"), (".bim", "plink_bed"), (".fam", "plink_bed"), (".haps", "haps"), (".haps.gz", "haps"), (".gen", "gen"), (".gen.gz", "gen"), (".parquet", "parquet"), (".bgen", "bgen"), ("GenotypeMatrix.dat", "dosage_folder"))


def sniff(path: str) -> str:
    """The format that a path's name tells; ValueError if it tells none."""
    for suffix, name in _SUFFIXES:
        if path.endswith(suffix):
            return name
    raise ValueError(f"no known genotype format: {path}")


def read_genotypes(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Variants with arrays of dosages: (chrom, pos, id, ref, alt, dosages[, ...]). Several files, or a folder of
    one per chromosome, are read as one by a glob."""
    kind = kind or sniff(path)
    stem = path.rsplit(".", 1)[0]
    if kind == "vcf":
        return vcf.read(spark, path)
    if kind == "plink_bed":
        return plink.read_bed(spark, stem)
    if kind == "ped_map":
        return plink.read_ped(spark, stem)
    if kind == "gen":
        return oxford.read_gen(spark, path)
    if kind == "haps":
        return oxford.read_haps(spark, path)
    if kind == "bgen":
        return bgen.read(spark, path)
    if kind == "dosage_folder":
        return dosage_folder.read(spark, path.removesuffix("/GenotypeMatrix.dat"))
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(kind)


def store(variants: DataFrame, path: str) -> None:
    """Variants as Parquet, partitioned by chromosome and sorted by position, so that read_region prunes: folders by
    chromosome, row groups by the least and largest position they hold."""
    variants.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").write.partitionBy("chrom").parquet(path)


def read_region(spark: SparkSession, path: str, chrom: str, first: int, last: int) -> DataFrame:
    """The variants of a region of what store has written, of bgzipped VCF files with an index beside each, of BED filesets, or of BGEN files
    with indexes: only what may hold the region is read."""
    kind = next((name for suffix, name in _SUFFIXES if path.endswith(suffix)), None)
    if kind == "vcf":
        return tabix.read_vcf(spark, path, [(chrom, first, last)])
    if kind == "plink_bed":
        return plink.read_bed(spark, path.rsplit(".", 1)[0], (chrom, first, last))
    if kind == "bgen":
        return bgen.read(spark, path, (chrom, first, last))
    return spark.read.option("basePath", path).parquet(path).where((F.col("chrom").cast("string") == chrom) & F.col("pos").between(first, last))


def _numbered(variants: DataFrame) -> list[str]:
    first = variants.select(F.size("dosages").alias("n")).first()
    return [f"s{i + 1}" for i in range(first["n"] if first else 0)]


def write_genotypes(variants: DataFrame, path: str, kind: str | None = None, samples: list[str] | None = None) -> None:
    """Variants with (chrom, pos, id, ref, alt, dosages) in a format: a folder of parts, in order of place for VCF and
    the binary formats, of which each part is a complete fileset."""
    kind = kind or sniff(path)
    if kind == "vcf":
        vcf.write(variants, path, samples)
    elif kind == "gen":
        oxford.write_gen(variants, path)
    elif kind == "haps":
        oxford.write_haps(variants, path)
    elif kind == "plink_bed":
        plink.write_bed(variants, path, samples or _numbered(variants))
    elif kind == "bgen":
        bgen.write(variants, path, samples or _numbered(variants))
    elif kind == "dosage_folder":
        dosage_folder.write(variants, path, samples or _numbered(variants))
    elif kind == "parquet":
        store(variants, path)
    elif kind == "ped_map":
        plink.write_transposed(variants, path)
    else:
        raise ValueError(kind)


__all__ = ["annotation", "bgen", "dosage_folder", "matrices", "oxford", "plink", "ranges", "read_genotypes", "sniff", "tabix", "vcf", "write_genotypes"]
