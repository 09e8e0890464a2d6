"""PLINK: BED/BIM/FAM, PED/MAP, transposed PED."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .parts import local, write_parts
from .ranges import CHUNK, numbered_lines, open_file, sizes, spread

MAGIC = b"\x6c\x1b\x01"  # fixed value: BED, one variant after another


def _bim(spark: SparkSession, path: str) -> DataFrame:
    x = F.split(F.trim("line"), r"\s+")
    return numbered_lines(spark, path).select("file", F.col("index"), x[0].alias("chrom"), F.nullif(x[1], F.lit(".")).alias("id"), x[2].try_cast("double").alias("cm"), x[3].cast("long").alias("pos"), F.nullif(x[4], F.lit("0")).alias("a1"), F.nullif(x[5], F.lit("0")).alias("a2"))


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    """(index, chrom, id, cm, pos, a1, a2) in file order."""
    return _bim(spark, path).drop("file")


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    """(index, family, sample, father, mother, sex, phenotype); 0 and -9 are null."""
    x = F.split(F.trim("line"), r"\s+")
    none = lambda c: F.nullif(c, F.lit("0"))
    return numbered_lines(spark, path).select("index", x[0].alias("family"), x[1].alias("sample"), none(x[2]).alias("father"), none(x[3]).alias("mother"), F.nullif(x[4].try_cast("int"), F.lit(0)).alias("sex"), F.nullif(x[5].try_cast("double"), F.lit(-9.0)).alias("phenotype"))


_TABLE = np.array([[2.0, np.nan, 1.0, 0.0][(b >> (2 * i)) & 3] for b in range(256) for i in range(4)]).reshape(256, 4)


def decode(blob: bytes, n: int) -> np.ndarray:
    """Counts of the first allele, (variants, n); nan is missing."""
    width = -(-n // 4)
    return _TABLE[np.frombuffer(blob, np.uint8).reshape(-1, width)].reshape(-1, 4 * width)[:, :n]


def bed_ranges(spark: SparkSession, stem: str, region: tuple[str, int, int] | None = None, chunk: int = CHUNK) -> DataFrame:
    """(file, first, variants, samples): runs of variants of about chunk bytes of the filesets at a stem or glob of stems; file is without its
    suffix. With a region (chromosome, first, last) only runs from its first to its last variant."""
    stems = lambda df, suffix: df.withColumn("file", F.regexp_replace("file", rf"\.{suffix}$", ""))
    people = stems(numbered_lines(spark, f"{stem}.fam"), "fam").groupBy("file").agg(F.count("*").alias("samples"))
    files = stems(sizes(spark, f"{stem}.bed"), "bed").join(people, "file").withColumn("width", F.ceil(F.col("samples") / 4))
    files = files.withColumn("each", F.greatest(F.lit(1), F.floor(F.lit(chunk) / F.col("width")))).withColumn("all", F.floor((F.col("length") - 3) / F.col("width")))
    whole = F.when((F.col("length") - 3) % F.col("width") == 0, F.col("all")).otherwise(F.raise_error(F.concat(F.lit("a BED file does not fit its FAM file: "), "file")).cast("long"))
    if region is None:
        runs = files.where("all > 0").withColumn("first", F.explode(F.sequence(F.lit(0), whole - 1, F.col("each"))))
        return runs.select("file", "first", F.least("each", F.col("all") - F.col("first")).alias("variants"), "samples")
    chrom, low, high = region
    inside = stems(_bim(spark, f"{stem}.bim"), "bim").where((F.col("chrom") == chrom) & F.col("pos").between(low, high))
    runs = inside.join(files.withColumn("all", whole), "file").where("index < all").groupBy("file", "samples", F.floor(F.col("index") / F.col("each")).alias("run")).agg(F.min("index").alias("first"), F.max("index").alias("last"))
    return runs.select("file", "first", (F.col("last") - F.col("first") + 1).alias("variants"), "samples")


def read_bed(spark: SparkSession, stem: str, region: tuple[str, int, int] | None = None, chunk: int = CHUNK) -> DataFrame:
    """(chrom, pos, id, ref, alt, dosages): dosages count alt, which is a1 of the BIM file.

    stem may be a glob: each .bed goes with the .bim and .fam of its own stem. Tasks read runs of variants by their
    bytes, of a file of any size; with a region (chromosome, first, last) only bytes between its first and last variant are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first, variants, n in zip(*(c.to_pylist() for c in batch.columns)):
                width = -(-n // 4)
                with open_file(f"{file}.bed") as f:
                    if f.read(3) != MAGIC:
                        raise ValueError(f"not a variant-major BED file: {file}.bed")
                    for s in range(0, variants, step := max(1, (4 << 20) // (8 * n))):
                        k = min(step, variants - s)
                        f.seek(3 + (first + s) * width)
                        d = decode(f.read(k * width), n)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * n), pa.array(d.ravel(), mask=np.isnan(d.ravel())))
                        yield pa.RecordBatch.from_arrays([pa.array([file] * k), pa.array(np.arange(first + s, first + s + k)), lists], names=["file", "index", "dosages"])

    runs = spread(bed_ranges(spark, stem, region, chunk))
    calls = runs.mapInArrow(run, "file string, index long, dosages array<double>")
    bim = _bim(spark, f"{stem}.bim").withColumn("file", F.regexp_replace("file", r"\.bim$", ""))
    if region:
        bim = bim.where((F.col("chrom") == region[0]) & F.col("pos").between(*region[1:]))
    return bim.join(calls, ["file", "index"]).select("chrom", "pos", "id", F.col("a2").alias("ref"), F.col("a1").alias("alt"), "dosages")


def encode(dosages: np.ndarray) -> bytes:
    """BED bytes of (variants, samples) counts of the first allele; nan is missing."""
    code = np.where(np.isnan(dosages), 1, np.where(dosages < 0.5, 3, np.where(dosages < 1.5, 2, 0))).astype(np.uint8)
    pad = -code.shape[1] % 4
    code = np.pad(code, ((0, 0), (0, pad))).reshape(len(code), -1, 4)
    return (code[:, :, 0] | (code[:, :, 1] << 2) | (code[:, :, 2] << 4) | (code[:, :, 3] << 6)).tobytes()


def bed_blocks(variants: DataFrame) -> DataFrame:
    """(chrom, pos, id, ref, alt, bed): each variant's BED bytes, to be written after MAGIC in order."""

    @F.pandas_udf("binary")
    def run(d: pd.Series) -> pd.Series:
        return d.map(lambda x: encode(np.array([[np.nan if y is None else y for y in x]], float)))

    return variants.select("chrom", "pos", "id", "ref", "alt", run("dosages").alias("bed"))


def write_bed(variants: DataFrame, folder: str, samples: list[str]) -> list[str]:
    """Stems folder/part-xxxxx, each a PLINK fileset (.bed, .bim, .fam) of its variants and all samples; alt is
    the first allele of the .bim. No variant passes through the driver."""

    def put(stem: str, rows: Iterator[dict]) -> None:
        with open(f"{stem}.bed", "wb") as bed, open(f"{stem}.bim", "w") as bim, open(f"{stem}.fam", "w") as fam:
            bed.write(MAGIC)
            for r in rows:
                bed.write(encode(np.array([[np.nan if x is None else x for x in r["dosages"]]], float)))
                alt = r["alt"][0] if isinstance(r["alt"], list) else r["alt"]
                bim.write(f"{r['chrom']}\t{r['id'] or '.'}\t0\t{r['pos']}\t{alt or 0}\t{r['ref'] or 0}\n")
            fam.writelines(f"{s} {s} 0 0 0 -9\n" for s in samples)

    return [f"{local(folder)}/{name}" for name, _ in write_parts(variants, folder, put)]


def read_map(spark: SparkSession, path: str) -> DataFrame:
    x = F.split(F.trim("line"), r"\s+")
    return numbered_lines(spark, path).select("index", x[0].alias("chrom"), x[1].alias("id"), x[2].try_cast("double").alias("cm"), x[3].cast("long").alias("pos"))


def read_ped_long(spark: SparkSession, stem: str) -> DataFrame:
    """(sample, index, a, b): the two alleles of each sample and variant; 0 is null."""
    lines = spark.read.text(f"{stem}.ped").where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("x"))
    x = F.col("x")
    n = ((F.size(x) - 6) / 2).cast("int")
    none = lambda c: F.nullif(c, F.lit("0"))
    cells = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.cast("long").alias("index"), none(F.get(x, 6 + 2 * i)).alias("a"), none(F.get(x, 7 + 2 * i)).alias("b")))
    return lines.where(n > 0).select(F.get(x, F.lit(1)).alias("sample"), F.explode(cells).alias("c")).select("sample", "c.*")


def read_ped(spark: SparkSession, stem: str) -> DataFrame:
    """(chrom, pos, id, ref, alt, dosages): alt is the rarer allele, or the later by name; samples by name."""
    long = read_ped_long(spark, stem)
    alleles = long.select("index", F.explode(F.array("a", "b")).alias("x")).where("x is not null").groupBy("index", "x").agg(F.count("*").alias("n"))
    ranked = alleles.groupBy("index").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "x"))).alias("s"))
    names = ranked.select("index", F.get("s", F.lit(0))["x"].alias("ref"), F.get("s", F.lit(1))["x"].alias("alt"))
    d = long.join(names, "index").withColumn("d", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), ((F.col("a") != F.col("ref")).cast("int") + (F.col("b") != F.col("ref")).cast("int")).cast("double")))
    rows = d.groupBy("index", "ref", "alt").agg(F.transform(F.sort_array(F.collect_list(F.struct("sample", "d"))), lambda s: s["d"]).alias("dosages"))
    return read_map(spark, f"{stem}.map").join(rows, "index").select("chrom", "pos", "id", "ref", "alt", "dosages")


def write_transposed(variants: DataFrame, path: str) -> None:
    """Transposed PED lines: chromosome, id, 0, position, then two alleles a sample."""
    call = lambda d: F.when(d.isNull(), "0 0").when(d < 0.5, F.concat_ws(" ", "ref", "ref")).when(d < 1.5, F.concat_ws(" ", "ref", "alt")).otherwise(F.concat_ws(" ", "alt", "alt"))
    variants.select(F.concat_ws(" ", "chrom", F.coalesce(F.col("id").cast("string"), F.lit(".")), F.lit("0"), F.col("pos").cast("string"), F.array_join(F.transform("dosages", call), " ")).alias("value")).write.text(path)
