"""Folders of allele and dosage matrices of fixed width, with lists of variants and individuals.

The matrices are read by records of fixed length, so a large file is split between tasks."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .parts import local, write_parts
from .ranges import CHUNK, numbered_lines, open_file, sizes, spread


def read_samples(spark: SparkSession, folder: str) -> DataFrame:
    """(index, sample, status, included, sex) in file order; individuals without a line of phenotypes count as included."""
    one = numbered_lines(spark, f"{folder}/Individuals.txt").select("index", F.trim("line").alias("sample"))
    x = F.split("value", "\t")
    about = spark.read.text(f"{folder}/PhenotypeInformation.txt").where(F.trim("value") != "").select(F.get(x, F.lit(0)).alias("sample"), F.get(x, F.lit(1)).alias("status"), (F.lower(F.get(x, F.lit(2))) == "include").alias("included"), F.lower(F.get(x, F.lit(3))).alias("sex"))
    return one.join(about.dropDuplicates(["sample"]), "sample", "left").select("index", "sample", "status", F.coalesce("included", F.lit(True)).alias("included"), "sex")


def read_variants(spark: SparkSession, folder: str) -> DataFrame:
    """(index, id, chrom, pos) in file order; variants without a mapping have null places."""
    ids = numbered_lines(spark, f"{folder}/SNPs.txt").select("index", F.trim("line").alias("id"))
    x = F.split("value", "\t")
    places = spark.read.text(f"{folder}/SNPMappings.txt").where(F.trim("value") != "").select(F.get(x, F.lit(2)).alias("id"), F.get(x, F.lit(0)).alias("chrom"), F.get(x, F.lit(1)).try_cast("long").alias("pos"))
    return ids.join(places.dropDuplicates(["id"]), "id", "left").select("index", "id", "chrom", "pos")


def _records(spark: SparkSession, path: str, width: int, name: str, chunk: int = CHUNK) -> DataFrame:
    """(index, name): the records of width bytes of a file, read by ranges."""
    each, all_ = max(1, chunk // max(1, width)), F.floor(F.col("length") / width)
    runs = sizes(spark, path).where(F.col("length") >= width).withColumn("first", F.explode(F.sequence(F.lit(0), all_ - 1, F.lit(each))))
    runs = spread(runs.select("file", "first", F.least(F.lit(each), all_ - F.col("first")).alias("n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                with open_file(file) as f:
                    for s in range(0, n, step := max(1, (1 << 20) // width)):
                        k = min(step, n - s)
                        f.seek((first + s) * width)
                        data = pa.py_buffer(f.read(k * width))
                        rows = pa.Array.from_buffers(pa.binary(width), k, [None, data]).cast(pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + s, first + s + k)), rows], names=["index", name])

    return runs.mapInArrow(run, f"index long, {name} binary")


def read(spark: SparkSession, folder: str, only_included: bool = True) -> DataFrame:
    """(chrom, pos, id, ref, alt, dosages) of the folder's variants; dosages count alt and are null where the call is
    missing. Of a variant's two alleles the first by name is ref; more than two are an error. Stored dosages, if there
    are any, are turned to count alt as the calls do (by the sign of what they have in common)."""
    samples = read_samples(spark, folder)
    every = samples.count()
    keep = np.array([r["index"] for r in samples.where("included").select("index").orderBy("index").collect()] if only_included else range(every), int)  # samples, a bounded side
    both = _records(spark, f"{folder}/GenotypeMatrix.dat", 2 * every, "calls")
    names = spark.read.format("binaryFile").option("pathGlobFilter", "ImputedDosageMatrix.dat").load(folder).select("path")
    if not names.isEmpty():
        both = both.join(_records(spark, f"{folder}/ImputedDosageMatrix.dat", every, "stored"), "index")
    else:
        both = both.withColumn("stored", F.lit(None).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for index, calls, stored in zip(*(c.to_pylist() for c in batch.columns)):
                a = np.frombuffer(calls, np.uint8).reshape(2, -1)[:, keep]
                seen = sorted(set(np.unique(a).tolist()) - {0, ord("0"), ord("-")})
                if len(seen) > 2:
                    raise ValueError(f"more than two alleles in variant {index}")
                ref, alt = (chr(seen[i]) if i < len(seen) else None for i in (0, 1))
                known = np.isin(a, seen).all(axis=0)
                d = (a == (ord(alt) if alt else 255)).sum(axis=0).astype(float)
                if stored is not None:
                    own = (np.frombuffer(stored, np.int8)[keep].astype(float) + 128) / 100
                    turn = ((d - d[known].mean()) * (own - own[known].mean()))[known].sum() < 0 if known.any() else False
                    d = 2 - own if turn else own
                out.append((index, ref, alt, [float(x) if k else None for x, k in zip(d, known)]))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["index", "ref", "alt", "dosages"])

    got = both.select("index", "calls", "stored").mapInArrow(run, "index long, ref string, alt string, dosages array<double>")
    return read_variants(spark, folder).join(got, "index").select("chrom", "pos", "id", "ref", "alt", "dosages")


def write(variants: DataFrame, folder: str, samples: list[str]) -> list[str]:
    """Folders folder/part-xxxxx, each a folder of this format with its variants, with one-base alleles, and all samples."""

    def put(stem: str, rows: Iterator[dict]) -> None:
        os.makedirs(stem)
        with open(f"{stem}/GenotypeMatrix.dat", "wb") as g, open(f"{stem}/ImputedDosageMatrix.dat", "wb") as m, open(f"{stem}/SNPs.txt", "w") as ids, open(f"{stem}/SNPMappings.txt", "w") as places:
            for r in rows:
                d = np.array([np.nan if x is None else x for x in r["dosages"]], float)
                alt = r["alt"][0] if isinstance(r["alt"], list) else r["alt"]
                call, none = np.round(np.nan_to_num(d)), np.isnan(d)
                ref_code, alt_code = ord(r["ref"]), ord(alt)
                g.write(np.where(none, 0, np.where(call >= 2, alt_code, ref_code)).astype(np.uint8).tobytes() + np.where(none, 0, np.where(call >= 1, alt_code, ref_code)).astype(np.uint8).tobytes())
                m.write((np.round(np.nan_to_num(d) * 100) - 128).astype(np.int8).tobytes())
                name = r["id"] or f"{r['chrom']}:{r['pos']}"
                ids.write(f"{name}\n")
                places.write(f"{r['chrom']}\t{r['pos']}\t{name}\n")
        with open(f"{stem}/Individuals.txt", "w") as f:
            f.writelines(f"{s}\n" for s in samples)
        with open(f"{stem}/PhenotypeInformation.txt", "w") as f:
            f.writelines(f"{s}\tunknown\tinclude\tunknown\n" for s in samples)

    return [f"{local(folder)}/{name}" for name, _ in write_parts(variants, folder, put)]
