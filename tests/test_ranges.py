"""Files by byte ranges: more tasks than files, files over 2 GB, and only the bytes of a region."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe import sources
from lociframe.sources import bgen, plink, ranges


def test_lines_are_numbered_by_file(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        want = {}
        for name, n in (("a b+c.txt", 500), ("é.txt", 1), ("z.txt", 333)):
            lines = [f"{name} {i} " + "x" * (i % 40) for i in range(n)]
            (tmp_path / name).write_text("\n\n".join(lines) + "\n")
            want |= {(str(tmp_path / name), i): x for i, x in enumerate(lines)}
        got = ranges.numbered_lines(spark, f"file://{tmp_path}/*.txt")
        assert {(r.file, r["index"]): r.line for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def put_fileset(folder, name, d, chrom):
    (folder / f"{name}.bed").write_bytes(plink.MAGIC + plink.encode(d))
    (folder / f"{name}.bim").write_text("".join(f"{chrom}\trs{chrom}_{i}\t0\t{10 * i}\tA\tG\n" for i in range(len(d))))
    (folder / f"{name}.fam").write_text("".join(f"f s{i} 0 0 1 -9\n" for i in range(d.shape[1])))


def test_bed_by_ranges_of_a_glob(spark, tmp_path):
    rng = np.random.default_rng(0)
    want = {}
    for chrom, (n, samples) in {"1": (900, 13), "2": (40, 8), "3": (1, 1)}.items():  # filesets of their own samples
        d = rng.choice([0.0, 1.0, 2.0, np.nan], (n, samples))
        put_fileset(tmp_path, f"chr{chrom}", d, chrom)
        want |= {(chrom, 10 * i): [None if np.isnan(x) else x for x in row] for i, row in enumerate(d)}
    runs = plink.bed_ranges(spark, f"file://{tmp_path}/chr*", chunk=200)
    assert runs.count() >= 20 and runs.agg(F.sum("variants")).first()[0] == 941  # more ranges than files
    got = plink.read_bed(spark, f"file://{tmp_path}/chr*", chunk=200).collect()
    assert {(r.chrom, r.pos): r.dosages for r in got} == want and len(got) == 941
    near = plink.read_bed(spark, f"file://{tmp_path}/chr*", ("1", 100, 250), 200).collect()
    assert {(r.chrom, r.pos) for r in near} == {("1", p) for p in range(100, 251, 10)} and all(r.dosages == want[(r.chrom, r.pos)] for r in near)
    with open(tmp_path / "chr2.bed", "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="does not fit"):
        plink.read_bed(spark, f"file://{tmp_path}/chr2").collect()


def test_a_bed_file_over_two_gigabytes(spark, tmp_path):
    """A sparse file: Spark's binary reader would refuse its content; a region at its end reads a few bytes."""
    samples, variants = 40_000, 230_000
    width = samples // 4
    with open(tmp_path / "big.bed", "wb") as f:
        f.write(plink.MAGIC)
        f.truncate(3 + width * variants)
        f.seek(3 + width * (variants - 1))
        f.write(b"\xff" * width)
    assert (tmp_path / "big.bed").stat().st_size > 2**31
    (tmp_path / "big.fam").write_text("f s 0 0 1 -9\n" * samples)
    with open(tmp_path / "big.bim", "w") as f:
        f.writelines(f"1\trs{i}\t0\t{i}\tA\tG\n" for i in range(variants))
    assert plink.bed_ranges(spark, f"file://{tmp_path}/big").count() > 60
    got = plink.read_bed(spark, f"file://{tmp_path}/big", ("1", variants - 2, variants)).orderBy("pos").select("pos", F.array_distinct("dosages").alias("d"), F.size("dosages").alias("n")).collect()
    assert [(r.pos, r.d, r.n) for r in got] == [(variants - 2, [2.0], samples), (variants - 1, [0.0], samples)]


def test_bgen_by_runs(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(str(1 + i % 2), 10 * i, f"rs{i}", "A" * (1 + i % 700), "G", rng.choice([0.0, 1.0, 2.0], 9).tolist()) for i in range(400)]
    v = spark.createDataFrame(rows, "chrom string, pos long, id string, ref string, alt string, dosages array<double>")
    files = bgen.write(v.repartition(3), str(tmp_path / "bg"), [f"s{i}" for i in range(9)])
    entries = bgen.skim(spark, f"file://{tmp_path}/bg/*.bgen")
    listed = bgen.read_index(spark, f"file://{tmp_path}/bg/*.bgi").withColumn("file", ranges.plain_name(F.col("file")))
    assert sorted(map(str, entries.collect())) == sorted(map(str, listed.collect()))  # heads tell what the index tells
    assert bgen.variant_runs(entries, 2000).count() > 4 * len(files)
    got = bgen.read(spark, f"file://{tmp_path}/bg/*.bgen", chunk=2000).collect()
    assert {(r.chrom, r.pos): (r.id, r.ref, r.alt, [round(x, 3) for x in r.dosages]) for r in got} == {r[:2]: (*r[2:5], r[5]) for r in rows} and len(got) == 400
    with open(files[0], "rb") as f:
        assert bgen.header(f.read())[1] == 9
        f.seek(8)
        assert int.from_bytes(f.read(4), "little") == listed.where(F.col("file") == files[0]).count()


def test_parts_are_streamed(spark, tmp_path, monkeypatch):
    """A writer sees rows one after another, not a list of its partition."""
    from lociframe.sources import parts

    v = spark.range(1000).select(F.lit("1").alias("chrom"), F.col("id").alias("pos"), F.col("id").cast("string").alias("id"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), F.array(F.lit(1.0)).alias("dosages"))

    def put(stem, rows):
        assert not isinstance(rows, list)
        with open(stem, "w") as f:
            f.writelines(f"{r['pos']}\n" for r in rows)

    made = parts.write_parts(v.repartition(7), f"file://{tmp_path}/p", put)
    text = "".join(open(f"{tmp_path}/p/{name}").read() for name, _ in made)
    assert sum(n for _, n in made) == 1000 and text.split() == [str(i) for i in range(1000)]


def test_dosage_folder_by_ranges(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [("1", i, f"v{i}", "A", "C", rng.choice([0.0, 1.0, 2.0], 5).tolist()) for i in range(300)]
    v = spark.createDataFrame(rows, "chrom string, pos long, id string, ref string, alt string, dosages array<double>").coalesce(1)
    folder = sources.dosage_folder.write(v, str(tmp_path / "d"), list("abcde"))
    got = [r for f in folder for r in sources.dosage_folder.read(spark, f).collect()]
    assert {r.pos: r.dosages for r in got} == {r[1]: r[5] for r in rows}
    assert sum(sources.dosage_folder._records(spark, f"{f}/GenotypeMatrix.dat", 10, "x", 100).count() for f in folder) == 300
