import numpy as np
from pyspark.sql import functions as F

from lociframe import sources
from lociframe.sources import annotation, matrices, oxford, plink, vcf


def put(folder, name, text):
    p = folder / name
    if isinstance(text, bytes):
        p.write_bytes(text)
    else:
        p.write_text(text)
    return str(p)


def test_sniff():
    assert [sources.sniff(p) for p in ("a.vcf.gz", "a.bed", "a.ped", "x.gen", "x.haps", "d.parquet")] == ["vcf", "plink_bed", "ped_map", "gen", "haps", "parquet"]


def test_vcf_round_trip(spark, tmp_path):
    text = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3\n1\t100\trs1\tA\tG\t50\tPASS\tAC=2;DB\tGT:GP\t0/1:0,1,0\t1|1:.\t./.:.\n1\t200\t.\tC\tT,G\t.\tPASS\t.\tGT\t0/2\t0/0\t1/2\n"
    path = put(tmp_path, "a.vcf", text)
    assert vcf.samples(spark, path) == ["s1", "s2", "s3"]
    v = vcf.read(spark, path).orderBy("pos").collect()
    assert v[0].dosages == [1.0, 2.0, None] and v[0].info == {"AC": "2", "DB": "true"} and v[0].phased == [False, True, False]
    assert v[1].id is None and v[1].alt == ["T", "G"] and v[1].dosages == [1.0, 0.0, 2.0] and v[1].qual is None
    vcf.write(vcf.read(spark, path), str(tmp_path / "out.vcf"), ["s1", "s2", "s3"])
    again = vcf.read(spark, str(tmp_path / "out.vcf")).orderBy("pos").collect()
    assert [r.dosages for r in again] == [r.dosages for r in v]


def test_gen_haps_round_trip(spark, tmp_path):
    g = put(tmp_path, "a.gen", "1 rs1 10 A G 1 0 0 0 0.5 0.5 0 0 0\n")
    r = oxford.read_gen(spark, g).first()
    assert r.dosages == [0.0, 1.5, None]
    oxford.write_gen(oxford.read_gen(spark, g), str(tmp_path / "b.gen"))
    assert oxford.read_gen(spark, str(tmp_path / "b.gen")).first().probabilities == r.probabilities
    h = put(tmp_path, "a.haps", "1 rs1 10 A G 0 1 1 1\n")
    assert oxford.read_haps(spark, h).first().dosages == [1.0, 2.0]
    oxford.write_haps(oxford.read_haps(spark, h), str(tmp_path / "b.haps"))
    assert oxford.read_haps(spark, str(tmp_path / "b.haps")).first().haplotypes == [0, 1, 1, 1]
    s = put(tmp_path, "a.sample", "ID_1 ID_2 missing sex\n0 0 0 D\nf1 s1 0.1 1\nf2 s2 0 0\n")
    assert [(x["index"], x["sample"], x.sex) for x in oxford.read_sample(spark, s).orderBy("index").collect()] == [(0, "s1", 1), (1, "s2", None)]


def test_plink(spark, tmp_path):
    d = np.array([[2, 1, 0, np.nan, 1], [0, 0, 1, 2, 2]])
    put(tmp_path, "a.bed", plink.MAGIC + plink.encode(d))
    put(tmp_path, "a.bim", "1\trs1\t0\t10\tA\tG\n1\trs2\t0\t20\tC\tT\n")
    put(tmp_path, "a.fam", "".join(f"f s{i} 0 0 {i % 3} -9\n" for i in range(5)))
    r = plink.read_bed(spark, str(tmp_path / "a")).orderBy("pos").collect()
    assert r[0].dosages == [2.0, 1.0, 0.0, None, 1.0] and (r[0].ref, r[0].alt) == ("G", "A")
    assert plink.bed_blocks(plink.read_bed(spark, str(tmp_path / "a"))).orderBy("pos").first().bed == plink.encode(d[:1])
    put(tmp_path, "p.ped", "f s1 0 0 1 1 A A C T\nf s2 0 0 1 1 A G 0 0\n")
    put(tmp_path, "p.map", "1 rs1 0 10\n1 rs2 0 20\n")
    p = plink.read_ped(spark, str(tmp_path / "p")).orderBy("pos").collect()
    assert p[0].dosages == [0.0, 1.0] and p[1].dosages == [1.0, None]


def test_annotation(spark, tmp_path):
    b = annotation.read_bed(spark, put(tmp_path, "a.bedfile", "track x\nchr1\t9\t20\tp\t5\t+\n")).first()
    assert (b.chrom, b.start, b.stop, b.strand) == ("1", 10, 20, "+")
    g = annotation.read_gtf(spark, put(tmp_path, "a.gtf", '1\ths\tgene\t5\t9\t.\t+\t.\tgene_id "E1"; gene_name "AB";\n'), ["gene"]).first()
    assert g.attributes == {"gene_id": "E1", "gene_name": "AB"} and g.start == 5
    m = annotation.read_gmt(spark, put(tmp_path, "a.gmt", "s1\turl\tA\tB\n")).collect()
    assert sorted(x.item for x in m) == ["A", "B"]
    terms, edges = annotation.read_obo(spark, put(tmp_path, "a.obo", "format-version: 1.2\n\n[Term]\nid: T:1\nname: root\n\n[Term]\nid: T:2\nname: kid\nis_a: T:1 ! root\n\n[Term]\nid: T:3\nname: old\nis_obsolete: true\n"))
    assert sorted(x.term for x in terms.collect()) == ["T:1", "T:2"] and edges.first().parent == "T:1"
    f = {x.name: x.sequence for x in annotation.read_fasta(spark, put(tmp_path, "a.fa", ">c1 x\nacg\nT\n>c2\nGG\n")).collect()}
    assert f == {"c1": "ACGT", "c2": "GG"}
    p = annotation.read_pileup(spark, put(tmp_path, "a.pileup", "1\t5\ta\t5\t.,G+2ACg^I.$\tIIIII\n")).first()
    assert (p.a, p.g) == (3, 2)
    long = ".+120" + "ACGTN" * 24 + "-75" + "g" * 75 + "c,^+T$"
    p = annotation.read_pileup(spark, put(tmp_path, "b.pileup", f"1\t5\ta\t4\t{long}\tIIII\n")).first()
    assert (p.a, p.c, p.g, p.t) == (2, 1, 0, 1)


def test_matrices(spark, tmp_path):
    path = put(tmp_path, "m.txt", "id\ta\tb\nx\t1\tNA\ny\t-\t2.5\n")
    m = matrices.read_matrix(spark, path, ["b"], ["y"]).first()
    assert (m.row, m.b) == ("y", 2.5)
    assert matrices.inspect(matrices.read_matrix(spark, path)).first() == (2, 2, 2)
    assert matrices.read_cells(spark, path).where("value is not null").count() == 2
    res = spark.createDataFrame([(0.5, "rs1", "1", 10, "p", "1", 20, -0.7), (0.01, "rs2", "1", 11, "p", "1", 20, 2.6)], "p double, snp string, snp_chrom string, snp_pos long, probe string, probe_chrom string, probe_pos long, z double")
    matrices.write_results(res, str(tmp_path / "res"))
    back = matrices.read_results(spark, str(tmp_path / "res")).orderBy("p").collect()
    assert [(r.snp, r.z) for r in back] == [("rs2", 2.6), ("rs1", -0.7)]


def panel(spark):
    rows = [("2", 50, "c", "A", "G", [0.0, 1.0, None, 2.0]), ("1", 300, "b", "T", "C", [2.0, 2.0, 1.0, 0.0]), ("1", 20, None, "C", "G", [None, 0.0, 0.0, 1.0]), ("X", 9, "d", "A", "T", [1.0, 1.0, 0.0, 2.0])]
    return spark.createDataFrame(rows, "chrom string, pos long, id string, ref string, alt string, dosages array<double>"), rows


def test_written_vcf_parts_join_to_one_file(spark, tmp_path):
    import glob

    v, _ = panel(spark)
    vcf.write(v, f"file://{tmp_path}/o", ["a", "b", "c", "d"])
    text = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/o/part-*")))
    assert text.startswith("##fileformat=VCF")
    body = [x.split("\t")[:2] for x in text.splitlines() if not x.startswith("#")]
    assert body == [["1", "20"], ["1", "300"], ["2", "50"], ["X", "9"]]


def test_vcf_posterior_rule(spark, tmp_path):
    text = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3\n1\t1\t.\tA\tG\t.\t.\t.\tGP:DP:GQ\t0.1,0.8,0.1:7:30\t0.34,0.33,0.33:.:.\t.\n"
    r = vcf.read(spark, put(tmp_path, "p.vcf", text), 0.4).first()
    assert r.calls == ["0/1", None, None] and r.dosages == [1.0, None, None] and r.depths == [7, None, None] and r.qualities == [30.0, None, None]
    assert vcf.read(spark, str(tmp_path / "p.vcf"), 0.3).first().dosages[1] is not None


def test_bed_filesets_round_trip(spark, tmp_path):
    v, rows = panel(spark)
    stems = plink.write_bed(v, f"file://{tmp_path}/bed", ["a", "b", "c", "d"])
    got = [r for s in stems for r in plink.read_bed(spark, s).collect()]
    assert {(r.chrom, r.pos): (r.id, r.ref, r.alt, r.dosages) for r in got} == {r[:2]: tuple(r[2:]) for r in rows}


def test_dosage_folder_round_trip(spark, tmp_path):
    v, rows = panel(spark)
    folders = sources.dosage_folder.write(v, str(tmp_path / "tt"), ["a", "b", "c", "d"])
    got = [r for f in folders for r in sources.dosage_folder.read(spark, f).collect()]
    assert len(got) == 4
    for r in got:
        want = next(x for x in rows if x[:2] == (r.chrom, r.pos))
        assert (r.ref, r.alt) == tuple(sorted(want[3:5]))
        assert r.dosages == [x if x is None or (r.ref == want[3]) else 2 - x for x in want[5]]
    samples = sources.dosage_folder.read_samples(spark, folders[0]).orderBy("index").collect()
    assert [r.sample for r in samples] == ["a", "b", "c", "d"] and all(r.included for r in samples)
    with open(f"{folders[0]}/PhenotypeInformation.txt", "w") as f:
        f.write("a\tunknown\texclude\tunknown\n")
    assert {len(r.dosages) for r in sources.dosage_folder.read(spark, folders[0]).collect()} == {3}


def test_bgen_round_trip_and_region(spark, tmp_path):
    v, rows = panel(spark)
    v = v.withColumn("dosages", F.transform("dosages", lambda d: F.when(d == 1, 0.75).otherwise(d)))
    files = sources.bgen.write(v, str(tmp_path / "bg"), ["a", "b", "c", "d"])
    got = sources.read_genotypes(spark, f"file://{tmp_path}/bg/*.bgen", "bgen").collect()
    assert {(r.chrom, r.pos, r.ref, r.alt) for r in got} == {(r[0], r[1], r[3], r[4]) for r in rows}
    for r in got:
        want = next(x for x in rows if x[:2] == (r.chrom, r.pos))[5]
        assert all((a is None) == (b is None) and (a is None or abs(a - (0.75 if b == 1 else b)) < 1e-4) for a, b in zip(r.dosages, want))
    assert sources.bgen.header(open(files[0], "rb").read())[4] == ["a", "b", "c", "d"]
    near = [r for f in files for r in sources.bgen.read(spark, f"file://{f}", ("1", 100, 400)).collect()]
    assert [(r.chrom, r.pos) for r in near] == [("1", 300)]
    block = b"\x01\x00\x00\x00\x02\x00\x02\x02" + bytes([2]) + bytes([1, 8]) + bytes([255, 0])
    assert sources.bgen.probabilities(block, 1, 2).tolist() == [[0.0, 1.0, 0.0]]


def test_region_scan_prunes(spark, tmp_path, capsys):
    v, rows = panel(spark)
    sources.store(v, f"file://{tmp_path}/v")
    got = sources.read_region(spark, f"file://{tmp_path}/v", "1", 1, 100)
    assert [(str(r.chrom), r.pos) for r in got.collect()] == [("1", 20)]
    got.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(chrom" in plan and "GreaterThanOrEqual(pos,1)" in plan


def test_small_annotation_readers(spark, tmp_path):
    r = annotation.read_regulome(spark, put(tmp_path, "r.txt", "chr1\t9\trs1\tMotifs|A, ChIP|B\t2a\n")).first()
    assert (r.chrom, r.pos, r.id, r.data, r.score) == ("1", 10, "rs1", ["Motifs|A", "ChIP|B"], "2a")
    w = annotation.read_wig(spark, put(tmp_path, "w.wig", "track x\nfixedStep chrom=chr2 start=5 step=10 span=2\n1\n2.5\nvariableStep chrom=chr3\n7 9\n")).orderBy("chrom", "start").collect()
    assert [tuple(x) for x in w] == [("2", 5, 6, 1.0), ("2", 15, 16, 2.5), ("3", 7, 7, 9.0)]
    s = annotation.read_soft(spark, put(tmp_path, "s.soft", "^DATABASE = G\n^PLATFORM = GPL1\n!x = y\n!platform_table_begin\nID\tSYMBOL\n1\tA\n2\tB\n!platform_table_end\n")).collect()
    assert [(x.entity, x.row) for x in s] == [("GPL1", {"ID": "1", "SYMBOL": "A"}), ("GPL1", {"ID": "2", "SYMBOL": "B"})]
    c = annotation.read_contacts(spark, put(tmp_path, "c.txt", "30\t10\t2.5\n10\t20\t1\n")).collect()
    assert [tuple(x) for x in c] == [(10, 20, 1.0), (10, 30, 2.5)]
