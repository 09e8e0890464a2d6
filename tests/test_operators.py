import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.operators import aggregates as agg
from lociframe.operators import enrichment, filters, intervals, ld, matrix, meta, models, ordered, ranks, screens, testing
from lociframe.plans import workflows as flow


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_band_join_matches_all_pairs(spark):
    rng = random.Random(1)
    a = [(i, rng.randint(0, 2), rng.randint(-300, 300)) for i in range(60)]
    b = [(i, rng.randint(0, 2), rng.randint(-300, 300)) for i in range(60)]
    got = rows(intervals.band_join(spark.createDataFrame(a, "i int, c int, p int"), spark.createDataFrame(b, "j int, c int, q int"), ["c"], "p", "q", 40).select("i", "j"))
    assert got == sorted((i, j) for (i, c, p), (j, d, q) in itertools.product(a, b) if c == d and abs(p - q) < 40)


def test_interval_joins_match_all_pairs(spark):
    rng = random.Random(2)
    spans = lambda n: [(i, rng.randint(0, 1), s, s + rng.randint(0, 90)) for i in range(n) for s in [rng.randint(0, 500)]]
    a, b = spans(40), spans(40)
    da, db = spark.createDataFrame(a, "i int, c int, s int, e int"), spark.createDataFrame(b, "j int, c int, s2 int, e2 int")
    got = rows(intervals.overlap_join(da, db, ["c"], ("s", "e"), ("s2", "e2"), 50).select("i", "j"))
    assert got == sorted((x[0], y[0]) for x, y in itertools.product(a, b) if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    pts = [(i, rng.randint(0, 1), rng.randint(0, 500)) for i in range(50)]
    dp = spark.createDataFrame(pts, "k int, c int, p int")
    hit = sorted((p[0], y[0]) for p, y in itertools.product(pts, b) if p[1] == y[1] and y[2] <= p[2] <= y[3])
    assert rows(intervals.point_join(dp, db, ["c"], "p", "s2", "e2", 50).select("k", "j")) == hit
    out = rows(intervals.point_join(dp, db, ["c"], "p", "s2", "e2", 50, "left_anti").select("k"))
    assert out == sorted((p[0],) for p in pts if p[0] not in {h[0] for h in hit})


def test_as_of_merge_and_contained(spark):
    left = spark.createDataFrame([(1, "x", 5), (2, "x", 1), (3, "y", 9)], "id int, c string, p int")
    right = spark.createDataFrame([("x", 2, 20), ("x", 5, 50), ("x", 6, 60)], "c string, s int, v int")
    assert rows(intervals.as_of_join(left, right, ["c"], "p", "s", ["v"]).select("id", F.coalesce("v", F.lit(-1)))) == [(1, 50), (2, -1), (3, -1)]
    s = spark.createDataFrame([("x", 1, 5), ("x", 4, 8), ("x", 10, 12), ("x", 11, 11), ("x", 10, 12)], "c string, s int, e int")
    assert rows(intervals.merge_spans(s, ["c"], "s", "e")) == [("x", 1, 8, 2), ("x", 10, 12, 3)]
    assert rows(intervals.drop_contained(s, ["c"], "s", "e").select("s", "e")) == [(1, 5), (4, 8), (10, 12)]


def test_running_sums_equal_one_window(spark):
    rng = random.Random(3)
    data = [(i, rng.choice([0.1, 0.2, 0.5, rng.random()])) for i in range(500)]
    df = spark.createDataFrame(data, "id int, p double")
    got = {r.id: r.run for r in ordered.running_sums(df, "p", ["p", "id"], {"run": F.lit(1)}).collect()}
    assert got == {i: k + 1 for k, (i, _) in enumerate(sorted(data, key=lambda x: (x[1], x[0])))}


def test_benjamini_hochberg_and_holm(spark):
    ps = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216]
    df = spark.createDataFrame(list(enumerate(ps)) + [(99, None)], "id int, p double")
    q = [r.q for r in testing.benjamini_hochberg(df, "p", "id").orderBy("id").collect()]
    n = len(ps)
    want = [min(1, min(ps[j] * n / (j + 1) for j in range(i, n))) for i in range(n)]
    assert np.allclose(q, want)
    assert [r.rejected for r in testing.holm(df, "p", "id").orderBy("id").collect()] == [True, False] + [False] * 8


def test_permutation_fdr_ties_and_cap(spark):
    real = spark.createDataFrame([(0.1,), (0.2,), (0.2,), (0.9,)], "p double")
    perm = spark.createDataFrame([(0.15,), (0.2,), (0.3,), (0.5,)], "p double")
    assert rows(testing.permutation_fdr(real, perm, "p", 2)) == [(0.1, 1, 0, 0.0), (0.2, 3, 2, 2 / 2 / 3), (0.9, 4, 4, 0.5)]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "id int, p double, g string, z double, n int")
    assert rows(testing.benjamini_hochberg(e, "p", "id")) == []
    assert rows(testing.permutation_fdr(e, e, "p", 3)) == []
    assert rows(meta.weighted_z(e, ["g"], "z", "n")) == []
    assert rows(ranks.ranked(e, ["g"], "z")) == []


def test_weighted_z_flip_negates(spark):
    d = spark.createDataFrame([("a", 2.0, 100, 1), ("a", -1.0, 50, 1), ("a", None, 70, 1)], "g string, z double, n int, f int")
    x = meta.weighted_z(d, ["g"], "z", "n", flip="f").first()
    y = meta.weighted_z(d.withColumn("f", F.lit(-1)), ["g"], "z", "n", flip="f").first()
    assert abs(x.z - (10 * 2 - math.sqrt(50)) / math.sqrt(150)) < 1e-12 and x.datasets == 2
    assert abs(x.z + y.z) < 1e-12


def test_ld_goldens(spark):
    same = np.zeros((1, 3, 3))
    same[0, 0, 0], same[0, 1, 1], same[0, 2, 2] = 4, 2, 4
    p = ld.haplotypes(same)[0]
    assert abs(p[0] - 0.5) < 1e-6 and abs(p[3] - 0.5) < 1e-6
    counts = spark.createDataFrame([(1, 2, 4, 0, 0, 0, 2, 0, 0, 0, 4)], "a int, b int, n00 long, n01 long, n02 long, n10 long, n11 long, n12 long, n20 long, n21 long, n22 long")
    r = ld.em_ld(counts).first()
    assert abs(r.r2 - 1) < 1e-6 and abs(r.d_prime - 1) < 1e-6
    assert abs(ld.genotype_r2(counts).first().r2 - 1) < 1e-12


def test_clump_and_prune(spark):
    h = spark.createDataFrame([("1", 100, 0.01, 1), ("1", 150, 0.001, 2), ("1", 400, 0.02, 3), ("1", 190, 0.5, 4), ("2", 100, 0.3, 5)], "c string, pos int, p double, k int")
    got = {r.k: r.locus for r in ld.clump(h, "c", "pos", "p", "k", 60).collect()}
    assert got == {1: 2, 2: 2, 3: 3, 4: 2, 5: 5}
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a int, b int")
    v = spark.createDataFrame([(i, i * 10) for i in range(1, 6)], "k int, pos int")
    assert rows(ld.prune(v, links, "k", "pos").select("k")) == [(1,), (3,), (5,)]
    assert rows(ld.components(links)) == [(1, 1), (2, 1), (3, 1), (4, 1)]


def test_ranks(spark):
    d = spark.createDataFrame([("a", i, x) for i, x in enumerate([3.0, 1.0, 3.0, 2.0, None])], "g string, i int, x double")
    assert [r["rank"] for r in ranks.ranked(d, ["g"], "x").orderBy("i").collect()] == [3.5, 1.0, 3.5, 2.0]
    n = [r.normal for r in ranks.inverse_normal(d, ["g"], "x").orderBy("i").collect()]
    assert abs(sum(sorted(n)[:1]) + 1.15034938) < 1e-6


def test_interaction_regression_and_nnls(spark):
    rng = np.random.default_rng(0)
    x, c = rng.normal(size=80), rng.normal(size=80)
    y = 1 + 2 * x - c + 0.5 * x * c + rng.normal(size=80) * 0.01
    d = spark.createDataFrame([("g", float(a), float(b), float(e)) for a, b, e in zip(x, c, y)], "g string, x double, c double, y double")
    f = agg.interaction_regression(d, ["g"], "x", "c", "y").first()
    assert abs(f.b1 - 2) < 0.01 and abs(f.b3 - 0.5) < 0.01 and f.t3 > 50
    a = np.array([[1.0, 0], [1, 1], [0, 1]])
    assert np.allclose(models.nnls(a, a @ [2, 0.5]), [2, 0.5])
    assert np.allclose(models.nnls(a, a @ [2, -1.0])[1], 0)


def test_beta_fit_recovers(spark):
    p = np.random.default_rng(4).beta(2.0, 30.0, 4000)
    a, b = models.fit_beta(p)
    assert abs(a - 2) < 0.15 and abs(b - 30) < 2.5


def test_gls_with_unit_blocks_is_least_squares(spark):
    rng = np.random.default_rng(5)
    n = 30
    x = rng.normal(size=n)
    y = 3 * x + rng.normal(size=n)
    data = [(i // 10, i, float(x[i]), float(y[i]), [1.0 if j == i % 10 else 0.0 for j in range(10)]) for i in range(n)]
    r = models.generalised_least_squares(spark.createDataFrame(data, "b int, i int, x double, y double, r array<double>"), "b", "i", "x", "y", "r").first()
    assert abs(r.beta - np.polyfit(x, y, 1)[0]) < 1e-9 and r.n == n


def test_matrix(spark):
    m = np.random.default_rng(6).normal(size=(50, 4))
    d = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(m)], "i int, v array<double>")
    _, cov, n = matrix.gram(d, "v")
    assert n == 50 and np.allclose(cov, np.cov(m.T))
    w, x = matrix.principal_coordinates(np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1)), 4)
    assert np.allclose(((x[:, None] - x[None]) ** 2).sum(-1), ((m[:, None] - m[None]) ** 2).sum(-1))
    res = matrix.regress_out(d, "v", np.arange(4.0)[:, None]).first()
    assert abs(sum(res.residual)) < 1e-9
    assert matrix.same(d, d.orderBy(F.desc("i"))) and not matrix.same(d, d.limit(3))
    cells = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0)], "r string, c string, v double")
    assert rows(matrix.transpose(cells, "r", "c", "v")) == [("x", "a", 1.0), ("x", "b", 2.0)]


def test_filters(spark):
    d = spark.createDataFrame([(1, 0.05), (2, None), (3, 0.2)], "id int, maf double")
    assert rows(d.where(filters.at_least(F.col("maf"), 0.05)).select("id")) == [(1,), (3,)]
    assert rows(d.where(filters.at_least(F.col("maf"), 0.05, inclusive=False)).select("id")) == [(3,)]
    e = spark.createDataFrame([(1, 0.4, False), (3, None, True)], "id int, maf double, excluded boolean")
    assert rows(filters.overlay(d, e, "id", ["maf"]).where("id != 2")) == [(1, 0.4)]


def test_enrichment(spark):
    m = spark.createDataFrame([(i, "s") for i in range(5)], "item int, grp string")
    h = spark.createDataFrame([(i, i < 4, float(-i)) for i in range(20)], "item int, hit boolean, score double")
    r = enrichment.fisher_enrichment(h, m, "item", "grp", "hit").first()
    assert (r.a, r.b, r.c, r.d) == (4, 0, 1, 15) and r.p < 0.002
    assert enrichment.rank_enrichment(h, m, "item", "grp", "score").first().auc == 1.0
    parents = spark.createDataFrame([("c", "b"), ("b", "a"), ("d", "a")], "term string, parent string")
    got = rows(enrichment.roll_up(spark.createDataFrame([("c",), ("d",)], "term string"), parents, spark.createDataFrame([("a",), ("d",)], "term string"), "term", "parent"))
    assert got == [("c", "a"), ("d", "d")]
    assert len(rows(enrichment.descendants(parents, "term", "parent"))) == 4


def test_conditional_mapping_finds_two_effects(spark):
    rng = np.random.default_rng(8)
    n = 200
    g = rng.integers(0, 3, size=(3, n))
    y = 2.0 * g[0] + 1.0 * g[1] + rng.normal(size=n) * 0.5
    geno = spark.createDataFrame([(v, s, float(g[v, s])) for v in range(3) for s in range(n)], "variant int, sample int, dosage double")
    val = spark.createDataFrame([(0, s, float(y[s])) for s in range(n)], "gene int, sample int, value double")
    pairs = spark.createDataFrame([(v, 0) for v in range(3)], "variant int, gene int")
    got = {r.round: r.variant for r in flow.conditional_mapping(pairs, geno, val, 1e-6, 4).collect()}
    assert got[1] == 0 and got[2] == 1


def test_shuffles_are_permutations(spark):
    s = flow.shuffled_samples(spark.range(20).withColumnRenamed("id", "sample"), "sample", 3, 9)
    for perm in range(4):
        r = s.where(F.col("perm") == perm).collect()
        assert sorted(x.sample for x in r) == sorted(x.shuffled for x in r) == list(range(20))
    assert rows(s) == rows(flow.shuffled_samples(spark.range(20).withColumnRenamed("id", "sample"), "sample", 3, 9))


def test_harmonise_actions(spark):
    study = spark.createDataFrame([(1, "1", 10, "A", "G", 0.2), (2, "1", 20, "A", "G", 0.2), (3, "1", 30, "A", "T", 0.1), (4, "1", 40, "A", "T", 0.48), (5, "1", 50, "A", "C", 0.2)], "variant int, chrom string, pos int, ref string, alt string, maf double")
    ref = spark.createDataFrame([(11, "1", 10, "G", "A", 0.2), (12, "1", 20, "T", "C", 0.2), (13, "1", 30, "A", "T", 0.12), (14, "1", 40, "A", "T", 0.48), (15, "1", 50, "G", "A", 0.2)], "ref_id int, chrom string, pos int, ref string, alt string, maf double")
    got = {r.variant: r.action for r in flow.harmonise(study, ref).collect()}
    assert got == {1: "keep", 2: "swap", 3: "keep", 4: "exclude"}


def test_bounded_cis_mapping_runs(spark):
    rng = np.random.default_rng(1)
    variants = spark.createDataFrame([(v, "1", v * 10) for v in range(4)], "variant int, chrom string, pos int")
    genes = spark.createDataFrame([(0, "1", 15)], "gene int, chrom string, mid int")
    n = 60
    g = rng.integers(0, 3, size=(4, n))
    geno = spark.createDataFrame([(v, s, int(g[v, s])) for v in range(4) for s in range(n)], "variant int, sample int, dosage int")
    t = spark.createDataFrame([(0, s, "d", float(3 * g[2, s] + rng.normal())) for s in range(n)], "gene int, sample int, dataset string, value double")
    m = flow.cis_mapping(variants, genes, geno, t, 1000, hwe=None, permutations=2, seed=3).orderBy("p").first()
    assert m.variant == 2 and m.fdr == 0.0


@pytest.mark.parametrize("welch", [True, False])
def test_t_test(spark, welch):
    d = spark.createDataFrame([("g", True, 1.0), ("g", True, 2.0), ("g", True, 3.0), ("g", False, 5.0), ("g", False, 7.0)], "k string, a boolean, x double")
    r = agg.t_test(d, ["k"], "x", F.col("a"), welch).first()
    assert abs(r.t - (2 - 6) / math.sqrt(1 / 3 + 2 / 2)) < 1e-12


def test_rounds_go_on_to_the_end(spark):
    n = 54
    v = spark.createDataFrame([(i, i * 10) for i in range(n)], "k int, pos int").coalesce(1)
    links = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a int, b int").coalesce(1)
    assert [r.k for r in ld.prune(v, links, "k", "pos").orderBy("k").collect()] == list(range(0, n, 2))
    deep = spark.createDataFrame([(i, i + 1) for i in range(32)], "term int, parent int").coalesce(1)
    up = enrichment.roll_up(spark.createDataFrame([(0,)], "term int"), deep, spark.createDataFrame([(32,)], "term int"), "term", "parent")
    assert rows(up) == [(0, 32)]
    assert enrichment.descendants(deep, "term", "parent").count() == 32 * 33 // 2


def test_weighted_chi2_tails():
    from lociframe.functions.special import gammaincc
    from lociframe.operators.correlated import mixture_upper_p

    for n, q in ((1, 3.84), (5, 30.0), (12, 8.0)):
        assert mixture_upper_p(2.5 * q, np.full(n, 2.5)) == pytest.approx(float(gammaincc(np.array([n / 2]), np.array([q / 2]))[0]), rel=1e-9)
    rng = np.random.default_rng(4)
    w = np.array([3.0, 1.0, 0.4, 0.05])
    draws = (rng.standard_normal((400_000, 4)) ** 2) @ w
    for q in (1.0, 5.0, 15.0):
        assert mixture_upper_p(q, w) == pytest.approx((draws > q).mean(), abs=0.003)
    assert mixture_upper_p(0.0, w) == 1.0 and mixture_upper_p(1.0, np.zeros(0)) == 0.0


def test_gene_p_with_ld(spark):
    from lociframe.operators.correlated import gene_p, mixture_upper_p

    z = spark.createDataFrame([("g", 1, 2.0), ("g", 2, 1.0), ("h", 1, 2.0), ("h", 3, -1.0), ("k", 4, 0.5)], "gene string, variant long, z double")
    pairs = spark.createDataFrame([("g", 1, 2, 0.8), ("h", 9, 1, 0.5)], "gene string, a long, b long, r double")
    got = {r.gene: (r.n, r.q, r.p) for r in gene_p(z, pairs, "gene", "variant").collect()}
    assert got["g"] == (2, 5.0, pytest.approx(mixture_upper_p(5.0, np.array([1.8, 0.2]))))
    assert got["h"] == (2, 5.0, pytest.approx(math.exp(-2.5))) and got["k"][0] == 1


def test_cube_round_trip(spark, tmp_path):
    from lociframe.operators import screens

    rows = [(v, g, c, float(v * g + c), 10) for v in range(5) for g in range(3) for c in range(2)]
    cube = spark.createDataFrame(rows, "variant long, gene long, covariate long, z double, n long")
    screens.write_cube(cube, f"file://{tmp_path}/cube")
    back = spark.read.parquet(f"file://{tmp_path}/cube")
    assert back.count() == len(rows)
    assert screens.cube_slice(back, gene=2, covariate=None, variant=[1, 3]).count() == 4


def test_ordered_blocks_equal_one_pass(spark):
    """Blocks much smaller than the data: carried values, ends and neighbours."""
    rng = random.Random(2)
    spans = [("a" if i % 5 else "b", s, s + rng.choice([0, 3, 40])) for i in range(150) for s in [rng.randrange(600)]]
    df = spark.createDataFrame(spans, "k string, start long, stop long")
    for fn in (intervals.merge_spans, intervals.drop_contained):
        small = sorted(map(tuple, fn(df, ["k"], "start", "stop", width=16).collect()))
        assert small == sorted(map(tuple, fn(df, ["k"], "start", "stop", width=10_000).collect())) and small
    points = spark.createDataFrame([("a" if i % 3 else "b", rng.randrange(600), i) for i in range(80)], "k string, pos long, v long").dropDuplicates(["k", "pos"])
    near = lambda w: sorted((r.v, tuple(r.n)) for r in intervals.neighbours(points, ["k"], "pos", "v", 3, "n", width=w).collect())
    assert near(8) == near(10_000)
    right = spark.createDataFrame([("a", p, p * 10) for p in range(0, 600, 97)], "k string, at long, x long")
    asof = lambda w: sorted((r.v, str(r.x)) for r in intervals.as_of_join(points, right, ["k"], "pos", "at", ["x"], width=w).collect())
    assert asof(8) == asof(10_000)


def test_merged_spans_do_not_depend_on_the_order_of_equal_ones(spark):


    rng = random.Random(5)
    spans = [("x", a, a + rng.choice([0, 3, 90]), i % 2) for i, a in enumerate(rng.choices(range(0, 900, 30), k=300))] + [("x", 120, 700, 1), ("x", 120, 700, 0)] * 4 + [("y", 5, 5, 0)] * 9
    for gap in (0, 4):
        want = []
        for c, a, b, _ in sorted(spans):
            if want and want[-1][0] == c and a <= want[-1][2] + gap:
                want[-1] = (c, want[-1][1], max(b, want[-1][2]), want[-1][3] + 1)
            else:
                want.append((c, a, b, 1))
        for parts in (1, 3, 8):
            rng.shuffle(spans)
            s = spark.createDataFrame(spans, "c string, s int, e int, tag int").repartition(parts)
            for width in (1 << 20, 50):
                assert rows(intervals.merge_spans(s, ["c"], "s", "e", gap, width)) == want


@pytest.mark.parametrize("by", ["position", "p"])
def test_pruning_in_tiles(spark, by, monkeypatch):
    """A chain of 2,000 links in order of position is decided in few rounds, and clumps and pruned variants equal a plain pass."""


    from lociframe.operators import ld

    rng = random.Random(11)
    n = 2000
    links = [(i, i + 1) for i in range(n - 1)] + [(i, i + 2) for i in range(0, n - 2, 3)] + [(i, i + rng.randrange(3, 400)) for i in range(0, n - 400, 17)]
    rank = {i: i if by == "position" else rng.random() for i in range(n)}
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    kept = set()
    for i in sorted(range(n), key=lambda i: (rank[i], i)):
        if not kept & near.get(i, set()):
            kept.add(i)
    rounds = []
    write = ld.settled
    monkeypatch.setattr(ld, "settled", lambda df: rounds.append("kept" in df.columns and "inside" in df.columns) or write(df))
    v = spark.createDataFrame([(i, float(rank[i]), 1, i * 10) for i in range(n)], "k int, p double, chrom int, pos int")
    e = spark.createDataFrame(links, "a int, b int")
    got = {r.k for r in ld.prune(v, e, "k", "p", ["chrom", "pos"], tile=200).collect()}
    assert got == kept and sum(rounds) < 20
    clumps = {r.k: r.locus for r in ld.greedy_clumps(v, e, "k", "p", ["chrom", "pos"], tile=300).collect()}
    assert clumps == {i: i if i in kept else min(near[i] & kept, key=lambda f: (rank[f], f)) for i in range(n)}
    assert ld.prune(v.limit(0), e, "k", "p").collect() == [] and ld.prune(v.limit(3), e.limit(0), "k", "p").count() == 3


def test_many_blocks_equal_one(spark, monkeypatch):
    """Orders in blocks of a few rows give what one block gives, nulls and ties included."""
    rng = random.Random(8)
    data = [(i, None if i % 17 == 0 else rng.randrange(1, 60) / 997, rng.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(data, "id int, p double, v int").repartition(5)

    def results():
        up = {r.id: r.s for r in ordered.running_sums(df, "p", ["p", "id"], {"s": F.col("v")}).collect()}
        down = {r.id: r.s for r in ordered.running_sums(df, "p", [F.desc("p"), "id"], {"s": F.col("v")}, descending=True).collect()}
        least = {r.id: r.m for r in ordered.running_min_from_end(df, "p", ["p", "id"], F.col("v"), "m").collect()}
        bh = {r.id: round(r.q, 12) for r in testing.benjamini_hochberg(df, "p", "id").collect()}
        holm = {r.id: r.rejected for r in testing.holm(df, "p", "id", 0.6).collect()}
        return up, down, least, bh, holm

    one = results()
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 7)
    assert len(ordered.block_cuts(df, "p")) > 20
    assert results() == one
    ps = sorted((p, i) for i, p, _ in data if p is not None)
    fail = next((k for k, (p, _) in enumerate(ps) if p > 0.6 / (len(ps) - k)), len(ps))
    assert one[4] == {i: k < fail for k, (_, i) in enumerate(ps)} and 0 < fail < len(ps)
    order = sorted(data, key=lambda x: (x[1] is not None, x[1] or 0, x[0]))
    total, want = 0, {}
    for i, _, v in order:
        total += v
        want[i] = total
    assert one[0] == want


def plan(df):
    return df._jdf.queryExecution().toString()


def test_minima_from_the_end_read_a_row_once(spark):
    """Frames that are open at the end cost rows squared, so windows begin there."""
    df = spark.createDataFrame([(i, (i * 7 % 10) / 10 or None, i % 3) for i in range(40)], "id int, p double, g int")
    q = testing.benjamini_hochberg_by(df, ["g"], "p", "id")
    assert all("currentrow$(), unboundedfollowing" not in plan(x) for x in (testing.benjamini_hochberg(df, "p", "id"), q))
    for g in range(3):
        own = sorted((r.p, r.id, r.q) for r in q.where(f"g = {g}").collect())
        want = [min(1.0, *(p * len(own) / (k + 1) for k, (p, _, _) in enumerate(own) if k >= i)) for i in range(len(own))]
        assert [x for _, _, x in own] == pytest.approx(want)


def test_storey_q_reads_a_row_once(spark):
    df = spark.createDataFrame([(i, (i * 7 % 11) / 11) for i in range(44)], "id int, p double")
    q = testing.storey_q(df, "p", "id")
    assert "currentrow$(), unboundedfollowing" not in plan(q)
    pi0 = min(1.0, sum(i * 7 % 11 > 5 for i in range(44)) / 22)
    bh = {r.id: r.q for r in testing.benjamini_hochberg(df, "p", "id").collect()}
    assert {r.id: r.q for r in q.collect()} == pytest.approx({k: x * pi0 for k, x in bh.items()})


def test_storey_q_takes_pi0_and_minima_from_the_same_p(spark):
    """tests are worked out once: p that come out otherwise a second time must not be counted in pi0."""
    again = F.udf(lambda i: random.random() ** 2, "double")
    got = testing.storey_q(spark.range(4000).select("id", again("id").alias("p")), "p", "id").orderBy("p").collect()
    pi0 = sum(r.p > 0.5 for r in got) / 2000
    least, want = 1.0, []
    for k in range(4000, 0, -1):
        least = min(least, got[k - 1].p * 4000 / k)
        want.append(least * pi0)
    assert pi0 < 1 and [r.q for r in got] == pytest.approx(want[::-1])


def test_results_survive_p_that_differ_when_computed_again(spark, monkeypatch):
    """Sums over a shuffle may differ in their last digit when they are computed again; no row may be lost for it."""
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 7)
    again = F.udf(lambda i: (i + 1 + random.random() / 2) / 100, "double")
    df = spark.range(60).select("id", again("id").alias("p"))
    for out in (testing.benjamini_hochberg(df, "p", "id"), testing.holm(df, "p", "id"), testing.qq(df, "p", "id"), screens.naive_bh(df, "p", "id")):
        assert out.count() == 60
    q = {r.id: r.q for r in testing.benjamini_hochberg(df, "p", "id").collect()}
    assert sorted(q) == list(range(60)) and all(q[i] <= q[i + 1] for i in range(59))
    sets = spark.createDataFrame([(i, i % 4) for i in range(60)], "id long, s int")
    assert sum(r.n for r in enrichment.rank_enrichment(df, sets, "id", "s", "p").collect()) == 60


def test_priorities_of_equal_sums_tie(spark):
    """The same z in another order come to sums that differ in the last digit; such items tie, and the smaller comes first."""
    assert 0.1 + 0.2 + 0.3 > 0.3 + 0.2 + 0.1
    z = [(1, t, x) for t, x in enumerate((0.3, 0.2, 0.1))] + [(2, t, x) for t, x in enumerate((0.1, 0.2, 0.3))] + [(3, 0, None), (4, 0, 9.0), (4, 7, 5.0)]
    got = enrichment.prioritise(spark.createDataFrame(z, "i int, t int, z double").coalesce(1), spark.createDataFrame([(0,), (1,), (2,)], "t int"), "i", "t", "z")
    assert [(r.i, r["rank"]) for r in got.orderBy("rank").collect()] == [(4, 1), (1, 2), (2, 3), (3, 4)]
    assert {r.i: r.score for r in got.collect()} == {1: pytest.approx(0.6 / 3**0.5), 2: pytest.approx(0.6 / 3**0.5), 3: None, 4: 9.0}


def test_prioritised_scores_add_in_the_order_given(spark):
    """0.1 + 0.2 + 0.3 is over 0.3 + 0.2 + 0.1 in its last digit, and so is the first item's score over the second's, wherever its rows lie."""
    z = [(2, 7, 0, 0.3), (2, 8, 1, 0.2), (2, 9, 2, 0.1), (1, 6, 0, 0.1), (1, 5, 0, 0.2), (1, 4, 1, 0.3), (0, 3, 2, 0.3), (0, 1, 2, 0.1), (0, 2, 1, 0.2), (3, 0, 0, None), (4, 1, 0, None), (4, 2, 0, 9.0)]
    frame = spark.createDataFrame(z, "i int, at int, t int, z double").repartition(3)
    got = enrichment.prioritise(frame, spark.createDataFrame([(0,), (1,), (2,)], "t int"), "i", "t", "z", "at")
    assert [(r.i, r["rank"]) for r in got.orderBy("rank").collect()] == [(4, 1), (0, 2), (1, 3), (2, 4), (3, 5)]
    assert {r.i: r.score for r in got.collect()} == {0: (0.1 + 0.2 + 0.3) / 3**0.5, 1: (0.3 + 0.2 + 0.1) / 3**0.5, 2: (0.3 + 0.2 + 0.1) / 3**0.5, 3: None, 4: 9.0}


def test_deconvolution_in_stacks_is_that_of_each_group(spark):
    rng = np.random.default_rng(3)
    data, want = [], {}
    for k in range(120):
        n = int(rng.integers(6, 30))
        c, g = rng.random(n), rng.integers(0, 3, n).astype(float)
        y = 3 * c + (1 - c) * g * rng.normal() + rng.random(n)
        data += [(k, float(a), float(1 - a), float(b), float(e)) for a, b, e in zip(c, g, y)]
        fits = []
        for d in (g, 2 - g):
            a = np.column_stack([c, 1 - c, c * d, (1 - c) * d])
            x = models.nnls(a, y)
            fits.append((((y - a @ x) ** 2).sum(), len(fits), a, x))
        rss, turned, a, x = min(fits, key=lambda f: f[:2])
        p = [models.f_test(((y - (less := np.delete(a, 2 + i, axis=1)) @ models.nnls(less, y)) ** 2).sum(), rss, n - 3, n - 4) for i in range(2)]
        want[k] = [(x[i], -x[2 + i] if turned else x[2 + i], p[i]) for i in range(2)]
    got = models.deconvolve(spark.createDataFrame(data, "k int, c1 double, c2 double, g double, y double"), ["k"], "y", "g", ["c1", "c2"])
    assert "FlatMapGroups" not in plan(got)  # a call of Python a group is what took the time
    found = {(r.k, r.cell): (r.beta, r.beta_dosage, r.p) for r in got.collect()}
    assert len(found) == 240
    for k, cells in want.items():
        for cell, w in zip(("c1", "c2"), cells):
            assert found[k, cell] == pytest.approx(w, abs=1e-6)  # p near 1 goes with the root of rounding


def test_mixups_of_all_pairs_are_never_rows(spark):
    """Against plain loops; a sample measured twice in a gene, samples and genes that are null, and blocks of several samples."""
    rng = np.random.default_rng(5)
    effects = [(v, v % 3) for v in range(7)] + [(7, None)]
    geno = [(v, s, int(rng.integers(3))) for v in range(8) for s in range(24) if rng.random() < 0.9] + [(1, None, 0), (2, 3, None)]
    vals = [(g, s, float(rng.normal())) for g in range(3) for s in range(24) if rng.random() < 0.9] + [(0, 5, 0.25), (1, None, 0.5), (None, 4, 1.0)]
    groups, want = {}, {}
    for v, g in effects:
        for w, s, d in geno:
            for h, t, x in vals:
                if v == w and g is not None and g == h and s is not None and s == t and d is not None:
                    groups.setdefault((v, g, d), []).append(x)
    for (v, g, d), xs in groups.items():
        if len(xs) >= 3 and np.std(xs, ddof=1) > 0:
            for w, s, e in geno:
                for h, t, x in vals:
                    if (w, e, h) == (v, d, g):
                        want.setdefault((s, t), []).append(abs(x - np.mean(xs)) / np.std(xs, ddof=1))
    frames = [spark.createDataFrame(r, c) for r, c in ((effects, "variant int, gene int"), (geno, "variant int, sample long, dosage int"), (vals, "gene long, sample long, value double"))]
    from unittest import mock

    with mock.patch.multiple(flow, GENOTYPED=10, MEASURED=7):
        scores = flow.mixups(*frames)
        got = {(r.genotyped, r.measured): (r.score, r.n) for r in scores.collect()}
    assert got.keys() == want.keys() and all(got[k][1] == len(x) and abs(got[k][0] - np.mean(x)) < 1e-9 for k, x in want.items())
    assert "Join" not in scores._jdf.queryExecution().optimizedPlan().toString()  # once scored, a pair of samples is no join's row


def test_mixups_copy_neither_side_for_the_other(spark):
    """Many blocks of either side, and rows move once; a repeated effect counts in groups but makes no call twice; genes that few samples have, and that most have."""
    rng = np.random.default_rng(8)
    effects = [(v, v % 4) for v in range(12)] + [(1, 1), (2, 3)]
    geno = [(v, s, int(rng.integers(3))) for v in range(12) for s in range(40) if rng.random() < 0.9]
    vals = [(g, s, float(rng.normal())) for g in range(4) for s in range(50) if rng.random() < (0.2 if g == 2 else 0.9)]
    x, groups, want = {(g, s): y for g, s, y in vals}, {}, {}
    for v, g in effects:
        for w, s, d in geno:
            if v == w and (g, s) in x:
                groups.setdefault((v, g, d), []).append(x[g, s])
    for (v, g, d), xs in groups.items():
        if len(xs) >= 3 and np.std(xs, ddof=1) > 0:
            for s in (s for w, s, e in geno if (w, e) == (v, d)):
                for t in range(50):
                    if (g, t) in x:
                        want.setdefault((s, t), []).append(abs(x[g, t] - np.mean(xs)) / np.std(xs, ddof=1))
    frames = [spark.createDataFrame(r, c) for r, c in ((effects, "variant int, gene int"), (geno, "variant int, sample int, dosage int"), (vals, "gene int, sample int, value double"))]
    from unittest import mock

    with mock.patch.multiple(flow, GENOTYPED=4, MEASURED=5):
        scores = flow.mixups(*frames)
        got = {(r.genotyped, r.measured): (r.score, r.n) for r in scores.collect()}
    assert got.keys() == want.keys() and all(got[k][1] == len(y) and abs(got[k][0] - np.mean(y)) < 1e-9 for k, y in want.items())
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert not any(step in plan for step in ("Generate", "CoGroup", "Join"))  # each side was a copy a block of the other


def test_theil_sen_shuffles_no_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(k, i if i % 7 else None if i else 3, float(rng.integers(3)), float(rng.normal())) for k in range(4) for i in range(15)] + [(9, 1, 1.0, 2.0), (9, 2, 1.0, 3.0), (None, 1, 0.0, 1.0), (None, 2, 1.0, 1.0), (5, 1, None, 1.0)]
    fit = agg.theil_sen(spark.createDataFrame(rows, "k int, i int, x double, y double"), ["k"], "x", "y", "i")
    got = {r.k: r for r in fit.collect()}
    assert "Join" not in fit._jdf.queryExecution().optimizedPlan().toString() and sorted(got) == [0, 1, 2, 3]
    for k, r in got.items():
        own = [(i, x, y) for g, i, x, y in rows if g == k]
        s = [(b[2] - a[2]) / (b[1] - a[1]) for a in own for b in own if a[0] is not None and b[0] is not None and a[0] < b[0] and a[1] != b[1]]
        want = np.percentile(s, [50, 2.5, 97.5])
        assert r.pairs == len(s) and np.allclose([r.slope, r.low, r.high], want)
        assert abs(r.intercept - (np.median([y for _, _, y in own]) - want[0] * np.median([x for _, x, _ in own]))) < 1e-9


def test_tasks_of_ranks_and_regressions_stay_small(spark):
    """Rows are dealt to as many tasks as they need, whatever the session's number of partitions."""
    from unittest import mock

    df = spark.range(1000).selectExpr("id % 50 as k", "id", "double(id * 7 % 11) as x", "double(id * 5 % 13) as c", "double(id * id % 17) as y").localCheckpoint()
    ways = [lambda: ranks.inverse_normal(df, ["k"], "y").select("k", "id", "normal"), lambda: ranks.spearman(df, ["k"], "x", "y"), lambda: screens.covariate_screen(df, ["k"], "x", ["c", "id"], "y"), lambda: agg.interaction_regression(df, ["k"], "x", "c", "y")]
    near = lambda rows: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)
    for way in ways:
        plain = near(way().collect())
        with mock.patch.object(ordered, "BLOCK_ROWS", 50):
            small = way()
            assert small.rdd.getNumPartitions() == 20
            assert near(small.collect()) == plain


def test_conditional_mapping_reads_genes_with_values_only(spark):
    from unittest import mock

    geno = spark.createDataFrame([(v, s, (s * (v + 1) + v) % 3) for v in range(4) for s in range(30)], "variant long, sample long, dosage int")
    val = spark.createDataFrame([(1, s, float((s * 2 + 1) % 3) + s % 5 * 0.01) for s in range(30)], "gene long, sample long, value double")
    pairs = spark.createDataFrame([(v, g) for v in range(4) for g in range(6)], "variant long, gene long")
    with mock.patch.object(flow, "associate", wraps=flow.associate) as seen:
        hits = flow.conditional_mapping(pairs, geno, val, 1e-4, 2).collect()
    assert hits and all({r.gene for r in c.args[0].collect()} <= {1} for c in seen.call_args_list)
