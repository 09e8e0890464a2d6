"""Strand flips that only linkage shows, and the number of components that uncovers effects."""

import numpy as np

from lociframe.plans import workflows as flow

TURN = {"A": "T", "T": "A", "C": "G", "G": "C"}


def panels(rng, sites, samples):
    """Dosages of alt in both panels, from haplotypes with long linkage."""
    out = []
    for n in samples:
        h = np.zeros((2 * n, sites), int)
        h[:, 0] = rng.random(2 * n) < 0.45
        for j in range(1, sites):
            stay = rng.random(2 * n) < 0.93
            h[:, j] = np.where(stay, h[:, j - 1], rng.random(2 * n) < 0.45)
        flip = np.arange(sites) % 4 == 1  # alternate alleles that go with the other's reference allele
        h[:, flip] = 1 - h[:, flip]
        out.append(h.reshape(n, 2, sites).sum(axis=1))
    return out


def test_planted_strand_flips_come_back(spark):
    rng = np.random.default_rng(3)
    sites = 60
    kinds = [("A", "T"), ("C", "G"), ("A", "G"), ("T", "C"), ("A", "C")]
    alleles = [kinds[i % 2] if 20 <= i < 32 or i % 3 else kinds[2 + i % 3] for i in range(sites)]  # twelve unclear ones in a row
    ours, theirs = panels(rng, sites, (250, 300))
    flipped = rng.random(sites) < 0.4
    named = rng.random(sites) < 0.5  # the study lists its alleles the other way round
    study, sg = [], []
    for i in range(sites):
        ref, alt = ((TURN[a] for a in alleles[i]) if flipped[i] else alleles[i])
        d = ours[:, i]
        if named[i]:
            ref, alt, d = alt, ref, 2 - d
        m = d.mean() / 2
        study.append((i, "1", 100 * i, ref, alt, float(min(m, 1 - m))))
        sg += [(i, s, int(x)) for s, x in enumerate(d)]
    reference = [(f"r{i}", "1", 100 * i, *alleles[i], float(min(theirs[:, i].mean() / 2, 1 - theirs[:, i].mean() / 2))) for i in range(sites)]
    rg = [(f"r{i}", s, int(x)) for i in range(sites) for s, x in enumerate(theirs[:, i])]
    study.append((900, "1", 99_999, "A", "T", 0.47))  # nothing near: unclear
    reference.append(("r900", "1", 99_999, "A", "T", 0.47))
    got = {r.variant: r for r in flow.harmonise_by_ld(spark.createDataFrame(study, "variant int, chrom string, pos int, ref string, alt string, maf double"), spark.createDataFrame(reference, "ref_id string, chrom string, pos int, ref string, alt string, maf double"), spark.createDataFrame(sg, "variant int, sample int, dosage int"), spark.createDataFrame(rg, "ref_id string, sample int, dosage int"), 800, 0.2).collect()}
    assert len(got) == sites + 1 and got[900].action == "exclude" and got[900].agree == 0
    for i in range(sites):
        assert got[i].ref_id == f"r{i}"
        unclear = set(alleles[i]) in ({"A", "T"}, {"C", "G"})
        assert got[i].action == ("swap" if flipped[i] else "keep"), i
        assert (got[i].agree + got[i].against >= 3) == unclear
    # those in the middle of the row see no settled variant at first: they wait for a later pass
    assert all(got[i].agree + got[i].against >= 3 for i in range(24, 28))


def test_number_of_components_is_found_once_decomposed(spark, monkeypatch):
    rng = np.random.default_rng(6)
    n, genes, factors = 80, 120, 4
    g = rng.integers(0, 3, (30, n))
    f = rng.standard_normal((factors, n)) * 8
    x = rng.standard_normal((genes, factors)) @ f + rng.standard_normal((genes, n))
    x[:30] += 1.2 * g  # gene i follows variant i
    calls = []
    own = flow.decompose.singular_values
    monkeypatch.setattr(flow.decompose, "singular_values", lambda *a, **k: calls.append(1) or own(*a, **k))
    values = spark.createDataFrame([(i, x[i].tolist()) for i in range(genes)], "gene int, values array<double>")
    pairs = spark.createDataFrame([(v, k) for v in range(30) for k in (v, 30 + v, 60 + v)], "variant int, gene int")
    genotypes = spark.createDataFrame([(v, s, int(g[v, s])) for v in range(30) for s in range(n)], "variant int, sample int, dosage int")
    got = flow.component_search(values, list(range(n)), pairs, genotypes, 1e-4, step=2, most=20).orderBy("components").collect()
    hits = {r.components: r.hits for r in got}
    assert calls == [1] and [r.components for r in got if r.best][0] in (4, 6, 8)
    assert hits[4] >= 20 > hits[0] + 10 and max(hits.values()) == next(r.hits for r in got if r.best)
    assert len(got) < 11  # it stopped before the last step
