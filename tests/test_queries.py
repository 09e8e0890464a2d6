"""Registered queries against their SQL on the smallest tables, a few at a time by operator family."""

import math
import os
import random

import duckdb
import numpy as np
import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

from lociframe.plans import catalog_correlated, catalog_models, catalog_screens, oracles  # noqa: E402, F401
from lociframe.plans.catalog import QUERIES, SQL  # noqa: E402


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def embeddings(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], float)
    w, v = np.linalg.eigh(np.cov(x.T))
    v = v[:, np.argsort(-w)]
    return [r.vec_id for r in rows], x - x.mean(axis=0), v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])


def plain_components(spark, got):
    ids, x, v = embeddings(spark)
    want = dict(zip(ids, x @ v[:, :5]))
    assert all(r.scores == pytest.approx(want[r.vec_id].tolist(), abs=2e-4) for r in got) and len(got) == len(ids)


def plain_residuals(spark, got):
    ids, x, v = embeddings(spark)
    want = dict(zip(ids, ((x - x @ v[:, :3] @ v[:, :3].T) ** 2).sum(axis=1)))
    assert all(r.power == pytest.approx(want[r.vec_id], abs=2e-4) for r in got) and len(got) == len(ids)


def plain_beta(spark, got):
    """Each gene's least p under the beta distribution for which the likelihood of the permutations' least p is largest."""
    rows = spark.read.parquet(f"{SF}/orders.parquet").selectExpr("o_orderkey % 7 as gene", "cast(floor(o_orderkey / 7) as bigint) % 21 as perm", "((o_orderkey * 7919) % 1000003 + 1) / 1000004e0 as p").groupBy("gene", "perm").agg({"p": "min"}).collect()
    least = {}
    for r in rows:
        least.setdefault(r.gene, {})[r.perm] = r["min(p)"]
    for r in got:
        null = np.array([p for k, p in least[r.gene].items() if k])
        loss = lambda a, b: ((a - 1) * np.log(null) + (b - 1) * np.log1p(-null)).mean() - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)
        a = b = 1.0
        step = 2.0
        while step > 1.000001:
            best = max(((a * i, b * j) for i in (1 / step, 1, step) for j in (1 / step, 1, step)), key=lambda x: loss(*x))
            step = step if best != (a, b) else step**0.5
            a, b = best
        grid = (np.arange(200_000) + 0.5) / 200_000 * r.p
        cdf = np.exp((a - 1) * np.log(grid) + (b - 1) * np.log1p(-grid) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)).mean() * r.p
        assert r.p == pytest.approx(least[r.gene][0], abs=1e-7) and r.adjusted == pytest.approx(cdf, rel=0.02, abs=1e-6)


def reads_by(spark, key):
    """(ref, alt, proportion, sample) of each key, as arrays."""
    con = duckdb.connect()
    rows = con.sql(f"select {key} as key, cast(l_quantity as int) as k, (cast(l_quantity as int) * 7 + l_linenumber * 5) % 43 as m, (s_acctbal + 1000e0) / 11000e0 as c, l_suppkey as sample from '{SF}/lineitem.parquet' join '{SF}/supplier.parquet' on l_suppkey = s_suppkey").df()
    return {k: g for k, g in rows[rows.k + rows.m > 0].groupby("key")}


def plain_terms(q, k, m, s):
    """The logarithm of one ordering's probability under a beta-binomial; s is infinite for a binomial."""
    lg = np.vectorize(math.lgamma)
    if not np.isfinite(s).all():
        return k * np.log(q) + m * np.log1p(-q)
    return lg(k + q * s) + lg(m + (1 - q) * s) - lg(k + m + s) - lg(q * s) - lg((1 - q) * s) + lg(s)


def plain_dispersion(spark, got):
    own = reads_by(spark, "l_suppkey")
    assert len(got) == len(own)
    for r in got:
        k, m = own[r.sample].k.to_numpy(float), own[r.sample].m.to_numpy(float)
        ll = lambda sigma: plain_terms(0.5, k, m, np.full(len(k), 1 / sigma**2 - 1)).sum()
        assert r.settled and r.log_likelihood == pytest.approx(ll(r.sigma), abs=1e-5) and all(r.log_likelihood >= ll(s) - 1e-7 for s in np.linspace(0.02, 0.98, 25))


def plain_allelic(spread):
    def check(spark, got):
        own = reads_by(spark, "l_partkey")
        assert len(got) == len(own)
        spreads = {r.sample: 1 / r.sigma**2 - 1 for r in QUERIES["sample_dispersion"](spark, SF).collect()} if spread else {}
        grid = [(a, b) for a in np.linspace(0.05, 0.95, 7) for b in np.linspace(0.05, 0.95, 7)]
        for r in got:
            g = own[r.variant]
            k, m, c = g.k.to_numpy(float), g.m.to_numpy(float), g.c.to_numpy(float)
            s = np.array([spreads.get(x, np.inf) for x in g["sample"]])
            ll = lambda q: plain_terms(np.clip(q, 1e-6, 1 - 1e-6), k, m, s).sum()
            assert r.settled and r.n == len(k) and r.null_ll == pytest.approx(ll(np.full(len(k), r.ratio)), abs=1e-4)
            assert all(r.null_ll >= ll(np.full(len(k), q)) - 1e-6 for q in np.linspace(0.05, 0.95, 10))
            if c.min() == c.max():
                assert r.slope is None
                continue
            assert r.alt_ll == pytest.approx(ll(r.base + r.slope * c), abs=1e-4) and r.chi2 == pytest.approx(max(0, 2 * (r.alt_ll - r.null_ll)), abs=1e-6)
            if r.variant % 5 == 0:
                u = (c - c.min()) / (c.max() - c.min())
                assert all(r.alt_ll >= ll(a + (b - a) * u) - 1e-6 for a, b in grid)

    return check


def plain_overdispersed(spark, got):
    own = reads_by(spark, "l_partkey")
    assert len(got) == len(own)
    lg = np.vectorize(math.lgamma)
    for r in got:
        k, m = own[r.variant].k.to_numpy(float), own[r.variant].m.to_numpy(float)
        ways = (lg(k + m + 1) - lg(k + 1) - lg(m + 1)).sum()
        ll = lambda q, t: ways + plain_terms(q, k, m, np.full(len(k), t)).sum()
        assert r.settled and r.log_likelihood == pytest.approx(ll(r.ratio, r.theta), abs=1e-4) and r.null_ll == pytest.approx(ll(0.5, r.theta), abs=1e-4)
        if r.variant % 5 == 0:
            assert all(r.log_likelihood >= ll(q, t) - 1e-6 for q in np.linspace(0.1, 0.9, 9) for t in np.exp(np.linspace(-1, 5, 7)))


def plain_elastic(spark, got):
    """The conditions of a minimum, on the rows themselves."""
    rows = duckdb.sql(f"select embedding, case when label = 3 then 1e0 else 0e0 end as share from '{SF}/embeddings.parquet'").fetchall()
    x, y = np.array([r[0] for r in rows], np.float32).astype(float), np.array([r[1] for r in rows])
    xs, ys = (x - x.mean(axis=0)) / x.std(axis=0), (y - y.mean()) / y.std()
    assert len(got) == 3 * 65 and all(r.settled for r in got)
    for k in range(3):
        own = sorted((r for r in got if r.repetition == k), key=lambda r: r.feature)
        b = np.array([r.coefficient for r in own[1:]]) * x.std(axis=0) / y.std()
        mix, penalty = own[0].mix, own[0].penalty / y.std()
        slope = xs.T @ (ys - xs @ b) / len(y) - penalty * (1 - mix) * b
        assert own[0].coefficient == pytest.approx(y.mean() - x.mean(axis=0) @ np.array([r.coefficient for r in own[1:]]), abs=1e-6)
        assert np.abs(slope[b == 0]).max(initial=0) <= penalty * mix + 1e-6 and slope[b != 0] == pytest.approx(penalty * mix * np.sign(b[b != 0]), abs=1e-6)


def plain_markers(spark, got):
    models = QUERIES["elastic_net_models"](spark, SF).where("feature > 0 and coefficient != 0").collect()
    want = {}
    for r in models:
        want.setdefault(r.feature, []).append(r.coefficient)
    want = {f: c for f, c in want.items() if len(c) >= 3}  # 0.7 of three models, rounded up
    assert {r.feature: r.models for r in got} == {f: len(c) for f, c in want.items()} and all(r["mean"] == pytest.approx(np.mean(want[r.feature])) for r in got)


def plain_svd(spark, got):
    ids, x, _ = embeddings(spark)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    vt = vt[:6] * np.sign(vt[range(6), np.abs(vt[:6]).argmax(axis=1)])[:, None]
    want = dict(zip(ids, x @ vt.T))
    assert len(got) == len(ids) and all(r.scores == pytest.approx(want[r.vec_id].tolist(), abs=1e-5) for r in got)
    assert np.linalg.norm([r.scores for r in got], axis=0) == pytest.approx(s[:6], rel=1e-9)


def plain_ica(spark, got):
    """The same fixed points by plain rounds over the whole matrix, each restart on its own."""
    ids, x, _ = embeddings(spark)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    turn = np.sign(vt[range(3), np.abs(vt[:3]).argmax(axis=1)])
    z = u[:, :3] * turn * np.sqrt(len(x))
    runs = []
    for k in range(3):
        p, _, q = np.linalg.svd(np.random.default_rng([1, k]).standard_normal((3, 3)))
        w = p @ q
        for _ in range(2000):
            g = np.tanh(z @ w.T)
            p, _, q = np.linalg.svd(g.T @ z / len(z) - (1 - g * g).mean(axis=0)[:, None] * w)
            last, w = w, p @ q
            if np.abs(np.abs((w * last).sum(axis=1)) - 1).max() < 1e-6:
                break
        runs.append(w)
    total = np.zeros((3, 3))
    for w in runs:
        c = runs[0] @ w.T
        total += w[np.abs(c).argmax(axis=1)] * np.sign(c[range(3), np.abs(c).argmax(axis=1)])[:, None]
    total /= np.linalg.norm(total, axis=1, keepdims=True)
    want = z @ total.T
    mine = np.array([r.sources for r in sorted(got, key=lambda r: ids.index(r.vec_id))])
    assert all(r.settled for r in got)
    c = np.abs(np.corrcoef(np.concatenate([mine, want], axis=1).T)[:3, 3:])
    assert sorted(c.argmax(axis=0)) == [0, 1, 2] and c.max(axis=0).min() > 0.999


def plain_table(sql, *views):
    from lociframe.plans.views import with_views

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con.sql(f"{with_views(*views)} {sql}").df()


def plain_genes(spark, got, rows=None):
    """Each gene's sum and its exact tail, from the calls themselves."""
    from lociframe.operators.correlated import mixture_upper_p
    from lociframe.plans.catalog import CALLS_SQL

    z = plain_table(", b as (select snp as variant, max(z) as z from effects group by snp) select g.gene, b.variant, b.z from b join variants v on b.variant = v.variant join genes g on v.chrom = g.chrom and v.pos between g.start - 2000 and g.stop + 2000", "effects", "variants", "genes")
    pairs = plain_table(f", {CALLS_SQL} select a, b, abs(corr(x, y)) as r from j group by a, b having count(*) >= 8 and min(x) < max(x) and min(y) < max(y)", "genotypes", "variants")
    r = {(a, b): c for a, b, c in pairs.itertuples(index=False)}
    want = {}
    for gene, g in z.groupby("gene"):
        ids = sorted(g.variant)
        m = np.array([[1.0 if a == b else r.get((min(a, b), max(a, b)), 0.0) for b in ids] for a in ids])
        want[gene] = (len(ids), (g.z**2).sum(), mixture_upper_p(float((g.z**2).sum()), np.maximum(np.linalg.eigvalsh(m), 0)))
    assert {x.gene for x in got} == set(want)
    for x in got:
        n, q, p = want[x.gene]
        assert x.n == n and x.q == pytest.approx(q, abs=1e-4)
        if "how" not in x:
            assert x.p == pytest.approx(p, abs=2e-5)
        elif x.how == "draws":
            assert x.over >= 20 and abs(x.p - p) < 6 * math.sqrt(p / x.draws)
        else:
            assert x.p == pytest.approx(max(p, 1e-12), rel=1e-6)


def plain_merged_sets(spark, got):
    """Pairs of items merged by hand, one matrix, one solve a set."""
    from lociframe.plans.catalog import _sets
    from lociframe.plans.views import Views

    items = sorted(plain_table("select variant from variants", "variants").variant)
    members = {}
    for m in _sets(Views(spark, SF))[0].collect():
        members.setdefault(m.grp, set()).add(m.item)
    blocks = {}
    for i in items:
        blocks.setdefault(i // 10, []).append(i)
    place, y, mats = {}, [], []
    for own in blocks.values():
        pairs = [own[k : k + 2] for k in range(0, len(own), 2)]
        a = np.array([[1 / len(p) if i in p else 0 for i in own] for p in pairs])
        r = np.array([[1.0 if i == j else 0.97 if i // 2 == j // 2 else 0.5 ** (1 + abs(i // 2 - j // 2)) for j in range(len(own))] for i in range(len(own))])
        c = a @ r @ a.T
        mats.append(np.linalg.inv(c / np.sqrt(np.outer(np.diag(c), np.diag(c)))))
        for k, p in enumerate(pairs):
            place |= {i: len(y) + k for i in p}
        y += (a @ [i * 7919 % 101 / 10 for i in own]).tolist()
    w, at = np.zeros((len(y), len(y))), 0
    for m in mats:
        w[at : at + len(m), at : at + len(m)] = m
        at += len(m)
    y = np.array(y)
    seen = 0
    for x in got:
        d = np.column_stack([np.ones(len(y)), np.zeros(len(y))])
        d[sorted({place[i] for i in members[x.grp] if i in place}), 1] = 1
        cov = np.linalg.inv(d.T @ w @ d)
        b = cov @ d.T @ w @ y
        e = y - d @ b
        assert x.n == d[:, 1].sum() and x.beta == pytest.approx(b[1], rel=1e-6, abs=1e-9) and x.se == pytest.approx(math.sqrt(e @ w @ e / (len(y) - 2) * cov[1, 1]), rel=1e-6)
        seen += 1
    assert seen > 3


def plain_linkage(spark, got):
    """Votes of near variants in passes, from correlations that SQL gives."""
    v = plain_table("select variant, chrom, pos, ref, alt, 0.05 + variant % 9 * 0.05 as maf from variants where ref <> alt", "variants").set_index("variant")
    calls = ", c as (select variant, sample, min(dosage) as x, max(dosage) as y from genotypes where dosage is not null group by 1, 2), n as (select a.variant as a, b.variant as b from variants a join variants b on a.chrom = b.chrom and a.variant <> b.variant and abs(a.pos - b.pos) < 3000)"
    r = plain_table(calls + " select a, b, case when min(p.x) < max(p.x) and min(q.x) < max(q.x) then corr(p.x, q.x) end as r1, case when min(p.y) < max(p.y) and min(q.y) < max(q.y) then corr(p.y, q.y) end as r2 from n join c p on p.variant = a join c q on q.variant = b and q.sample = p.sample group by a, b", "genotypes", "variants").dropna()
    sign = lambda i: -1 if i % 3 == 0 else 1  # noqa: E731  the second panel's dosages are turned
    near = {}
    for a, b, r1, r2 in r.itertuples(index=False):
        if a in v.index and b in v.index and r1 * r1 >= 0.01 and r2 * r2 >= 0.01:
            near.setdefault(a, []).append((b, np.sign(r1 * r2) * sign(a) * sign(b)))
    unclear = {i for i in v.index if {v.ref[i], v.alt[i]} in ({"A", "T"}, {"C", "G"})}
    way = {i: sign(i) for i in v.index if i not in unclear}  # whether alt is the other panel's alt
    votes = {}
    while True:
        new = {}
        for i in unclear - set(votes):
            heard = [s * sign(i) * way[b] for b, s in near.get(i, []) if b in way]
            agree, against = sum(h > 0 for h in heard), sum(h < 0 for h in heard)
            if agree + against >= 3 and agree != against:
                new[i] = (agree, against)
        if not new:
            break
        votes |= new
        way |= {i: sign(i) * (1 if a > b else -1) for i, (a, b) in new.items()}
    rows = {x.variant: x for x in got}
    assert set(rows) == set(v.index)
    for i, x in rows.items():
        assert (x.agree, x.against) == votes.get(i, (0, 0)), i
        if i not in unclear:
            assert x.action == "keep"
        elif i in votes:
            assert x.action == ("keep" if votes[i][0] > votes[i][1] else "swap")
        else:
            assert x.action == ("keep" if v.maf[i] < 0.4 else "exclude")
    assert votes


def plain_search(spark, got):
    """The mapping of residuals by plain correlation, for each number of components."""
    t = plain_table(", t as (select variant % 100 + 1 as gene, sample, dataset, avg(expression) as value from genotypes group by 1, 2, 3) select gene, sample, avg(value) as value from t group by 1, 2", "genotypes")
    c = plain_table("select variant, sample, min(dosage) as dosage from genotypes where dosage is not null group by 1, 2", "genotypes").pivot(index="variant", columns="sample", values="dosage")
    pairs = plain_table("select v.variant, g.gene from variants v join genes g on v.chrom = g.chrom and abs(v.pos - g.mid) < 20000", "variants", "genes")
    wide = t.pivot(index="gene", columns="sample", values="value")
    x = wide.apply(lambda r: r.fillna(r.mean()), axis=1).to_numpy()
    x -= x.mean(axis=1, keepdims=True)
    vt = np.linalg.svd(x, full_matrices=False)[2]
    hits = {}
    for k in range(0, 7, 2):
        left = dict(zip(wide.index, x - x @ vt[:k].T @ vt[:k]))
        count, genes = 0, set()
        for variant, gene in pairs.itertuples(index=False):
            if variant not in c.index or gene not in left:
                continue
            d = c.loc[variant].reindex(wide.columns).to_numpy(float)
            ok = ~np.isnan(d)
            n = int(ok.sum())
            if n < 3 or d[ok].std() == 0:
                continue
            r = np.corrcoef(d[ok], left[gene][ok])[0, 1]
            if abs(r) >= 1:
                continue
            f = n - 2
            u = r * math.sqrt(f / (1 - r * r))
            z = (8 * f + 1) / (8 * f + 3) * math.sqrt(f * math.log(1 + u * u / f))
            if math.erfc(z / math.sqrt(2)) <= 0.05:
                count += 1
                genes.add(gene)
        hits[k] = (count, len(genes))
    mine = {r.components: (r.hits, r.genes) for r in got}
    assert mine == {k: hits[k] for k in mine} and 0 in mine
    assert [r.components for r in got if r.best] == [min(k for k, h in mine.items() if h[0] == max(x[0] for x in mine.values()))]


#: Queries that SQL cannot say, with what tests them.
PLAIN = {"gene_scores_ld": plain_genes, "gene_scores_by_draws": plain_genes, "set_regression_merged": plain_merged_sets, "harmonise_with_ld": plain_linkage, "component_search": plain_search, "elastic_net_models": plain_elastic, "marker_features": plain_markers, "singular_scores": plain_svd, "independent_sources": plain_ica, "sample_dispersion": plain_dispersion, "cell_type_allelic": plain_allelic(True), "cell_type_binomial": plain_allelic(False), "beta_binomial_maximum": plain_overdispersed, "principal_components": plain_components, "remove_components": plain_residuals, "top_with_beta": plain_beta, "beta_adjusted_p": plain_beta}
#: Queries whose operators have tests of their own against plain computations.
ELSEWHERE = {"deconvolve_cells": "test_interaction_regression_and_nnls", "conditional_mapping": "test_conditional_mapping_finds_two_effects", "cis_mapping_with_fdr": "test_bounded_cis_mapping_runs"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    if name in PLAIN:
        return PLAIN[name](spark, df.collect())
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in SQL:
        assert name in ELSEWHERE, "neither SQL nor a plain computation to check with"
        return
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    want = sorted((tuple(plain(dict(zip(rel.columns, r))[c]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want


def test_streaming_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from lociframe import streaming

    src = tmp_path / "in"
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(src))
    stream = spark.readStream.schema(spark.read.parquet(str(src)).schema).parquet(str(src))
    w = streaming.running_counts(stream.withColumn("dosage", F.when(F.col("value") > 1, 1)), ["event_type"], "dosage")
    q = w.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.event_type: r.n for r in spark.table("counts").collect()}
    assert got == {r.event_type: r["count"] for r in spark.read.parquet(str(src)).groupBy("event_type").count().collect()}


def test_two_stage_leaves_out_a_covariance_of_just_a_hundredth(spark, tmp_path):
    """Added up row by row this covariance of one hundredth in size comes to np.float64(0.010000000000000031); the SQL's bound is over 0.01."""
    tied, other = [27, 34, 7, 7, 32, 43, 8, 3, 33, 37], [31, 40, 18, 1, 12, 48, 16, 47, 38, 8]
    data = [(k, i, i, 1, float(q), 999.0 + i, 0.1, "A", 0.05) for k, own in ((1, tied), (2, other)) for i, q in enumerate(own)]
    rows = spark.createDataFrame(data, "l_partkey long, l_suppkey long, l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string, l_discount double")
    rows.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [r.variant for r in QUERIES["two_stage_least_squares"](spark, str(tmp_path)).collect()] == [2]


def test_two_stage_rounds_a_half_alike_in_any_order(spark, tmp_path):
    """The intercept is 62.8665 exactly; row by row it may come to a last digit less, which is 62.866."""
    quantity = [26, 10, 18, 25, 21, 23, 42, 30, 42, 16, 4, 44, 27, 17, 1, 5, 39, 43, 47, 37, 24, 17, 16, 35, 1, 30, 41, 33, 35, 31]
    price = [94604.75, 42864.42, 37895.12, 49318.69, 6513.25, 95584.56, 12761.31, 99267.02, 74910.13, 14306.52, 58136.71, 101364.98, 67556.55, 54257.21, 43649.98, 8870.83, 69536.89, 4444.14, 26279.77, 5477.13, 103109.26, 103360.77, 47834.45, 71967.69, 17565.11, 93374.04, 7073.49, 44799.74, 52508.28, 75151.49]
    rng, data = random.Random(1), []
    for variant in range(200):
        order = rng.sample(range(30), 30)
        data += [(variant, i, i, 1, float(quantity[i]), price[i], 0.1, "A", 0.05) for i in order]
    rows = spark.createDataFrame(data, "l_partkey long, l_suppkey long, l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string, l_discount double")
    rows.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["two_stage_least_squares"](spark, str(tmp_path)).collect()
    assert len(got) == 200 and {(r.n, r.beta, r.alpha) for r in got} == {(30, -0.385, 62.867)}


def test_two_stage_rounds_an_ill_conditioned_half_alike_in_any_order(spark, tmp_path):
    """The covariance is -5/196, so last digits grow: the intercept of just 6477.1675 comes out by more than the tenth digit less."""
    quantity = [22, 27, 37, 2, 5, 21, 12, 35, 10, 26, 7, 27, 45, 50, 38, 35, 33, 50, 32, 34, 25, 30, 25, 20, 20, 39, 24, 49]
    price = [76178.49, 76807.85, 23010.94, 49348.08, 91257.39, 25095.53, 45131.69, 75486.6, 8992.07, 95143.03, 101882.43, 34668.0, 61429.81, 28067.36, 69925.41, 54397.65, 26589.24, 30708.28, 77549.13, 47442.56, 38574.15, 62193.53, 27069.4, 62897.96, 19700.35, 35860.44, 21527.64, 40785.92]
    rng, data = random.Random(1), []
    for variant in range(200):
        data += [(variant, i, i, 1, float(quantity[i]), price[i], 0.1, "A", 0.05) for i in rng.sample(range(28), 28)]
    # no whole cents: rounded as it comes
    data += [(200, i, i, 1, float(q), 999.0 * (i + 1 / 3), 0.1, "A", 0.05) for i, q in enumerate((3, 4, 5, 8))]
    rows = spark.createDataFrame(data, "l_partkey long, l_suppkey long, l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string, l_discount double")
    rows.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.variant: (r.n, r.beta, r.alpha) for r in QUERIES["two_stage_least_squares"](spark, str(tmp_path)).collect()}
    assert {got.pop(k) for k in range(200)} == {(28, -230.707, 6477.168)} and got == {200: (4, 0.7, -1.667)}
