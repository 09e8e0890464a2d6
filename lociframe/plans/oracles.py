"""SQL of catalogue queries that takes more than a line: exact tails by sums and Simpson's rule, EM and greedy
passes by recursion and folds, regressions by taking out one term after another."""

from __future__ import annotations

from ..functions import stats
from .catalog import CALLS_SQL, MEMBERS_SQL, SQL
from .views import with_views


def _horner(x: str, coefficients: tuple[float, ...], last: str | None = None) -> str:
    out = repr(coefficients[0])
    for c in map(repr, coefficients[1:]):
        out = f"({out} * {x} + {c})"
    return f"({out} * {x} + {last})" if last else out


def probit_sql(p: str) -> str:
    """The normal quantile of p."""
    q, m = f"sqrt(-2 * ln(least({p}, 1 - ({p}))))", f"(({p}) - 0.5)"
    tail = f"({_horner(q, stats._C)}) / ({_horner(q, stats._D, '1e0')})"
    body = f"({_horner(f'({m} * {m})', stats._A)}) * {m} / ({_horner(f'({m} * {m})', stats._Q, '1e0')})"
    return f"case when ({p}) <= 0 or ({p}) >= 1 then null when ({p}) < 0.02425 then {tail} when ({p}) > 1 - 0.02425 then -({tail}) else {body} end"


def put(name: str, views: tuple[str, ...], sql: str, recursive: bool = False) -> None:
    text = (with_views(*views) if views else "with one as (select 1 as one)") + sql
    SQL[name] = text.replace("with ", "with recursive ", 1) if recursive else text


put(
    "inverse_normal",
    ("genotypes",),
    f""", x as (select variant, obs, line, (rank() over (partition by variant order by expression) + (count(*) over (partition by variant, expression) - 1) / 2e0 - 0.5) / count(*) over (partition by variant) as u from genotypes where expression is not null)
 select variant, obs, line, round({probit_sql("u")}, 6) as normal from x""",
)
put(
    "allelic_meta",
    ("reads",),
    f""", s as (select variant, sample, sum(ref_reads) as k, sum(ref_reads) + sum(alt_reads) as n from reads group by 1, 2 having sum(ref_reads) + sum(alt_reads) > 0),
 d as (select distinct least(k, n - k) as low, n from s), g as (select low, n, unnest(range(0, cast(low as bigint) + 1)) as x from d), t as (select low, n, greatest(1e-300, least(1, 2 * sum(exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) - n * ln(2))))) as p from g group by low, n),
 z as (select s.variant, sign(s.k * 1e0 / s.n - 0.5) * -({probit_sql("p / 2")}) as z from s join t on least(s.k, s.n - s.k) = t.low and s.n = t.n) select variant, round(sum(z) / sqrt(count(z)), 5) as z from z group by variant""",
)
put(
    "set_fisher",
    (),
    f""", {MEMBERS_SQL}, t as (select grp, count(*) filter (where hit) as a, (select count(*) from hits where hit) - count(*) filter (where hit) as b, count(*) filter (where not hit) as c, (select count(*) from hits where not hit) - count(*) filter (where not hit) as d from members m join hits h on m.item = h.item group by grp having count(*) >= 5),
 g as (select grp, a, a + b as r, a + c as k, a + b + c + d as n, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) as x from t),
 p as (select grp, a, x, exp(lgamma(r + 1) - lgamma(x + 1) - lgamma(r - x + 1) + lgamma(n - r + 1) - lgamma(k - x + 1) - lgamma(n - r - k + x + 1) - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1)) as p from g),
 o as (select grp, max(p) filter (where x = a) as own from p group by grp), s as (select p.grp, least(1, sum(p) filter (where p <= own * (1 + 1e-7))) as p from p join o on p.grp = o.grp group by p.grp)
 select t.grp, a, b, c, d, round(p, 8) as p, case when b * c > 0 then round(a * d * 1e0 / (b * c), 8) end as odds_ratio from t join s on t.grp = s.grp""",
)
put(
    "correlation_p",
    ("genotypes",),
    """, c as (select variant, dataset, count(dosage) as n, case when min(dosage) < max(dosage) and min(expression) < max(expression) then corr(dosage, expression) end as r from genotypes where dosage is not null group by 1, 2 having count(dosage) > 4),
 a as (select variant, dataset, n, r, n - 2 as v, atan(abs(r) / sqrt(1 - r * r)) as top from c), g as (select *, unnest(range(0, 401)) as i from a where abs(r) < 1),
 s as (select variant, dataset, n, sum(w * pow(cos(top * i / 400), v - 1)) * top as part, sum(w * pow(abs(cos(pi() / 2 * i / 400)), v - 1)) * pi() / 2 as whole from (select *, case when i in (0, 400) then 1 when i % 2 = 1 then 4 else 2 end as w from g) t group by 1, 2, 3, top)
 select a.variant, a.dataset, a.n, round(1 - part / whole, 8) as p from a left join s on a.variant = s.variant and a.dataset = s.dataset""",
)
put(
    "ld_haplotypes",
    ("genotypes", "variants"),
    f""", {CALLS_SQL}, t as (select a, b, count(*) as n, count(*) filter (where x = 1 and y = 1) as het, sum((x = 0)::int * (y = 0)::int * 2 + (x = 0)::int * (y = 1)::int + (x = 1)::int * (y = 0)::int) as c0, sum((x = 0)::int * (y = 2)::int * 2 + (x = 0)::int * (y = 1)::int + (x = 1)::int * (y = 2)::int) as c1,
  sum((x = 2)::int * (y = 0)::int * 2 + (x = 1)::int * (y = 0)::int + (x = 2)::int * (y = 1)::int) as c2, sum((x = 2)::int * (y = 2)::int * 2 + (x = 1)::int * (y = 2)::int + (x = 2)::int * (y = 1)::int) as c3 from j group by a, b),
 em as (select a, b, 0 as i, (c0 + het / 2e0) / (2 * n) as p0, (c1 + het / 2e0) / (2 * n) as p1, (c2 + het / 2e0) / (2 * n) as p2, (c3 + het / 2e0) / (2 * n) as p3 from t union all
  select a, b, i + 1, (c0 + het * s) / (2 * n), (c1 + het * (1 - s)) / (2 * n), (c2 + het * (1 - s)) / (2 * n), (c3 + het * s) / (2 * n) from (select em.a, em.b, i, n, het, c0, c1, c2, c3, case when p0 * p3 + p1 * p2 > 0 then p0 * p3 / (p0 * p3 + p1 * p2) else 0.5 end as s from em join t on em.a = t.a and em.b = t.b where i < 25) q),
 f as (select a, b, p0 + p1 as pa, p0 + p2 as pb, p0 - (p0 + p1) * (p0 + p2) as d from em where i = 25), h as (select *, pa * (1 - pa) * pb * (1 - pb) as var, case when d < 0 then least(pa * pb, (1 - pa) * (1 - pb)) else least(pa * (1 - pb), (1 - pa) * pb) end as top from f)
 select h.a, h.b, n, case when var > 1e-12 then round(d * d / var, 6) end as r2, case when var > 1e-12 and top > 1e-12 then round(least(1, abs(d) / top), 6) end as d_prime from h join t on h.a = t.a and h.b = t.b""",
    recursive=True,
)


def _clump(hits: str, window: int) -> str:
    """f: the founders of each chromosome in order of p, from hits."""
    return f"f as (select chrom, list_reduce(list([{{'pos': pos, 'k': variant}}] order by p, variant), lambda a, x: case when len(list_filter(a, lambda y: abs(y.pos - x[1].pos) <= {window})) > 0 then a else list_concat(a, x) end) as f from {hits} group by chrom)"


put(
    "clump_loci",
    ("effects", "variants"),
    f", best as (select snp as variant, min(p) as p from effects group by snp), hits as (select v.variant, v.chrom, v.pos, p from variants v join best b on v.variant = b.variant where p < 0.02), {_clump('hits', 5000)} select h.variant, h.chrom, list_filter(f.f, lambda y: abs(y.pos - h.pos) <= 5000)[1].k as locus from hits h join f on h.chrom = f.chrom",
)
put(
    "clumped_risk_scores",
    ("effects", "variants", "genotypes"),
    f", best as (select snp as variant, p, z as weight from (select *, row_number() over (partition by snp order by p, id) as k from effects) t where k = 1), hits as (select v.variant, v.chrom, v.pos, p, weight from variants v join best b on v.variant = b.variant where p <= 0.1), {_clump('hits', 2000)}, u as (select unnest(f).k as variant from f), w as (select h.variant, weight from hits h join u on h.variant = u.variant),"
    " j as (select g.variant, sample, dosage, weight from genotypes g join w on g.variant = w.variant), ok as (select variant from j group by variant having count(dosage) * 1e0 / count(*) >= 0.75) select sample, round(sum(dosage * weight), 4) as score, count(*) as n from j where dosage is not null and variant in (select variant from ok) group by sample",
)
put(
    "ld_pruned",
    ("genotypes", "variants"),
    f", {CALLS_SQL}, r as (select a, b, pow(case when min(x) < max(x) and min(y) < max(y) then corr(x, y) end, 2) as r2 from j group by a, b), e as (select a, b from r where r2 >= 0.30001 union all select b, a from r where r2 >= 0.30001), nb as (select a as variant, list(b) as nb from e group by a),"
    " v as (select v.variant, v.chrom, v.pos, coalesce(nb, []) as nb from variants v left join nb on v.variant = nb.variant), k as (select unnest(list_reduce(list([{'k': variant, 'nb': nb}] order by pos, variant), lambda a, x: case when list_has_any(list_transform(a, lambda y: y.k), x[1].nb) then a else list_concat(a, x) end)).k as variant from v group by chrom) select v.variant, v.chrom, v.pos from v join k on v.variant = k.variant",
)
put(
    "regress_out_covariates",
    (),
    """, y as (select vec_id, unnest(embedding) as y, generate_subscripts(embedding, 1) - 1 as i from embeddings), x as (select *, i - 31.5 as x1, (i - 31.5) * (i - 31.5) - 341.25 as x2, y - avg(y) over (partition by vec_id) as c from y)
 select vec_id, round(sum(c * c) - pow(sum(c * x1), 2) / sum(x1 * x1) - pow(sum(c * x2), 2) / sum(x2 * x2), 4) as power from x group by vec_id""",
)
put(
    "sample_mixups",
    ("genotypes", "variants"),
    """, g as (select variant, sample, min(dosage) as dosage from genotypes where dosage is not null group by 1, 2), t as (select gene, sample, avg(value) as value from (select variant % 100 + 1 as gene, sample, dataset, avg(expression) as value from genotypes group by 1, 2, 3) u group by 1, 2),
 e as (select variant, variant % 100 + 1 as gene from variants), own as (select e.variant, e.gene, dosage, avg(value) as m, stddev_samp(value) as s from e join g on e.variant = g.variant join t on t.gene = e.gene and t.sample = g.sample group by 1, 2, 3 having count(*) >= 3 and stddev_samp(value) > 0)
 select g.sample as genotyped, t.sample as measured, round(avg(abs(t.value - m) / s), 4) as score, count(*) as n from g join own on g.variant = own.variant and g.dosage = own.dosage join t on t.gene = own.gene group by 1, 2""",
)
put(
    "harmonise_panels",
    ("variants", "peaks"),
    """, s as (select variant, chrom, pos - pos % 130 as pos, ref, alt, 0.05 + variant % 9 * 0.05 as m from variants where ref <> alt), x as (select peak as ref_id, chrom, start as pos, substr('ACGT', cast(peak % 4 as int) + 1, 1) as r2, substr('CGTA', cast(peak % 4 as int) + 1, 1) as a2, 0.05 + peak % 9 * 0.05 as mr from peaks),
 j as (select s.*, x.ref_id, mr, least(ref, alt) = least(r2, a2) and greatest(ref, alt) = greatest(r2, a2) as same, least(ref, alt) = least(translate(r2, 'ACGT', 'TGCA'), translate(a2, 'ACGT', 'TGCA')) and greatest(ref, alt) = greatest(translate(r2, 'ACGT', 'TGCA'), translate(a2, 'ACGT', 'TGCA')) as turned from s join x on s.chrom = x.chrom and s.pos = x.pos),
 k as (select *, case when cast(variant as varchar) = cast(ref_id as varchar) then 0 when same then 1 when turned then 2 end as rank from j), b as (select *, min(rank) over (partition by variant) as best from k where rank is not null), c as (select *, count(*) over (partition by variant) as k from b where rank = best),
 d as (select variant, ref_id, case when k > 1 or not (same or turned) then 'exclude' when ref || alt in ('AT', 'TA', 'CG', 'GC') then case when abs(m - mr) <= 0.1 and m < 0.4 then 'keep' else 'exclude' end when same then 'keep' else 'swap' end as action from c) select variant, min(ref_id) as ref_id, action from d group by variant, action""",
)
def _interaction(source: str, keys: str) -> str:
    """The interaction regression of source(keys, x, c, i, y): the covariate is taken out of x, i and y, then x out of i and y."""
    on = lambda a, b: " and ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))
    of = lambda a: ", ".join(f"{a}.{k.strip()}" for k in keys.split(","))
    return f""", v as ({source}), g as (select {keys}, count(*) as n, avg(x) as mx, avg(c) as mc, avg(i) as mi, avg(y) as my, case when min(c) < max(c) then regr_slope(x, c) end as xc, case when min(c) < max(c) then regr_slope(i, c) end as ic, case when min(c) < max(c) then regr_slope(y, c) end as yc from v group by {keys}),
 w as (select {of("v")}, n, (x - mx) - xc * (c - mc) as rx, (i - mi) - ic * (c - mc) as ri, (y - my) - yc * (c - mc) as ry, i, x from v join g on {on("v", "g")}), h as (select {keys}, sum(rx * ri) / nullif(sum(rx * rx), 0) as ix, sum(rx * ry) / nullif(sum(rx * rx), 0) as yx, sum(rx * rx) as sxx, sum(x * x) as x2 from w group by {keys}),
 q as (select {of("w")}, n, ri - ix * rx as ti, ry - yx * rx as ty, i, sxx, x2 from w join h on {on("w", "h")}), f as (select {keys}, n, sum(ti * ty) / nullif(sum(ti * ti), 0) as b3, sum(ti * ti) as sii, sum(ty * ty) as syy, sum(ti * ty) as siy, sum(i * i) as i2, min(sxx) as sxx, min(x2) as x2 from q group by {keys}, n),
 k as (select {of("g")}, g.n, case when g.n > 4 and sii > 1e-7 * i2 and f.sxx > 1e-7 * f.x2 and xc is not null then b3 end as b3, yx, ix, xc, ic, yc, mx, mc, mi, my, sii, greatest(0, syy - siy * siy / nullif(sii, 0)) as rss from g join h on {on("g", "h")} join f on {on("g", "f")})
 select {keys}, n, round(my - (yx - b3 * ix) * mx - (yc - (yx - b3 * ix) * xc - b3 * ic) * mc - b3 * mi, 5) as b0, round(yx - b3 * ix, 5) as b1, round(yc - (yx - b3 * ix) * xc - b3 * ic, 5) as b2, round(b3, 5) as b3, round(case when rss > 0 then b3 / sqrt(rss / (n - 4) / sii) end, 5) as t3 from k"""


def _one(covariate: str, keys: str = "variant") -> str:
    return f"select {keys}, dosage * 1e0 as x, {covariate} * 1e0 as c, dosage * {covariate} * 1e0 as i, expression as y from genotypes where dosage is not null"


put("interaction_regression", ("genotypes",), _interaction(_one("depth"), "variant"))
put("trans_correlation_qtl", ("genotypes",), _interaction(_one("quantity"), "variant"))
put("covariate_interaction_screen", ("genotypes",), _interaction(" union all ".join(_one(c, f"variant, '{c}' as covariate") for c in ("depth", "quantity")), "variant, covariate"))
put(
    "gene_scores",
    ("effects", "variants", "genes"),
    """, b as (select snp as variant, max(z) as z from effects group by snp), k as (select g.gene, count(b.z) as n, sum(b.z * b.z) as q from b join variants v on b.variant = v.variant join genes g on v.chrom = g.chrom and v.pos between g.start - 2000 and g.stop + 2000 group by g.gene),
 s as (select *, unnest(range(0, 1001)) as i, sqrt(q) / 1000 as h from k), t as (select gene, n, q, sum(case when i in (0, 1000) then 1 when i % 2 = 1 then 4 else 2 end * h / 3 * 2 * pow(i * h, n - 1) * exp(-i * h * i * h / 2 - n / 2e0 * ln(2) - lgamma(n / 2e0))) as p from s group by 1, 2, 3) select gene, n, round(q, 5) as chi2, round(1 - p, 6) as p from t""",
)
