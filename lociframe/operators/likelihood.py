"""Maximum likelihood of allele counts, a batch of keys at a time.

A key's rows are counted first (equal rows are one, with a weight), so what is gathered is its distinct counts, whose
number a study's samples bound. Keys of a batch climb together: rows lie in one flat array, sums by key are bin
counts, and each round is one projected Newton step for every key that is still open, shortened where it does not gain. Keys that do
not settle say so in the column `settled`.

The terms: with share q of the first allele and dispersion sigma, its count of k in k + m is beta-binomial with
a = q s, b = (1 - q) s, s = 1 / sigma ** 2 - 1, or binomial where sigma is null or 0. A site is heterozygous with probability
`het`; else its reads of one allele are errors, each with probability `error`."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..functions.special import log_gamma, log_gamma_slopes

#: Shares stay this far from 0 and 1.
EDGE = 1e-6
#: Rows that are worked on at once: few, so that the arrays of a round stay in a core's cache.
ROWS = 1 << 15
#: Shares that a scan tries where there may be several tops, and how many of the best are climbed from.
SCAN, CLIMBS = (0.01, 0.06, 0.15, 0.3, 0.5, 0.7, 0.85, 0.94, 0.99), 5

Surface = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def maximise(surface: Surface, start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 200, within: float = 1e-8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points, values, settled) of each row of start, of one or two parameters, climbed to a maximum in its box.

    surface(points, keys) gives values (n), gradients (n, p) and second derivatives (n, p, p) of those keys alone, which ascend. A point is
    settled when no free parameter could gain more than within, relative to the value, by its slope over a Newton step. A key is
    left once it gains no more, so late rounds cost what their open keys do."""
    low, high = np.broadcast_to(low, start.shape), np.broadcast_to(high, start.shape)
    x = np.clip(start, low, high)
    keys = np.arange(len(x))
    value, g, h = surface(x, keys)
    for _ in range(rounds):
        slope, step = _uphill(x[keys], g[keys], h[keys], low[keys], high[keys])
        open_ = (slope * step).sum(axis=1) > within * (1 + np.abs(value[keys])) * 1e-3
        keys, slope, step = keys[open_], slope[open_], step[open_]
        if not len(keys):
            break
        at, scale = x[keys], np.ones((len(keys), 1))
        y = np.clip(at + step, low[keys], high[keys])
        v2, g2, h2 = surface(y, keys)
        for _ in range(39):
            worse = np.flatnonzero(v2 < value[keys] + 1e-4 * (slope * (y - at)).sum(axis=1))
            if not len(worse):
                break
            scale[worse] /= 2
            y[worse] = np.clip(at[worse] + scale[worse] * step[worse], low[keys[worse]], high[keys[worse]])
            v2[worse], g2[worse], h2[worse] = surface(y[worse], keys[worse])
        up = (v2 >= value[keys]) & (np.abs(y - at).max(axis=1) > 0)
        keys = keys[up]
        x[keys], value[keys], g[keys], h[keys] = y[up], v2[up], g2[up], h2[up]
    slope, step = _uphill(x, g, h, low, high)
    return x, value, (slope * step).sum(axis=1) <= within * (1 + np.abs(value))


def _uphill(x: np.ndarray, g: np.ndarray, h: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the parameters that are free to follow them, and their Newton steps."""
    free = ~((x <= low) & (g < 0)) & ~((x >= high) & (g > 0))
    slope = np.where(free, g, 0.0)
    return slope, _newton(slope, h, free)


def _newton(g: np.ndarray, h: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Newton steps of free parameters; where the surface is not curved down it is bent until it is."""
    n, p = g.shape
    a = np.where(free[:, :, None] & free[:, None, :], h, 0.0)
    a[:, range(p), range(p)] = np.where(free, a[:, range(p), range(p)], -1.0)
    if p == 1:
        return g / np.maximum(np.abs(a[:, 0]), 1e-300)
    half, gap = (a[:, 0, 0] + a[:, 1, 1]) / 2, (a[:, 0, 0] - a[:, 1, 1]) / 2
    top = half + np.sqrt(gap**2 + a[:, 0, 1] ** 2)
    bend = np.where(top < -1e-9 * (1 + np.abs(half)), 0.0, top + 1e-3 * (1 + np.abs(half)))
    d0, d1 = a[:, 0, 0] - bend, a[:, 1, 1] - bend
    det = d0 * d1 - a[:, 0, 1] ** 2
    det = np.where(np.abs(det) < 1e-300, 1e-300, det)
    return -np.stack([(d1 * g[:, 0] - a[:, 0, 1] * g[:, 1]) / det, (d0 * g[:, 1] - a[:, 0, 1] * g[:, 0]) / det], axis=1)


def _count_term(q: np.ndarray, k: np.ndarray, m: np.ndarray, s: np.ndarray, fixed: np.ndarray, slopes: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The logarithm of the probability of one ordering of k and m reads at share q, and its first and second derivative in q.
    s is inf for binomial counts; fixed: _fixed_term(k, m, s)."""
    over = np.isfinite(s)
    value, d, dd = k * np.log(q) + m * np.log1p(-q), k / q - m / (1 - q), -k / q**2 - m / (1 - q) ** 2
    if over.any():
        q, k, m, t = q[over], k[over], m[over], s[over]
        a, b = q * t, (1 - q) * t
        if not slopes:
            value[over] = fixed[over] + log_gamma(k + a) + log_gamma(m + b) - log_gamma(a) - log_gamma(b)
            return value, value, value
        (ka, dka, ddka), (mb, dmb, ddmb), (la, da, dda), (lb, db, ddb) = (log_gamma_slopes(x) for x in (k + a, m + b, a, b))
        value[over] = fixed[over] + ka + mb - la - lb
        d[over], dd[over] = t * (dka - dmb - da + db), t * t * (ddka + ddmb - dda - ddb)
    return value, d, dd


def _fixed_term(k: np.ndarray, m: np.ndarray, s: np.ndarray) -> np.ndarray:
    """What no share changes in _count_term."""
    over = np.isfinite(s)
    t = np.where(over, s, 1.0)
    return np.where(over, log_gamma(t) - log_gamma(k + m + t), 0.0)


def _mixed(value: np.ndarray, d: np.ndarray, dd: np.ndarray, k: np.ndarray, m: np.ndarray, het: float, error: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with what homozygous sites with errors add."""
    if het >= 1:
        return value, d, dd
    with np.errstate(divide="ignore"):
        le, lo = np.log(error), np.log1p(-error)
    wrong = np.logaddexp(np.where(k > 0, k * le, 0.0) + np.where(m > 0, m * lo, 0.0), np.where(m > 0, m * le, 0.0) + np.where(k > 0, k * lo, 0.0))
    if het <= 0:
        return wrong, np.zeros_like(d), np.zeros_like(dd)
    own = np.log(het) + value
    whole = np.logaddexp(own, np.log1p(-het) + wrong)
    w = np.exp(own - whole)
    return whole, w * d, w * dd + w * (1 - w) * d * d


def _s(sigma: np.ndarray) -> np.ndarray:
    sigma = np.asarray(sigma, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isnan(sigma) | (sigma <= 0), np.inf, np.maximum(1 / sigma**2 - 1, 1e-9))


def log_likelihood(ratio: Column, ref: Column, alt: Column, sigma: Column | None = None, het: float = 1.0, error: float = 0.0) -> Column:
    """The logarithm of the probability of an ordering of the reads at a share of the first allele; null in, null out."""

    @F.pandas_udf("double")
    def run(q: pd.Series, k: pd.Series, m: pd.Series, sd: pd.Series) -> pd.Series:
        q, k, m = (x.to_numpy(float) for x in (q, k, m))
        p = np.clip(q, EDGE, 1 - EDGE)
        s = _s(sd.to_numpy(float))
        v = _count_term(p, k, m, s, _fixed_term(k, m, s), False)[0]
        out = pd.Series(_mixed(v, v, v, k, m, het, error)[0])
        return out.where(out.notna(), None)

    none = F.lit(None) if sigma is None else sigma
    return run(ratio.cast("double"), ref.cast("double"), alt.cast("double"), none.cast("double"))


def _gathered(reads: DataFrame, by: list[str], **columns: Column | None) -> DataFrame:
    """(keys, names..., w): arrays of the distinct rows of each key and how often they are there."""
    names = list(columns)
    one = reads.select(*by, *(F.lit(None).cast("double").alias(n) if c is None else c.cast("double").alias(n) for n, c in columns.items()))
    one = one.groupBy(*by, *names).agg(F.count("*").cast("double").alias("w"))
    g = one.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*names, "w"))).alias("r"))
    return g.select(*by, *(F.col(f"r.{n}").alias(n) for n in [*names, "w"]))


def _chunks(arrays: tuple[pd.Series, ...]):
    """Flat arrays of consecutive keys, ROWS rows at most unless one key has more: (number of keys, key of each row, columns)."""
    sizes = np.array([len(x) for x in arrays[0]], np.int64)
    start = 0
    while start < len(sizes):
        ends = np.cumsum(sizes[start:])
        stop = start + max(1, int(np.searchsorted(ends, ROWS, side="right")))
        at = np.repeat(np.arange(stop - start), sizes[start:stop])
        yield stop - start, at, [np.concatenate([np.asarray(v, float) for v in a.iloc[start:stop]]) if len(at) else np.zeros(0) for a in arrays]
        start = stop


def _picked(at: np.ndarray, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray | slice]:
    """Rows of the keys, and the place of each row's key among them; at tells the key of each row of all n."""
    if len(keys) == n:
        return at, slice(None)
    place = np.full(n, -1)
    place[keys] = np.arange(len(keys))
    to = place[at]
    rows = np.flatnonzero(to >= 0)
    return to[rows], rows


class _Counts:
    """A column of counts whose numbers repeat within keys: a function of count and key is computed once for each that differs."""

    def __init__(self, at: np.ndarray, n: int, counts: np.ndarray):
        own, which = np.unique(counts, return_inverse=True)
        pairs, self.place = np.unique(at * len(own) + which, return_inverse=True)
        self.n, self.at, self.counts = n, pairs // max(1, len(own)), own[pairs % max(1, len(own))]

    def of(self, function, add: np.ndarray, keys: np.ndarray, rows: np.ndarray | slice) -> list[np.ndarray]:
        """What function gives for each row's count plus add of its key; rows: those of keys, as _picked tells."""
        to, pairs = _picked(self.at, self.n, keys)
        place = self.place[rows]
        if len(keys) < self.n:
            back = np.zeros(len(self.at), np.int64)
            back[pairs] = np.arange(len(pairs))
            place = back[place]
        return [x[place] for x in function(self.counts[pairs] + add[to])]


def _tops(heights: np.ndarray) -> np.ndarray:
    """Which points of each grid (the first axis counts grids) no neighbour along an axis or a diagonal exceeds."""
    out = np.ones(heights.shape, bool)
    padded = np.pad(heights, [(0, 0)] + [(1, 1)] * (heights.ndim - 1), constant_values=-np.inf)
    for shift in np.ndindex(*[3] * (heights.ndim - 1)):
        out &= heights >= padded[(slice(None), *(slice(s, s + k) for s, k in zip(shift, heights.shape[1:])))]
    return out


def _sums(at: np.ndarray, n: int, *values: np.ndarray) -> list[np.ndarray]:
    return [np.bincount(at, v, n) for v in values]


def _null(values: np.ndarray, ok: np.ndarray) -> pd.Series:
    return pd.Series(values).astype(object).where(pd.Series(ok & np.isfinite(values)), None)


def allelic_test(reads: DataFrame, by: list[str], ref: str, alt: str, sigma: str | None = None, proportion: str | None = None, het: float = 1.0, error: float = 0.0) -> DataFrame:
    """Likelihood-ratio tests (one degree of freedom) of allele counts of heterozygous samples.

    (keys, n, reads, ratio, slope, base, null_ll, alt_ll, chi2, p, settled). Without proportion: one joint share `ratio` against one half.
    With it (a cell type's proportion in each sample): a share that follows it, base + slope * proportion, within 0
    and 1 at all of a key's proportions, against one joint share; slope, base, chi2 and p are null where proportions do not vary.
    sigma is each sample's dispersion; without it, or where null, counts are binomial. Rows without reads or with nulls are left out.

    Shares at a key's smallest and largest proportion are the parameters, so that the bounds are a box. The binomial and beta-binomial are
    concave there; with het under 1 the best points of a scan are climbed from too, and the highest top counts."""
    v = reads.where((F.col(ref) + F.col(alt) > 0) & (F.lit(True) if proportion is None else F.col(proportion).isNotNull()))
    g = _gathered(v, by, k=F.col(ref), m=F.col(alt), c=F.col(proportion) if proportion else F.lit(0.0), sd=F.col(sigma) if sigma else None)

    @F.pandas_udf("struct<n:long,reads:long,ratio:double,slope:double,base:double,null_ll:double,alt_ll:double,settled:boolean>")
    def run(k: pd.Series, m: pd.Series, c: pd.Series, sd: pd.Series, w: pd.Series) -> pd.DataFrame:
        parts = []
        for n, at, (k_, m_, c_, sd_, w_) in _chunks((k, m, c, sd, w)):
            s = _s(sd_)
            fixed, every = _fixed_term(k_, m_, s), np.arange(n)
            least, most = np.full(n, np.inf), np.full(n, -np.inf)
            np.minimum.at(least, at, c_)
            np.maximum.at(most, at, c_)
            span = most - least
            u = (c_ - least[at]) / np.where(span > 0, span, 1)[at]

            def flat(x: np.ndarray, keys: np.ndarray, slopes: bool = True):
                to, rows = _picked(at, n, keys)
                k, m, w = k_[rows], m_[rows], w_[rows]
                value, d, dd = _mixed(*_count_term(x[to, 0], k, m, s[rows], fixed[rows], slopes), k, m, het, error)
                v_, g_, h_ = _sums(to, len(keys), w * value, w * d, w * dd)
                return v_, g_[:, None], h_[:, None, None]

            def line(x: np.ndarray, keys: np.ndarray, slopes: bool = True):
                to, rows = _picked(at, n, keys)
                k, m, w, hi = k_[rows], m_[rows], w_[rows], u[rows]
                lo = 1 - hi
                value, d, dd = _mixed(*_count_term(lo * x[to, 0] + hi * x[to, 1], k, m, s[rows], fixed[rows], slopes), k, m, het, error)
                v_, g0, g1, h00, h01, h11 = _sums(to, len(keys), w * value, w * d * lo, w * d * hi, w * dd * lo * lo, w * dd * lo * hi, w * dd * hi * hi)
                return v_, np.stack([g0, g1], axis=1), np.stack([np.stack([h00, h01], axis=1), np.stack([h01, h11], axis=1)], axis=1)

            def highest(surface, start):
                """The highest of the climbs from start and, where the surface may have several tops, from the highest points of a scan that no neighbour exceeds."""
                starts = [start]
                if het < 1:
                    scan = np.array(np.meshgrid(*[SCAN] * start.shape[1])).reshape(start.shape[1], -1).T
                    heights = np.stack([surface(np.tile(x, (n, 1)), every, False)[0] for x in scan], axis=1)
                    tops = _tops(heights.reshape(n, *[len(SCAN)] * start.shape[1]))
                    starts += [scan[i] for i in np.argsort(-np.where(tops.reshape(n, -1), heights, -np.inf), axis=1)[:, :CLIMBS].T]
                best = maximise(surface, start, EDGE, 1 - EDGE)
                for x in starts[1:]:
                    got = maximise(surface, x, EDGE, 1 - EDGE)
                    up = got[1] > best[1]
                    best = np.where(up[:, None], got[0], best[0]), np.where(up, got[1], best[1]), np.where(up, got[2], best[2])
                return best

            count, all_, first, wc, wcc, wy, wcy = _sums(at, n, w_, w_ * (k_ + m_), w_ * k_, w_ * u, w_ * u * u, w_ * k_ / (k_ + m_), w_ * u * k_ / (k_ + m_))
            joint = np.clip(first / np.maximum(all_, 1), 0.01, 0.99)
            one, one_ll, one_ok = highest(flat, joint[:, None])
            if proportion is None:
                half = flat(np.full((n, 1), 0.5), every, False)[0]
                parts.append(pd.DataFrame({"n": count.astype(int), "reads": all_.astype(int), "ratio": one[:, 0], "slope": None, "base": None, "null_ll": half, "alt_ll": one_ll, "settled": one_ok}))
                continue
            det = count * wcc - wc * wc
            rise = np.where(det > 1e-12, (count * wcy - wc * wy) / np.where(det > 1e-12, det, 1), 0)
            foot = (wy - rise * wc) / count
            ends = np.clip(np.stack([foot, foot + rise], axis=1), 0.01, 0.99)
            two, two_ll, two_ok = highest(line, ends)
            varies = span > 0
            slope = (two[:, 1] - two[:, 0]) / np.where(varies, span, 1)
            parts.append(pd.DataFrame({"n": count.astype(int), "reads": all_.astype(int), "ratio": one[:, 0], "slope": _null(slope, varies), "base": _null(two[:, 0] - slope * least, varies), "null_ll": one_ll, "alt_ll": _null(np.maximum(two_ll, one_ll), varies), "settled": one_ok & (two_ok | ~varies)}))
        return pd.concat(parts, ignore_index=True)

    out = g.select(*by, run("k", "m", "c", "sd", "w").alias("x")).select(*by, "x.*")
    out = out.withColumn("chi2", F.greatest(F.lit(0.0), 2 * (F.col("alt_ll") - F.col("null_ll"))) + F.lit(0.0) * F.col("alt_ll"))
    out = out.withColumn("p", special.chi2_upper_p(F.col("chi2"), F.lit(1.0)))
    return out.select(*by, "n", "reads", "ratio", "slope", "base", "null_ll", "alt_ll", "chi2", "p", "settled")


def sample_dispersion(reads: DataFrame, by: list[str], ref: str, alt: str, het: float = 1.0, error: float = 0.0) -> DataFrame:
    """(keys, n, sigma, log_likelihood, settled): each sample's dispersion, the largest likelihood of all its counts at a share of one half.

    The parameter is the logarithm of s = 1 / sigma ** 2 - 1; the climb starts from a coarse scan, as the likelihood is flat far from its top."""
    g = _gathered(reads.where(F.col(ref) + F.col(alt) > 0), by, k=F.col(ref), m=F.col(alt))

    @F.pandas_udf("struct<n:long,sigma:double,log_likelihood:double,settled:boolean>")
    def run(k: pd.Series, m: pd.Series, w: pd.Series) -> pd.DataFrame:
        parts = []
        for n, at, (k_, m_, w_) in _chunks((k, m, w)):

            every, ks, ms, both = np.arange(n), _Counts(at, n, k_), _Counts(at, n, m_), _Counts(at, n, k_ + m_)

            def surface(x: np.ndarray, keys: np.ndarray):
                to, rows = _picked(at, n, keys)
                t = np.exp(x[:, 0])
                (ka, dka, ddka), (ma, dma, ddma), (kmt, dkmt, ddkmt) = (c.of(log_gamma_slopes, add, keys, rows) for c, add in ((ks, t / 2), (ms, t / 2), (both, t)))
                (la, da, dda), (lt, dt, ddt) = ([z[to] for z in log_gamma_slopes(y)] for y in (t / 2, t))
                t, w = t[to], w_[rows]
                value = ka + ma - kmt - 2 * la + lt
                d = (dka + dma) / 2 - dkmt - da + dt
                dd = (ddka + ddma) / 4 - ddkmt - dda / 2 + ddt
                value, d, dd = _mixed(value, t * d, t * t * dd + t * d, k_[rows], m_[rows], het, error)
                v_, g_, h_ = _sums(to, len(keys), w * value, w * d, w * dd)
                return v_, g_[:, None], h_[:, None, None]

            def height(x: float):
                """Values alone, all keys at one point."""
                t = np.exp(np.full(n, x))
                (ka,), (ma,), (kmt,) = (c.of(lambda y: [log_gamma(y)], add, every, slice(None)) for c, add in ((ks, t / 2), (ms, t / 2), (both, t)))
                value = ka + ma - kmt + (log_gamma(t) - 2 * log_gamma(t / 2))[at]
                return _sums(at, n, w_ * _mixed(value, value, value, k_, m_, het, error)[0])[0]

            scan = np.linspace(-4, 12, 17)
            values = np.stack([height(x) for x in scan], axis=1)
            x, top, ok = maximise(surface, scan[values.argmax(axis=1)][:, None], -9.0, 18.0)
            parts.append(pd.DataFrame({"n": _sums(at, n, w_)[0].astype(int), "sigma": 1 / np.sqrt(1 + np.exp(x[:, 0])), "log_likelihood": top, "settled": ok}))
        return pd.concat(parts, ignore_index=True)

    return g.select(*by, run("k", "m", "w").alias("x")).select(*by, "x.*")


def beta_binomial_maximum(reads: DataFrame, by: list[str], ref: str, alt: str) -> DataFrame:
    """(keys, n, ratio, theta, log_likelihood, null_ll, chi2, p, settled): the share and theta = a + b with the largest beta-binomial
    likelihood of a key's allele counts, and twice its gain over a share of one half with the same theta."""
    g = _gathered(reads.where(F.col(ref) + F.col(alt) > 0), by, k=F.col(ref), m=F.col(alt))

    @F.pandas_udf("struct<n:long,ratio:double,theta:double,log_likelihood:double,null_ll:double,settled:boolean>")
    def run(k: pd.Series, m: pd.Series, w: pd.Series) -> pd.DataFrame:
        parts = []
        for n, at, (k_, m_, w_) in _chunks((k, m, w)):
            ways, every = special.ln_choose(k_ + m_, k_), np.arange(n)

            def surface(x: np.ndarray, keys: np.ndarray):
                to, rows = _picked(at, n, keys)
                k, m, w, q, t = k_[rows], m_[rows], w_[rows], x[to, 0], np.exp(x[to, 1])
                own = (x[:, 0] * np.exp(x[:, 1]), (1 - x[:, 0]) * np.exp(x[:, 1]), np.exp(x[:, 1]))
                (a0, a1, a2), (b0, b1, b2), (t0, t1, t2) = ([z[to] for z in log_gamma_slopes(y)] for y in own)
                (ka, dka, ddka), (mb, dmb, ddmb), (kmt, dkmt, ddkmt) = (log_gamma_slopes(y) for y in (k + q * t, m + (1 - q) * t, k + m + t))
                la, lb, lt = dka - a1, dmb - b1, t1 - dkmt
                ta, tb, tt = ddka - a2, ddmb - b2, t2 - ddkmt
                value = ways[rows] + ka + mb - kmt - a0 - b0 + t0
                dt = q * la + (1 - q) * lb + lt
                v_, g0, g1, h00, h01, h11 = _sums(to, len(keys), w * value, w * t * (la - lb), w * t * dt, w * t * t * (ta + tb), w * t * (la - lb + t * (q * ta - (1 - q) * tb)), w * (t * t * (q * q * ta + (1 - q) ** 2 * tb + tt) + t * dt))
                return v_, np.stack([g0, g1], axis=1), np.stack([np.stack([h00, h01], axis=1), np.stack([h01, h11], axis=1)], axis=1)

            first, all_ = _sums(at, n, w_ * k_, w_ * (k_ + m_))
            q0 = np.clip(first / all_, 0.001, 0.999)
            scan = np.linspace(-2, 12, 8)
            values = np.stack([surface(np.stack([q0, np.full(n, x)], axis=1), every)[0] for x in scan], axis=1)
            x, top, ok = maximise(surface, np.stack([q0, scan[values.argmax(axis=1)]], axis=1), np.array([EDGE, -7.0]), np.array([1 - EDGE, 18.0]))
            half = surface(np.stack([np.full(n, 0.5), x[:, 1]], axis=1), every)[0]
            parts.append(pd.DataFrame({"n": _sums(at, n, w_)[0].astype(int), "ratio": x[:, 0], "theta": np.exp(x[:, 1]), "log_likelihood": top, "null_ll": half, "settled": ok}))
        return pd.concat(parts, ignore_index=True)

    out = g.select(*by, run("k", "m", "w").alias("x")).select(*by, "x.*")
    out = out.withColumn("chi2", F.greatest(F.lit(0.0), 2 * (F.col("log_likelihood") - F.col("null_ll"))))
    return out.select(*by, "n", "ratio", "theta", "log_likelihood", "null_ll", "chi2", special.chi2_upper_p(F.col("chi2"), F.lit(1.0)).alias("p"), "settled")


def negative_binomial(reads: DataFrame, by: list[str], ref: str, alt: str) -> DataFrame:
    """(keys, n, ratio, log_likelihood, chi2, p): reads of one allele until the other's are counted. The largest likelihood is at the joint
    share, so sums by key are all it takes; chi2 is twice the gain over one half. Rows without reads of the second allele are left out."""

    @F.pandas_udf("double")
    def ways(k: pd.Series, m: pd.Series) -> pd.Series:
        k, m = k.to_numpy(float), m.to_numpy(float)
        return pd.Series(log_gamma(k + m) - log_gamma(k + 1) - log_gamma(m))

    v = reads.where((F.col(alt) > 0) & F.col(ref).isNotNull()).select(*by, F.col(ref).cast("double").alias("__k"), F.col(alt).cast("double").alias("__m"))
    s = v.withColumn("__w", ways("__k", "__m")).groupBy(*by).agg(F.count("*").alias("n"), F.sum("__k").alias("__k"), F.sum("__m").alias("__m"), F.sum("__w").alias("__w"))
    all_ = F.col("__k") + F.col("__m")
    ratio = F.col("__k") / all_
    gain = F.when(F.col("__k") > 0, F.col("__k") * F.log(ratio)).otherwise(0.0) + F.col("__m") * F.log(F.col("__m") / all_)
    out = s.select(*by, "n", ratio.alias("ratio"), (F.col("__w") + gain).alias("log_likelihood"), F.greatest(F.lit(0.0), 2 * (gain - all_ * F.log(F.lit(0.5)))).alias("chi2"))
    return out.withColumn("p", special.chi2_upper_p(F.col("chi2"), F.lit(1.0)))
