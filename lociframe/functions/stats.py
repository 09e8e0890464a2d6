"""Statistical scalar functions as Column arithmetic, so they stay inside generated code.

Tail probabilities use the Abramowitz-Stegun polynomial 26.2.17 (absolute error under
1e-7); functions that need more (exact t, F, chi-square, beta) are in special.py.
Null in, null out; values outside a function's domain give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the polynomial 26.2.17.
_P, _B = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
#: Smallest probability reported, as underflow would give 0.
P_FLOOR = 2e-323


def two_sided_normal_p(z: Column) -> Column:
    """p of |Z| >= |z| by the polynomial."""
    a = F.abs(z)
    t = 1 / (1 + _P * a)
    poly = t * (_B[0] + t * (_B[1] + t * (_B[2] + t * (_B[3] + t * _B[4]))))
    return F.greatest(F.lit(P_FLOOR), 2 * F.exp(-a * a / 2) * 0.3989422804014327 * poly)


def normal_cdf(z: Column) -> Column:
    tail = two_sided_normal_p(z) / 2
    return F.when(z >= 0, 1 - tail).otherwise(tail)


# Fixed values of Acklam's rational approximation of the normal quantile.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_Q = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(x: Column, coef: tuple[float, ...], last: float | None = None) -> Column:
    out = F.lit(coef[0])
    for c in coef[1:] if last is None else (*coef[1:], last):
        out = out * x + c
    return out


def probit(p: Column) -> Column:
    """The standard normal quantile of p (relative error under 1.2e-9); null unless 0 < p < 1."""
    q = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _poly(q, _C) / _poly(q, _D, 1.0)
    m = p - 0.5
    r = m * m
    body = _poly(r, _A) * m / _poly(r, _Q, 1.0)
    inside = (p > 0) & (p < 1)
    return F.when(inside & (p < 0.02425), tail).when(inside & (p > 1 - 0.02425), -tail).when(inside, body)


def p_to_z_two_sided(p: Column) -> Column:
    """|z| of a two-sided p."""
    return -probit(p / 2)


def fisher_z(r: Column) -> Column:
    return F.when(F.abs(r) < 1, 0.5 * F.log((1 + r) / (1 - r)))


def correlation_t(r: Column, n: Column) -> Column:
    """Student's t of a correlation of n pairs."""
    return F.when((n > 2) & (F.abs(r) < 1), r * F.sqrt((n - 2) / (1 - r * r)))


def correlation_z(r: Column, n: Column) -> Column:
    """z of a correlation of n pairs: its t, with n - 2 degrees of freedom, made normal by
    Wallace's approximation, exact enough for ranking and meta-analysis (error under 0.3 %)."""
    t = correlation_t(r, n)
    df = n - 2
    scale = (8 * df + 1) / (8 * df + 3)
    return F.signum(t) * scale * F.sqrt(df * F.log1p(t * t / df))


def spearman_fieller_z(r: Column, n: Column) -> Column:
    """z of a rank correlation, sqrt((n - 3) / 1.06) atanh r."""
    return F.when(n > 3, F.sqrt((n - 3) / 1.06) * fisher_z(r))


def z_to_r(z: Column, n: Column) -> Column:
    return z / F.sqrt(n - 2 + z * z)


def z_to_beta(z: Column, maf: Column, n: Column) -> Column:
    return z / F.sqrt(2 * maf * (1 - maf) * (n + z * z))


def z_to_se(z: Column, maf: Column, n: Column) -> Column:
    return 1 / F.sqrt(2 * maf * (1 - maf) * (n + z * z))


def beta_to_z(beta: Column, se: Column, n: Column) -> Column:
    return beta / (se * F.sqrt(n))


def chi2_p_1df(x: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    return F.when(x >= 0, two_sided_normal_p(F.sqrt(x)))


def m_value(beta: Column) -> Column:
    """Methylation M of a beta strictly between 0 and 1."""
    return F.when((beta > 0) & (beta < 1), F.log2(beta / (1 - beta)))


def beta_value(m: Column) -> Column:
    return F.pow(F.lit(2.0), m) / (F.pow(F.lit(2.0), m) + 1)


def johnson_su_pdf(x: Column, mu: float, sigma: float, gamma: float, delta: float) -> Column:
    y = (x - mu) / sigma
    u = gamma + delta * F.asinh(y)
    return delta / (sigma * F.sqrt(F.lit(6.283185307179586) * (1 + y * y))) * F.exp(-u * u / 2)


def nearest(above: str, below: str, digits: int) -> Column:
    """above / below, expressions of whole decimals, rounded to digits from the exact quotient, halves away from zero; null where below is 0."""
    steps = F.expr(f"({2 * 10**digits} * abs({above}) + abs({below})) div nullif(2 * abs({below}), 0)")
    return steps * F.when(F.expr(f"({above}) < 0") != F.expr(f"({below}) < 0"), -1).otherwise(1) / 10.0**digits


def looked_up_p(z: Column) -> Column:
    """two_sided_normal_p as a table of 5,000 entries a unit gives it: z is held within 37.65, and the
    entry is the one at or under it."""
    held = F.greatest(F.lit(-37.65), F.least(F.lit(37.65), z))
    return two_sided_normal_p(F.floor((held + 37.65) * 5000) / 5000 - 37.65)


def rounded_r(r: Column) -> Column:
    """A correlation to three decimals, halves away from 0."""
    return F.floor(F.abs(r) * 1000 + 0.5) / 1000 * F.signum(r)


def binned_r(r: Column, bins: int) -> Column:
    """The middle of a correlation's bin, of so many between -1 and 1."""
    return (F.floor((r + 1) / 2 * bins) + 0.5) / bins * 2 - 1


#: The polynomial as SQL text with {z} for the value, for engines that have no such function.
NORMAL_P_SQL = (
    "greatest(2e-323, 2 * exp(-abs({z}) * abs({z}) / 2) * 0.3989422804014327 * (1 / (1 + 0.2316419 * abs({z}))) * (0.319381530 + (1 / (1 + 0.2316419 * abs({z}))) * (-0.356563782"
    " + (1 / (1 + 0.2316419 * abs({z}))) * (1.781477937 + (1 / (1 + 0.2316419 * abs({z}))) * (-1.821255978 + (1 / (1 + 0.2316419 * abs({z}))) * 1.330274429)))))"
)


def normal_p_sql(z: str) -> str:
    return NORMAL_P_SQL.replace("{z}", f"({z})")
