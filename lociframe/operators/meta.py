"""Meta-analysis over datasets and the comparison of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import special, stats


def weighted_z(effects: DataFrame, by: list[str], z: str, n: str, weight: str = "sqrt", least: int = 1, flip: str | None = None) -> DataFrame:
    """z, n and datasets: sum of w z over the root of the sum of w squared, w the root of n or n
    itself. Null z are left out; flip is a column of 1, -1 or null (left out)."""
    v = F.col(z) * (F.col(flip) if flip else 1)
    w = F.when(v.isNotNull(), F.sqrt(F.col(n).cast("double")) if weight == "sqrt" else F.col(n).cast("double"))
    s = effects.groupBy(*by).agg(F.count(v).alias("datasets"), F.sum(F.when(v.isNotNull(), F.col(n))).alias("n"), F.sum(w * v).alias("__wz"), F.sum(w * w).alias("__ww"))
    s = s.where((F.col("datasets") >= least) & (F.col("__ww") > 0)).withColumn("z", F.col("__wz") / F.sqrt("__ww"))
    return s.select(*by, "datasets", "n", "z", stats.two_sided_normal_p(F.col("z")).alias("p"))


def heterogeneity(effects: DataFrame, by: list[str], z: str, n: str, exact_p: bool = False) -> DataFrame:
    """Cochran's Q of z around what the joint effect expects of each dataset's n, and I2."""
    v = effects.where(F.col(z).isNotNull() & (F.col(n) > 0))
    r = F.sqrt(F.col(n).cast("double"))
    # sum (z - r E)^2 with E = sum r z / sum n: sum z^2 - (sum r z)^2 / sum n
    s = v.groupBy(*by).agg(F.count("*").alias("k"), F.sum(F.col(z) * F.col(z)).alias("zz"), F.sum(r * F.col(z)).alias("rz"), F.sum(F.col(n).cast("double")).alias("nn"))
    q = F.greatest(F.lit(0.0), F.col("zz") - F.col("rz") ** 2 / F.col("nn"))
    out = s.select(*by, "k", q.alias("q"), F.when((F.col("k") > 1) & (q > 0), F.greatest(F.lit(0.0), (q - (F.col("k") - 1)) / q)).otherwise(0.0).alias("i2"))
    return out.withColumn("q_p", F.when(F.col("k") > 1, special.chi2_upper_p(F.col("q"), F.col("k") - 1))) if exact_p else out


def fixed_effect_correlation(effects: DataFrame, by: list[str], r: str, n: str) -> DataFrame:
    """Joint Fisher z of correlations with weights n - 3, Q, tau2 and I2."""
    v = effects.where((F.abs(F.col(r)) < 1) & (F.col(n) > 3)).withColumn("__z", stats.fisher_z(F.col(r))).withColumn("__w", (F.col(n) - 3).cast("double"))
    s = v.groupBy(*by).agg(F.count("*").alias("k"), F.sum("__w").alias("w"), F.sum(F.col("__w") * F.col("__z")).alias("wz"), F.sum(F.col("__w") * F.col("__z") ** 2).alias("wzz"), F.sum(F.col("__w") ** 2).alias("ww"))
    q = F.greatest(F.lit(0.0), F.col("wzz") - F.col("wz") ** 2 / F.col("w"))
    df = F.col("k") - 1
    c = F.col("w") - F.col("ww") / F.col("w")
    return s.select(*by, "k", (F.col("wz") / F.col("w")).alias("fisher_z"), F.tanh(F.col("wz") / F.col("w")).alias("r"), q.alias("q"), F.when(c > 0, F.greatest(F.lit(0.0), (q - df) / c)).otherwise(0.0).alias("tau2"), F.when(q > 0, F.greatest(F.lit(0.0), (q - df) / q)).otherwise(0.0).alias("i2"))


def signed_binomial_z(p: Column, share: Column) -> Column:
    """z of a two-sided p with the sign of share over one half."""
    return F.signum(share - 0.5) * stats.p_to_z_two_sided(F.greatest(p, F.lit(1e-300)))


def compare(first: DataFrame, second: DataFrame, on: list[str], z: str) -> DataFrame:
    """Both results side by side, whether each has the key, and whether directions agree."""
    a = first.select(*on, F.col(z).alias("z1"), F.lit(True).alias("__a"))
    b = second.select(*on, F.col(z).alias("z2"), F.lit(True).alias("__b"))
    j = a.join(b, on, "full")
    where = F.when(F.col("__a") & F.col("__b"), "both").when(F.col("__a"), "first").otherwise("second")
    return j.select(*on, "z1", "z2", where.alias("found"), F.when(F.col("__a") & F.col("__b"), F.signum("z1") == F.signum("z2")).alias("same_direction"))


def replication(reference: DataFrame, other: DataFrame, on: list[str], z: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Reference results with the other's z and p, and whether they replicate: same direction and p
    up to alpha over the number of shared results."""
    o = other.select(*on, F.col(z).alias("other_z"), F.col(p).alias("other_p"))
    j = reference.join(o, on, "left")
    n = j.where("other_p is not null").count()
    return j.withColumn("replicated", F.coalesce((F.signum(z) == F.signum("other_z")) & (F.col("other_p") <= alpha / max(1, n)), F.lit(False)))


def leave_one_out(effects: DataFrame, by: list[str], dataset: str, z: str, n: str) -> DataFrame:
    """weighted_z without each dataset in turn, from group sums less each row's part."""
    w = Window.partitionBy(*by)
    r = F.sqrt(F.col(n).cast("double"))
    v = effects.where(F.col(z).isNotNull())
    rest_n = F.sum(n).over(w) - F.col(n)
    rest = F.sum(r * F.col(z)).over(w) - r * F.col(z)
    return v.select(*by, dataset, F.when(rest_n > 0, rest / F.sqrt(rest_n.cast("double"))).alias("z_without"))


def z_matrix(effects: DataFrame, row: list[str], dataset: str, z: str, datasets: list) -> DataFrame:
    """One column of z per dataset."""
    return effects.groupBy(*row).pivot(dataset, datasets).agg(F.first(z))
