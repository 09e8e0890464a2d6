"""Multiple testing: Benjamini-Hochberg, Bonferroni, Holm, Storey, permutation FDR and its levels.

Global orders run through blocks (ordered.py), never through one task. p ties are broken by an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import block_cuts, blocked, running_min_from_end, running_sums, settled


def benjamini_hochberg(tests: DataFrame, p: str, tie: str, out: str = "q") -> DataFrame:
    """tests (null p left out) with min(1, least of p n / rank over this and larger p).

    Equal p share the least, that of the last of them, so only distinct p with their numbers are put in order,
    in one set of blocks. tie is not needed for the result. Tests are written before they meet their p again: sums that are
    computed a second time may differ in their last digit."""
    return _step_up(settled(tests.where(F.col(p).isNotNull())), p, out)


def _step_up(t: DataFrame, p: str, out: str) -> DataFrame:
    """benjamini_hochberg of tests that are written and have p."""
    c = settled(t.groupBy(F.col(p).alias("__p")).agg(F.count("*").alias("__k")))
    n = c.agg(F.sum("__k")).first()[0] or 0
    cuts = block_cuts(c, "__p")
    c = running_sums(blocked(c, "__p", cuts), "__p", ["__p"], {"__upto": F.col("__k")}, cuts=cuts)
    c = running_min_from_end(c, "__p", ["__p"], F.col("__p") * n / F.col("__upto"), out, cuts)
    return t.join(c.select("__p", F.least(F.lit(1.0), out).alias(out)), F.col(p) == F.col("__p")).drop("__p")


def benjamini_hochberg_by(tests: DataFrame, by: list[str], p: str, tie: str, out: str = "q") -> DataFrame:
    """The same inside each group, as plain windows."""
    w = Window.partitionBy(*by)
    t = tests.where(F.col(p).isNotNull()).withColumn("__r", F.row_number().over(w.orderBy(p, tie)))
    least = F.min(F.col(p) * F.col("__n") / F.col("__r")).over(w.orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0))  # from the end
    return t.withColumn("__n", F.count("*").over(w)).withColumn(out, F.least(F.lit(1.0), least)).drop("__r", "__n")


def bonferroni(tests: DataFrame, p: str, out: str = "adjusted") -> DataFrame:
    n = tests.where(F.col(p).isNotNull()).count()
    return tests.withColumn(out, F.least(F.lit(1.0), F.col(p) * n))


def holm(tests: DataFrame, p: str, tie: str, alpha: float = 0.05, out: str = "rejected") -> DataFrame:
    """tests with whether Holm's step-down rejects: all up to the first p over alpha / (n - rank + 1), in order of p and tie. Only distinct
    p with their numbers are put in order: of equal p the first rank fails first, and the rest of them after it. Tests are written before
    they meet the first p again, as in benjamini_hochberg."""
    t = settled(tests.where(F.col(p).isNotNull()))
    c = settled(t.groupBy(F.col(p).alias("__p")).agg(F.count("*").alias("__k")))
    n = c.agg(F.sum("__k")).first()[0] or 0
    c = running_sums(c, "__p", ["__p"], {"__upto": F.col("__k")})
    # at p, ranks from upto - k + 1 to upto: the bound alpha / (n - rank + 1) is least for the first
    fails = c.where(F.col("__p") > alpha / (n - (F.col("__upto") - F.col("__k") + 1) + 1)).agg(F.min("__p").alias("__first"))  # one row
    return t.join(F.broadcast(fails), how="left").withColumn(out, F.col("__first").isNull() | (F.col(p) < F.col("__first"))).drop("__first")


def storey_pi0(tests: DataFrame, p: str, lam: float = 0.5) -> DataFrame:
    """One row with n and pi0, the estimated share of true nulls, at most 1."""
    return tests.where(F.col(p).isNotNull()).agg(F.count("*").alias("n"), F.least(F.lit(1.0), F.count_if(F.col(p) > lam) / (F.count("*") * (1 - lam))).alias("pi0"))


def storey_q(tests: DataFrame, p: str, tie: str, lam: float = 0.5, out: str = "q") -> DataFrame:
    """benjamini_hochberg times pi0, both from one reading of the tests, written first as there."""
    t = settled(tests.where(F.col(p).isNotNull()))
    pi0 = storey_pi0(t, p, lam).first()["pi0"]
    q = _step_up(t, p, out)
    return q.withColumn(out, F.col(out) * F.lit(1.0 if pi0 is None else pi0))


def strongest(tests: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """One row per group, the first in order: the level of an FDR, or the top association."""
    w = Window.partitionBy(*by).orderBy(*order)
    return tests.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def permutation_fdr(real: DataFrame, permuted: DataFrame, p: str, permutations: int) -> DataFrame:
    """(p, n_real, n_permuted, fdr) of each distinct real p: permuted results up to p over the number
    of permutations, over real results up to p, at most 1. Equal p share a value. Not monotonised.

    Both sides are counted by p before they are put in order."""
    a = real.where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("nr"), F.lit(0).cast("long").alias("np"))
    b = permuted.where(F.col(p).isNotNull()).groupBy(p).agg(F.lit(0).cast("long").alias("nr"), F.count("*").alias("np"))
    c = a.unionByName(b).groupBy(p).agg(F.sum("nr").alias("nr"), F.sum("np").alias("np"))
    c = settled(c)
    r = running_sums(c, p, [p], {"n_real": F.col("nr"), "n_permuted": F.col("np")}).where("nr > 0")
    return r.select(p, "n_real", "n_permuted", F.least(F.lit(1.0), F.col("n_permuted") / permutations / F.col("n_real")).alias("fdr"))


def fdr_at_level(real: DataFrame, permuted: DataFrame, level: list[str], perm: str, p: str, tie: str, permutations: int) -> DataFrame:
    """permutation_fdr over the strongest result of each key, of each permutation."""
    return permutation_fdr(strongest(real, level, [p, tie]), strongest(permuted, [*level, perm], [p, tie]), p, permutations)


def apply_thresholds(tests: DataFrame, thresholds: DataFrame, p: str, fdr: str = "fdr") -> DataFrame:
    """tests with the fdr of the largest threshold p up to their own, from another result.

    Thresholds are few distinct rows; both are put in order in blocks and carried on."""
    t = thresholds.groupBy(F.col(p).alias("__p")).agg(F.max(fdr).alias("__f"))
    both = tests.withColumn("__p", F.col(p)).withColumn("__f", F.lit(None).cast("double")).withColumn("__side", F.lit(1)).withColumn("__row", F.struct(*tests.columns)).select("__p", "__f", "__side", "__row")
    both = both.unionByName(t.select("__p", "__f", F.lit(0).alias("__side"), F.lit(None).cast(both.schema["__row"].dataType).alias("__row")))
    b = blocked(both, "__p")
    last = b.where("__side = 0").groupBy("__block").agg(F.max_by("__f", "__p").alias("__f"))
    every = b.select("__block").distinct().join(last, "__block", "left")
    carry = every.select("__block", F.last("__f", ignorenulls=True).over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"))
    w = Window.partitionBy("__block").orderBy("__p", "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = b.join(F.broadcast(carry), "__block").withColumn("__g", F.coalesce(F.last("__f", ignorenulls=True).over(w), "__carry"))
    return out.where("__side = 1").select("__row.*", F.col("__g").alias(fdr))


def qq(tests: DataFrame, p: str, tie: str) -> DataFrame:
    """expected and observed -log10 p, from ranks over n + 1."""
    t = settled(tests.where(F.col(p) > 0))
    n = t.count()
    r = running_sums(t, p, [p, tie], {"__rank": F.lit(1)})
    return r.select(tie, (-F.log10(F.col("__rank") / (n + 1))).alias("expected"), (-F.log10(p)).alias("observed"))


def lambda_gc(tests: DataFrame, by: list[str], z: str) -> DataFrame:
    """Genomic inflation: the median of z squared over 0.4549364 (that of chi-square, one df)."""
    return tests.groupBy(*by).agg((F.median(F.col(z) * F.col(z)) / 0.4549364).alias("lambda"))
