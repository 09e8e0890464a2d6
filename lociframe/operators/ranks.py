"""Ranks and rank-based transforms over groups in long form.

A group is one window partition. For one group of all rows use the global variants,
which count by value first and so sort distinct values only, in ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from .aggregates import pearson
from .ordered import dealt


def average_rank(by: list[str], value: str) -> Column:
    """Rank from 1; ties share the mean of their ranks. Rows with null values rank among themselves
    last; leave them out first."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def ranked(values: DataFrame, by: list[str], value: str, out: str = "rank", ties: str = "average", tie_breaker: str | None = None) -> DataFrame:
    """values with the rank of each; ties: average, sequential (by tie_breaker)."""
    v = dealt(values.where(F.col(value).isNotNull()), by)
    if ties == "average":
        return v.withColumn(out, average_rank(by, value))
    return v.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(value, *([tie_breaker] if tie_breaker else []))))


def inverse_normal(values: DataFrame, by: list[str], value: str, out: str = "normal") -> DataFrame:
    """The normal quantile of (rank - 1/2) / n."""
    n = F.count("*").over(Window.partitionBy(*by))
    return ranked(values, by, value, "__r").withColumn(out, stats.probit((F.col("__r") - 0.5) / n)).drop("__r")


def spearman(values: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """n and rho: Pearson's correlation of average ranks."""
    v = dealt(values.where(F.col(x).isNotNull() & F.col(y).isNotNull()), by).withColumn("__x", average_rank(by, x)).withColumn("__y", average_rank(by, y))
    return v.groupBy(*by).agg(F.count("*").alias("n"), pearson(F.col("__x"), F.col("__y")).alias("rho"))


def mann_whitney(values: DataFrame, by: list[str], value: str, group: Column) -> DataFrame:
    """n1, n2, u1, z, p and auc of the rows where group holds against the others; average ranks, no
    correction for ties or continuity."""
    v = ranked(values.where(group.isNotNull()), by, value, "__r")
    s = v.groupBy(*by).agg(F.count_if(group).alias("n1"), F.count_if(~group).alias("n2"), F.sum(F.when(group, F.col("__r"))).alias("r1")).where("n1 > 0 and n2 > 0")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    z = (u1 - n1 * n2 / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    return s.select(*by, "n1", "n2", u1.alias("u1"), z.alias("z"), stats.two_sided_normal_p(z).alias("p"), (u1 / (n1 * n2)).alias("auc"))


def quantile_normalise(values: DataFrame, sample: str, value: str, out: str = "normalised") -> DataFrame:
    """Values of each sample replaced by the mean, over samples, of the values of their rank; a
    rank halfway between two takes the mean of both. Samples should have equally many values."""
    v = values.where(F.col(value).isNotNull())
    w = Window.partitionBy(sample).orderBy(value)
    means = v.select(F.row_number().over(w).alias("place"), value).groupBy("place").agg(F.avg(value).alias("mean"))
    r = v.withColumn("__r", average_rank([sample], value)).withColumn("__lo", F.floor("__r").cast("int")).withColumn("__hi", F.ceil("__r").cast("int"))
    lo, hi = means.select(F.col("place").alias("__lo"), F.col("mean").alias("__mlo")), means.select(F.col("place").alias("__hi"), F.col("mean").alias("__mhi"))
    return r.join(lo, "__lo").join(hi, "__hi").withColumn(out, (F.col("__mlo") + F.col("__mhi")) / 2).select(*values.columns, out)


def centre_scale(values: DataFrame, by: list[str], value: str, scale: bool = True, out: str = "scaled") -> DataFrame:
    """Values less their group's mean, over its sample standard deviation if scale (null if that is 0)."""
    w = Window.partitionBy(*by)
    centred = F.col(value) - F.avg(value).over(w)
    sd = F.stddev_samp(value).over(w)
    return values.withColumn(out, F.when(sd > 0, centred / sd) if scale else centred)


def log2_shifted(values: DataFrame, value: str, out: str = "log2") -> DataFrame:
    """log2(x + 1), or log2(x - least + 1) if the least of all values is 0 or less."""
    least = values.agg(F.min(value).alias("__least"))
    shift = F.when(F.col("__least") <= 0, -F.col("__least")).otherwise(0.0)
    return values.join(F.broadcast(least)).withColumn(out, F.log2(F.col(value) + shift + 1)).drop("__least")  # one row


def cumulative_share(values: DataFrame, by: list[str], order: list[str | Column], value: str) -> DataFrame:
    """values with the running total and its percentage of the group's total."""
    w = Window.partitionBy(*by)
    run = F.sum(value).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return values.withColumn("running", run).withColumn("percent", 100 * F.col("running") / F.sum(value).over(w))
