"""Matrices in long form (row, column, value), and array-row form for kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import settled


def transpose(cells: DataFrame, row: str, column: str, value: str) -> DataFrame:
    return cells.select(F.col(column).alias(row), F.col(row).alias(column), value)


def to_wide(cells: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    return cells.groupBy(row).pivot(column, columns).agg(F.first(value))


def to_long(wide: DataFrame, row: str, columns: list[str], column: str = "column", value: str = "value") -> DataFrame:
    return wide.unpivot([row], columns, column, value)


def to_arrays(cells: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """(row, values): one array a row, in order of column."""
    return cells.groupBy(row).agg(F.transform(F.sort_array(F.collect_list(F.struct(column, value))), lambda x: x[value]).alias("values"))


def common_rows(first: DataFrame, *others: DataFrame, row: str) -> DataFrame:
    """Cells of first whose row is in all others."""
    for o in others:
        first = first.join(o.select(row).distinct(), row, "left_semi")
    return first


def merge(first: DataFrame, second: DataFrame, on: list[str], value: str, how: str = "inner") -> DataFrame:
    """Cells of both, side by side; how inner for what they share, full for all."""
    return first.select(*on, F.col(value).alias(f"{value}_1")).join(second.select(*on, F.col(value).alias(f"{value}_2")), on, how)


def symmetric(pairs: DataFrame, a: str, b: str, value: str, diagonal: float | None = None) -> DataFrame:
    """Both directions of each pair; with diagonal, its cells too."""
    both = pairs.select(a, b, value).union(pairs.select(F.col(b), F.col(a), F.col(value)))
    if diagonal is not None:
        names = both.select(F.col(a)).distinct()
        both = both.union(names.select(a, F.col(a).alias(b), F.lit(diagonal).alias(value)))
    return both


def upper_pairs(cells: DataFrame, row: str, column: str, value: str, least: float | None = None) -> DataFrame:
    """Cells over the diagonal, those above least only if given."""
    up = cells.where(F.col(row) < F.col(column))
    return up if least is None else up.where(F.col(value) > least)


def indicator(members: DataFrame, item: str, group: str) -> DataFrame:
    """Distinct memberships as cells of value 1."""
    return members.select(item, group).distinct().withColumn("value", F.lit(1))


def collapse(values: DataFrame, mapping: DataFrame, item: str, group: str, by: list[str], value: str) -> DataFrame:
    """Mean value and number of items per group; items without a group go to "-"."""
    j = values.join(mapping.select(item, group), item, "left").withColumn(group, F.coalesce(F.col(group).cast("string"), F.lit("-")))
    return j.groupBy(group, *by).agg(F.avg(value).alias("mean"), F.count_distinct(item).alias("items"))


def per_million(counts: DataFrame, sample: str, value: str) -> DataFrame:
    """counts with reads per million of their sample's total."""
    total = counts.groupBy(sample).agg(F.sum(value).alias("__total"))
    return counts.join(total, sample).withColumn("per_million", F.when(F.col("__total") > 0, 1e6 * F.col(value) / F.col("__total"))).drop("__total")


def _moments(rows: DataFrame, values: str) -> DataFrame:
    """(i, j, s): sums of products of columns i and j of array rows; j -1: sums of column i; i -1: the number of rows."""

    def partial(batches):
        total, outer, n = None, None, 0
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["v"].to_numpy()).astype(float)
            if total is None:
                total, outer = np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1]))
            total += x.sum(axis=0)
            outer += x.T @ x
            n += len(x)
        if n:
            k = len(total)
            i = np.repeat(np.arange(k), k)
            yield pd.DataFrame({"i": np.concatenate([i, np.arange(k), [-1]]), "j": np.concatenate([np.tile(np.arange(k), k), np.full(k, -1), [-1]]), "s": np.concatenate([outer.ravel(), total, [n]])})

    return rows.where(F.col(values).isNotNull()).select(F.col(values).cast("array<double>").alias("v")).mapInPandas(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))


def covariances(rows: DataFrame, values: str) -> DataFrame:
    """(i, j, covariance) of all columns of array rows, numbered from 1, from partial sums of each task; nothing
    comes to the driver."""
    m = settled(_moments(rows, values))
    n = m.where("i = -1").select(F.col("s").alias("n"))  # one row
    mean = m.where("i >= 0 and j = -1").join(F.broadcast(n)).select(F.col("i"), (F.col("s") / F.col("n")).alias("m"), "n")
    both = m.where("i >= 0 and j >= 0").join(mean, "i").join(mean.select(F.col("i").alias("j"), F.col("m").alias("m2")), "j")
    return both.where("n > 1").select((F.col("i") + 1).cast("long").alias("i"), (F.col("j") + 1).cast("long").alias("j"), ((F.col("s") - F.col("n") * F.col("m") * F.col("m2")) / (F.col("n") - 1)).alias("covariance"))


def gram(rows: DataFrame, values: str, centre: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """(means, covariance, n) of array rows, from partial sums of each task.

    What comes to the driver is columns squared, never rows; for matrices whose number
    of columns is bounded (samples, cohorts)."""
    got = _moments(rows, values).toPandas()
    if got.empty:
        return np.zeros(0), np.zeros((0, 0)), 0
    k = int(got["i"].max()) + 1
    n = int(got.loc[(got.i < 0), "s"].iloc[0])
    means = np.zeros(k)
    m = got[(got.i >= 0) & (got.j < 0)]
    means[m.i] = m.s / n
    cov = np.zeros((k, k))
    c = got[got.j >= 0]
    cov[c.i, c.j] = c.s
    return means, (cov - n * np.outer(means, means)) / max(1, n - 1) if centre else cov, n


def principal_components(rows: DataFrame, values: str, k: int, scale: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, eigenvalues, vectors as columns) of the leading k components; the largest part
    of a vector is positive."""
    means, cov, _ = gram(rows, values)
    scales = np.sqrt(np.maximum(np.diag(cov), 1e-300)) if scale else np.ones(len(means))
    w, v = np.linalg.eigh(cov / scales[:, None] / scales[None, :])
    order = np.argsort(-w)[:k]
    v = v[:, order]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return means, scales, w[order], v


def project(rows: DataFrame, values: str, means: np.ndarray, scales: np.ndarray, vectors: np.ndarray, out: str = "scores") -> DataFrame:
    """rows with their scores on components."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        x = (np.stack(v.to_numpy()).astype(float) - means) / scales
        return pd.Series(list(x @ vectors))

    return rows.withColumn(out, run(values))


def remove_components(rows: DataFrame, values: str, means: np.ndarray, vectors: np.ndarray, out: str = "residual") -> DataFrame:
    """rows with what is left of their centred values without the given components."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(float) - means
        return pd.Series(list(x - (x @ vectors) @ vectors.T))

    return rows.withColumn(out, run(values))


def regress_out(rows: DataFrame, values: str, covariates: np.ndarray, most_vif: float = 1e4, out: str = "residual") -> DataFrame:
    """rows (arrays over samples) with residuals of least squares on covariates (samples by columns)
    and an intercept; covariates that others explain (VIF over most_vif) are left out, last first."""
    keep: list[int] = []
    for j in range(covariates.shape[1]):
        x = covariates[:, j] - covariates[:, j].mean()
        if keep:
            a = covariates[:, keep] - covariates[:, keep].mean(axis=0)
            rest = x - a @ np.linalg.lstsq(a, x, rcond=None)[0]
        else:
            rest = x
        if (x @ x) > 0 and (rest @ rest) > (x @ x) / most_vif:
            keep.append(j)
    q, _ = np.linalg.qr(np.column_stack([np.ones(len(covariates)), covariates[:, keep]]))

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(float)
        return pd.Series(list(x - (x @ q) @ q.T))

    return rows.withColumn(out, run(values))


def principal_coordinates(distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, coordinates) of a square distance matrix of bounded size, doubly centred."""
    n = len(distance)
    j = np.eye(n) - 1 / n
    w, v = np.linalg.eigh(-0.5 * j @ (distance**2) @ j)
    order = np.argsort(-w)[:k]
    v = v[:, order] * np.sign(v[np.abs(v[:, order]).argmax(axis=0), order])
    return w[order], v * np.sqrt(np.maximum(w[order], 0))


def same(first: DataFrame, second: DataFrame) -> bool:
    """Whether two datasets hold the same rows, as often."""
    cols = sorted(first.columns)
    if cols != sorted(second.columns):
        return False
    a, b = first.select(*cols), second.select(*cols)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
