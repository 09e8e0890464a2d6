"""Elastic-net models of a share (a cell type's proportion) on many features, with penalties chosen over folds.

Tasks sum products of the columns by repetition and fold; Spark adds the sums up, and rows are not read again: a
training set's sums are all sums less its fold's, and the error on a fold follows from the fold's own sums. Each repetition is then one
group of folds times columns squared, which the number of features bounds, worked on in a task of its own: coordinate descent on
correlations, for all mixes of penalties and all training sets at once, along a path of falling penalties."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import settled

#: Shares of the absolute penalty in the whole that are tried.
MIXES = (0.01, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2)


def fold_sums(rows: DataFrame, key: str, x: str, y: str, folds: int, repetitions: int, seed: int) -> DataFrame:
    """(repetition, fold, i, j, s): sums of products of columns i <= j over each fold's rows; column 0 is one, 1 is y, then the features.

    Rows with a null in x, y or the key are left out. A row's fold in a repetition is a hash of the seed, the repetition and its key."""
    fold = F.array(*(F.pmod(F.xxhash64(F.lit(seed), F.lit(r), F.col(key)), F.lit(folds)).cast("int") for r in range(repetitions)))
    v = rows.where(F.col(y).isNotNull() & F.col(key).isNotNull() & F.forall(x, lambda c: c.isNotNull()))
    v = v.select(fold.alias("f"), F.concat(F.array(F.lit(1.0), F.col(y).cast("double")), F.col(x).cast("array<double>")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            f = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
            m = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            if total is None:
                total = np.zeros((repetitions, folds, m.shape[1], m.shape[1]))
            for r in range(repetitions):
                for k in range(folds):
                    own = m[f[:, r] == k]
                    total[r, k] += own.T @ own
        if total is not None:
            i, j = np.triu_indices(total.shape[2])
            for r in range(repetitions):
                for k in range(folds):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), c, np.int32)) for c in (r, k)] + [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[r, k][i, j])], names=["repetition", "fold", "i", "j", "s"])

    return v.mapInArrow(run, "repetition int, fold int, i int, j int, s double").groupBy("repetition", "fold", "i", "j").agg(F.sum("s").alias("s"))


def descend(gram: np.ndarray, xy: np.ndarray, mix: np.ndarray, penalties: np.ndarray, within: float = 1e-9, sweeps: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients (penalties, problems, features), settled (problems)) of problems side by side: gram (problems, features, features) and xy
    (problems, features) are means of products of scaled columns, mix each one's share of the absolute penalty, penalties (steps, problems) falling.

    Each coefficient in turn goes to its own minimum; sweeps go over all, then over those that are not 0 until these rest."""
    n, p = xy.shape
    beta, rest = np.zeros((n, p)), xy.copy()  # rest: xy less gram times beta
    diagonal = np.einsum("nii->ni", gram)
    out, ok = np.zeros((len(penalties), n, p)), np.ones(n, bool)

    def sweep(columns: np.ndarray, soft: np.ndarray, hard: np.ndarray) -> np.ndarray:
        moved = np.zeros(n)
        for j in columns:
            z = rest[:, j] + diagonal[:, j] * beta[:, j]
            new = np.sign(z) * np.maximum(np.abs(z) - soft, 0) / (diagonal[:, j] + hard)
            step = new - beta[:, j]
            if step.any():
                np.subtract(rest, gram[:, :, j] * step[:, None], out=rest)
                beta[:, j] = new
                np.maximum(moved, np.abs(step), out=moved)
        return moved

    every = np.arange(p)
    for t, penalty in enumerate(penalties):
        soft, hard = penalty * mix, penalty * (1 - mix)
        for _ in range(sweeps):
            moved = sweep(every, soft, hard)
            if moved.max(initial=0) < within:
                break
            active = np.flatnonzero(beta.any(axis=0))
            for _ in range(sweeps):
                if sweep(active, soft, hard).max(initial=0) < within:
                    break
        ok &= moved < within
        out[t] = beta
    return out, ok


def _moments(total: np.ndarray) -> tuple[np.ndarray, ...]:
    """(n, means, deviations, correlation-scaled gram, xy) of sums (..., columns, columns); a constant column has deviation 1 and products 0."""
    n = total[..., 0, 0]
    mean = total[..., 0, 1:] / n[..., None]
    cov = total[..., 1:, 1:] / n[..., None, None] - mean[..., :, None] * mean[..., None, :]
    var = np.einsum("...ii->...i", cov)
    flat = var <= 1e-12 * (1 + mean**2)
    sd = np.where(flat, 1.0, np.sqrt(np.maximum(var, 1e-300)))
    cov = np.where(flat[..., :, None] | flat[..., None, :], 0.0, cov / sd[..., :, None] / sd[..., None, :])
    return n, mean, sd, cov[..., 1:, 1:], cov[..., 1:, 0]


def fit_path(total: np.ndarray, mixes: tuple[float, ...], steps: int) -> dict:
    """The model of one repetition from its folds' sums (folds, columns, columns).

    For each mix the penalty is the largest whose mean error over folds is within one standard error of the least; of the mixes the one with the
    least error there. Penalties fall in even ratios from the one that leaves no feature."""
    whole = total.sum(axis=0)
    train = np.concatenate([whole[None], whole[None] - total])
    n, mean, sd, gram, xy = _moments(train)
    few = n[0] < gram.shape[1]
    a = np.array(mixes)
    top = np.abs(xy[0]).max(initial=0) / np.maximum(a, 1e-3)
    path = top * np.logspace(0, np.log10(0.01 if few else 1e-4), steps)[:, None]  # (steps, mixes), scaled by the deviation of y
    k = len(train)
    beta, ok = descend(np.repeat(gram, len(a), axis=0), np.repeat(xy, len(a), axis=0), np.tile(a, k), np.tile(path, (1, k)) * np.repeat(sd[0, 0] / sd[:, 0], len(a)))
    beta = beta.reshape(steps, k, len(a), -1) * (sd[:, None, :1] / sd[:, None, 1:])  # in the features' own units
    base = mean[:, None, 0] - (beta * mean[:, None, 1:]).sum(axis=-1)
    # a fold's sum of squares of y - base - x beta, from its own sums
    own = np.concatenate([-base[:, 1:, :, None], np.ones_like(base[:, 1:, :, None]), -beta[:, 1:]], axis=-1)
    size = total[:, 0, 0]
    error = np.einsum("tfai,fij,tfaj->tfa", own, total, own, optimize=True) / np.maximum(size, 1)[None, :, None]
    w = size / size.sum()
    cvm = (error * w[None, :, None]).sum(axis=1)
    cvsd = np.sqrt(((error - cvm[:, None]) ** 2 * w[None, :, None]).sum(axis=1) / max(1, len(total) - 1))
    least = cvm.argmin(axis=0)
    bound = cvm[least, range(len(a))] + cvsd[least, range(len(a))]
    chosen = (cvm <= bound).argmax(axis=0)
    best = int(cvm[chosen, range(len(a))].argmin())
    t = int(chosen[best])
    return {"mix": float(a[best]), "penalty": float(path[t, best] * sd[0, 0]), "error": float(cvm[t, best]), "base": float(base[t, 0, best]), "beta": beta[t, 0, best], "settled": bool(ok.all())}


def elastic_net(rows: DataFrame, key: str, x: str, y: str, folds: int = 10, repetitions: int = 10, mixes: tuple[float, ...] = MIXES, steps: int = 100, seed: int = 1) -> DataFrame:
    """(repetition, feature, coefficient, mix, penalty, error, settled): the model of y on the features of array x that each repetition's folds
    choose; feature 0 is the intercept, the others count from 1, zeros included. Coefficients are in the features' units; both penalties act on
    scaled features and y, and are given in units of y. A repetition with an empty fold, or rows too few for its folds, has no model."""
    sums = fold_sums(rows, key, x, y, folds, repetitions, seed)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = int(pdf.j.max()) + 1
        total = np.zeros((folds, p, p))
        total[pdf.fold, pdf.i, pdf.j] = pdf.s
        total[pdf.fold, pdf.j, pdf.i] = pdf.s
        r = int(pdf.repetition.iloc[0])
        if (total[:, 0, 0] < 1).any() or total[:, 0, 0].sum() < folds + 2 or p < 3:
            return pd.DataFrame({c: [] for c in ("repetition", "feature", "coefficient", "mix", "penalty", "error", "settled")})
        m = fit_path(total, mixes, steps)
        return pd.DataFrame({"repetition": r, "feature": np.arange(p - 1), "coefficient": np.concatenate([[m["base"]], m["beta"]]), "mix": m["mix"], "penalty": m["penalty"], "error": m["error"], "settled": m["settled"]})

    return sums.groupBy("repetition").applyInPandas(run, "repetition int, feature int, coefficient double, mix double, penalty double, error double, settled boolean")


def marker_features(models: DataFrame, share: float = 0.7) -> DataFrame:
    """(feature, models, mean): features that at least this share of the models use, with their mean coefficient there."""
    used = models.where("feature > 0 and coefficient != 0").groupBy("feature").agg(F.count("*").alias("models"), F.avg("coefficient").alias("mean"))
    n = models.agg(F.count_distinct("repetition").alias("__n"))  # one row
    return used.join(F.broadcast(n), F.col("models") >= F.ceil(F.col("__n") * share)).drop("__n")


def predicted(rows: DataFrame, x: str, models: DataFrame, out: str = "predicted", how: str = "median") -> DataFrame:
    """rows with the median (or mean) of what the models say of them; null where x has a null. Models are features times repetitions, and go to
    all tasks."""
    m = settled(models.select("repetition", "feature", "coefficient")).toPandas()
    if m.empty:
        return rows.withColumn(out, F.lit(None).cast("double"))
    wide = m.pivot(index="feature", columns="repetition", values="coefficient").to_numpy()

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        mid = np.median if how == "median" else np.mean
        have = v.notna()
        got = np.full(len(v), np.nan)
        if have.any():
            got[have] = mid(np.stack(v[have].to_numpy()).astype(float) @ wide[1:] + wide[0], axis=1)
        return pd.Series(got).astype(object).where(~np.isnan(got), None)

    whole = F.when(F.forall(x, lambda c: c.isNotNull()), F.col(x).cast("array<double>"))
    return rows.withColumn(out, run(whole))
