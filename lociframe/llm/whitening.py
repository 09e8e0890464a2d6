"""Whitening of embeddings by spectrum slicing.

Every remaining entry c becomes the whole number floor(64 * c) + 1000000. Tasks sum numbers, then products of numbers less the
nearest whole mean, both exactly; Spark adds the tasks' sums up, and what comes to the driver is dimensions squared. There
LDL' factorisations of the shifted covariance count how many eigenvalues lie over a shift (inertia),
bisection narrows shifts until each leading eigenvalue is alone between two, and Rayleigh quotient iteration, which converges
cubically, finds it. A result that leaves its two shifts is cast away and these are narrowed,
so the counts at both certify each component's number. Eigenvalues that no shift parts within CLUSTER of the largest are one
cluster, whose vectors come from a common subspace.

Defined results: rows whose vector is null, empty, or holds a null or non-finite entry, and rows of another length than most
(of lengths as frequent, the longest) are left out of the fit and the result. Null and repeated ids are rows like others. An
empty table gives no rows. Components with an eigenvalue of 0, to rounding, have no direction: whitened is null, and
they are not in the identity error. Entries beyond 2 ** 52 / 64 count as that. Deviations are exact; one over 38 digits is null,
and in the query one over 63 bits is. Only the columns named are read."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

SHIFT = 1_000_000
COMPONENTS = 32
#: Eigenvalues this near, relative to the norm, are one cluster.
CLUSTER = 1e-11
#: Rows of a batch that are multiplied at once.
ROWS = 4096


# --- spectrum slicing ------------------------------------------------------------------------


def negative_pivots(a: np.ndarray, shift: float) -> int:
    """Negative eigenvalues of a - shift: the negative pivots of its LDL' factors, with pivots of one or two rows
    chosen so that the factors stay small (Bunch and Kaufman)."""
    m = a - shift * np.eye(len(a))
    n, k, count = len(m), 0, 0
    alpha = (1 + 17**0.5) / 8
    while k < n:
        below = np.abs(m[k + 1 :, k])
        most = below.max(initial=0.0)
        two = False
        if abs(m[k, k]) < alpha * most:
            r = k + 1 + int(below.argmax())
            row = np.abs(m[r, k:])
            row[r - k] = 0
            sigma = row.max()
            if abs(m[k, k]) * sigma < alpha * most * most:
                two = abs(m[r, r]) < alpha * sigma
                at = k + two
                if at != r:
                    m[[at, r], k:] = m[[r, at], k:]
                    m[k:, [at, r]] = m[k:, [r, at]]
        if two:  # such a block has one eigenvalue of each sign
            count += 1
            c = m[k + 2 :, k : k + 2]
            step = c @ np.linalg.solve(m[k : k + 2, k : k + 2], c.T)
            m[k + 2 :, k + 2 :] -= (step + step.T) / 2  # symmetric to the last bit, so rows and columns choose the same pivots
            k += 2
        else:
            d = m[k, k]
            if d != 0:
                count += d < 0
                c = m[k + 1 :, k]
                m[k + 1 :, k + 1 :] -= np.outer(c, c) / d
            k += 1
    return int(count)


def _solve(a: np.ndarray, shift: float, x: np.ndarray, norm: float) -> np.ndarray:
    for nudge in (0.0, 1e-15, 1e-14):
        try:
            y = np.linalg.solve(a - (shift + nudge * norm) * np.eye(len(a)), x)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(y).all():
            return y
    return x


def _alone(a: np.ndarray, low: float, high: float, norm: float) -> tuple[float, np.ndarray] | None:
    """The one eigenpair between low and high by Rayleigh quotient iteration from the middle; None where it strays."""
    x = np.random.default_rng(len(a)).standard_normal(len(a))
    for _ in range(2):
        x = _solve(a, (low + high) / 2, x / np.linalg.norm(x), norm)
    x /= np.linalg.norm(x)
    best = None
    for _ in range(12):
        rho = float(x @ a @ x)
        rest = float(np.linalg.norm(a @ x - rho * x))
        if best is not None and rest >= best[0]:
            break
        best = (rest, rho, x)
        x = _solve(a, rho, x, norm)
        x /= np.linalg.norm(x)
    rest, rho, x = best
    return (rho, x) if low < rho < high and rest <= 1e-11 * norm else None


def _cluster(a: np.ndarray, low: float, high: float, size: int, norm: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of a cluster, largest first: iteration of a subspace, then the small problem in it."""
    x = np.random.default_rng(len(a)).standard_normal((len(a), size))
    for _ in range(3):
        x, _ = np.linalg.qr(np.column_stack([_solve(a, (low + high) / 2, c, norm) for c in x.T]))
    w, v = np.linalg.eigh(x.T @ a @ x)
    return w[::-1], (x @ v)[:, ::-1]


def leading_eigenpairs(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and unit vectors as columns, their largest entry positive."""
    n = len(a)
    k = min(k, n)
    norm = float(np.linalg.norm(a))
    if not k or not norm:
        return np.zeros(k), np.eye(n)[:, :k]
    above = lambda shift: n - negative_pivots(a, shift)
    edge = norm * (1 + 1e-9)
    open_, found = [(-edge, n, edge, 0)], []
    while open_:
        low, at_low, high, at_high = open_.pop()
        if at_low == at_high or at_high >= k:
            continue
        if at_low - at_high == 1 and (pair := _alone(a, low, high, norm)):
            found.append((at_high, np.array([pair[0]]), pair[1][:, None]))
        elif high - low <= CLUSTER * norm:
            found.append((at_high, *_cluster(a, low, high, at_low - at_high, norm)))
        else:
            middle = (low + high) / 2
            at = above(middle)
            open_ += [(low, at_low, middle, at), (middle, at, high, at_high)]
    found.sort(key=lambda x: x[0])
    near: list[list] = []
    for one in found:  # a shift may have parted what is one cluster
        if near and near[-1][-1][1][-1] - one[1][0] <= 4 * CLUSTER * norm:
            near[-1].append(one)
        else:
            near.append([one])
    found = [g[0] if len(g) == 1 else (g[0][0], *_cluster(a, g[-1][1][-1], g[0][1][0], sum(len(w) for _, w, _ in g), norm)) for g in near]
    values, vectors = np.concatenate([w for _, w, _ in found])[:k], np.concatenate([v for _, _, v in found], axis=1)[:, :k]
    return values, vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)


# --- exact sums in tasks ----------------------------------------------------------------------


def _matrices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches of ROWS rows at most, with their vectors as a matrix."""
    for batch in batches:
        for s in range(0, batch.num_rows, ROWS):
            part = batch.slice(s, ROWS)
            values = part.column(column).flatten().to_numpy(zero_copy_only=False)
            yield part, values.reshape(part.num_rows, -1)


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """(n, sums of each dimension) of x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for _, x in _matrices(batches, 0):
            n, total = n + len(x), x.sum(axis=0) + (0 if total is None else total)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array([n, *total.tolist()], pa.int64())], names=["i", "s"])

    got = {r.i: int(r.s) for r in rows.select("x").mapInArrow(run, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return got.pop(-1, 0), [got[i] for i in sorted(got)]


def _products(rows: DataFrame, column: str, centre: list[int]) -> np.ndarray:
    """Sums over all rows of products of entries i and j, less centre; exact, if entries are whole, up to the last rounding."""
    whole = dict(rows.dtypes)[column] == "array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, k = None, 0
        for _, x in _matrices(batches, 0):
            y = x - np.array(centre, x.dtype)
            k = y.shape[1]
            if not whole:
                part = y.T @ y
            elif float(np.abs(y).max(initial=0)) ** 2 * len(y) < 2**53:  # doubles hold each sum of a slice exactly
                f = y.astype(float)
                part = (f.T @ f).astype(np.int64).astype(object)
            else:
                y = y.astype(object)
                part = y.T @ y
            total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(k)
            kind = pa.decimal128(38, 0) if whole else pa.float64()
            values = [Decimal(int(v)) for v in total[i, j]] if whole else total[i, j]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values, kind)], names=["i", "j", "s"])

    got = rows.select(column).mapInArrow(run, f"i int, j int, s {'decimal(38,0)' if whole else 'double'}").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    m = np.zeros((len(centre), len(centre)))
    m[got.i, got.j] = m[got.j, got.i] = got.s.astype(float)
    return m


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): the rows that remain, entries as whole numbers."""
    v = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = v.where((F.size("v") > 0) & sound)
    bound = float(1 << 52)
    x = F.transform("v", lambda c: F.floor(F.least(F.greatest(64 * c, F.lit(-bound)), F.lit(bound))) + SHIFT)
    return v.select("id", x.alias("x"))


def _apply(rows: DataFrame, n: int, sums: list[int], near: list[int], matrix: np.ndarray) -> DataFrame:
    """(id, deviation, w): the exact deviation, and the centred x times matrix."""
    kind = dict(rows.dtypes)["id"]
    rest = np.array([(s - n * m) / n for s, m in zip(sums, near)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, 1):
            y = x - np.array(near, np.int64)
            w = (y - rest) @ matrix
            most = (int(np.abs(y).max(initial=0)) + 1) * n
            if most * most * y.shape[1] < 1 << 62:
                d = n * y - np.array([s - n * m for s, m in zip(sums, near)], np.int64)
                dev = pa.array((d * d).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                d = n * y.astype(object) - np.array([s - n * m for s, m in zip(sums, near)], object)
                dev = pa.array([Decimal(v) if v < 10**38 else None for v in (d * d).sum(axis=1).tolist()], pa.decimal128(38, 0))
            offsets = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays([part.column(0), dev, pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], names=["id", "deviation", "w"])

    return rows.select("id", "x").mapInArrow(run, f"id {kind}, deviation decimal(38,0), w array<double>")


def whiten(rows: DataFrame, id_col: str, vector_col: str, components: int = COMPONENTS) -> tuple[DataFrame, dict]:
    """((id, deviation, w), fit): w holds the whitened leading components of each remaining row. fit: n, sums, eigenvalues,
    vectors, explained, identity_error."""
    x = materialize(whole_vectors(rows, id_col, vector_col), "vectors")
    lengths = x.groupBy(F.size("x").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).first()
    if lengths is None:
        return x.select("id", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.lit(None).cast("array<double>").alias("w")), {"n": 0, "sums": [], "values": np.zeros(0), "vectors": np.zeros((0, 0)), "explained": [], "identity_error": None}
    x = x.where(F.size("x") == lengths["k"])
    n, sums = _sums(x)
    near = [(2 * s + n) // (2 * n) for s in sums]  # the nearest whole numbers to the means
    rest = np.array([(s - n * m) / n for s, m in zip(sums, near)])
    cov = _products(x, "x", near) / n - np.outer(rest, rest)
    values, vectors = leading_eigenpairs(cov, components)
    kept = values > len(cov) * np.finfo(float).eps * np.linalg.norm(cov)
    w = materialize(_apply(x, n, sums, near, vectors[:, kept] / np.sqrt(values[kept])), "whitened")
    k = int(kept.sum())
    error = float(np.abs(_products(w, "w", [0] * k) / n - np.eye(k)).max()) if k else None
    trace = float(np.trace(cov))
    explained = [float(v / trace) if trace > 0 else None for v in values]
    return w, {"n": n, "sums": sums, "values": values, "vectors": vectors, "explained": explained, "identity_error": error}


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each remaining vector and component."""
    w, fit = whiten(rows, id_col, vector_col, components)
    shares = F.array(*(F.lit(e).cast("double") for e in fit["explained"])).cast("array<double>")
    at: Column = F.explode(F.sequence(F.lit(1), F.lit(len(fit["explained"])))) if fit["explained"] else F.explode(F.array().cast("array<int>"))
    out = w.select(F.col("id").alias(id_col), at.alias("component"), F.lit(fit["n"]).cast("long").alias("n"), F.expr("try_cast(deviation as bigint)").alias("deviation"), "w")
    return out.select(id_col, "component", "n", "deviation", F.get("w", F.col("component") - 1).alias("whitened"), F.get(shares, F.col("component") - 1).alias("explained"), F.lit(fit["identity_error"]).cast("double").alias("identity_error"))
