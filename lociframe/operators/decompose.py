"""Singular values and independent components of tall matrices, a row an array.

Tasks reduce their rows to triangles (QR), and triangles meet SIXTEEN at a time in further tasks, so that no
product of columns is summed, small singular values keep their digits, and neither rows nor columns
squared meet on the driver: what comes there is k vectors. Where columns are too many for a triangle in a task, a range finder
takes a block of directions, applies the matrix and its transpose in passes over the rows, and keeps all it has seen
(a block Krylov space) until the singular values rest; the triangle is then of that small space.

Independent components are fixed points on whitened scores. All restarts climb together, a pass over the rows each
round; components of the restarts are matched, averaged, and their agreement is the stability."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import settled

SIXTEEN = 16
#: Columns up to which a task holds a triangle of all of them (32 MB).
WIDE = 2048
ROWS = 4096


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        for s in range(0, b.num_rows, ROWS):
            part = b.column(0).slice(s, ROWS)
            yield part.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(part), -1)


def _sound(rows: DataFrame, values: str) -> DataFrame:
    """One column v: arrays without nulls; others are left out."""
    return rows.where(F.col(values).isNotNull() & F.forall(values, lambda c: c.isNotNull())).select(F.col(values).cast("array<double>").alias("v"))


def column_means(rows: DataFrame, values: str) -> tuple[int, np.ndarray]:
    """(n, means), from one partial sum a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0.0
        for x in _blocks(batches):
            n, total = n + len(x), total + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array([float(n), *total])], names=["i", "s"])

    got = {r.i: r.s for r in _sound(rows, values).mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    n = int(got.pop(-1, 0))
    return n, np.array([got[i] for i in sorted(got)]) / max(n, 1)


def triangle(rows: DataFrame, values: str, means: np.ndarray, basis: np.ndarray | None = None) -> DataFrame:
    """One row r: the flattened upper triangle R of a QR of the centred rows, times basis if given. Tasks emit a triangle each, which
    meet in rounds of SIXTEEN."""
    k = len(means) if basis is None else basis.shape[1]

    def tall(blocks: Iterator[np.ndarray]) -> np.ndarray:
        r = np.zeros((0, k))
        for x in blocks:
            r = np.linalg.qr(np.concatenate([r, x]), mode="r")
        return r

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = tall((x - means) if basis is None else (x - means) @ basis for x in _blocks(batches))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["part", "r"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        r = tall(np.asarray(x).reshape(-1, k) for x in pdf.sort_values("part")["r"])
        return pd.DataFrame({"part": [int(pdf["part"].min()) // SIXTEEN], "r": [r.ravel()]})

    found = settled(_sound(rows, values).mapInArrow(first, "part int, r array<double>"))
    parts = (found.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        found = settled(found.groupBy(F.floor(F.col("part") / SIXTEEN)).applyInPandas(meet, "part int, r array<double>"))
        parts = -(-parts // SIXTEEN)
    return found.select("r")


def _from_triangle(found: DataFrame, columns: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors as rows) of the k largest, decomposed in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.column(0).to_pylist():
                _, s, vt = np.linalg.svd(np.array(r).reshape(-1, columns), full_matrices=False)
                yield pa.RecordBatch.from_arrays([pa.array(range(min(k, len(s))), pa.int32()), pa.array(s[:k]), pa.array(list(vt[:k]), pa.list_(pa.float64()))], names=["i", "s", "v"])

    got = found.mapInArrow(run, "i int, s double, v array<double>").orderBy("i").collect()
    return np.array([r.s for r in got]), np.array([r.v for r in got]).reshape(-1, columns)


def singular_values(rows: DataFrame, values: str, k: int, centre: bool = True, wide: int = WIDE, block: int = 8, within: float = 1e-10, rounds: int = 60, seed: int = 1) -> dict:
    """{n, means, values, vectors}: the k largest singular values of the rows less their means, and right vectors as rows, the largest part of each
    positive. Fewer where rows or columns are. Over wide columns they are found by a range finder of blocks of k + block
    directions, until they change by no more than within; it raises if rounds do not do."""
    n, means = column_means(rows, values)
    c = len(means)
    if not n:
        return {"n": 0, "means": means, "values": np.zeros(0), "vectors": np.zeros((0, c))}
    shift = means if centre else np.zeros(c)
    k = min(k, c, n)
    if c <= wide:
        s, v = _from_triangle(triangle(rows, values, shift), c, k)
    else:
        basis = _krylov(rows, values, shift, k, min(k + block, c), within, rounds, seed)
        s, w = _from_triangle(triangle(rows, values, shift, basis), basis.shape[1], k)
        v = w @ basis.T
    return {"n": n, "means": shift, "values": s, "vectors": v * np.where(v[range(len(v)), np.abs(v).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]}


def _krylov(rows: DataFrame, values: str, shift: np.ndarray, k: int, width: int, within: float, rounds: int, seed: int) -> np.ndarray:
    """An orthonormal basis (columns by directions) whose space has the leading k right vectors."""
    sound = settled(_sound(rows, values))

    def applied(q: np.ndarray) -> np.ndarray:
        """The transposed centred matrix times the matrix times q, summed over tasks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for x in _blocks(batches):
                x = x - shift
                part = x.T @ (x @ q)
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *map(pa.array, total.T)], names=["i", *names])

        names = [f"s{j}" for j in range(q.shape[1])]
        got = sound.mapInArrow(run, ", ".join(["i int", *(f"{c} double" for c in names)])).groupBy("i").agg(*(F.sum(c).alias(c) for c in names)).toPandas()
        out = np.zeros(q.shape)
        out[got["i"].to_numpy()] = got[names].to_numpy()
        return out

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(shift), width)))[0]
    basis, images, last = q, np.zeros((len(shift), 0)), None
    for _ in range(rounds):
        image = applied(q)
        images = np.concatenate([images, image], axis=1)
        ritz = np.sort(np.linalg.eigvalsh((basis.T @ images + images.T @ basis) / 2))[::-1][:k]
        if last is not None and np.abs(ritz - last).max() <= within * abs(ritz[0]):
            return basis
        last = ritz
        for _ in range(2):  # twice, as once leaves rounding
            image = image - basis @ (basis.T @ image)
        u, s, _ = np.linalg.svd(image, full_matrices=False)
        u = u[:, s > 1e-12 * abs(ritz[0])]  # images are of the size of squares; what is less is rounding, and has no direction
        u, s, _ = np.linalg.svd(u - basis @ (basis.T @ u), full_matrices=False)  # small parts, once scaled up, lean on the basis again
        q = u[:, s > 0.5]
        if not q.shape[1]:
            return basis
        basis = np.concatenate([basis, q], axis=1)
    raise RuntimeError(f"the singular values have not settled in {rounds} rounds")


def project(rows: DataFrame, values: str, shift: np.ndarray, vectors: np.ndarray, out: str = "scores") -> DataFrame:
    """rows with their scores on vectors (rows of a matrix); null where values has a null."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        have = v.notna()
        got = iter((np.stack(v[have].to_numpy()).astype(float) - shift) @ vectors.T if have.any() else ())
        return pd.Series([next(got) if h else None for h in have])

    return rows.withColumn(out, run(F.when(F.forall(values, lambda c: c.isNotNull()), F.col(values).cast("array<double>"))))


# --- independent components -------------------------------------------------------------------


def _apart(w: np.ndarray) -> np.ndarray:
    """The orthonormal rows nearest to those of each matrix."""
    u, _, vt = np.linalg.svd(w, full_matrices=False)
    return u @ vt


def independent_components(rows: DataFrame, values: str, k: int, restarts: int = 10, rounds: int = 500, within: float = 1e-8, seed: int = 1) -> dict:
    """{n, means, loadings, stability, settled}: k independent components, by the slope of log cosh, over restarts from random rotations.

    loadings are rows over columns; a row's sources are its centred values times them, of variance 1. Components of each restart
    are matched with the first's by the largest cosine, turned to its sign, and averaged; stability is the mean cosine with the average.
    settled tells of each restart whether its rows changed by no more than within. Directions without variance are left out."""
    svd = singular_values(rows, values, k)
    n, s = svd["n"], svd["values"]
    keep = s > 1e-10 * s.max(initial=0)
    k = int(keep.sum())
    if not k:
        return {"n": n, "means": svd["means"], "loadings": np.zeros((0, len(svd["means"]))), "stability": np.zeros(0), "settled": np.zeros(0, bool)}
    whitening = svd["vectors"][keep] * np.sqrt(n) / s[keep][:, None]
    z = settled(project(_sound(rows, values), "v", svd["means"], whitening, "z").select("z"))
    w = _apart(np.stack([np.random.default_rng([seed, r]).standard_normal((k, k)) for r in range(restarts)]))
    done = np.zeros(restarts, bool)

    def moments(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over rows of the slopes times z, and of the slopes' slopes, of each restart."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(w), k, k + 1))
            for x in _blocks(batches):
                for r, own in enumerate(w):
                    g = np.tanh(x @ own.T)
                    total[r, :, :k] += g.T @ x
                    total[r, :, k] += (1 - g * g).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["i", "s"])

        got = z.mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).toPandas()
        out = np.zeros(len(w) * k * (k + 1))
        out[got.i] = got.s
        out = out.reshape(len(w), k, k + 1)
        return out[:, :, :k], out[:, :, k]

    for _ in range(rounds):
        open_ = np.flatnonzero(~done)
        first, second = moments(w[open_])
        new = _apart(first / n - (second / n)[:, :, None] * w[open_])
        change = np.abs(np.abs(np.einsum("rij,rij->ri", new, w[open_])) - 1).max(axis=1)
        w[open_] = new
        done[open_] = change < within
        if done.all():
            break
    cosine = np.einsum("ik,rjk->rij", w[0], w)
    match = np.abs(cosine).argmax(axis=2)
    turned = np.take_along_axis(w, match[:, :, None], axis=1) * np.sign(np.take_along_axis(cosine, match[:, :, None], axis=2))
    mean = turned.mean(axis=0)
    mean /= np.linalg.norm(mean, axis=1, keepdims=True)
    stability = np.abs(np.einsum("ik,rik->ri", mean, turned)).mean(axis=0)
    order = np.argsort(-stability, kind="stable")
    return {"n": n, "means": svd["means"], "loadings": (mean @ whitening)[order], "stability": stability[order], "settled": done}
