"""Language identification by the nearest of several centroids per language.

A text is the vector of its character 1- to 3-gram counts (letters lower-cased, runs of
anything else one blank), hashed into DIMS places, as (1 + log count) * idf and
scaled to length 1. Document frequencies cover all training rows. The vectors of a
sample of at most about SAMPLE texts a language (chosen by a hash of the id) are
clustered into CENTROIDS spherical centroids, one language a task. A text gets the
language of the centroid with the largest cosine; if that is under `reject`, too
far from all of them, `rejected` says so.

Null texts and texts without a letter are `und` with score 0. Ties go to the first
language in sorted order. Whole texts count, long ones in pieces of bounded size that
overlap as far as their grams reach, so a piece's border changes nothing. Rows with a null id are
not trained on and stay in the result. Repeated rows get equal results; only the named columns are read; an empty table
gives an empty result, and without any training rows every text is `und`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import slices

DIMS = 4096
SAMPLE = 400
CENTROIDS = 3
REJECT = 0.25
_PIECE = 1 << 18


def held_out(id_col: str, folds: int, fold: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold


def _codes(lowered: str) -> np.ndarray:
    """Code points, what is no letter as blanks."""
    code = np.frombuffer(lowered.encode("utf-32-le", "replace"), np.uint32)
    letter = (code >= 0xAA) & (code != 0xD7) & (code != 0xF7) & ~((code >= 0x2000) & (code < 0x2070)) & ~((code >= 0x3000) & (code < 0x3005)) | (code >= 97) & (code < 123)
    return np.where(letter, code, 32).astype(np.uint32)


def counts(texts: list[str | None]) -> np.ndarray:
    """Gram counts, one row a text. A long text goes in pieces, each with the last two places of the
    one before, so the grams are those of the whole; a blank is at both ends."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for i, text in enumerate(texts):
        lowered = (text or "").lower()
        if not lowered:
            continue
        before = np.array([32], np.uint32)
        new = 1  # places of c that the piece before has not counted
        for at in range(0, len(lowered), _PIECE):
            own = _codes(lowered[at : at + _PIECE])
            if at + _PIECE >= len(lowered):
                own = np.append(own, np.uint32(32))
            c = np.concatenate([before, own])
            keep = np.append(True, (c[1:] != 32) | (c[:-1] != 32))
            keep[: len(before)] = True
            c = c[keep]
            old = len(before) - new
            a = c * np.uint32(0x9E3779B1)
            b = a[:-1] ^ (c[1:] * np.uint32(0x85EBCA77) + np.uint32(1))
            d = b[:-1] * np.uint32(0xC2B2AE3D) ^ (c[2:] * np.uint32(0x27D4EB2F) + np.uint32(2))
            h = np.concatenate([a[old:], b[max(old - 1, 0) :] * np.uint32(0x2545F491), d[max(old - 2, 0) :] * np.uint32(0x9E3779B1)])
            out[i] += np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(20), minlength=DIMS)[:DIMS]
            before, new = c[-2:], 0
    return out


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.where(count > 0, 1 + np.log(np.maximum(count, 1)), 0) * idf
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _batches(batch: pa.RecordBatch, column: int):
    for s, e in slices(batch.column(column), 1 << 20):
        for i in range(s, e, 256):
            yield i, min(e, i + 256)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for s, e in _batches(batch, 0):
            total += (counts(batch.column(0).slice(s, e - s).to_pylist()) > 0).sum(axis=0)
            n += e - s
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.flatnonzero(total), -1)), pa.array(np.append(total[total > 0], n))], names=["dim", "n"])


def _cluster(idf: np.ndarray, k: int, rounds: int = 12):
    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group["id"].to_numpy(), kind="stable")
        texts = group["txt"].take(pa.array(order)).to_pylist()
        x = np.concatenate([vectors(counts(texts[i : i + 256]), idf) for i in range(0, len(texts), 256)])
        x = x[np.linalg.norm(x, axis=1) > 0]
        centres = x[:1]
        while len(centres) < min(k, len(x)):  # the next seed is the vector farthest from all so far
            centres = np.concatenate([centres, x[[int(np.argmin((x @ centres.T).max(axis=1)))]]])
        for _ in range(rounds):
            own = np.argmax(x @ centres.T, axis=1)
            for j in range(len(centres)):
                if (own == j).any():
                    m = x[own == j].mean(axis=0)
                    centres[j] = m / max(float(np.linalg.norm(m)), 1e-9)
        lang = group["lang"][0].as_py()
        return pa.table({"lang": pa.array([lang] * len(centres), pa.string()), "centre": pa.array([c.astype(np.float32).tobytes() for c in centres], pa.binary())})

    return run


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, k: int = CENTROIDS) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(idf, the language of each centroid, centroids) from rows with text and language.

    What comes to the driver is DIMS numbers and k centroids a language."""
    rows = train.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("txt"), F.col(lang_col).cast("string").alias("lang")).where("txt is not null and lang is not null")
    df = rows.select("txt").mapInArrow(_frequencies, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    found = {r["dim"]: r["n"] for r in df}
    n = found.pop(-1, 0)
    each = np.zeros(DIMS)
    each[list(found)] = list(found.values())
    idf = np.log((1 + n) / (1 + each)).astype(np.float32) + 1
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return idf, [], np.zeros((0, DIMS), np.float32)
    share = F.create_map(*(F.lit(v) for lang, c in sorted(sizes.items()) for v in (lang, min(1.0, sample / c))))
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    got = sorted((r["lang"], bytes(r["centre"])) for r in chosen.groupBy("lang").applyInArrow(_cluster(idf, k), "lang string, centre binary").collect())
    return idf, [g[0] for g in got], np.array([np.frombuffer(g[1], np.float32) for g in got]).reshape(-1, DIMS)


def predict(docs: DataFrame, model: tuple[np.ndarray, list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row of docs."""
    idf, langs, centres = model
    shipped = docs.sparkSession.sparkContext.broadcast((idf, langs, centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, langs, centres = shipped.value
        for batch in batches:
            for s, e in _batches(batch, 1):
                texts = batch.column(1).slice(s, e - s).to_pylist()
                none = np.array([not langs or not any(map(str.isalpha, t or "")) for t in texts])
                if langs:
                    cos = vectors(counts(texts), idf) @ centres.T
                    best, score = np.argmax(cos, axis=1), np.clip(cos.max(axis=1).astype(np.float64), 0, 1)
                else:
                    best, score = np.zeros(len(texts), int), np.zeros(len(texts))
                score[none] = 0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s).cast(pa.int64()), pa.array(["und" if x else langs[b] for x, b in zip(none, best)], pa.string()), pa.array(score), pa.array(none | (score < reject))], names=["id", "lang_pred", "score", "rejected"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("txt"))
    return own.mapInArrow(run, "id long, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2) -> DataFrame:
    """Fit on the rows outside the held-out fold, predict all rows."""
    model = fit(docs.where(~held_out(id_col, folds, fold)), id_col, text_col, lang_col)
    return predict(docs, model, id_col, text_col).withColumn("held_out", F.coalesce(held_out(id_col, folds, fold), F.lit(False))).select(id_col, "held_out", "lang_pred", "score", "rejected")
