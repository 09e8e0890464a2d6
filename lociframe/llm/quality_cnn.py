"""Quality classification with a byte-level convolutional network in numpy.

The UTF-8 bytes of a text, A to Z and all, are cut into chunks of CHUNK bytes that begin
every STRIDE, so they overlap and cover the whole text. FILTERS learned filters of
WIDTH bytes run over each chunk; their largest responses in the chunk feed a small
hidden layer; the largest hidden values of all chunks are combined into one
probability. Because largest values are all that counts, a gradient reaches one place
a filter and chunk, which makes training cheap.

Training uses a sample of labelled rows of at most about SAMPLE a class (chosen by a
hash of the id), texts of any length, and, as scoring, every chunk of them: a text's chunks are gone through in pieces, and as only the
chunks with the largest hidden values have a gradient, only these are kept. It runs on the
driver, on this bounded sample, from a fixed seed.

A null id is in no sample and stays null in its own row. Null and empty texts are one chunk of zero bytes and get the score that the network
gives it. Repeated rows get equal scores. Long texts are scored in pieces of
bounded size. Only the named columns are read. An empty table gives an empty
result; without labels of both classes every score is the share of label 1, or 0.5."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import held_out
from .textops import slices, tidy, utf8

CHUNK, STRIDE, WIDTH, FILTERS, HIDDEN = 256, 192, 6, 16, 12
SAMPLE, EPOCHS = 1200, 14
_PIECE_CHUNKS = 2048

Model = dict[str, np.ndarray]


def chunks_of(data: np.ndarray) -> np.ndarray:
    """Overlapping chunks of one text, the last one padded with zeros."""
    n = max(1, -(-max(0, len(data) - (CHUNK - STRIDE)) // STRIDE))
    padded = np.zeros((n - 1) * STRIDE + CHUNK, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STRIDE]


def _respond(filters: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Responses (chunk, place, filter)."""
    places = CHUNK - WIDTH + 1
    out = filters[0][chunks[:, :places]]
    for j in range(1, WIDTH):
        out += filters[j][chunks[:, j : j + places]]
    return out


def _forward(m: Model, pooled: np.ndarray) -> np.ndarray:
    return np.maximum(np.maximum(pooled + m["fb"], 0) @ m["w1"] + m["b1"], 0)


def pool(m: Model, chunks: np.ndarray) -> np.ndarray:
    """The largest response of each filter in each chunk."""
    return np.concatenate([_respond(m["filters"], chunks[i : i + 64]).max(axis=1) for i in range(0, len(chunks), 64)])


def peaks(filters: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each filter responds most in each chunk, and how much."""
    where, most = [], []
    for i in range(0, len(chunks), 64):
        raw = _respond(filters, chunks[i : i + 64])
        where.append(raw.argmax(axis=1))
        most.append(np.take_along_axis(raw, where[-1][:, None, :], axis=1)[:, 0])
    return np.concatenate(where), np.concatenate(most)


def _leading(m: Model, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each hidden value, the chunk of a text where it is largest: its bytes, and where and how much each filter responds there."""
    best = None
    for s in range(0, len(chunks), _PIECE_CHUNKS):
        piece = chunks[s : s + _PIECE_CHUNKS]
        where, most = peaks(m["filters"], piece)
        h = np.maximum(np.maximum(most + m["fb"], 0) @ m["w1"] + m["b1"], 0)
        at = h.argmax(axis=0)
        own = h[at, np.arange(HIDDEN)], piece[at], where[at], most[at]
        if best is None:
            best = own
        else:
            up = own[0] > best[0]
            best = (np.where(up, own[0], best[0]), *(np.where(up[:, None], a, b) for a, b in zip(own[1:], best[1:])))
    return best[1:]


def train(texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    m: Model = {
        "filters": rng.normal(0, 0.35, (WIDTH, 256, FILTERS)).astype(np.float32),
        "fb": np.full(FILTERS, -0.5, np.float32),
        "w1": rng.normal(0, (2 / FILTERS) ** 0.5, (FILTERS, HIDDEN)).astype(np.float32),
        "b1": np.zeros(HIDDEN, np.float32),
        "w2": rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32),
        "b2": np.zeros(1, np.float32),
    }
    first, second = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    parts = [chunks_of(t) for t in texts]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(parts))
        for at in range(0, len(order), 48):
            pick = order[at : at + 48]
            chunks, where, most = (np.concatenate(x) for x in zip(*(_leading(m, parts[i]) for i in pick)))  # HIDDEN rows a text
            p0 = most + m["fb"]
            p = np.maximum(p0, 0)
            h0 = p @ m["w1"] + m["b1"]
            unit = np.tile(np.arange(HIDDEN), len(pick))
            rows = np.arange(len(chunks))
            doc = np.maximum(h0[rows, unit], 0).reshape(-1, HIDDEN)
            score = 1 / (1 + np.exp(-np.clip(doc @ m["w2"] + m["b2"], -30, 30)))
            g = ((score - labels[pick]) * weights[pick] / len(pick)).astype(np.float32)
            grad = {"w2": doc.T @ g, "b2": g.sum(keepdims=True)}
            gh = np.zeros_like(h0)
            gh[rows, unit] = np.repeat(g, HIDDEN) * m["w2"][unit] * (h0[rows, unit] > 0)
            grad["w1"], grad["b1"] = p.T @ gh, gh.sum(axis=0)
            gp = (gh @ m["w1"].T) * (p0 > 0)
            grad["fb"] = gp.sum(axis=0)
            gf = np.zeros_like(m["filters"])
            filt = np.arange(FILTERS)[None, :]
            for j in range(WIDTH):
                np.add.at(gf[j], (chunks[rows[:, None], where + j], filt), gp)
            grad["filters"] = gf
            step += 1
            rate = 4e-3 * (0.5 * (1 + np.cos(np.pi * epoch / EPOCHS)) + 0.05)
            for k, v in grad.items():
                v = v + 1e-5 * m[k]
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                m[k] = (m[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return m


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, fold: int = 0, sample: int = SAMPLE) -> Model | float:
    """The network, or the share of label 1 if there is one class only, from labels outside the held-out fold.

    Rows are chosen among the labels, about `sample` a class, before they meet the texts, so
    that side of the join has a bound and no text is moved but those chosen."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out("id", folds, fold)).groupBy("id").agg(F.min("label").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return float(next(iter(sizes), 0.5))
    share = F.when(F.col("label") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, sample / sizes[0]))
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30))
    texts_of = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("txt")).join(F.broadcast(chosen), "id")
    got = texts_of.select("id", "label", F.coalesce("txt", F.lit("")).cast("binary").alias("bytes")).collect()
    got.sort(key=lambda r: (r["id"], r["bytes"]))
    labels_of = np.array([r["label"] for r in got], np.float32)
    if not 0 < labels_of.sum() < len(got):
        return float(labels_of.mean()) if len(got) else sizes[1] / (sizes[0] + sizes[1])
    texts = [np.frombuffer(r["bytes"], np.uint8) for r in got]
    n1 = int(labels_of.sum())
    n0 = len(labels_of) - n1
    # the sample is balanced; weights give each class its share of all labelled rows, halfway
    p1 = sizes[1] / (sizes[0] + sizes[1])
    weights = np.where(labels_of == 1, p1**0.5 / n1, (1 - p1) ** 0.5 / n0)
    return train(texts, labels_of, weights / weights.mean())


def scores(m: Model, texts: list[np.ndarray]) -> np.ndarray:
    parts = [chunks_of(t) for t in texts]
    out = np.zeros((len(texts), HIDDEN), np.float32)
    held, owner = [], []

    def flush():
        if held:
            h = _forward(m, pool(m, np.concatenate(held)))
            np.maximum.at(out, np.concatenate(owner), h)
            held.clear()
            owner.clear()

    size = 0
    for i, c in enumerate(parts):
        for at in range(0, len(c), _PIECE_CHUNKS):
            held.append(c[at : at + _PIECE_CHUNKS])
            owner.append(np.full(len(held[-1]), i))
            size += len(held[-1])
            if size >= _PIECE_CHUNKS:
                flush()
                size = 0
    flush()
    return 1 / (1 + np.exp(-np.clip(out.astype(np.float64) @ m["w2"] + m["b2"], -30, 30)))


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row of docs."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("txt"))
    if isinstance(model, float):
        return own.select(F.col("id").alias(id_col), F.lit(model).alias("score"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            for s, e in slices(batch.column(1), 1 << 20):
                data, offs = utf8(batch.column(1).slice(s, e - s))
                got = scores(m, [data[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s).cast(pa.int64()), pa.array(got)], names=["id", "score"])

    return own.mapInArrow(tidy(run), "id long, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, fold: int = 0, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, unchanged, whose score is threshold or more. No row is moved."""
    model = fit(docs, labels, id_col, text_col, label_col, folds, fold)
    if isinstance(model, float):
        return docs if model >= threshold else docs.limit(0)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            for s, e in slices(batch.column(column), 1 << 20):
                data, offs = utf8(batch.column(column).slice(s, e - s))
                good = scores(m, [data[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]) >= threshold
                yield batch.slice(s, e - s).filter(pa.array(good))

    return docs.mapInArrow(tidy(run), docs.schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, fold: int = 0, threshold: float = 0.3) -> DataFrame:
    """Fit on labelled rows outside the held-out fold; (doc_id, held_out, score, predicted) of all rows."""
    model = fit(docs, labels, id_col, text_col, label_col, folds, fold)
    out = score(docs, model, id_col, text_col)
    return out.select(id_col, F.coalesce(held_out(id_col, folds, fold), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
