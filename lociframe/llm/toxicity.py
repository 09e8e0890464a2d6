"""Toxicity by class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary texts, predict each byte of a word from
all bytes before it in the word, and the word's end. Counts are numbers of texts, so
that a text that repeats a word, or a long one, does not speak louder. A class's counts
are discounted, the more the larger they are up to three (the modified Kneser-Ney
discounts); what that leaves goes to a model that both classes share: of the same beginning, counted
by the different words that begin so, and below that by the different beginnings that
a byte follows. A rare form thus leans on the shared counts, and says little; stems
and words that are regular in one class stand out. A word is what stands between white
space, A-Z lower-cased; one of more than PART bytes is read in parts of PART bytes, so
every byte counts.

A text's log-likelihoods are sums over its words. The toxic less the ordinary one, per word over the whole
text (d) and of the two words where it is largest (top, next), and the logarithm of the number of words, which
says how large these get by chance, are combined by a logistic function. It is fitted,
by Newton steps whose sums Spark forms, on labelled rows that the models have
not seen (a quarter of the training rows).

Nothing that is counted is left out, and no table of words comes to the driver or is
broadcast. Tasks gather texts in blocks; the blocks' distinct words meet in buckets, which are ranges of
words in their order. All words with one beginning are thus neighbours, and a bucket can
count its beginnings by itself, but for those few that a border of its range cuts: these, at most
KEY a border, are summed over buckets by grouping and joined back. A bucket gives each block its words' sums in the
order of the block's list; there they meet the block's texts as word numbers. The
borders are quantiles of a sample of texts and say only which words a bucket gets.

Null, empty and blank texts have no words and all measures 0. A null id stays null in its own row.
Repeated rows get equal scores. Long texts are a block of their own. Only the
named columns are read. An empty table gives an empty result; without labels
of both classes all scores are the share of label 1, or 0.5. Texts are read twice, and
have to be the same in the same order both times, as files are; otherwise the job fails."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _PIECES, _grow, _join, _part, _pieces, _shrink
from .langid import held_out
from .shared import materialize, with_labels
from .textops import Words, slices, utf8

BLOCK_BYTES = 32 << 20
#: Bytes of text for one bucket of words, and texts in the sample for its borders, about.
BUCKET_TEXT, BORDER_TEXTS = 64 << 20, 4000
PART = 12
KEY = 7  # bytes by which words are dealt
END = 2
CLASS_DISCOUNTS = np.array([0, 1, 2, 2.8])
SHARED_DISCOUNTS = np.array([0, 0.9, 1.3, 1.6])
MEASURES = ("d", "top", "next", "size")

TEXTS, LIST, WORDS, NUMBERS, SUMS = range(5)  # kinds of pieces
_EDGES = "h binary, b int, t long, o long, n long, bucket long"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class _Parts:
    """The parts of the words of every text of a batch."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        words = Words(data, offs)
        words.data = np.maximum(words.data, 1)  # 0 pads
        size = words.end - words.start
        n = -(-size // PART)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.data = words.data
        self.start = np.repeat(words.start, n) + at * PART
        self.last = at == np.repeat(n - 1, n)
        self.end = np.where(self.last, np.repeat(words.end, n), self.start + PART)
        sums = np.concatenate([[0], np.cumsum(n)])
        self.count = np.diff(sums[words.bound])
        self.hashes = words.prefix_hashes(self.start, self.end) ^ self.last.astype(np.uint64) if len(at) else np.zeros(0, np.uint64)

    def keys(self, i: np.ndarray) -> np.ndarray:
        """The first KEY bytes, end marker included, as one number."""
        out = np.zeros(len(i), np.uint64)
        start, size, last = self.start[i], self.end[i] - self.start[i], self.last[i]
        for j in range(KEY):
            byte = np.where(j < size, self.data[np.minimum(start + j, max(len(self.data) - 1, 0))], np.where((j == size) & last, END, 0)) if len(i) else out
            out = out << np.uint64(8) | byte.astype(np.uint64)
        return out

    def strings(self, i: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[b:e] + (b"\x02" if x else b"") for b, e, x in zip(self.start[i].tolist(), self.end[i].tolist(), self.last[i].tolist())]


def _split(bounds: np.ndarray, kind: int, labelled: bool = False):
    """Blocks of (id, text[, label]). LIST: part of a block's list of distinct words, for a bucket,
    with the numbers of toxic and ordinary texts that have them if labelled (source -1: nothing goes back). TEXTS:
    the block's texts as word numbers, for the block. Frequent words have small numbers; a list keeps their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq
            block = (part << 24) + seq
            seq += 1
            found = np.concatenate([h[0] for h in held])
            hashes, first, inverse = np.unique(found, return_index=True, return_inverse=True)
            total = lambda i: np.bincount(inverse, np.concatenate([h[i] for h in held]), len(hashes)).astype(np.int64)
            order = np.argsort(-total(1), kind="stable")
            bucket = np.searchsorted(bounds, np.concatenate([h[2] for h in held])[first[order]], side="right")
            check = np.array([len(hashes), np.bitwise_xor.reduce(hashes, initial=np.uint64(0)).view(np.int64)]).tobytes()
            if kind == TEXTS:
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                starts = np.cumsum([0] + [len(h[0]) for h in held])
                number = np.concatenate([rank[inverse[s + h[3]]] for s, h in zip(starts, held)])
                docs = [x for h in held for x in h[4]]
                yield from _pieces([(block, block, TEXTS, _join([_shrink(np.concatenate([h[5] for h in held])), _shrink(bucket), _shrink(number), check]))], [docs]).to_batches()
            else:
                words = [w for h in held for w in h[3]]
                listed = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[listed], np.arange(len(bounds) + 2))
                counts = [total(4)[order], total(5)[order]] if labelled else []
                for x in np.flatnonzero(np.diff(cut)).tolist():
                    own = listed[cut[x] : cut[x + 1]]
                    yield from _pieces([(x, -1 if labelled else block, LIST, _join([zstandard.compress(b" ".join([words[i] for i in first[order[own]]]), 3), check, *(_shrink(c[own]) for c in counts)]))]).to_batches()
            held.clear()

        size = 0
        for batch in batches:
            for s, e in slices(batch.column(1), 1 << 20):
                parts = _Parts(*utf8(batch.column(1).slice(s, e - s)))
                hashes, at, inverse, times = np.unique(parts.hashes, return_index=True, return_inverse=True, return_counts=True)
                if kind == TEXTS:
                    held.append((hashes, times, parts.keys(at), inverse.astype(np.int32), batch.column(0).slice(s, e - s).to_pylist(), parts.count))
                else:
                    by = None, None
                    if labelled:
                        label = np.asarray(batch.column(2).slice(s, e - s).to_numpy(zero_copy_only=False), np.int64)
                        pairs = np.unique(np.repeat(np.arange(e - s), parts.count) * max(len(at), 1) + inverse)
                        word, toxic = pairs % max(len(at), 1), label[pairs // max(len(at), 1)]
                        by = np.bincount(word, toxic, len(at)), np.bincount(word, 1 - toxic, len(at))
                    held.append((hashes, times, parts.keys(at), parts.strings(at), *by))
                size += len(parts.data)
                if size >= BLOCK_BYTES:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return run


def _merge(group: pa.Table) -> pa.Table:
    """All lists of a bucket: WORDS, its distinct words in order and how many toxic and ordinary texts have
    each, and NUMBERS, each block's list in them."""
    bucket = group["dest"][0].as_py()
    number: dict[bytes, int] = {}
    lists, counted = [], []
    for source, payload in zip(group["source"].to_pylist(), group["payload"]):
        packed, check, *counts = _part(payload.as_py())
        own = zstandard.decompress(packed).split(b" ")
        x = np.fromiter((number.setdefault(w, len(number)) for w in own), np.int64, len(own))
        if source < 0:
            counted.append((x, *map(_grow, counts)))
        else:
            lists.append((source, x, check))
    t, o = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    for x, toxic, ordinary in counted:
        t[x] += toxic
        o[x] += ordinary
    words = sorted(number)
    old = np.fromiter((number[w] for w in words), np.int64, len(words))
    new = np.empty_like(old)
    new[old] = np.arange(len(old))
    return _pieces([(bucket, -1, WORDS, _join([zstandard.compress(b" ".join(words), 3), _shrink(t[old]), _shrink(o[old])])), *((bucket, source, NUMBERS, _join([_shrink(new[x]), check])) for source, x, check in lists)])


class _Trie:
    """Words in order, as rows of bytes; those with one beginning are neighbours."""

    def __init__(self, words: list[bytes]):
        width = PART + 1
        self.bytes = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(-1, width)
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        same = (self.bytes[1:] == self.bytes[:-1]).cumprod(axis=1).sum(axis=1)
        self.shared = np.concatenate([[-1], np.minimum(same, np.minimum(self.size[1:], self.size[:-1]))])[: len(words)]

    def levels(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(j, rows that have byte j, first row of each beginning of j + 1 bytes, its parent, beginning of each row)."""
        parent = np.zeros(len(self.size), np.int64)
        for j in range(self.bytes.shape[1]):
            has = self.size > j
            first = np.flatnonzero(has & (self.shared <= j))
            if not len(first):
                return
            flags = np.zeros(len(has), np.int64)
            flags[first] = 1
            own = np.cumsum(flags) - 1
            yield j, has, first, parent[first], own
            parent = own


def _cut(bounds: np.ndarray, bucket: int) -> set[bytes]:
    """The beginnings that words of other buckets may have as well."""
    borders = [int(bounds[i]).to_bytes(KEY, "big") for i in (bucket - 1, bucket) if 0 <= i < len(bounds)]
    return {b""} | {b[:n] for b in borders for n in range(KEY + 1)}


def _edges(bounds: np.ndarray):
    """Of each bucket's labelled words: what follows the beginnings that borders cut (h, b: next byte,
    t and o: texts, n: words), the beginnings needed (b -1), and how many other beginnings each byte ends (h null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                packed, t, o = _part(payload.as_py())
                t, o = _grow(t), _grow(o)
                some = np.flatnonzero(t + o)
                words = zstandard.decompress(packed).split(b" ")
                t, o, trie = t[some], o[some], _Trie([words[i] for i in some])
                cut = _cut(bounds, bucket)
                ends = np.zeros(256, np.int64)
                rows = [(h, -1, 0, 0, 0) for h in cut]
                before = np.zeros(1, np.int64)
                for j, has, first, parent, _ in trie.levels():
                    byte = trie.bytes[first, j]
                    open_ = np.isin(parent, _find(trie, before, j, cut))
                    sums = [np.add.reduceat(np.where(has, x, 0), first) for x in (t, o, np.ones(len(t), np.int64))]
                    for i in np.flatnonzero(open_).tolist():
                        rows.append((trie.bytes[first[i], :j].tobytes(), int(byte[i]), *(int(x[i]) for x in sums)))
                    ends += np.bincount(byte[~open_], minlength=256)
                    before = first
                rows += [(None, b, 0, 0, int(n)) for b, n in enumerate(ends) if n]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))] + [pa.array([bucket] * len(rows), pa.int64())], names=["h", "b", "t", "o", "n", "bucket"])

    return run


def _find(trie: _Trie, before: np.ndarray, j: int, cut: set[bytes]) -> list[int]:
    """Which of the beginnings of j bytes, whose first rows are `before`, are cut by borders."""
    if j == 0:
        return [0]
    own = trie.bytes[before, :j]
    return [int(i) for h in cut if len(h) == j for i in np.flatnonzero((own == np.frombuffer(h, np.uint8)).all(axis=1))]


def _steps(n: np.ndarray) -> np.ndarray:
    """1, 2 or 3 in columns: which discount a count has."""
    return np.stack([n == 1, n == 2, n >= 3])


def log_ratios(trie: _Trie, t: np.ndarray, o: np.ndarray, edges: dict[bytes, np.ndarray], single: np.ndarray) -> np.ndarray:
    """log p(toxic) - log p(ordinary) of each word. edges: of beginnings that are cut, (256, 3) sums over
    all buckets; single: how likely each byte is by the beginnings that it ends."""
    out = np.zeros(len(t))
    known = (t + o > 0).astype(np.int64)
    before = np.zeros(1, np.int64)
    for j, has, first, parent, own in trie.levels():
        byte = trie.bytes[first, j]
        child = np.stack([np.add.reduceat(np.where(has, x, 0), first) for x in (t, o, known)])
        n_parents = int(parent.max()) + 1
        for i in _find(trie, before, j, set(edges)):
            mine = parent == i
            child[:, mine] = edges[trie.bytes[before[i], :j].tobytes()][byte[mine]].T
        sums, left = [], []
        for x, discounts in zip(child, (CLASS_DISCOUNTS, CLASS_DISCOUNTS, SHARED_DISCOUNTS)):
            sums.append(np.bincount(parent, x, n_parents))
            left.append(sum(d * np.bincount(parent, s, n_parents) for d, s in zip(discounts[1:], _steps(x))))
        for i in _find(trie, before, j, set(edges)):
            if i < n_parents:
                every = edges[trie.bytes[before[i], :j].tobytes()]
                for k, discounts in enumerate((CLASS_DISCOUNTS, CLASS_DISCOUNTS, SHARED_DISCOUNTS)):
                    sums[k][i], left[k][i] = every[:, k].sum(), (discounts[1:, None] * _steps(every[:, k])).sum()
        (st, so, sn), (lt, lo, ln) = ([x[parent] for x in y] for y in (sums, left))
        ct, co, cn = child
        taken = lambda c, d: c - d[np.minimum(c, 3)]
        shared = np.where(cn > 0, (taken(cn, SHARED_DISCOUNTS) + ln * single[byte]) / np.maximum(sn, 1), 1.0)
        p = [np.where(s > 0, (taken(c, CLASS_DISCOUNTS) + rest * shared) / np.maximum(s, 1), shared) for c, s, rest in ((ct, st, lt), (co, so, lo))]
        value = np.log(p[0]) - np.log(p[1])
        out[has] += value[own[has]]
        before = first
    return out


def _add(single: np.ndarray):
    """SUMS: the log ratios of a bucket's words, for each block in the order of its list."""

    def run(group: pa.Table, edges: pa.Table) -> pa.Table:
        kinds, payload = group["kind"].to_numpy(), group["payload"]
        source, bucket = group["source"].to_numpy(), group["dest"][0].as_py()
        packed, t, o = _part(payload[int(np.flatnonzero(kinds == WORDS)[0])].as_py())
        cut: dict[bytes, np.ndarray] = {}
        for h, b, *counts in zip(*(edges[c].to_pylist() for c in ("h", "b", "t", "o", "n"))):
            cut.setdefault(h, np.zeros((256, 3), np.int64))[b] = counts
        each = log_ratios(_Trie(zstandard.decompress(packed).split(b" ")), _grow(t), _grow(o), cut, single).astype(np.float32)
        rows = []
        for i in np.flatnonzero(kinds == NUMBERS):
            number, check = _part(payload[int(i)].as_py())
            rows.append((int(source[i]), bucket, SUMS, _join([_planes(each[_grow(number)]), check])))
        return _pieces(rows)

    return run


def _planes(values: np.ndarray) -> bytes:
    """Values, compressed by bytes of like weight."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 3)


def _of_planes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1).T).view(kind).ravel()


def _score(group: pa.Table) -> pa.Table:
    """(id, measures) of a block's texts."""
    kinds, source = group["kind"].to_numpy(), group["source"].to_numpy()
    own = np.flatnonzero(kinds == TEXTS)
    if len(own) != 1:
        raise RuntimeError("the texts changed between two readings")
    docs = group["docs"][int(own[0])].as_py()
    count, bucket, number, check = _part(group["payload"][int(own[0])].as_py())
    count, bucket, number = _grow(count), _grow(bucket), _grow(number)
    place = np.empty(len(bucket), np.int64)
    place[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))
    parts = np.flatnonzero(kinds == SUMS)
    lists = [_part(group["payload"][int(i)].as_py()) for i in parts[np.argsort(source[parts])]]
    each = np.concatenate([np.zeros(0, np.float32), *(_of_planes(x[0], np.float32) for x in lists)])
    if len(each) != len(bucket) or any(x[1] != check for x in lists):
        raise RuntimeError("the texts changed between two readings")
    value = each[place[number]]
    out = np.zeros((3, len(docs)))
    some = np.flatnonzero(count)
    if len(some):
        at = (np.cumsum(count) - count)[some]
        n = count[some]
        out[0, some] = np.add.reduceat(value.astype(np.float64), at) / n
        top = np.maximum.reduceat(value, at)
        out[1, some] = top
        text = np.repeat(np.arange(len(some)), n)
        where = np.flatnonzero(value == top[text])
        once = where[np.unique(text[where], return_index=True)[1]]
        value[once] = -np.inf
        out[2, some] = np.where(n > 1, np.maximum.reduceat(value, at), top)
    return pa.table({"id": pa.array(docs, pa.int64()), **{m: pa.array(x) for m, x in zip(MEASURES, out)}, "size": pa.array(np.log1p(count))})


def borders(texts: DataFrame, rows: int, buckets: int) -> np.ndarray:
    """buckets - 1 keys that deal the distinct words of a sample of texts evenly."""
    share = min(1.0, max(BORDER_TEXTS, 20 * buckets) / max(rows, 1))
    chosen = texts.where(F.pmod(F.xxhash64("txt"), F.lit(1 << 30)) < share * (1 << 30))
    words = chosen.select(F.explode(F.split(F.translate("txt", _UPPER, _LOWER), r"[\x09-\x0D\x20]+", -1)).alias("w")).where("w != ''").distinct()
    key = F.conv(F.rpad(F.hex(F.substring(F.col("w").cast("binary"), 1, KEY)), 2 * KEY, "0"), 16, 10).cast("long")
    found = words.agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)], 100 * buckets)).first()[0]
    return np.unique(np.array(found or [], np.uint64))


def measures(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, buckets: int | None = None) -> DataFrame:
    """(id, d, top, next, size) of every row of docs, by models of labelled (id, txt, label).
    Shuffle files go as soon as what they lead to is written."""
    conf, name = docs.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        return _measures(docs, labelled, id_col, text_col, buckets)
    finally:
        conf.set(name, before)


def _measures(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, buckets: int | None) -> DataFrame:
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("txt"))
    rows, volume = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("txt")), F.lit(0))).first()
    bounds = borders(own, rows, buckets or max(16, volume // BUCKET_TEXT))
    known = labelled.select(F.col("id").cast("long"), F.col("txt").cast("string"), "label").where("label in (0, 1)")
    lists = own.mapInArrow(_split(bounds, LIST), _PIECES).union(known.mapInArrow(_split(bounds, LIST, True), _PIECES))
    merged = materialize(lists.groupBy("dest").applyInArrow(_merge, _PIECES), "words")
    edges = materialize(merged.where(F.col("kind") == WORDS).select("dest", "payload").mapInArrow(_edges(bounds), _EDGES), "edges")
    sums = edges.where("h is not null and b >= 0").groupBy("h", "b").agg(*(F.sum(c).alias(c) for c in ("t", "o", "n")))
    ends = np.zeros(256)
    for r in edges.where("h is null").select("b", "n").union(sums.select("b", F.lit(1))).groupBy("b").agg(F.sum("n").alias("n")).collect():  # 256 rows at most
        ends[r["b"]] = r["n"]
    taken = np.maximum(ends - SHARED_DISCOUNTS[1], 0)
    single = (taken + (ends.sum() - taken.sum()) / 256) / ends.sum() if ends.sum() else np.full(256, 1 / 256)
    told = edges.where("b = -1").select("h", F.col("bucket").alias("dest")).join(sums, "h")
    added = merged.groupBy("dest").cogroup(told.groupBy("dest")).applyInArrow(_add(single), _PIECES)
    texts = own.mapInArrow(_split(bounds, TEXTS), _PIECES)
    return materialize(texts.union(added).groupBy("dest").applyInArrow(_score, "id long, d double, top double, next double, size double"), "measures")


def fit_logistic(rows: DataFrame, columns: tuple[str, ...], label: str, penalty: float = 0.02) -> np.ndarray | None:
    """Weights of the columns and an offset, of label 1, by Newton steps with a small penalty; None
    without both labels. Each step's sums are one aggregation."""
    first = rows.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1), *(f(c) for c in columns for f in (F.avg, F.stddev_pop))).first()
    if not first[0] or not first[1]:
        return None
    middle, scale = np.array(first[2::2], float), np.array(first[3::2], float)
    scale[scale < 1e-9] = 1.0
    z = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(columns, middle, scale)] + [F.lit(1.0)]
    k = len(z)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    w = np.zeros(k)
    for _ in range(40):
        dot = sum((x * float(v) for x, v in zip(z[1:], w[1:])), z[0] * float(w[0]))
        p = 1 / (1 + F.exp(-F.greatest(F.least(dot, F.lit(40.0)), F.lit(-40.0))))
        got = rows.select(*(x.alias(f"z{i}") for i, x in enumerate(z)), (F.col(label) - p).alias("g"), (p * (1 - p)).alias("h"))
        got = got.agg(*(F.sum(F.col("g") * F.col(f"z{i}")) for i in range(k)), *(F.sum(F.col("h") * F.col(f"z{i}") * F.col(f"z{j}")) for i, j in pairs)).first()
        grad, hess = np.array(got[:k]) - penalty * w, penalty * np.eye(k)
        for (i, j), v in zip(pairs, got[k:]):
            hess[i, j] += v
            hess[j, i] = hess[i, j]
        step = np.linalg.solve(hess, grad)
        w = w + step * min(1.0, 8 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    slope = w[:-1] / scale
    return np.append(slope, w[-1] - slope @ middle)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, fold: int = 0, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, from labels outside the held-out fold."""
    rows = with_labels(docs.select(id_col, text_col).where(~held_out(id_col, folds, fold)), labels, id_col, label_col, "__label")
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("txt"), "__label", held_out(id_col, folds, (fold + 1) % folds).alias("own"))
    sizes = {r["__label"]: r["count"] for r in rows.groupBy("__label").count().collect()}
    out = F.col("id").alias(id_col), F.coalesce(held_out("id", folds, fold), F.lit(False)).alias("held_out")
    if len(sizes) < 2:
        p = float(next(iter(sizes), 0.5))
        return docs.select(F.col(id_col).alias("id")).select(*out, F.lit(p).alias("score"), F.lit(int(p >= threshold)).alias("predicted"))
    found = measures(docs, rows.where("not own").withColumnRenamed("__label", "label"), id_col, text_col)
    seen = materialize(found.join(rows.where("own").select("id", F.col("__label").alias("label")).distinct(), "id").select(*MEASURES, "label"), "calibration")
    w = fit_logistic(seen, MEASURES, "label")
    w = np.array([1.0, 0, 0, 0, 0]) if w is None else w
    dot = sum((F.col(c) * float(v) for c, v in zip(MEASURES, w)), F.lit(float(w[-1])))
    scored = found.withColumn("score", 1 / (1 + F.exp(-dot)))
    return scored.select(*out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
