"""Benchmark decontamination by size-partitioned MinHash containment search.

Which documents hold at least percent / 100 of the k-word shingles of a benchmark
item? Items are partitioned by size into powers of two. For the partition of up
to S shingles every document, however long, is covered by windows of 2 S
consecutive shingles that begin every S: a passage of S shingles lies whole in
one of them, so the Jaccard similarity of item and window stays high although
that of item and document may be tiny. Each of `bands` MinHash values is a band of
one row: item and window are candidates if one value agrees. An item of more than EXACT shingles of
which only the required share is there, in the least favourable size, is found
with probability 1 - 0.81^bands (more than 0.9999 for 48). The partition of items up to EXACT
shingles has windows of one shingle: any n - need + 1 of an item's n shingles hold one that
every document with need of them has, so the least of its hashes are its values, and none is missed. Candidates are then
verified by exact shingle containment over the whole document.

Values of the windows are looked up in a table of fixed size (2^20 slots of one
byte, whatever the number of items) before they leave a task; what passes is
joined with the items' values in Spark. More items make that table let more
pass, never less.

Null and empty texts match nothing. An item or document of fewer than k words has
its whole word sequence as one shingle. Rows that repeat a document or item id, or have a null one, are compared
each by itself; of the rows of one (doc_id, item_id) the one with the largest containment, then
the largest item, is returned. Long texts are searched in one piece. Only the id and text columns are read. Empty tables give an
empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .textops import Words, grams, mix, shingle_sets, slices, tidy, utf8

_SLOTS = 1 << 20
_SMALL = 16
#: Items of so many shingles are found by their shingles themselves.
EXACT = 8
_EXACT_LEVEL = 63
_ITEM = "ref long, item long, n long, level int, toks array<long>, keys array<long>"
_HIT = "row long, doc long, keys array<long>, toks array<long>"


def _factors(bands: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _keys(values: np.ndarray, level: int, band: int) -> np.ndarray:
    return mix(values, (level << 20) + band + 1)


def _as_list(values: np.ndarray, bound: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(values.view(np.int64)))


def _items(k: int, bands: int, percent: int):
    factors = _factors(bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e in slices(batch.column(2)):
                toks, bound = shingle_sets(Words(*utf8(batch.column(2).slice(s, e - s))), k)
                n = np.diff(bound)
                level = np.ceil(np.log2(np.maximum(n, _SMALL) / _SMALL)).astype(np.int32)
                level[n <= EXACT] = _EXACT_LEVEL
                keys = [np.zeros(0, np.uint64)]
                for i in range(len(n)):
                    own = toks[bound[i] : bound[i + 1]]
                    if 0 < n[i] <= EXACT:
                        keys.append(_keys(own[: n[i] - (percent * n[i] + 99) // 100 + 1], _EXACT_LEVEL, 0))
                    elif n[i]:
                        least = (own[:, None] * factors).min(axis=0)
                        keys.append(np.concatenate([_keys(least[j : j + 1], int(level[i]), j) for j in range(bands)]))
                    else:
                        keys.append(np.zeros(0, np.uint64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), batch.column(1).slice(s, e - s), pa.array(n), pa.array(level), _as_list(toks, bound), _as_list(np.concatenate(keys), np.cumsum([len(x) for x in keys]))], names=["ref", "item", "n", "level", "toks", "keys"])

    return run


def _slot_table(values: DataFrame) -> np.ndarray:
    """For each slot (the low 20 bits) the next 8 bits of the one value in it, or 255 for
    several, 0 for none. At most 2^20 small rows come to the driver, however many values."""
    spread = values.select((F.col("v").bitwiseAND(_SLOTS - 1)).cast("int").alias("slot"), (F.shiftrightunsigned("v", 20) % 254 + 1).cast("int").alias("f"))
    rows = spread.groupBy("slot").agg(F.min("f").alias("lo"), F.max("f").alias("hi")).toArrow()
    table = np.zeros(_SLOTS, np.uint8)
    lo, hi = rows["lo"].to_numpy(), rows["hi"].to_numpy()
    table[rows["slot"].to_numpy()] = np.where(lo == hi, lo, 255)
    return table


def _may_be_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Indices of the values that the table may hold."""
    held = table[values & np.uint64(_SLOTS - 1)]
    at = np.flatnonzero(held)
    f = ((values[at] >> np.uint64(20)) % np.uint64(254) + np.uint64(1)).astype(np.uint8)
    return at[(held[at] == f) | (held[at] == 255)]


def _search(k: int, bands: int, levels: list[int], key_table, tok_table):
    factors = _factors(bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyt, tokt = key_table.value, tok_table.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for s, e in slices(batch.column(1), 1 << 19):
                words = Words(*utf8(batch.column(1).slice(s, e - s)))
                begun, row = row, row + e - s
                h = words.hashes()
                z, count = grams(h, words.bound, k)
                short = (words.count > 0) & (words.count < k)
                if short.any():  # their one shingle stands for them
                    z, bound = shingle_sets(words, k) if (~short & (words.count > 0)).sum() == 0 else _with_short(words, z, count, k)
                    count = np.diff(bound)
                if not len(z):
                    continue
                bound = np.concatenate([[0], np.cumsum(count)])
                segs = -(-count // _SMALL)  # segments of each text
                first = np.concatenate([[0], np.cumsum(segs)])
                within = np.arange(first[-1]) - np.repeat(first[:-1], segs)
                seg_at = np.repeat(bound[:-1], segs) + within * _SMALL
                found_doc, found_key = [], []
                if _EXACT_LEVEL in levels:
                    keys = _keys(z, _EXACT_LEVEL, 0)
                    hit = _may_be_in(keys, keyt)
                    found_doc.append(np.searchsorted(bound, hit, side="right") - 1)
                    found_key.append(keys[hit])
                steps = []
                for level in range(max((x for x in levels if x != _EXACT_LEVEL), default=-1) + 1):
                    n_seg = -(-segs // (1 << level))
                    begin = np.concatenate([[0], np.cumsum(n_seg)])
                    doc = np.repeat(np.arange(len(count)), n_seg)
                    above = np.repeat(begin[:-1], n_seg)
                    if level:
                        last = steps[-1][2]
                        at = np.repeat(last[:-1], n_seg) + 2 * (np.arange(begin[-1]) - above)
                    else:
                        at = None
                    alone = np.append(doc[1:] != doc[:-1], True)
                    steps.append((at, alone, begin, doc))
                for band in range(bands if steps else 0):
                    least = np.minimum.reduceat(z * factors[band], seg_at)
                    for level, (at, alone, _, doc) in enumerate(steps):
                        if level:
                            least = np.minimum.reduceat(least, at)
                        if level in levels:
                            window = least.copy()
                            np.minimum(window[:-1], least[1:], out=window[:-1], where=~alone[:-1])
                            keys = _keys(window, level, band)
                            hit = _may_be_in(keys, keyt)
                            if len(hit):
                                found_doc.append(doc[hit])
                                found_key.append(keys[hit])
                if not found_doc:
                    continue
                doc, key = np.concatenate(found_doc), np.concatenate(found_key)
                order = np.lexsort((key, doc))
                doc, key = doc[order], key[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
                doc, key = doc[new], key[new]
                which, per = np.unique(doc, return_counts=True)
                if not len(which):
                    continue
                toks = []
                for d in which:
                    own = np.unique(z[bound[d] : bound[d + 1]])
                    toks.append(own[_may_be_in(own, tokt)])
                yield pa.RecordBatch.from_arrays([pa.array(begun + which), batch.column(0).slice(s, e - s).take(pa.array(which)), _as_list(key, np.concatenate([[0], np.cumsum(per)])), _as_list(np.concatenate(toks), np.concatenate([[0], np.cumsum([len(t) for t in toks])]))], names=["row", "doc", "keys", "toks"])

    return run


def _with_short(words: Words, z: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle sequences with the single shingles of the short texts in their places."""
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    own = np.empty(len(short), np.uint64)
    for i, d in enumerate(short):
        part = Words(words.data[words.start[words.bound[d]] : words.end[words.bound[d + 1] - 1]], np.array([0, words.end[words.bound[d + 1] - 1] - words.start[words.bound[d]]]))
        own[i] = shingle_sets(part, k)[0][0]
    at = (np.cumsum(count) - count)[short]
    count = count.copy()
    count[short] = 1
    return np.insert(z, at, own), np.concatenate([[0], np.cumsum(count)])


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, percent: int = 80, bands: int = 48) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every document and item where
    the document holds percent / 100 or more of the item's distinct k-word shingles."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("txt"))
    ref = items.select(F.monotonically_increasing_id().alias("ref"), F.col(item_id).cast("long").alias("item"), F.col(item_text).cast("string").alias("txt"))
    ref = materialize(ref.mapInArrow(tidy(_items(k, bands, percent)), _ITEM).where("n > 0"), "items")
    levels = sorted(r[0] for r in ref.select("level").distinct().collect())  # powers of two: a few dozen at most
    if not levels:
        hits = spark.createDataFrame([], _HIT)
    else:
        key_table = spark.sparkContext.broadcast(_slot_table(ref.select(F.explode("keys").alias("v"))))
        tok_table = spark.sparkContext.broadcast(_slot_table(ref.select(F.explode("toks").alias("v"))))
        hits = materialize(own.mapInArrow(tidy(_search(k, bands, levels, key_table, tok_table)), _HIT), "hits")
    keys = ref.select("ref", F.explode("keys").alias("key"))
    pairs = hits.select("row", F.explode("keys").alias("key")).join(keys, "key").select("row", "ref").distinct()
    both = pairs.join(hits.select("row", "doc", F.col("toks").alias("have")), "row").join(ref.select("ref", "item", "n", "toks"), "ref")
    both = both.select("doc", "item", "n", F.size(F.array_intersect("toks", "have")).cast("long").alias("shared")).where(f"100 * shared >= {percent} * n")
    both = both.groupBy("doc", "item").agg(F.max(F.struct((F.col("shared") / F.col("n")).alias("containment"), "n", "shared")).alias("best"))
    return both.select(F.col("doc").alias(id_col), F.col("item").alias(item_id), F.col("best.n").alias("n_item"), F.col("best.shared").alias("n_shared"), F.col("best.containment").alias("containment"))
