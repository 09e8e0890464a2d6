"""BPE encoding and decoding through a table of distinct words.

1. Spark splits texts into words. Tasks gather blocks of about BLOCK_BYTES and send
   each block's distinct words, with the block's name, to buckets dealt by word hash.
2. A bucket is its part of the table of distinct words: every distinct word of the
   corpus is encoded once, and each block gets the ids back in the order of its list.
   A very frequent word is in each block's list once, so no key is hot.
3. Texts are split a second time, which is cheaper than moving them twice; a block's
   texts, as word numbers, meet its ids, which are joined to them by position.
4. The distinct ids of each block are joined with the fixed table from id to piece
   in Spark; texts are decoded from what the join returns.

A word is a maximal run of characters other than ASCII white space, cut as well
between an ASCII letter and one of . , ; : ! ? on either side. No token of a
tokenizer whose pre-tokenizer separates white space, letters and punctuation
reaches over such a cut, so the ids of a text are its words' ids one after another.

Null is the empty text: no tokens. A null doc_id stays null in its row and touches no
other. Repeated rows are results of their own. Long texts are a block of their own.
Columns other than those named are not read. An empty table gives an empty result.
docs is read twice and has to hold the same rows in the same order both times, as files
do; if a block's words differ between the two, the job fails instead of giving a wrong result."""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize
from .textops import byte_hashes, slices, tidy, tidy_group

BLOCK_BYTES, SLICE_BYTES = 16 << 20, 1 << 20
#: Bytes of text for one bucket of words, about.
BUCKET_TEXT = 128 << 20
#: Ids of texts that are decoded at a time, about.
DECODE_IDS = 200_000

#: Between words: white space, and the borders of letters and punctuation.
BORDERS = r"[\x09-\x0D\x20]+|(?<=[A-Za-z])(?=[.,;:!?])|(?<=[.,;:!?])(?=[A-Za-z])"

TEXTS, LIST, IDS = range(3)  # kinds of pieces
_PIECES = "dest long, source long, kind int, payload binary, docs array<long>"
_PLACED = "block long, token_id int, known int, docs array<long>, sizes array<int>, tokens array<int>"


def words_of(text: Column) -> Column:
    """The words of a text, in order, with blanks between them."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BORDERS, " ")


def _shrink(values: np.ndarray) -> bytes:
    """Whole numbers of 0 and more, compressed by bytes of like weight."""
    wide = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    planes = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return struct.pack("<BQ", planes, len(values)) + zstandard.compress(np.ascontiguousarray(wide[:, :planes].T).tobytes(), 3)


def _grow(data: bytes) -> np.ndarray:
    planes, n = struct.unpack_from("<BQ", data)
    out = np.zeros((n, 4), np.uint8)
    out[:, :planes] = np.frombuffer(zstandard.decompress(data[9:]), np.uint8).reshape(planes, n).T
    return out.view("<u4").ravel().astype(np.int64)


def _join(parts: list[bytes]) -> bytes:
    return struct.pack(f"<I{len(parts)}Q", len(parts), *map(len, parts)) + b"".join(parts)


def _part(data: bytes) -> list[bytes]:
    n = struct.unpack_from("<I", data)[0]
    sizes = struct.unpack_from(f"<{n}Q", data, 4)
    ends = np.cumsum((4 + 8 * n, *sizes)).tolist()
    return [data[s:e] for s, e in zip(ends[:-1], ends[1:])]


def _pieces(rows: list[tuple[int, int, int, bytes]], docs: list | None = None) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.table([*(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)), pa.array(docs or [None] * len(rows), pa.list_(pa.int64()))], names=["dest", "source", "kind", "payload", "docs"])


def _split(buckets: int, kind: int, block_bytes: int = BLOCK_BYTES):
    """Blocks of (id, words), of about block_bytes. LIST: parts of a block's list of distinct words, for buckets (dest under 0).
    TEXTS: the block's texts as word numbers, for the block. The words that are most frequent in
    the block have the smallest numbers; a list keeps their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray, list]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq
            block = (part << 24) + seq
            seq += 1
            coded = pa.concat_arrays([h[0] for h in held]).dictionary_encode()
            words, new = coded.dictionary, coded.indices.to_numpy()
            starts = np.cumsum([0] + [len(h[0]) for h in held])
            number = np.concatenate([new[h[1] + s] for h, s in zip(held, starts)])
            offs = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
            data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) and words.buffers()[2] else np.zeros(0, np.uint8)
            hashes = byte_hashes(data, offs[:-1], offs[1:])
            order = np.argsort(-np.bincount(number, minlength=len(words)), kind="stable")
            bucket = (hashes[order] % np.uint64(buckets)).astype(np.int64)
            check = np.array([len(words), len(number), np.bitwise_xor.reduce(hashes, initial=np.uint64(0)).view(np.int64)]).tobytes()
            if kind == TEXTS:
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                docs = [x for h in held for x in h[3]]
                yield from _pieces([(block, block, TEXTS, _join([_shrink(np.concatenate([h[2] for h in held])), _shrink(bucket), _shrink(rank[number]), check]))], [docs]).to_batches()
            else:
                raw = data.tobytes()
                listed = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[listed], np.arange(buckets + 1))
                b, n = offs[order[listed]].tolist(), offs[order[listed] + 1].tolist()
                for x in np.flatnonzero(np.diff(cut)).tolist():
                    own = b" ".join([raw[b[i] : n[i]] for i in range(cut[x], cut[x + 1])])
                    yield from _pieces([(-1 - x, block, LIST, _join([zstandard.compress(own, 3), check]))]).to_batches()
            held.clear()

        size = 0
        for batch in batches:
            for s, e in slices(batch.column(1), SLICE_BYTES):
                lists = pc.split_pattern(batch.column(1).slice(s, e - s).cast(pa.large_string()), " ")
                words = lists.flatten()
                some = pc.not_equal(words, "")
                sums = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
                coded = words.filter(some).dictionary_encode()
                held.append((coded.dictionary, coded.indices.to_numpy(), np.diff(sums[ends]), batch.column(0).slice(s, e - s).to_pylist()))
                size += int(pc.sum(pc.binary_length(batch.column(1).slice(s, e - s))).as_py() or 0)
                if size >= block_bytes:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return run


def _encode(tokenizer):
    """All blocks' lists of one bucket of words: the bucket's table of distinct words, each encoded
    once, and its ids for each block in the order of the block's list."""

    def run(group: pa.Table) -> pa.Table:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        bpe = Tokenizer.from_str(tokenizer.value)
        bpe.no_truncation()
        bpe.no_padding()
        number: dict[bytes, int] = {}
        lists, checks = [], []
        for payload in group["payload"]:
            packed, check = _part(payload.as_py())
            listed = zstandard.decompress(packed).split(b" ")
            lists.append(np.fromiter((number.setdefault(w, len(number)) for w in listed), np.int32, len(listed)))
            checks.append(check)
        distinct = list(number)
        del number
        sizes = np.zeros(len(distinct), np.int64)
        flat = []
        for i in range(0, len(distinct), 20_000):
            got = [x.ids for x in bpe.encode_batch_fast([w.decode() for w in distinct[i : i + 20_000]], add_special_tokens=False)]
            sizes[i : i + len(got)] = [len(x) for x in got]
            flat.append(np.fromiter((y for x in got for y in x), np.int32))
        del distinct
        ids, start = np.concatenate(flat), np.concatenate([[0], np.cumsum(sizes)])
        bucket = group["dest"][0].as_py()
        out = []
        for source, x, check in zip(group["source"].to_pylist(), lists, checks):
            n = sizes[x]
            at = np.repeat(start[x] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((source, bucket, IDS, _join([_shrink(n), _shrink(ids[at]), check])))
        return _pieces(out)

    return run


def _place(group: pa.Table) -> pa.Table:
    """A block's distinct ids, one a row, and after them its texts with the ids of their words in place."""
    kinds, source = group["kind"].to_numpy(), group["source"].to_numpy()
    texts = np.flatnonzero(kinds == TEXTS)
    if len(texts) != 1:
        raise RuntimeError("the texts changed between two readings")
    docs = group["docs"][int(texts[0])].as_py()
    count, bucket, number, check = _part(group["payload"][int(texts[0])].as_py())
    count, bucket, number = _grow(count), _grow(bucket), _grow(number)
    where = np.argsort(bucket, kind="stable")  # the place in all lists, one after another, of each
    place = np.empty(len(where), np.int64)
    place[where] = np.arange(len(where))
    sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    parts = np.flatnonzero(kinds == IDS)
    for i in parts[np.argsort(-source[parts], kind="stable")]:
        x = _part(group["payload"][int(i)].as_py())
        if x[2] != check:
            raise RuntimeError("the texts changed between two readings")
        sizes.append(_grow(x[0]))
        ids.append(_grow(x[1]).astype(np.int32))
    size, ids = np.concatenate(sizes), np.concatenate(ids)
    if len(size) != len(bucket):
        raise RuntimeError("the texts changed between two readings")
    start = np.concatenate([[0], np.cumsum(size)])
    bound = np.concatenate([[0], np.cumsum(count)])
    tokens = np.concatenate([[0], np.cumsum(size[place[number]])])[bound]  # tokens before each text
    known = np.unique(ids)
    block = group["dest"][0].as_py()
    rows: list[tuple] = []
    s = 0
    while s < len(docs):
        e = max(s + 1, int(np.searchsorted(tokens, tokens[s] + DECODE_IDS, side="right")) - 1)
        x = place[number[bound[s] : bound[e]]]
        m = size[x]
        rows.append((docs[s:e], np.diff(tokens[s : e + 1]), ids[np.repeat(start[x] - (np.cumsum(m) - m), m) + np.arange(m.sum())]))
        s = e
    none = [None] * len(known)
    return pa.table(
        [
            pa.array([block] * (len(known) + len(rows)), pa.int64()),
            pa.array([*known.tolist(), *[None] * len(rows)], pa.int32()),
            pa.array([*none, *[len(known)] * len(rows)], pa.int32()),
            *(pa.array([*none, *[r[i] for r in rows]], pa.list_(t)) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))),
        ],
        names=["block", "token_id", "known", "docs", "sizes", "tokens"],
    )


def _decode(keep_ids: bool, keep_text: bool):
    """Results of texts, whose rows follow those of their block's ids, in order, and joined pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, pieces, table = None, [], [], None
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            for i, (own, token, known) in enumerate(zip(cols["block"].to_pylist(), cols["token_id"].to_pylist(), cols["known"].to_pylist())):
                if own != block:
                    block, ids, pieces, table = own, [], [], None
                if token is not None:
                    ids.append(token)
                    pieces.append(cols["piece"][i].as_py() or "")
                    continue
                if len(ids) != known:
                    raise RuntimeError("a block's pieces are not before its texts")
                if table is None:
                    table = np.array(ids, np.int32), pa.array(pieces, pa.large_string()), pa.array(map(str, ids), pa.large_string())
                tokens, sizes = cols["tokens"][i].values, cols["sizes"][i].values.to_numpy()
                place = pa.array(np.searchsorted(table[0], tokens.to_numpy()))
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int64())
                text, decimals = (pc.binary_join(pa.LargeListArray.from_arrays(ends, x.take(place)), pa.scalar(" ", pa.large_string())) for x in table[1:])
                sha = lambda column: pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column], pa.string())
                out = {"id": pa.array(cols["docs"][i].as_py(), pa.int64()), "n_tokens": pa.array(sizes.astype(np.int64)), "ids_sha256": sha(decimals), "decoded_sha256": sha(text)}
                if keep_ids:
                    out["ids"] = pa.ListArray.from_arrays(ends.cast(pa.int32()), tokens)
                if keep_text:
                    out["decoded"] = text.cast(pa.string())
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def load_vocabulary(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def piece_table(spark: SparkSession, vocabulary: str) -> DataFrame:
    """(token_id, piece): the fixed table that decoding joins with."""
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_str(vocabulary)
    return spark.createDataFrame([(i, bpe.id_to_token(i)) for i in range(bpe.get_vocab_size(with_added_tokens=True))], "token_id int, piece string")


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with the text of its ids: positions are exploded, joined with the pieces (a
    fixed vocabulary, so that side is small for any input) and put together in order.

    Null or empty ids decode to the empty text; ids outside the vocabulary are left out. A column
    of the name out_col is replaced, all others stay."""
    spark = encoded.sparkSession
    rest = [c for c in encoded.columns if c != out_col]
    keyed = materialize(encoded.select(F.monotonically_increasing_id().alias("row"), F.struct(*rest).alias("own"), F.col(ids_col).alias("ids")), "ids")
    long = keyed.select("row", F.posexplode("ids").alias("pos", "token_id"))
    pieces = long.join(F.broadcast(piece_table(spark, vocabulary)), "token_id")
    text = pieces.groupBy("row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), " ").alias("text"))
    return keyed.join(text, "row", "left").select(*(F.col("own")[c].alias(c) for c in rest), F.coalesce("text", F.lit("")).alias(out_col))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, keep_ids: bool = False, keep_text: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids][, decoded]) of every row of docs. block_bytes: of text that a task holds at a
    time, about; smaller blocks repeat more words in their lists."""
    spark = docs.sparkSession
    vocabulary = vocabulary or load_vocabulary()
    tokenizer = spark.sparkContext.broadcast(vocabulary)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("txt"))
    volume = own.agg(F.sum(F.octet_length("txt"))).first()[0] or 0
    buckets = max(16, volume // BUCKET_TEXT)
    split = own.select("id", words_of(F.col("txt")).alias("words"))
    ids = split.mapInArrow(tidy(_split(buckets, LIST, block_bytes)), _PIECES).groupBy("dest").applyInArrow(tidy_group(_encode(tokenizer)), _PIECES)
    texts = split.mapInArrow(tidy(_split(buckets, TEXTS, block_bytes)), _PIECES)
    placed = texts.unionByName(ids).groupBy("dest").applyInArrow(tidy_group(_place), _PLACED)
    known = placed.join(F.broadcast(piece_table(spark, vocabulary)), "token_id", "left")
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    return known.mapInArrow(tidy(_decode(keep_ids, keep_text)), schema).withColumnRenamed("id", id_col)
